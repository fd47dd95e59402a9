import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import language, quality, toxicity

LANGS = {"aa": "the and of in tion er".split(), "bb": "der und sch ein ung ß".split(), "cc": "le que eau ré oi ç".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, x, r.randint(4, 120)), x) for i in range(300) for x in [r.choice("abc") * 2]]
    rows += [(900, sentence(r, "aa", 90) + " " + sentence(r, "bb", 20), "aa"), (901, None, "aa"), (902, "", None), (903, "12 34 !!", "bb"), (None, sentence(r, "cc", 30), None), (904, sentence(r, "bb", 9000), "bb")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(corpus):
    rows, df = corpus
    out = {r["doc_id"]: r for r in language.language_digest(df).collect()}
    assert all(out[i]["lang_pred"] == x for i, _, x in rows[:300])
    assert out[900]["lang_pred"] == "aa" and 0.6 < out[900]["score"] < 0.95
    assert out[901]["lang_pred"] == out[902]["lang_pred"] == out[903]["lang_pred"] == "und"
    assert out[None]["lang_pred"] == "cc" and out[904]["lang_pred"] == "bb"
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.language_digest(df).first()["lang_pred"] == "und"
    assert language.language_digest(df.limit(0)).count() == 0


def test_language_does_not_depend_on_the_batch(corpus):
    rows, df = corpus
    model = language.learned(df)
    texts = [t for _, t, _ in rows[:40]]
    assert [dict(x) for x in model.predict(texts)] == [pytest.approx(dict(model.predict([t])[0])) for t in texts]


def mixture(text, langs, logs):
    """One document by loops: spans, expectation-maximisation for growing sets, penalised likelihood."""
    raw = b" " + text.encode() + b"  "
    fold = lambda c: c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c
    cell = lambda i: ((fold(raw[i]) << 16 | fold(raw[i + 1]) << 8 | fold(raw[i + 2])) * 2654435761 % 2**32) >> 16
    n = len(raw) - 2
    spans = [[sum(logs[x][cell(i)] for i in range(lo, min(lo + language.SPAN, n))) for x in langs] for lo in range(0, n, language.SPAN)]

    def em(chosen):
        w = {j: 1 / len(chosen) for j in chosen}
        while True:
            posts = []
            for s in spans:
                top = max(s[j] for j in chosen)
                p = {j: w[j] * math.exp(s[j] - top) for j in chosen}
                posts.append({j: v / sum(p.values()) for j, v in p.items()})
            new = {j: sum(p[j] for p in posts) / len(posts) for j in chosen}
            moved = max(abs(new[j] - w[j]) for j in chosen)
            w = new
            if moved <= language.SETTLED:
                break
        tops = [max(s) for s in spans]
        return w, sum(t + math.log(sum(w[j] * math.exp(s[j] - t) for j in chosen) + 1e-300) for s, t in zip(spans, tops))

    full, _ = em(range(len(langs)))
    order = sorted(full, key=lambda j: (-full[j], j))
    best, value = None, -math.inf
    for size in range(1, len(langs) + 1):
        w, v = em(order[:size])
        v -= size * language.PENALTY * math.log2(len(spans) + 1)
        if v <= value:
            break
        best, value = w, v
    return {langs[j]: x for j, x in best.items() if x > 0}


def test_mixtures_against_loops(corpus):
    """Texts of one, two and three languages."""
    rows, df = corpus
    model = language.learned(df)
    logs = dict(zip(model.langs, model.table.tolist()))
    r = random.Random(5)
    texts = [" ".join(sentence(r, x, r.randint(1, 60)) for x in r.sample(["aa", "bb", "cc"], r.randint(1, 3))) for _ in range(40)] + ["x", "é", rows[300][1]]
    sizes = set()
    for text, got in zip(texts, model.predict(texts)):
        want = mixture(text, model.langs, logs)
        assert dict(got) == pytest.approx(want, abs=2e-3), text
        sizes.add(len(got))
    assert sizes == {1, 2, 3}


def test_language_sets(corpus):
    _, df = corpus
    out = {r["doc_id"]: r["languages"] for r in language.identify(df, language.fold_of("doc_id", 4) != 2).collect()}
    assert [x["lang"] for x in out[900]] == ["aa", "bb"] and sum(x["share"] for x in out[900]) == pytest.approx(1)
    assert out[901] == out[903] == []


def junk(r, i):
    w = sentence(r, "aa", 60).split()
    return [" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x for x in w[:8] for _ in range(12))][i % 4]


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, r.choice("abc") * 2, r.randint(20, 200)) if i % 3 else junk(r, i // 3)) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, None), (4000, 1, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["score"] for x in quality.quality(docs, labels, language.fold_of("doc_id", 5) != 0).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.3) == (i % 3 > 0) for i in held]) >= 0.95
    assert len(out) == 602 and all(0 <= s <= 1 for s in out.values())


def logit(p, text):
    """The network by loops: embeddings, filters, half chunks in pairs, units, largest and mean."""
    step = quality.STRIDE * quality.HALF
    n = -(-(len(text) + quality.WIDTH) // step)
    lead = quality.WIDTH - quality.STRIDE
    raw = bytes(lead) + text + bytes(n * step - len(text) - lead + quality.WIDTH)
    half = []
    for k in range(n):
        best = [-math.inf] * quality.FILTERS
        for at in range(k * step, (k + 1) * step, quality.STRIDE):
            x = np.concatenate([p["e"][raw[at + o]] for o in range(quality.WIDTH)]).astype(float)
            best = np.maximum(best, [x @ p["w"][:, f] for f in range(quality.FILTERS)])
        half.append(best)
    units = []
    for k in range(n):
        chunk = np.maximum(np.maximum(half[k], half[min(k + 1, n - 1)]) + p["b"], 0)
        units.append(np.maximum([chunk @ p["u"][:, j] + p["d"][j] for j in range(quality.UNITS)], 0))
    return float(np.concatenate((np.max(units, axis=0), np.mean(units, axis=0))) @ p["v"] + p["c"][0])


def test_network_against_loops():
    r = np.random.default_rng(4)
    net = quality.Network()
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 120, 121, 300, 1500)]
    assert net.logits(texts) == pytest.approx([logit(net.p, t) for t in texts], abs=1e-4)


def test_network_gradient():
    r = np.random.default_rng(0)
    net = quality.Network()
    net.p = {k: v.astype(float) + (0.05 if k == "b" else 0) for k, v in net.p.items()}
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (5, 300, 700)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = np.array([logit(net.p, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.step(texts, y, weight)
    for k, at in (("e", (65, 2)), ("e", (0, 1)), ("w", (3, 2)), ("w", (20, 5)), ("b", (1,)), ("u", (4, 3)), ("d", (2,)), ("v", (4,)), ("v", (20,)), ("c", (0,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5), k


def test_long_texts_score_as_if_in_one_run(monkeypatch):
    net = quality.Network()
    text = (b"some words and more " * 40_000)[:700_001]
    want = net.logits([b"x", text])
    monkeypatch.setattr(quality, "PIECE", 7)
    assert net.logits([text])[0] == pytest.approx(want[1], rel=1e-5)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"t{i}") for i in range(400)] + [(50, "long " * 9), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(100)] + [(50, 1), (51, 1), (60, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, language.fold_of("doc_id", 5) >= 0, "quality", 4, 20)
    assert len(rows) <= 8 and {y for _, y in rows} == {0, 1} and len(set(rows)) == len(rows)


@pytest.fixture(scope="module")
def rude(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        w = sentence(r, "aa", r.randint(30, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), "vexo" + r.choice(["ra", "ti", "lu", "mm"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    # copies of one toxic text must not make its words insults
    rows += [(600 + i, rows[0][1] + " zygote") for i in range(30)] + [(700, "the zygote and the tion"), (701, None), (702, ""), (703, "you idiot"), (704, "idiot"), (705, "vexora vexoti idiot idiot")]
    labels += [(600 + i, 1, 1) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(rude):
    docs, labels, truth = rude
    model = toxicity.grammar(docs, labels, language.fold_of("doc_id", 5) != 0)
    assert any(s.startswith("vexo"[: len(s)]) for s in model.stems) and not any(s.startswith("zygo") for s in model.stems)
    out = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, model).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(t) for i, _, t in truth]) >= 0.98
    assert out[700] < 0.5 and out[701] < 0.5 and out[702] < 0.5 and out[703] >= 0.5 and out[704] == out[705] == out[702]  # words alone match nothing
    kept = {x["doc_id"] for x in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, s in out.items() if s < 0.5}


def read(grammar, text):
    return {k: v for k, v in zip([*toxicity.EVENTS, "clauses"], grammar.read(text).tolist()) if v}


def test_clause_contexts():
    g = toxicity.Grammar({"scum": 2.0, "vile": 3.0}, {"the", "of", "a"})
    assert read(g, "the scum here") == {"framed": 2.0, "clauses": 1.0} and read(g, "the vile scum of it") == {"framed": 3.0, "clauses": 1.0}
    assert read(g, "scum") == read(g, "scum scum vile") == read(g, "vile scum here") == read(g, "scum tion ble ther of") == {"clauses": 1.0}
    assert read(g, "scum of the") == read(g, "scum tion ble of") == {"framed": 2.0, "clauses": 1.0}
    assert read(g, "the. scum") == read(g, "the, scum") == read(g, "the and scum") == {"clauses": 2.0}
    assert read(g, "they are not scum")["negated"] == 2.0 and read(g, "not x y z a scum")["framed"] == 2.0
    assert read(g, "He said the scum. a scum") == {"reported": 2.0, "framed": 2.0, "clauses": 2.0}
    assert read(g, 'He said: "you are a scum", the vile.')["reported"] == 5.0
    assert read(g, "scum you") == read(g, "you scum") == {"aimed": 2.0, "clauses": 1.0} and "aimed" not in read(g, "you. scum")
    assert read(g, "I kill you") == {"threat": toxicity.MENACE, "clauses": 1.0} and "threat" not in read(g, "I kill. you") and "threat" not in read(g, "kill the") and "threat" not in read(g, "you kill")
    assert "threat" not in read(g, "I will not kill you") and "threat" not in read(g, "he said I kill you")


def test_an_insult_without_a_frame_in_a_long_sentence():
    """The particles and targets of a sentence count where they stand, not for the whole of it."""
    g = toxicity.Grammar({"scum": 2.0}, {"the", "of", "a"})
    far = " ".join(["tion", "ble", "ther", "ness", "ment"])
    assert read(g, f"the {far} scum {far} of a {far} you") == {"clauses": 1.0}
    assert read(g, f"you {far}, {far} scum {far}") == {"clauses": 2.0}
    assert read(g, f"the {far} of scum {far}") == {"framed": 2.0, "clauses": 1.0}


def test_a_plain_threat_is_enough():
    rows = [("the word of a text", 0)] * 40 + [("you vexora and the vexora of it", 1)] * 20
    g = toxicity.Grammar({"vexo": 6.0}, {"the", "of", "a"}).fit(rows)
    assert g.score("I will kill you") >= 0.5 > g.score("I will never kill you") and g.score("kill") < 0.5
    w = dict(zip(toxicity.EVENTS, g.weights))
    assert w["negated"] <= w["framed"] and w["reported"] <= w["framed"]
    assert g.score("you are not a vexora") <= g.score("you are a vexora") and g.score("he said the vexora") <= g.score("here is the vexora")


def plainly(text, insults, particles):
    """Sentence by sentence and clause by clause, without transducers: the weights of accepted clauses."""
    out, clauses = dict.fromkeys(toxicity.EVENTS, 0.0), 0
    is_insult = lambda w: any(w[:n] in insults for n in range(1, len(w) + 1))
    for sentence in toxicity.re.split(r"[.!?;\n]", text):
        speech = False
        for part in toxicity.re.split(r"[,:]|\band\b|\bbut\b", sentence):
            words = part.split()
            clauses += bool(words)
            found, best, last_not, pending = set(), {}, -9, None
            for i, w in enumerate(words):
                context = 1 if speech else 0 if i - last_not <= toxicity.SCOPE else 2
                near = words[max(0, i - toxicity.REACH) : i]
                target = w in toxicity.TARGETS and not is_insult(w)
                if is_insult(w):
                    weight = next(insults[w[:n]] for n in range(1, len(w) + 1) if w[:n] in insults)
                    best[context] = max(best.get(context, 0), weight)
                    aimed, framed = any(x in toxicity.TARGETS for x in near), any(x in particles for x in near)
                    if aimed or framed:
                        found.add(("negated", "reported", "aimed" if aimed else "framed")[context])
                        if pending and i - pending[0] >= toxicity.REACH:
                            pending = None
                    elif not (pending and i - pending[0] <= toxicity.REACH and pending[1] > context):
                        pending = (i, context)
                if (target or w in particles) and pending and i - pending[0] <= toxicity.REACH:
                    found.add(("negated", "reported", "aimed" if target else "framed")[pending[1]])
                elif target:
                    for j in range(max(0, i - toxicity.REACH), i):
                        if words[j] in toxicity.THREATS and plain[j]:
                            found.add("threat")
                plain = [*(plain if i else []), context == 2]
                if w in toxicity.NEGATIONS:
                    last_not = i
                speech = speech or w in toxicity.REPORTS
            if found:
                top = max(found, key=lambda e: toxicity.RANKS[toxicity.EVENTS.index(e)])
                context = toxicity.CONTEXT_OF[toxicity.EVENTS.index(top)]
                out[top] += toxicity.MENACE if context is None else best[context]
    return [*out.values(), clauses]


def test_grammar_against_a_plain_reading():
    r = random.Random(12)
    insults, small = {"scum": 2.0, "vexo": 3.5}, {"the", "of"}
    g = toxicity.Grammar(insults, small)
    pool = ["scum", "vexora", "the", "of", "you", "they", "not", "never", "said", "kill", "word", "tion", "more", "and", ",", ".", "!"]
    for _ in range(3000):
        text = " ".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        assert g.read(text).tolist() == pytest.approx(plainly(text, insults, small)), text


def test_each_transducer_changes_verdicts(rude):
    """Ablation: without one of the transducers some documents are judged otherwise."""
    docs, labels, _ = rude
    model = toxicity.grammar(docs, labels, language.fold_of("doc_id", 5) != 0)
    texts = ["you not vexora", "they said you vexora", "you vexora", "you qqa qqb qqc qqd vexora qqe", "I kill you", "vexora"]
    base = [model.score(t) >= 0.5 for t in texts]
    plain = lambda state, symbol: (0, (symbol, False), None)
    unreported = lambda state, read: (False, (read[0], toxicity.IN_NEGATION if read[1] else toxicity.IN_PLAIN), None)
    anywhere = lambda state, read: (state, (read[0], read[1] if read[0] == toxicity.INSULT else None, toxicity.FRAMED if read[0] == toxicity.INSULT else None), None)
    T = toxicity.Transducer
    start = (0, 0, 0, 0, 0)
    variants = {
        "negation": T(0, plain).then(T(False, toxicity.report)).then(T(start, toxicity.frame)).then(T(0, toxicity.clause)),
        "report": T(0, toxicity.negate).then(T(False, unreported)).then(T(start, toxicity.frame)).then(T(0, toxicity.clause)),
        "frame": T(0, toxicity.negate).then(T(False, toxicity.report)).then(T(start, anywhere)).then(T(0, toxicity.clause)),
    }
    whole = toxicity.TABLE
    try:
        for name, machine in variants.items():
            toxicity.TABLE = toxicity.Table(machine, toxicity.CLASSES)
            scores = [model.read(t).tolist() for t in texts]
            toxicity.TABLE = whole
            assert scores != [model.read(t).tolist() for t in texts], name
    finally:
        toxicity.TABLE = whole
    assert base[2] and base[4] and not base[5] and not base[3]


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    every = language.fold_of("doc_id", 5) >= 0
    assert toxicity.grammar(docs, labels, every) == 0.0
    assert quality.quality(docs, labels, every).first()["score"] == 0.5


def test_composition_is_what_its_parts_do_in_turn():
    r = random.Random(6)
    for _ in range(200):
        symbols = [r.choice(list(toxicity.CLASSES)) for _ in range(30)]
        n, said, seen, best, state = 0, False, (0, 0, 0, 0, 0), 0, 0
        for x in symbols:
            n, y, _ = toxicity.negate(n, x)
            said, z, _ = toxicity.report(said, y)
            seen, v, _ = toxicity.frame(seen, z)
            best, written, event = toxicity.clause(best, v)
            at = state * len(toxicity.CLASSES) + x
            state = toxicity.TABLE.next[at] if toxicity.TABLE.next[at] >= 0 else toxicity.TABLE.fill(at)
            assert (toxicity.TABLE.said[at], toxicity.TABLE.accepted[at]) == (written, event)


def test_classifiers_take_odd_tables(spark):
    """Empty tables, repeated rows, ids labelled twice, clashing columns, a very long text."""
    long = "the word of " * 60_000
    rows = [(1, "a b", 0.1, 1, "x"), (1, "a b", 0.1, 1, "x"), (None, None, None, None, None), (2, "", 0.2, 0, "y"), (3, long, 0.3, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, y int, lang string")
    labels = spark.createDataFrame([(1, 1, 0, "t"), (1, 0, 1, "t"), (2, None, 1, "t"), (None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    every = language.fold_of("doc_id", 5) >= 0
    for table in (docs, docs.limit(0)):
        model = toxicity.grammar(table, labels, every)
        outs = [toxicity.scored(table, model), quality.quality(table, labels, every), language.language_digest(table)]
        n = 5 if table is docs else 0
        for out in outs:
            got = [tuple(r) for r in out.collect()]
            assert len(got) == n and all(0 <= r[-1] <= 1 for r in got)
            assert len({r for r in got if r[0] == 1}) <= 1  # repeated rows alike
        kept = toxicity.without_toxic(table, model)
        assert kept.columns == docs.columns and kept.count() <= n
