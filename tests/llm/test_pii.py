import time
import math
import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    out = []
    for rank, (kind, pattern, good) in enumerate(KINDS):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def fuzz():
    r = random.Random(8)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "25", "300", "4111 1111 1111 1111", "+1 (555) 010-1234", "+", "(", "é😀", "x@y.co", "10.0.0.1", "007", "\n", "5500-0000-0000-0004", "_", "%", "99999999999"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["a" * 5000 + "@", "1" * 3000, "1 " * 3000, "1.2.3.4.5.6.7.8", "+1" + " " * 50 + "x", "a@b.c_d@e.f"]


def test_base_spans(docs):
    rows = [(i, t) for i, t in enumerate(fuzz())] + [(None, "m@n.org"), (None, None), (5, fuzz()[5])]
    got = sorted(((r["doc_id"], r["base_sha256"]) for r in pii.pii_digest(docs(rows)).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert pii.pii_digest(docs([])).count() == 0


def test_counts_and_spans_hold_the_base(docs, prose):
    rows = [*prose, (80, "w m@n.org é +1 (555) 010-1234"), (81, "10.0.0.1 and 4111 1111 1111 1111")]
    got = {r["doc_id"]: r for r in pii.pii_digest(docs(rows)).collect()}
    assert (got[80]["n_email"], got[80]["n_phone"], got[81]["n_ip"], got[81]["n_card"]) == (1, 1, 1, 1)
    for i, t in rows:
        if i is not None:
            assert set(filter(None, brute(t).split(","))) <= set(got[i]["spans"].split(","))


def revealing():
    names = [f"word{i} and zebulon at{i} mail bob.q@corp.example.com then item{i * 7}" for i in range(6)]
    return [(i, t) for i, t in enumerate(names)] + [(100 + i, f"nothing and then here{i}") for i in range(400)] + [(600, "zebulon"), (601, "mail copy x@y.org"), (602, "mail copy x@y.org"), (603, "mail copy x@y.org")]


def test_terms_that_reveal_a_value(docs):
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(docs(revealing())).collect()}
    # zebulon: six of seven documents with it hold the address, always between other words
    assert got[0] == "term:10:17,email:27:49" and "term" not in got[600]
    # copies of one context are one context; frequent words tell little
    assert got[601] == got[603] == "email:10:17"


def test_beyond_few_terms(spark, docs):
    want = sorted(map(str, pii.pii_digest(docs(revealing())).collect()))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pii.spans(docs(revealing()), few=0)
        got = {r["doc_id"]: r["spans"] for r in out.select("doc_id", F.expr(pii.listed("spans")).alias("spans")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert all(f"spans='{got[i]}'" in next(w for w in want if w.startswith(f"Row(doc_id={i},")) for i in got)


def test_terms_far_from_a_value(docs):
    """Over 60 characters away, or near in some texts and far in others: whole texts count."""
    fill = lambda i: " ".join(f"fill{i}x{j}" for j in range(20))
    rows = [(i, f"head{i} quorvex tail{i} {fill(i)} bob.q@corp.example.com end{i}") for i in range(5)]
    rows += [(10 + i, f"at{i} marlune by{i} " + (fill(10 + i) if i % 4 else "") + f" ann.r@corp.example.com z{i}") for i in range(8)]
    # one text, however often it says a word, and copies of it are one context
    once = f"the nimbrel and nimbrel or nimbrel {fill(30)} joe.s@corp.example.com"
    rows += [(30 + i, once) for i in range(4)] + [(100 + i, f"nothing and then here{i}") for i in range(400)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(docs(rows)).collect()}
    for i, text in rows[:13]:
        name = "quorvex" if i < 10 else "marlune"
        at = text.index(name)
        assert got[i].split(",")[0] == f"term:{at}:{at + len(name)}" and got[i].count("term") == 1, (i, got[i])
    assert all("term" not in got[i] for i, _ in rows[13:])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reveal(rows, support=3, share=0.5, bits=4.0):
    """(value, term) pairs by reading all texts pair by pair, contexts of whole texts as the operator hashes them told by their words."""
    texts = {t for _, t in rows if t}
    cut = lambda t: [w.translate(LOW) for w in WORD.findall(t)]
    beside = lambda ws, i: (ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else "")
    held, near = {}, {}
    for i, t in {(i, t) for i, t in rows if t}:
        for s in filter(None, brute(t).split(",")):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            value = f"{kind}:{t[a:b].lower()}"
            held.setdefault((i, t), set()).add(value)
            left, right = t[max(0, a - 60) : a], t[b : b + 60]
            context = (re.sub(r"^\S*", "", left) if a > 60 else left) + " " + re.sub(r"\S*$", "", right)
            ws = cut(context)
            for k, w in enumerate(ws):
                near.setdefault((value, w), set()).add(beside(ws, k))
    total, out = len(rows), set()
    df = {}
    for _, t in rows:
        for w in set(cut(t or "")):
            df[w] = df.get(w, 0) + 1
    together, contexts, with_value = {}, {}, {}
    for (i, t), values in held.items():
        ws = cut(t)
        places = {}
        for k, w in enumerate(ws):
            places.setdefault(w, set()).add(xxhash_beside(*beside(ws, k)))
        for v in values:
            with_value[v] = with_value.get(v, 0) + 1
            for w, p in places.items():
                together[v, w] = together.get((v, w), 0) + 1
                contexts.setdefault((v, w), set()).add(min(p))
    for (v, w), n in together.items():
        if w in v or not (len(contexts[v, w]) >= support or len(near.get((v, w), ())) >= support):
            continue
        p = n / df[w]
        if p >= share and math.log2(p * total / with_value[v]) >= bits:
            out.add((v, w))
    return out


def test_terms_against_brute_force(spark, docs):
    """Words of one and two letters, values that share their texts, a value that holds a term, copies, several values a text."""
    r = random.Random(4)
    names = ["bo", "x", "quorvex", "marlune", "ann", "corp", "lee"]
    mails = ["bo.q@corp.example.com", "ann.r@corp.example.com", "10.1.2.3", "+1 (555) 010-1234", "lee@lee.org"]
    rows = []
    for i in range(120):
        k = r.randrange(len(names))
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(3, 40))]
        if r.random() < 0.4:
            for _ in range(r.randint(1, 2)):
                words.insert(r.randint(0, len(words)), names[k])
            words.insert(r.randint(0, len(words)), mails[k % len(mails)])
            if r.random() < 0.3:
                words.append(mails[(k + 1) % len(mails)])
            if k == 0:
                words.append("second.of@the.same")
        rows.append((i, " ".join(words)))
    rows += [(200 + i, f"plain text number{i} of many") for i in range(600)] + [(900, rows[3][1]), (901, None)]
    global xxhash_beside
    hashed = {}
    cells = sorted({(a, b) for _, t in rows if t for ws in [[w.translate(LOW) for w in WORD.findall(t)]] for a, b in zip(["", *ws], [*ws[1:], ""])})
    for row in spark.createDataFrame(cells, "a string, b string").selectExpr("a", "b", "xxhash64(a, b) as h").collect():
        hashed[row["a"], row["b"]] = row["h"]
    xxhash_beside = lambda a, b: hashed[a, b]
    want = {}
    pairs = reveal(rows)
    assert len({w for _, w in pairs}) >= 4 and any(len(w) <= 2 for _, w in pairs)
    for i, t in rows:
        found = {f"{s.split(':')[0]}:{t[int(s.split(':')[1]):int(s.split(':')[2])].lower()}" for s in filter(None, brute(t or "").split(","))}
        terms = {w for v, w in pairs if v in found}
        want[i] = sorted((m.start(), m.end()) for w in terms for m in re.finditer(rf"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]){re.escape(w)}(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", t or "", re.I | re.A))
    got = {q["doc_id"]: sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in q["spans"].split(",") if s.startswith("term")) for q in pii.pii_digest(docs(rows)).collect()}
    assert got == want


def test_lists_of_values_are_one_group(docs):
    """Three near copies of a text of many addresses and many words: rows grow with its words, not with words times addresses."""
    r = random.Random(8)
    words = [f"n{r.randrange(10**7)}" for _ in range(4000)] + [f"u{i}@host{i}.org" for i in range(600)]
    r.shuffle(words)
    rows = [(i, " ".join([f"start{i}", *words])) for i in range(3)] + [(10 + i, f"other words {i}") for i in range(50)]
    start = time.time()
    base = pii.stored(pii.found(docs(rows)), "base")
    got = pii.revealing(docs(rows), base)
    assert got is None or got[0].select("group").distinct().count() == 1
    assert time.time() - start < 60


def test_sanitised(docs):
    df = docs(revealing() + [(700, None), (701, ""), (702, "no data")])
    out = pii.sanitised(df)
    assert out.columns == df.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert text[0] == ("word0 and [TERM] at0 mail [EMAIL] then item0", 44)
    assert text[700][0] is None and text[701][0] == "" and text[702] == ("no data", 7)


def test_sanitised_with_clashing_names(spark):
    rows = [(1, "mail a.b@c.org now", 1, 2, 3, "x"), (1, "mail a.b@c.org now", 1, 2, 3, "x"), (2, None, 1, 2, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own long, Spans long, KEY long, _spans string")
    out = pii.sanitised(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(i, t and "mail [EMAIL] now", *more) for i, t, *more in rows], key=str)
