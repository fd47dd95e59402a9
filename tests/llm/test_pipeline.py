"""The pipeline against its stages done by hand on a small corpus."""

import hashlib

import public_tokenizers
import pytest
from test_decontaminate import brute as contaminated
from test_pii import brute as spans
from test_simhash import components, fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import language, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [r for r in prose if r[0] is not None and r[0] != 3]
    rows += [(300 + i, f"{prose[i + 1][1]} you idiot and moron here {i}") for i in range(12)]
    rows += [(400, "mail a.b@c.org or +1 (555) 010-1234 at 10.0.0.1 now"), (401, " ".join(prose[40][1].split()[25:60]) + " tail"), (402, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 312)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(prose[40][1].split()[25:60]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def redacted(text):
    out, at = "", 0
    for s in filter(None, spans(text).split(",")):
        kind, a, b = s.split(":")
        if int(a) >= at:
            out, at = out + text[at : int(a)] + f"[{kind.upper()}]", int(b)
        else:
            at = max(at, int(b))
    return out + text[at:]


def test_against_stages_by_hand(spark, folder):
    path, rows, items = folder
    docs, labels = (corpus_pipeline.load(spark, path, t) for t in ("documents", "labels"))
    model = toxicity.grammar(docs, labels, language.fold_of("doc_id", 5) != 0)
    left = [(i, t) for i, t in rows if model.score(t) < 0.5]
    assert {i for i, _ in rows} - {i for i, _ in left} == set(range(300, 312))
    roots = components([fingerprint(t) for _, t in left])
    least = {}
    for (i, t), r in zip(left, roots):
        least[r] = min(least.get(r, (i, t)), (i, t), key=lambda x: x[0])
    left = sorted(least.values())
    bad = {x[0] for x in contaminated(left, items) if x[5]}
    assert 401 in bad
    left = [(i, redacted(t or "")) for i, t in left if i not in bad]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (ids, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, folder):
    path, rows, _ = folder
    odd = [(None, None, None, None, None), (None, "x y", None, None, None), (1, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (2, "", "", "", 0)]
    for table in (odd, []):
        docs = spark.createDataFrame(table, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
        assert out.count() == (3 if table else 0)  # one empty text, "x y", one of the repeated rows
