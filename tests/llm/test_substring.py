import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import substring


def brute(rows, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs, prose):
    rows = [*prose, *[(200 + i, " ".join(f"w{(i * j) % 7}" for j in range(120))) for i in range(8)]]
    for size in (35, 20):
        assert sorted((tuple(r) for r in substring.dedup_digest(docs(rows).repartition(3), size).collect()), key=str) == brute(rows, size)


def test_copies_inside_and_across_batches(spark, docs, prose):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = prose * 2
        assert sorted((tuple(r) for r in substring.dedup_digest(docs(rows).repartition(5)).collect()), key=str) == brute(rows, 35)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_longer_than_a_run(docs, prose):
    """Runs of 40 words: long texts repeat passages of each other and of themselves across the cuts."""
    long = prose[-5][1] if len(prose[-5][1]) > 2000 else next(t for _, t in prose if t and len(t) > 9000)
    words = long.split()
    rows = [*prose, (80, " ".join(words[100:900])), (81, " ".join(words[:200] + ["x"] + words[40:160] + ["y"] + words[50:150])), (82, "\t" + " ".join(f"n{i}" for i in range(700)) + "\n")]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.deduplicated(docs(rows), piece=320).collect() if r["doc_id"] is not None) == sorted(x[:3] for x in brute(rows, 35) if x[0] is not None)
    kept = {r["doc_id"]: hashlib.sha256(r["kept"].encode()).hexdigest() for r in substring.deduplicated(docs(rows[45:]), piece=64).collect()}
    assert kept.items() == {x[0]: x[3] for x in brute(rows[45:], 35)}.items()


def test_places_fit_their_bits():
    try:
        substring.least_place(np.zeros((1 << 24) + 1, np.uint64), 5)
    except ValueError:
        return
    raise AssertionError


def test_empty(docs):
    assert substring.dedup_digest(docs([])).count() == 0
    got = substring.dedup_digest(docs([(1, None), (2, "")])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 0, 0), (2, 0, 0)]


def test_windows_that_agree_in_half_their_hash(docs):
    """One anchor, different windows, the same top 32 bits: found by search over the last word."""
    texts = [" ".join([f"w{i}" for i in range(34)] + [last]) for last in ("n4951", "n117952")]
    data = " ".join(texts).encode()
    words, first = substring.words_of(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]) + 1, len(data)]))
    hashes, _, seg, anchor, *_ = substring.segments(words, first, 35, 12)
    assert len(hashes) == 2 and anchor[seg[0]] == anchor[seg[1]] and hashes[0] != hashes[1] and hashes[0] >> np.uint64(32) == hashes[1] >> np.uint64(32)
    assert [r["n_removed"] for r in substring.deduplicated(docs(list(enumerate(texts)))).collect()] == [0, 0]


def test_a_common_anchor_is_split_and_equal_windows_still_meet(spark, docs):
    phrase = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([f"a{i % 150}x{j}" for j in range(20)] + phrase + [f"b{i % 150}y{j}" for j in range(20)])) for i in range(200)]
    want = {(doc, n) for doc, _, n, _ in brute(rows, 35)}
    assert {n for _, n in want} == {0, 60}
    found = substring.repeated_windows(docs(rows).repartition(4), 35, 12, buckets=3, limit=40).collect()
    keys = {r["key"]: r["doc_id"] for r in docs(rows).select("doc_id", substring.row_key().alias("key")).collect()}
    bits = {}
    for r in found:
        bits.setdefault(keys[r["key"]], []).append((r["start"], r["bits"]))
    assert {(i, int(substring.covered(60, *zip(*bits[i]), 35).sum()) if i in bits else 0) for i, _ in rows} == want
    texts = docs(rows).select("text")
    parts = substring.bucket_parts(texts, 35, 12, 3, 40)
    sent = [b for b in substring.shipped(pa.array([t for _, t in rows]), np.arange(200), np.arange(200), 35, 12, parts)]
    sizes = [len(h) for b in sent for g, h in zip(b.column(0).to_pylist(), b.column(6).to_pylist()) if g >= 0]
    assert parts.max() > 10 and max(sizes) < 120 and sum(sizes) == 150 * 26
