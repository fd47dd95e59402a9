import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import exact


def brute(rows):
    """keep: the greatest id of equal texts; one of the rows that repeat it stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    seen, out = set(), []
    for i, t in rows:
        t = t or ""
        top = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, top, len(groups[t]), hashlib.sha256(t.encode()).hexdigest(), i == top and t not in seen))
        if i == top:
            seen.add(t)
    return sorted(out, key=str)


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aehilnorst éß日") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = text(9000)
    rows = [(i, text(r.randint(0, 400))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(40)]
    rows += [(200, long), (201, long), (202, long[:-1]), (203, long + " "), (204, long[:20000] + "x" + long[20001:]), (205, "a" * 50000), (206, "a" * 50000), (207, "a" * 50001)]
    rows += [(300, None), (301, ""), (302, " "), (None, None), (None, "only null"), (None, "only null"), (303, "x"), (303, "x"), (303, "y"), (None, "x")]
    # the same chunks in another order, and one text that begins another
    cut = [c for c in map(str, range(3000))]
    return [*rows, (400, " ".join(cut)), (401, " ".join(cut[1500:] + cut[:1500])), (402, " ".join(cut[:1500]))]


def result(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["kept"]) for r in df.collect()), key=str)


def test_against_brute_force(docs):
    rows = texts()
    assert result(exact.exact_digest(docs(rows).repartition(5))) == brute(rows)


def test_fingerprints_that_stand_for_several_chunks(docs):
    """Two bits and one: nearly all chunks share theirs with others, and bytes alone tell texts apart."""
    rows = texts()
    for bits in (3, 1):
        weak = lambda c: F.xxhash64(exact.chunk_bytes(c)).bitwiseAND(F.lit(bits))  # noqa: B023, E731
        assert result(exact.exact_groups(docs(rows), fingerprint=weak)) == brute(rows)


def test_chunks_are_the_text_and_follow_content(docs):
    rows = texts()
    cut = docs(rows).select("doc_id", "text", exact.chunks().alias("c"), F.transform(exact.chunks(), F.length).alias("n")).collect()
    for r in cut:
        joined = "".join(r["c"] or []).encode("latin1").decode() if r["text"] is not None else None
        assert joined == r["text"] and all(1 <= n <= exact.MOST for n in r["n"] or [])
    long = next(t for i, t in rows if i == 200)
    both = docs([(1, long), (2, "some words before it " * 9 + long)]).select(exact.chunks().alias("c")).collect()
    shared = len(set(both[0]["c"]) & set(both[1]["c"]))
    assert len(both[0]["c"]) > 30 and shared >= len(both[0]["c"]) - 4


def test_distinct_documents_keep_their_columns(spark):
    rows = texts()
    table = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, ID long, _key long, row string")
    out = exact.distinct_documents(table)
    want = sorted(((b[0], b[3]) for b in brute(rows) if b[4]), key=str)
    got = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=str)
    assert out.columns == table.columns and {r["row"] for r in out.collect()} == {"z"}
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]


def test_empty_table_and_a_hot_text(spark, docs):
    assert exact.exact_digest(docs([])).count() == 0 and exact.distinct_documents(docs([])).count() == 0
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    assert result(exact.exact_digest(docs(rows).repartition(8))) == brute(rows)


def test_no_python_on_the_path(docs):
    out = exact.exact_digest(docs(texts()))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
