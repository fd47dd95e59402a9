import hashlib
import random
import re

from tidemark.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (f := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= f
                    hit[k : k + n] = [True] * n
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def check(spark, docs, rows, items):
    got = decontaminate.contamination_digest(docs(rows), spark.createDataFrame(items, ITEM)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_against_brute_force(spark, docs, prose):
    r = random.Random(9)
    long = prose[52 - 3][1]
    items = [(1, " ".join(prose[40][1].split()[25:60]).upper()), (2, "short one here"), (3, long[:200]), (4, ""), (5, None), (6, "solo"), (None, " ".join(prose[42][1].split()[0:14])), (7, "the " * 12), (8, "nine words are here to make it one window"), (2, "another text of one id that nothing holds at all ok ok")]
    rows = [*prose, (90, "before short-one here! after"), (91, "SOLO"), (92, "x nine words, are here to make it one window y"), (93, "nine words are here to make it one")]
    # a run that straddles pieces
    far = [r.choice(["aa", "bb", "cc", "dd"]) for _ in range(1400)]
    items.append((9, " ".join(far[505:525])))
    rows.append((94, " ".join(far)))
    check(spark, docs, rows, items)


def test_beyond_few_grams(spark, docs, prose, monkeypatch):
    """The filter and the shuffle join, also with a filter so small that most bits are set."""
    long = prose[52 - 3][1]
    items = [(1, " ".join(prose[40][1].split()[25:60])), (2, "one"), (3, long[:200]), (4, "the " * 12), (5, "seven words are in this one here")]
    rows = [*prose, (90, "x seven words are in this one here y")]
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for slots in (decontaminate.SLOTS, 2):
            monkeypatch.setattr(decontaminate, "SLOTS", slots)
            out = decontaminate.contamination(docs(rows), spark.createDataFrame(items, ITEM), few=0)
            plan = out._jdf.queryExecution().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
            got = sorted((r["doc_id"], len(r["items"]), r["n_words"]) for r in out.collect() if r["doc_id"] is not None)
            assert got == sorted((x[0], x[3], x[1]) for x in brute(rows, items) if x[0] is not None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_empty_tables(spark, docs, prose):
    check(spark, docs, [], [(1, "a b c")])
    check(spark, docs, prose[:5], [])


def test_clean_with_clashing_names(spark, prose):
    """Columns of the names that the join uses, in any case."""
    items = [(1, " ".join(prose[40][1].split()[25:60]))]
    table = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in prose], "doc_id long, text string, ID long, _key long, Key long, _bad string")
    kept = decontaminate.clean(table, spark.createDataFrame(items, ITEM))
    assert kept.columns == table.columns and {(r["ID"], r["_key"], r["Key"], r["_bad"]) for r in kept.collect()} == {(1, 2, 3, "x")}
    assert kept.count() == sum(not x[5] for x in brute(prose, items))


def test_clean_keeps_what_shares_nothing(spark, docs, prose):
    items = [(1, " ".join(prose[40][1].split()[25:60]))]
    kept = decontaminate.clean(docs(prose), spark.createDataFrame(items, ITEM))
    assert kept.columns == docs(prose).columns
    clean = [x[0] for x in brute(prose, items) if not x[5]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, clean))


def test_an_item_as_long_as_a_gram_beside_long_ones(spark, docs):
    """Seven words are a gram of a long item too; each kind keeps its own span."""
    r = random.Random(4)
    long = [f"l{i}" for i in range(24)]
    seven = [f"s{i}" for i in range(7)]
    other = lambda n: [f"o{r.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(long)), (2, " ".join(seven)), (3, " ".join(long[2:9])), (4, "a b c d e f g h i")]
    texts = [other(5) + long[k : k + n] + other(4) for k in range(12) for n in (7, 9, 10, 11, 12)]
    texts += [other(3) + seven, seven, seven + other(1), seven[:6] + other(5), long[2:9], long[:9], other(2) + long[9:16]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check(spark, docs, rows, items)
    check(spark, docs, rows, items[:2])
    kept = decontaminate.clean(docs(rows), spark.createDataFrame(items[:2], ITEM))
    assert sorted(r["doc_id"] for r in kept.collect()) == [x[0] for x in sorted(brute(rows, items[:2])) if not x[5]]
