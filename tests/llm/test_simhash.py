import random

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import graph, simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(docs, prose):
    got = sorted((tuple(r) for r in simhash.simhash_digest(docs(prose)).collect()), key=str)
    fps = [fingerprint(t) for _, t in prose]
    roots = components(fps)
    least = {}
    for (i, _), r in zip(prose, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(prose, fps, roots)), key=str)
    assert got == want


def clusters(n):
    """Fingerprints in tight groups, far ones, pairs at exactly four and five bits."""
    r = random.Random(4)
    out = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(n)}
    base = r.getrandbits(64)
    return sorted(out | {base, base ^ 0xF, base ^ 0x1F000, base ^ (0x33 << 30)})


def linked(spark, fps, most):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), most)
    roots = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    return [roots.get(s, s) for (s,) in signed]


def test_links_connect_what_is_connected(spark):
    fps = clusters(40)
    want = components(fps)
    for most in (4096, 4):  # by verification, and by stars around common centres
        got = linked(spark, fps, most)
        pairs = lambda labels: pd.Series(labels).groupby(labels).apply(lambda g: tuple(g.index)).tolist()
        assert sorted(pairs(got)) == sorted(pairs(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(docs, prose):
    df = docs(prose)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    roots = simhash.near_duplicates(df)
    assert kept.count() == len(set(components([fingerprint(t) for _, t in prose])))
    ids = {r["component_id"] for r in roots.collect()} - {None}
    assert ids <= {r["doc_id"] for r in kept.collect()}
    assert simhash.representatives(docs([])).count() == 0
    assert kept.where(F.col("doc_id").isin(50, 51)).count() == 0


def test_representatives_with_clashing_names(spark, prose):
    df = spark.createDataFrame([(i, t, i, "k", 1) for i, t in prose], "doc_id long, text string, ID long, _key string, Key long")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len(set(components([fingerprint(t) for _, t in prose]))) and all(r["ID"] == r["doc_id"] and r["_key"] == "k" for r in got)
