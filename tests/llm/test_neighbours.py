import numpy as np

from tidemark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.5, "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            out[q] = [i for _, i in sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 24)) * 2
    rows = [(i, (centres[i % 12] + r.normal(size=24)).tolist()) for i in range(1500)]
    df = frame(spark, rows)
    out = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = brute(rows, set(range(0, 1500, 50)))
    hit = sum(r["vec_id"] in want[r["query_id"]] for r in out)
    assert len(out) == 300 and hit / 300 >= 0.95
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for x in out:
        assert abs(x["score"] - np.sqrt(((vectors[x["query_id"]] - vectors[x["vec_id"]]) ** 2).sum())) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(10, 40)]
    odd = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [None, 1.0, 1.0]), (5, []), (6, [float("inf"), 0.0, 1.0])]
    rows = [*same, *odd, (0, [1.0, 2.0, 3.1]), (100, [5.0, 5.0, 5.0])]
    df = frame(spark, rows)
    out = neighbours.nearest(df, df.where("vec_id in (0, 1, 2, 10, 100)")).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert got == brute(rows, {0, 10, 100})


def test_small_tables(spark):
    assert neighbours.nearest(frame(spark, []), frame(spark, [])).count() == 0
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [tuple(r)[:3] for r in neighbours.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_crowds_of_nearly_equal_vectors(spark):
    """More crowds than cells, each with more members than any list of candidates would hold: neighbours are all of one crowd."""
    r = np.random.default_rng(1)
    rows = [(c * 600 + i, (centre + r.normal(size=8) * 1e-4).tolist()) for c, centre in enumerate(r.normal(size=(8, 8))) for i in range(600)]
    df = frame(spark, rows)
    out = neighbours.nearest(df, df.where("vec_id % 300 = 0")).collect()
    want = brute(rows, set(range(0, 4800, 300)))
    assert len(out) == 160 and sum(x["vec_id"] in want[x["query_id"]] for x in out) >= 152


def test_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.0]), (2, [1.0, 0.5]), (5, [7.0])]
    out = neighbours.nearest(frame(spark, rows), frame(spark, rows)).collect()
    assert sorted((x["query_id"], x["vec_id"]) for x in out) == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_bounds_and_joint_loss():
    """Every distance lies within its bounds; the joint loss is less than that of codes of least error."""
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 12)) * r.choice([0.1, 1, 5], (2000, 1))
    books = neighbours.Codebooks(x, 2000)
    cell, codes, error = books.encode(x)
    q = r.normal(size=(20, 12))
    for c in np.unique(cell):
        mine = np.flatnonzero(cell == c)
        about = books.scan(int(c), codes[mine], q)
        exact = np.sqrt(((q[:, None] - x[mine][None]) ** 2).sum(axis=2))
        assert (np.abs(about - exact) <= error[mine] + 1e-9).all()
    y = books.cut((x - books.centres[cell]) / books.spread[cell][:, None])
    unit = y / np.sqrt((y**2).sum(axis=(1, 2)))[:, None, None]

    def loss(codes):
        e = y - np.stack([books.books[p][codes[:, p]] for p in range(books.parts)], 1)
        return ((e**2).sum(axis=(1, 2)) + (neighbours.PARALLEL - 1) * (e * unit).sum(axis=(1, 2)) ** 2)

    assert loss(books.codes_of(y)).mean() < 0.9 * loss(books.codes_of(y, 0)).mean()
    assert (loss(books.codes_of(y)) <= loss(books.codes_of(y, 1)) + 1e-9).all()


def test_far_cells_are_not_probed():
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.normal(size=(300, 16)) for c in r.normal(size=(20, 16)) * 30])
    books = neighbours.Codebooks(x, 10_240)
    assert len(books.centres) == 20 and books.probes <= 6
