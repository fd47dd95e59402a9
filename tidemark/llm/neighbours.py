"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Euclidean nearness is maximum inner product: seen from a centre c, the nearest x
has the greatest 2 (q-c).(x-c) - |x-c|^2 - |q-c|^2. Each vector belongs to the
cell of its nearest centre and is coded by its offset from it, in units of that
cell's spread. An offset is cut into subspaces of a few components, each coded in
four bits. Codes minimise a loss in which the error parallel to the offset, which
changes inner products, weighs more than the error across it; as the parallel
error is one number for all subspaces together, codes and codebooks are found by
coordinate descent. Centres and codebooks are fitted on a bounded sample.

A query looks into its nearest cells only: as many as, on the sample, hold 99 of
100 true neighbours. There it adds entries of small tables for every code, which
gives the distance to what the code stands for; how far each vector is from its
code is stored with it, so every distance is known to lie within bounds. Exact
distances are computed in the order of the lower bounds until the next one is
beyond the k-th: within the cells looked into nothing is lost, whatever crowds
of nearly equal vectors they hold, and there is no fixed number of candidates.

Vectors that are equal are coded once, with their least ids. A task takes a block
of one cell's vectors and a block of the queries that look into that cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of a subspace (the fewer, the closer the bounds), codes of a subspace (four bits), weight of parallel against orthogonal error.
PART, CODES, PARALLEL = 1, 16, 4.0
#: Vectors that centres and codebooks are fitted on at most, cells at most, vectors a cell is meant for.
FITTED, CELLS, MEANT = 16_000, 1024, 512
#: Share of the sample's neighbours that the probed cells hold, and how many of its vectors are asked.
HELD, ASKED = 0.99, 500
#: Vectors and queries of a block.
ROWS, QUERIES = 8_192, 4_096


class Codebooks:
    """Centres, spreads and codebooks, fitted on x; ``total`` vectors will be indexed."""

    def __init__(self, x: np.ndarray, total: int, k: int = 10, rounds: int = 8, seed: int = 5):
        self.dim = x.shape[1]
        self.parts = -(-self.dim // PART)
        r = np.random.default_rng(seed)
        n = max(1, min(CELLS, total // MEANT, len(x) // 16))
        self.centres = x[r.choice(len(x), n, replace=False)].copy() if len(x) else np.zeros((1, self.dim))
        for _ in range(rounds if len(x) else 0):
            cell = self.cells_of(x, 1)[:, 0]
            size = np.bincount(cell, minlength=n)
            total_of = np.zeros_like(self.centres)
            np.add.at(total_of, cell, x)
            self.centres[size > 0] = total_of[size > 0] / size[size > 0][:, None]
        cell = self.cells_of(x, 1)[:, 0]
        off = x - self.centres[cell]
        square = np.bincount(cell, weights=(off**2).sum(axis=1), minlength=n) / np.maximum(1, np.bincount(cell, minlength=n))
        self.spread = np.maximum(np.sqrt(square), 1e-9)
        self.books = np.zeros((self.parts, CODES, PART))
        if len(x):
            y = self.cut(off / self.spread[cell][:, None])
            for p in range(self.parts):
                self.books[p] = y[r.integers(0, len(y), CODES), p] + r.normal(size=(CODES, PART)) * 1e-6
            for _ in range(6):
                self.refit(y, self.codes_of(y))
        self.probes = self.needed(x, cell, k) if len(x) else 1

    def cells_of(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest centres of each row, nearest first, found in runs of rows."""
        half = (self.centres**2).sum(axis=1) / 2
        runs = []
        for lo in range(0, len(x), 4096):
            far = half - x[lo : lo + 4096] @ self.centres.T
            runs.append(far.argmin(axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most])
        return np.concatenate(runs) if runs else np.zeros((0, most), np.int64)

    def needed(self, x: np.ndarray, cell: np.ndarray, k: int) -> int:
        """How many cells hold HELD of the sample's true neighbours within the sample."""
        asked = x[:: max(1, len(x) // ASKED)]
        square = (x**2).sum(axis=1)
        ranks = []
        for lo in range(0, len(asked), 64):
            q = asked[lo : lo + 64]
            near = np.argpartition(square - 2 * q @ x.T, min(k, len(x) - 1), axis=1)[:, : k + 1]
            place = np.argsort(self.cells_of(q, len(self.centres)), axis=1)  # rank of each cell for each query
            ranks.append(np.take_along_axis(place, cell[near], 1).ravel())
        return int(np.quantile(np.concatenate(ranks), HELD, method="higher")) + 1

    def cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * PART - self.dim))).reshape(len(x), self.parts, PART)

    def costs(self, y: np.ndarray, unit: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """For subspace p the squared error of each code and its share of the parallel error (rows x codes)."""
        book = self.books[p]
        square = (y[:, p] ** 2).sum(axis=1)[:, None] - 2 * (y[:, p] @ book.T) + (book**2).sum(axis=1)
        return square, (y[:, p] * unit[:, p]).sum(axis=1)[:, None] - unit[:, p] @ book.T

    def codes_of(self, y: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of cut offsets: of least error first, then each subspace in turn to the least joint loss |r|^2 + (PARALLEL-1) (u.r)^2, r being what all codes leave."""
        unit = y / np.maximum(np.sqrt((y**2).sum(axis=(1, 2))), 1e-12)[:, None, None]
        every = np.arange(len(y))
        costs = [self.costs(y, unit, p) for p in range(self.parts)]
        codes = np.stack([square.argmin(axis=1) for square, _ in costs], 1)
        along = np.stack([share[every, codes[:, p]] for p, (_, share) in enumerate(costs)], 1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for p, (square, share) in enumerate(costs):
                rest = total - along[:, p]
                codes[:, p] = (square + (PARALLEL - 1) * (rest[:, None] + share) ** 2).argmin(axis=1)
                along[:, p] = share[every, codes[:, p]]
                total = rest + along[:, p]
        return codes.astype(np.uint8)

    def refit(self, y: np.ndarray, codes: np.ndarray) -> None:
        """Each subspace's codes in turn to the least joint loss, the others held: a small linear system for each code."""
        unit = y / np.maximum(np.sqrt((y**2).sum(axis=(1, 2))), 1e-12)[:, None, None]
        left = y - np.stack([self.books[p][codes[:, p]] for p in range(self.parts)], 1)
        along = (left * unit).sum(axis=2)
        total = along.sum(axis=1)
        for p in range(self.parts):
            rest = total - along[:, p]
            u, part = unit[:, p], y[:, p]
            sums = lambda v: np.stack([np.bincount(codes[:, p], weights=w, minlength=CODES) for w in v.reshape(len(y), -1).T], 1)  # noqa: E731, B023
            size = np.bincount(codes[:, p], minlength=CODES)
            a = size[:, None, None] * np.eye(PART) + (PARALLEL - 1) * sums(u[:, :, None] * u[:, None, :]).reshape(CODES, PART, PART)
            b = sums(part) + (PARALLEL - 1) * sums(u * (rest + (u * part).sum(axis=1))[:, None])
            used = size > 0
            self.books[p][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            along[:, p] = ((part - self.books[p][codes[:, p]]) * u).sum(axis=1)
            total = rest + along[:, p]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes (two to a byte) and the distance of each vector from what its code stands for."""
        cell = self.cells_of(x, 1)[:, 0]
        y = self.cut((x - self.centres[cell]) / self.spread[cell][:, None])
        codes = np.concatenate([self.codes_of(y[lo : lo + 2048]) for lo in range(0, len(y), 2048)]) if len(y) else np.zeros((0, self.parts), np.uint8)
        stands = np.stack([self.books[p][codes[:, p]] for p in range(self.parts)], 1)
        error = np.sqrt(((y - stands) ** 2).sum(axis=(1, 2))) * self.spread[cell]
        codes = np.pad(codes, ((0, 0), (0, self.parts % 2)))
        return cell, codes[:, ::2] | (codes[:, 1::2] << 4), error

    def scan(self, cell: int, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Distances (queries x vectors) to what the codes of one cell's vectors stand for, by adding up table entries."""
        low, high = codes & 15, codes >> 4
        off = queries - self.centres[cell]
        q = self.cut(off)
        s = self.spread[cell]
        out = np.repeat((off**2).sum(axis=1)[:, None], len(codes), axis=1)
        for p in range(self.parts):
            table = (s * s) * (self.books[p] ** 2).sum(axis=1) - 2 * s * (q[:, p] @ self.books[p].T)  # queries x 16
            out += table[:, (low if p % 2 == 0 else high)[:, p // 2]]
        return np.sqrt(np.maximum(out, 0))


def best_in_block(q: np.ndarray, x: np.ndarray, about: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x that are among the k nearest of q, with those that equal the k-th in single precision, and their exact distances.

    ``about`` are distances to the codes, ``error`` those of the vectors from their codes.
    """
    lower = about - error * (1 + 1e-9) - 1e-9 * (1 + about)
    first = np.argpartition(lower, min(4 * k, len(lower) - 1))[: 4 * k]
    exact = np.sqrt(((x[first] - q) ** 2).sum(axis=1))
    reach = np.partition(exact, k - 1)[k - 1] if len(first) >= k else np.inf
    more = np.setdiff1d(np.flatnonzero(lower <= reach * (1 + 1e-6)), first)
    at = np.concatenate((first, more))
    exact = np.concatenate((exact, np.sqrt(((x[more] - q) ** 2).sum(axis=1))))
    rounded = exact.astype(np.float32)
    if len(at) > k:
        keep = rounded <= np.partition(rounded, k - 1)[k - 1]
        at, exact = at[keep], exact[keep]
    return at, exact


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (doubles) of vectors that are neither null, empty, zero, nor hold null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where("vec_id is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)")


def distinct_vectors(rows: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """Equal vectors once: rep (the least id), x, ids (the least ``most``). Large groups are cut down by salt first."""
    same = F.xxhash64("x")
    salted = rows.select("vec_id", "x", same.alias("same"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
    some = salted.withColumn("k", F.row_number().over(Window.partitionBy("same", "x", "salt").orderBy("vec_id"))).where(F.col("k") <= most)
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("same", "x").orderBy("vec_id"))).where(F.col("k") <= most)
    return few.groupBy("same", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "x", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", fitted: int = FITTED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k nearest other vectors found.

    score is the Euclidean distance of the original vectors in double precision; ties
    go to the smaller id; fewer vectors than k in the cells looked into: all of those,
    and all cells are looked into where that is fewer than k. Unusable vectors take no
    part. Vectors of another length than a query are not compared with it. Rows that
    repeat an id count once for each different vector. Empty tables give empty ones;
    other columns are not read.
    """
    own = stored(usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "x"]), "vectors")
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "x"])
    sizes = {r["dim"]: r["count"] for r in own.groupBy(F.size("x").alias("dim")).count().collect()}  # lengths, a handful
    out = None
    for dim, total in sorted(sizes.items()):
        mine = nearest_of(own.where(F.size("x") == dim), asked.where(F.size("x") == dim), dim, total, k, fitted)
        out = mine if out is None else out.union(mine)
    return out if out is not None else own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def nearest_of(own: DataFrame, asked: DataFrame, dim: int, total: int, k: int, fitted: int) -> DataFrame:
    spark = own.sparkSession
    fitted = min(fitted, max(8 * CODES, 2_000_000 // dim))  # numbers held on the driver
    learn = own.orderBy(F.xxhash64("vec_id")).limit(fitted).select("x").toArrow().column(0).combine_chunks()
    learn = np.unique(learn.flatten().to_numpy().reshape(-1, dim), axis=0)
    fit = Codebooks(learn, total, k)
    books = spark.sparkContext.broadcast(fit)

    def encode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            cell, codes, error = books.value.encode(x)
            added = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "cell", "code", "error"])

    entries = distinct_vectors(own, k + 1).mapInArrow(encode, "rep long, x array<double>, ids array<long>, cell int, code binary, error double")
    entries = stored(entries, "entries")
    sizes = {r["cell"]: (r["n"], r["ids"]) for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # CELLS rows at most
    filled = np.array(sorted(sizes), np.int64)
    # cells that may hold fewer than k others: as many more are probed as make sure of k
    fewest = np.cumsum(np.sort([sizes[c][1] for c in filled]))
    probes = min(len(filled), max(fit.probes, int(np.searchsorted(fewest, k + 1)) + 1))
    blocks = {int(c): -(-sizes[c][0] // ROWS) for c in filled}
    groups = max(1, -(-asked.count() * probes // (QUERIES * max(1, len(filled)))))  # blocks of queries in a cell, on average

    def probe(batches: Iterator[pa.RecordBatch]):
        centres = books.value
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            order = centres.cells_of(x, len(centres.centres))
            order = order[np.isin(order, filled)].reshape(len(x), -1)[:, :probes]
            of = np.repeat(np.arange(len(x)), order.shape[1])
            many = np.array([blocks[c] for c in order.ravel().tolist()], np.int64)
            at = np.repeat(np.arange(len(of)), many)
            row = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel()[at], pa.int32()), pa.array(row, pa.int32()), b.column("vec_id").take(pa.array(of[at])), b.column("x").take(pa.array(of[at]))], names=["cell", "row", "query_id", "q"])

    col = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    looking = asked.mapInArrow(probe, "cell int, row int, query_id long, q array<double>").withColumn("col", col)
    dealt = F.pmod(F.xxhash64("rep"), F.element_at(F.create_map(*[F.lit(v) for c in filled.tolist() for v in (c, blocks[c])]), F.col("cell"))).cast("int")
    held = entries.select("cell", dealt.alias("row"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("col"), "rep", "x", "code", "error")

    def search(key, v: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(ask):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "far": np.zeros(0)})
        x, rep, error = np.stack(v["x"].to_numpy()), v["rep"].to_numpy(), v["error"].to_numpy()
        codes = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
        q, ids, out = np.stack(ask["q"].to_numpy()), ask["query_id"].to_numpy(), []
        for lo in range(0, len(q), 64):
            about = books.value.scan(int(key[0]), codes, q[lo : lo + 64])
            for i, row in enumerate(about, lo):
                at, far = best_in_block(q[i], x, row, error, k + 1)
                out.append((np.full(len(at), ids[i]), rep[at], far))
        return pd.DataFrame(dict(zip(("query_id", "rep", "far"), map(np.concatenate, zip(*out)))))

    found = held.groupBy("cell", "row", "col").cogroup(looking.groupBy("cell", "row", "col")).applyInPandas(search, "query_id long, rep long, far double")
    # equal in single precision: settled by the distance as it is reported
    best = found.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("far").cast("float")))).where(F.col("r") <= k + 1)
    pairs = best.select("query_id", "rep").join(entries.select("rep", "x", "ids"), "rep").join(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")
    exact = pairs.select("query_id", F.explode("ids").alias("vec_id"), F.expr("sqrt(aggregate(zip_with(x, q, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))").alias("score"))
    ranked = exact.where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
