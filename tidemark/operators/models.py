"""Repository models (L1 to L3): logistic regression, negative binomial with free dispersion, variance inflation.

Data stay in Spark. Each step of a fit is a weighted least-squares problem that is solved by a
tall and narrow QR: every task reduces its rows, batch by batch, to one triangle as wide as the
covariates, triangles are reduced in groups to at most TREE, and the driver reduces those. X'X is
never formed, so a design's condition number counts once, not squared. Rows are written once and
read in each step; functions that run in tasks use numpy only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staged import staged

#: Triangles that reach the driver.
TREE = 64
PARTIAL = "part int, triangle array<double>, sums array<double>"


@dataclass
class Fit:
    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    alpha: float | None = None
    alpha_error: float | None = None

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood

    def table(self, spark) -> DataFrame:
        """term, coefficient, se, z, p, ratio, ratio_low, ratio_high."""
        rows = []
        for name, b, e in zip(self.names, self.coefficients.tolist(), self.errors.tolist()):
            z = b / e if e else float("nan")
            rows.append((name, b, e, z, math.erfc(abs(z) / math.sqrt(2)), math.exp(b), math.exp(b - 1.96 * e), math.exp(b + 1.96 * e)))
        return spark.createDataFrame(rows, "term string, coefficient double, se double, z double, p double, ratio double, ratio_low double, ratio_high double")


def reduced(data: DataFrame, columns: list[str], others: list[str], step: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The triangle of all rows of [sqrt(w) X | sqrt(w) z], and sums.

    ``step`` takes X (with ones first) and the other columns of a batch and returns sqrt(w), sqrt(w) z and
    an array of sums. The order in which triangles meet does not change the result beyond rounding.
    """
    k = len(columns) + 2
    arrow = pa.schema([("part", pa.int32()), ("triangle", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        r, sums = np.zeros((k, k)), 0.0
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.column_stack([np.ones(batch.num_rows), *got[: len(columns)]])
            root, z, more = step(x, *got[len(columns) :])
            r = np.linalg.qr(np.vstack([r, np.column_stack([root[:, None] * x, z])]), mode="r")
            sums = sums + more
        if not np.isscalar(sums):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64())), pa.array([sums], pa.list_(pa.float64()))], schema=arrow)

    def join(pdf):
        pdf = pdf.sort_values("part")
        r = np.linalg.qr(np.vstack([np.reshape(t, (k, k)) for t in pdf["triangle"]]), mode="r")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "triangle": [r.ravel()], "sums": [np.sum(np.stack(list(pdf["sums"])), axis=0)]})

    rows = data.select(*columns, *others).mapInArrow(run, PARTIAL).groupBy(F.col("part") % TREE).applyInPandas(join, PARTIAL).collect()
    if not rows:
        raise ValueError("no rows to fit")
    rows.sort(key=lambda x: x["part"])
    r = np.linalg.qr(np.vstack([np.reshape(x["triangle"], (k, k)) for x in rows]), mode="r")
    return r, np.sum([x["sums"] for x in rows], axis=0)


def solved(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The least-squares solution of a triangle, the inverse of its square part, and how much the solution gains."""
    square, right = r[:-1, :-1], r[:-1, -1]
    return np.linalg.solve(square, right), np.linalg.inv(square), float(right @ right)


def errors_of(inverse: np.ndarray) -> np.ndarray:
    return np.sqrt((inverse**2).sum(axis=1))


def numbers(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns as doubles under new names, without rows that lack one, written once."""
    return staged(rows.select(*[F.col(c).cast("double").alias(n) for n, c in columns.items()]).na.drop(), "design")


def logistic(rows: DataFrame, outcome: str, columns: list[str], rounds: int = 50, tol: float = 1e-18) -> Fit:
    """Newton's method as weighted least squares; rows with a null in outcome or covariates are left out."""
    names = [f"x{i}" for i in range(len(columns))]
    data = numbers(rows, {"y": outcome, **dict(zip(names, columns))})
    beta = np.zeros(len(columns) + 1)
    for _ in range(rounds):

        def step(x, y, beta=beta):
            eta = x @ beta
            p = 1 / (1 + np.exp(-eta))
            root = np.sqrt(np.maximum(p * (1 - p), 1e-30))
            return root, (y - p) / root, np.array([len(y), y.sum(), (y * eta - np.logaddexp(0, eta)).sum()])

        r, (n, s, ll) = reduced(data, names, ["y"], step)
        delta, inverse, gain = solved(r)
        beta = beta + delta
        if gain < tol * n:
            break
    share = s / n
    null = s * math.log(share) + (n - s) * math.log(1 - share) if 0 < share < 1 else -1e-300
    return Fit(["const", *columns], beta, errors_of(inverse), ll, null)


def negative_binomial(rows: DataFrame, outcome: str, columns: list[str], offset: str, rounds: int = 60, tol: float = 1e-9) -> Fit:
    """NB2 with log link and offset: Fisher scoring for the coefficients, Newton in log r for the dispersion 1/r, in turn.

    Sums over the steps from r to y + r, for whole y, are read from a table up to the greatest y. The null model, for the
    pseudo R2, has the intercept, the offset and a dispersion of its own, over the same rows.
    """
    names = [f"x{i}" for i in range(len(columns))]
    data = numbers(rows, {"y": outcome, "o": offset, **dict(zip(names, columns))})
    own = _negative_binomial(data, names, rounds, tol)
    null = _negative_binomial(data, [], rounds, tol)[2] if columns else own[2]
    beta, errors, ll, r, curve = own
    return Fit(["const", *columns], beta, errors, ll, null, alpha=1 / r, alpha_error=(1 / r) / math.sqrt(max(curve, 1e-300)))


def _negative_binomial(data: DataFrame, names: list[str], rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    total, exposure, top = data.agg(F.sum("y"), F.sum(F.exp("o")), F.max("y")).first()
    beta = np.zeros(len(names) + 1)
    beta[0] = math.log(max(total, 1e-9) / exposure)
    steps = int(top)
    r, ll, inverse, curve = 1.0, 0.0, np.eye(len(beta)), 1.0
    for _ in range(rounds):

        def step(x, y, o, beta=beta, r=r):
            mu = np.exp(x @ beta + o)
            i, at = np.arange(steps) + r, y.astype(np.int64)
            upto = lambda v: np.concatenate([[0.0], np.cumsum(v)])[at]
            d1 = upto(1 / i) + np.log(r / (r + mu)) + 1 - (y + r) / (r + mu)
            d2 = -upto(1 / i**2) + 1 / r - 2 / (r + mu) + (y + r) / (r + mu) ** 2
            like = upto(np.log(i)) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu)) - upto(np.log(i - r + 1))
            root = np.sqrt(mu * r / (r + mu))
            return root, (y - mu) * r / (r + mu) / root, np.array([d1.sum(), d2.sum(), like.sum()])

        triangle, (g1, g2, new) = reduced(data, names, ["y", "o"], step)
        delta, inverse, _ = solved(triangle)
        beta = beta + delta
        # in u = log r: f' = r g1, f'' = r^2 g2 + r g1
        first, second = r * g1, r * r * g2 + r * g1
        curve = -second
        r = r * math.exp(max(-1.0, min(1.0, -first / second if second < 0 else math.copysign(0.5, first))))
        settled = abs(new - ll) < tol * (1 + abs(new)) and abs(first) < 1e-5 * (1 + abs(new))
        ll = new
        if settled:
            break
    return beta, errors_of(inverse), ll, r, curve


def inflation(rows: DataFrame, columns: list[str]) -> DataFrame:
    """term, vif: the diagonal of the inverse correlation matrix of the covariates, from one aggregation."""
    data = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    k = len(columns)
    got = data.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1, k)], F.count("*").alias("n")).first()
    m = np.eye(k)
    for at, (i, j) in enumerate((i, j) for i in range(k) for j in range(i + 1, k)):
        m[i, j] = m[j, i] = got[at]
    return rows.sparkSession.createDataFrame(list(zip(columns, np.diag(np.linalg.inv(m)).tolist())), "term string, vif double")
