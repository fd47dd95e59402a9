"""Quality score by a byte-level convolutional network in numpy.

Each byte has a learned embedding. Learned filters run over all bytes; chunks of
bytes that overlap by half cover the whole text. A filter's largest response in a
chunk tells whether the chunk holds what it looks for; a learned layer combines
these for each chunk, and the largest and the mean of what it gives over chunks
combine into one probability. Texts of any length are streamed through in runs.

The network is fitted on the driver by gradient descent on a bounded sample of
labelled rows: at most ``per_class`` of each label (chosen by a hash of the id),
of texts up to ``longest`` characters. Scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a filter sees, bytes from one place of it to the next, places of half a chunk, numbers a byte is embedded in, filters, units of the layer over them.
WIDTH, STRIDE, HALF, EMBED, FILTERS, UNITS = 8, 4, 32, 8, 32, 16
#: Bytes of half a chunk; half chunks and bytes that are computed at once.
STEP, PIECE, RUN = STRIDE * HALF, 4096, 1 << 19


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each after a lead of zeros (what a filter at the end of the text before sees) and filled with zeros to whole half chunks, and each text's half chunks (n+1 numbers)."""
    lead = b"\x00" * (WIDTH - STRIDE)
    sizes = [-(-(len(t) + WIDTH) // STEP) for t in texts]
    raw = b"".join((lead + t).ljust(k * STEP, b"\x00") for t, k in zip(texts, sizes)) + b"\x00" * WIDTH
    return np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


class Network:
    """Weights and the two passes. Half chunks never straddle texts, so a text's score does not depend on its neighbours."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": (r.normal(size=(256, EMBED)) * 0.5).astype(np.float32),
            "w": (r.normal(size=(WIDTH * EMBED, FILTERS)) * 0.2).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "u": (r.normal(size=(FILTERS, UNITS)) * 0.25).astype(np.float32),
            "d": np.full(UNITS, 0.1, np.float32),
            "v": (r.normal(size=2 * UNITS) * 0.1).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def filtered(self, raw: np.ndarray) -> np.ndarray:
        """Responses (half chunks x places x filters) on bytes of whole half chunks and a filter's width more."""
        x = self.p["e"][raw]
        n = (len(raw) - WIDTH) // STEP * HALF
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * x.itemsize, x.itemsize))
        return (view @ self.p["w"]).reshape(-1, HALF, FILTERS)

    def combined(self, half: np.ndarray, halves: np.ndarray):
        """Features of each text from its half chunks' largest responses: chunks are pairs of neighbours, the last half stands alone too."""
        n = np.diff(halves)
        last = np.zeros(len(half), bool)
        last[halves[1:] - 1] = True
        after = np.where(last[:, None], half, np.concatenate((half[1:], half[-1:])))
        chunk = np.maximum(np.maximum(half, after) + self.p["b"], 0)
        unit = np.maximum(chunk @ self.p["u"] + self.p["d"], 0)
        top, mean = np.maximum.reduceat(unit, halves[:-1]), np.add.reduceat(unit, halves[:-1]) / n[:, None]
        return np.concatenate((top, mean), 1), (after, chunk, unit, top, n)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """In runs of about RUN bytes; a longer text's half chunks are computed in pieces and combined once."""
        out = np.zeros(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < RUN):
                size += len(texts[hi])
                hi += 1
            raw, halves = padded(texts[lo:hi])
            half = np.concatenate([self.filtered(raw[at : at + PIECE * STEP + WIDTH]).max(axis=1) for at in range(0, len(raw) - WIDTH, PIECE * STEP)])
            out[lo:hi] = self.combined(half, halves)[0] @ self.p["v"] + self.p["c"]
            lo = hi
        return out

    def step(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        raw, halves = padded(texts)
        a = self.filtered(raw)
        best = a.argmax(axis=1)
        half = np.take_along_axis(a, best[:, None], 1)[:, 0]
        feats, (after, chunk, unit, top, n) = self.combined(half, halves)
        z = feats @ self.p["v"] + self.p["c"]
        d = weight * (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"v": feats.T @ d, "c": np.array([d.sum()])}
        df = d[:, None] * self.p["v"][None]
        own = np.repeat(np.arange(len(y)), n)
        is_top = unit == top[own]
        du = np.where(is_top, df[own, :UNITS] / np.maximum(1, np.add.reduceat(is_top, halves[:-1], dtype=np.int64))[own], 0) + df[own, UNITS:] / n[own, None]
        du = np.where(unit > 0, du, 0)
        g["u"], g["d"] = chunk.T @ du, du.sum(axis=0)
        dc = np.where(chunk > 0, du @ self.p["u"].T, 0)
        g["b"] = dc.sum(axis=0)
        mine = half >= after
        dh = np.where(mine, dc, 0)
        dh[1:] += np.where(mine, 0, dc)[:-1]
        # each half chunk's response comes from one place of the filter
        at = (best + np.arange(len(half))[:, None] * HALF) * STRIDE
        w = self.p["w"].reshape(WIDTH, EMBED, FILTERS)
        g["w"], g["e"] = np.zeros((WIDTH, EMBED, FILTERS)), np.zeros((256, EMBED))
        for o in range(WIDTH):
            seen = raw[at + o]
            held = np.bincount((seen.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), weights=dh.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            g["w"][o] = self.p["e"].T @ held
            g["e"] += held @ w[o].T
        g["w"] = g["w"].reshape(WIDTH * EMBED, FILTERS)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, size: int = 32, rate: float = 0.01, least: int = 600, seed: int = 11) -> Network:
        """Adam in ``epochs`` rounds over the rows, more if that makes under ``least`` steps; the rate falls to a seventeenth."""
        r = np.random.default_rng(seed)
        share = max(1e-6, y.mean()), max(1e-6, 1 - y.mean())
        weight = np.where(y == 1, 0.5 / share[0], 0.5 / share[1])
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        s = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        t, each = 0, -(-len(texts) // size)
        epochs = max(epochs, -(-least // each))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), size):
                i = order[lo : lo + size]
                t += 1
                for k, g in self.step([texts[j] for j in i], y[i], weight[i]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * 0.06 ** (t / (epochs * each)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, per_class: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most per_class ids of each label, chosen by a hash of the id, with a text each (of several with one id the first in
    order), so at most twice per_class rows. Texts are whole ones of up to ``longest`` characters; ids whose text is longer,
    null or missing give none. The ids, that few, are broadcast."""
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null")
    mixed = F.xxhash64("doc_id")
    picked = [known.where(F.col("y") == y).distinct().orderBy(mixed, "doc_id").limit(per_class) for y in (0, 1)]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= longest)
    rows = own.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["y"]))]


def fit(rows: list[tuple[str, int]]) -> Network | float:
    """A network; with rows of one label only that label's share, with none 0.5."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Network().fit([r[0].encode() for r in rows], y)


def scores(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row: the probability of label 1. A null text is scored as an empty one; whole texts of any length.
    Repeated rows and null ids are rows like others, ties have equal scores, an empty table gives an empty one. Other columns,
    whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            m = sent.value
            p = np.full(len(texts), m) if isinstance(m, float) else 1 / (1 + np.exp(-np.clip(m.logits(texts), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, longest: int = 12_000) -> DataFrame:
    """doc_id, score of docs by a network fitted on the labels' rows where ``learn`` holds, as sample() bounds them; rows as for scores."""
    return scores(docs, fit(sample(docs, labels, learn, "quality", per_class, longest)))
