"""Language identification as inference of a mixture.

N-gram counts of every learning document give each language a distribution over
hashed byte trigrams. A document is a sequence of spans, each written in one
language: expectation-maximisation estimates the proportions from the spans'
likelihoods, for the likeliest one, two, ... languages in turn, as long as the
likelihood after a penalty for the set's size still gains. The set and its
proportions are the result; the language with the largest one is the prediction,
its proportion the score. Every document is estimated until it settles, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

CELLS = 1 << 16
#: Bytes of a span; units of log-likelihood that another language must earn for each doubling of spans; the change of a proportion at which a document is settled.
SPAN, PENALTY, SETTLED = 48, 4.0, 1e-5
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32
LETTER = regex.compile(r"\p{L}")
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def cells(data: bytes) -> np.ndarray:
    """The hashed trigram that starts at each byte but the last two."""
    b = FOLD[np.frombuffer(data, np.uint8)].astype(np.uint32)
    return (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def fold_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in no fold."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % parts


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, cell, n over all rows that have both a text and a language. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for t, lang in zip(texts, langs):
                here = total.setdefault(lang, np.zeros(CELLS, np.int64))
                c = cells(b" " + t.encode() + b" ") if t else np.zeros(0, np.uint32)
                if len(c) > 4096:
                    here += np.bincount(c, minlength=CELLS)
                else:
                    np.add.at(here, c, 1)
        for lang, n in total.items():
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(n[on])], names=["lang", "cell", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of cells for each language, all sizes of corpora smoothed alike."""

    def __init__(self, totals: dict[str, tuple[np.ndarray, np.ndarray]], alpha: float = 0.5):
        """totals: cells and their counts for each language."""
        self.langs = sorted(totals)
        self.table = np.zeros((len(self.langs), CELLS), np.float32)
        for row, lang in zip(self.table, self.langs):
            n = np.zeros(CELLS)
            n[totals[lang][0]] = totals[lang][1]
            row[:] = np.log((n + alpha) / (n.sum() + alpha * CELLS))

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (spans x languages) of the texts' spans, and each text's first span (n+1 numbers)."""
        raw = [b" " + t.encode() + b"  " for t in texts]  # the last trigrams of a text reach into its own padding only
        sizes = np.array([len(r) - 2 for r in raw])
        c = cells(b"".join(raw))
        text_start = np.concatenate(([0], np.cumsum(sizes + 2)))
        n = -(-sizes // SPAN)
        first = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(first[-1]) - np.repeat(first[:-1], n)
        begin = np.repeat(text_start[:-1], n) + inside * SPAN
        end = np.minimum(begin + SPAN, np.repeat(text_start[:-1] + sizes, n))
        cuts = np.stack([begin, end], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(c) else cuts
        return np.stack([np.add.reduceat(t[c], cuts)[::2] for t in self.table], 1), first

    def mixtures(self, texts: list[str]) -> np.ndarray:
        """Proportions (texts x languages), zero outside the chosen set."""
        ll, first = self.spans(texts)
        top = ll.max(axis=1)
        base, like, n = np.add.reduceat(top, first[:-1]), np.exp(ll - top[:, None]), np.diff(first)
        full, _ = settled(like, n, np.ones((len(n), len(self.langs))))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        best, best_value = full.copy(), np.full(len(n), -np.inf)
        going = np.arange(len(n))
        for size in range(1, len(self.langs) + 1):
            part = like[np.repeat(np.isin(np.arange(len(n)), going), n)] if len(going) < len(n) else like
            w, value = settled(part, n[going], (rank[going] < size).astype(float))
            value = base[going] + value - size * PENALTY * np.log2(n[going] + 1)
            better = value > best_value[going]
            best[going[better]], best_value[going[better]] = w[better], value[better]
            going = going[better]  # a set that gains nothing ends the search
            if not len(going):
                break
        return best

    def predict(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """Each text's languages with their proportions, largest first, equal ones by name; none for texts without a letter."""
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        some = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        if some:
            for i, w in zip(some, self.mixtures([texts[i] for i in some])):
                out[i] = [(self.langs[j], min(1.0, float(w[j]))) for j in np.argsort(-w, kind="stable") if w[j] > 0]
        return out


def settled(like: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each text's proportions over its allowed languages until no proportion of the text changes by
    more than SETTLED, and the log-likelihoods. ``n`` are the texts' spans, like has a row for each."""
    w = allowed / allowed.sum(axis=1, keepdims=True)
    left, rows, sizes = np.arange(len(n)), like, n
    while len(left):
        begin = np.cumsum(sizes) - sizes
        p = rows * np.repeat(w[left], sizes, axis=0)
        p /= p.sum(axis=1, keepdims=True) + 1e-300
        new = np.add.reduceat(p, begin, axis=0) / sizes[:, None]
        moved = np.abs(new - w[left]).max(axis=1) > SETTLED
        w[left] = new
        if not moved.all():
            rows, left, sizes = rows[np.repeat(moved, sizes)], left[moved], sizes[moved]
    begin = np.cumsum(n) - n
    return w, np.add.reduceat(np.log((like * np.repeat(w, n, axis=0)).sum(axis=1) + 1e-300), begin)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows with a text and a language. Counts come to the driver added up, as arrays: at most 65,536 cells a language."""
    table = counts(docs, text_col, lang_col).groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns")).toArrow()
    return Model({lang.as_py(): (c.values.to_numpy(), k.values.to_numpy()) for lang, c, k in zip(*table.columns)})


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, languages (lang and share, largest share first) for each row; learns from the rows where ``learn`` holds.

    ``und`` with score 0 and no languages for null texts, texts without a letter, and if
    nothing could be learned. Equal proportions: the language first in order of names.
    Whole texts of any length. Repeated rows and null ids are rows like others; an empty
    table gives an empty one; other columns, whatever their names, are not read.
    """
    model = learned(docs.where(learn), text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    limit = (4 << 20) // max(1, len(model.langs) // 8)  # what is held at once grows with spans times languages

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), limit):
                found = sent.value.predict(batch.column(1).slice(lo, hi - lo).to_pylist())
                rows = [{"doc_id": i, "lang_pred": x[0][0] if x else "und", "score": x[0][1] if x else 0.0, "languages": [{"lang": a, "share": b} for a, b in x]} for i, x in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), found)]
                yield pa.RecordBatch.from_pylist(rows, RESULT)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns where crc32(doc_id) mod 4 is not 2."""
    out = identify(docs, fold_of("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
