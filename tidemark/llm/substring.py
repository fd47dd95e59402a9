"""Exact substring deduplication over fixed windows of words.

Every window of ``size`` words has a Rabin-Karp hash, rolled in numpy over a
whole batch of texts. Windows are counted in Spark. To count them without a row
for each, neighbouring windows travel together: those with the same anchor (the
least hash of a shorter run of words inside them, leftmost if equal) form a
segment, and equal windows have equal anchors, so a bucket of anchors sees all
copies of its windows, which are told by 64 bits of their own hash. As a bucket holds
a bounded number of windows, N windows give about N/2^46 false repeats in all. A window that a batch
holds more than once is known to repeat before the shuffle and is sent once for
the batch, so no passage, however common, fills a bucket. Different windows around
a common anchor could: a first pass counts each bucket's windows, and a bucket with
more than ``limit`` is split by the windows' own hashes, so equal windows still meet.

A text is taken in runs of words that overlap by a window less one, so what is held
at once does not grow with it; whether windows are equal does not depend on the cuts.

Repeated windows come back as bits of their segment, merge into maximal
intervals for each document, and the words they cover are removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, offsets_of, row_key, text_slices, whole_id

U = np.uint64
#: Bytes of texts that are taken at once; of a longer text, a run has an eighth as many words.
PIECE = 4 << 20
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (xor-shift and odd products)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Powers of an odd base modulo 2**64 and of its inverse, kept and lengthened as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(n, self.base, U)
            step[0] = 1
            back = np.full(n, self.inverse, U)
            back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]

    def hashes(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[starts:ends], wherever it stands."""
        up, down = self.of(len(values))
        total = np.concatenate((np.zeros(1, U), np.cumsum(values * up)))
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


BYTES, WORDS = Roller(BASE), Roller(WORD_BASE)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTE_VALUE = mixed(np.arange(1, 257, dtype=U))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words of texts that lie end to end in data, and each text's first word (n+1 numbers)."""
    ink = ~SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate(([False], ink[:-1]))
    starts = np.flatnonzero(ink & (fresh[:-1] | ~before))
    after = np.concatenate((ink[1:], [False]))
    ends = np.flatnonzero(ink & (fresh[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and each text's first word."""
    starts, ends, first = word_places(data, offsets)
    return BYTES.hashes(BYTE_VALUE[data], starts, ends), first


def least_place(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, leftmost of equals (hashes cut to 40 bits, a place needs 24)."""
    if len(h) > 1 << 24:
        raise ValueError("places have 24 bits: take shorter runs")
    x = (h >> U(24) << U(24)) | np.arange(len(h), dtype=U)
    done = 1
    out = x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return (out & U((1 << 24) - 1)).astype(np.int64)


def segments(words: np.ndarray, first: np.ndarray, size: int, gram: int):
    """Windows of a batch: their hashes, first words and segment numbers, and each segment's anchor, document, first window."""
    n = len(words) - size + 1
    if n <= 0:
        return None
    at = np.arange(n)
    doc = np.searchsorted(first, at, side="right") - 1
    valid = at + size <= first[doc + 1]
    if not valid.any():
        return None
    grams = np.arange(len(words) - gram + 1)
    anchors = WORDS.hashes(words, grams, grams + gram)
    place = least_place(anchors, size - gram + 1)[valid]
    at, doc = at[valid], doc[valid]
    hashes = WORDS.hashes(words, at, at + size)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    begin = np.flatnonzero(new)
    return hashes, at, np.cumsum(new) - 1, anchors[place[begin]], doc[begin], at[begin], begin


SENT = "bucket int, ids array<long>, keys array<long>, starts array<int>, masks array<int>, known array<int>, hashes array<long>"


def lists(column: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(column, kind))


def sliced(texts: pa.Array, size: int, gram: int, piece: int = PIECE):
    """For each slice of texts that has windows: its rows, the number of the texts' first words (under zero in a run further on), and segments()."""
    for lo, hi in text_slices(texts, piece):
        part = texts.slice(lo, hi - lo)
        offsets = offsets_of(part)
        data = bytes_of(part)[offsets[0] : offsets[-1]]
        if not len(data):
            continue
        if len(data) <= piece:
            words, first = words_of(data, offsets - offsets[0])
            found = segments(words, first, size, gram)
            if found is not None:
                yield lo, hi, first, found
            continue
        starts, ends, _ = word_places(data, np.array([0, len(data)]))  # one text
        run = max(1, piece // 8)
        for at in range(0, len(starts) - size + 1, run):
            s, e = starts[at : at + run + size - 1], ends[at : at + run + size - 1]
            words = BYTES.hashes(BYTE_VALUE[data[s[0] : e[-1]]], s - s[0], e - s[0])
            found = segments(words, np.array([0, len(words)]), size, gram)
            if found is not None:
                yield lo, hi, np.array([-at, len(words)]), found


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> U(20)) % U(buckets)).astype(np.int64)


def shipped(texts: pa.Array, ids: np.ndarray, keys: np.ndarray, size: int, gram: int, parts: np.ndarray, piece: int = PIECE):
    """Rows for the shuffle: for each bucket and part of it the windows that fall in it, by segments; bucket -1-b: what this batch alone has decided.

    parts has each bucket's number of parts; part k of bucket b is sent as bucket b + k * len(parts).
    """
    buckets = len(parts)
    for lo, hi, first, found in sliced(texts, size, gram, piece):
        hashes, at, seg, anchor, doc, start, begin = found
        bit = (np.arange(len(hashes)) - begin[seg]).astype(np.int64)
        _, first_of, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        again = count[back] > 1
        power = np.int64(1) << bit
        known = np.add.reduceat(np.where(again, power, 0), begin)
        row, key = ids[lo:hi][doc], keys[lo:hi][doc]
        offset = (start - first[doc]).astype(np.int32)
        lone = np.sort(first_of)
        bucket = bucket_of(anchor, buckets)[seg[lone]]
        bucket += buckets * (hashes[lone] % parts[bucket].astype(U)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        lone, bucket = lone[order], bucket[order]
        rows = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(seg[lone], prepend=-1) != 0))  # a segment's windows in one part
        edges = np.flatnonzero(np.diff(bucket[rows], prepend=-1))
        cuts = np.concatenate((edges, [len(rows)]))
        of = seg[lone[rows]]
        bits = lambda on: np.add.reduceat(np.where(on, power[lone], 0), rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[rows][edges].astype(np.int32)),
                lists(row[of], cuts, pa.int64()),
                lists(key[of], cuts, pa.int64()),
                lists(offset[of], cuts, pa.int32()),
                lists(bits(True), cuts, pa.int32()),
                lists(bits(again[lone]), cuts, pa.int32()),
                lists(hashes[lone].view(np.int64), np.append(rows, len(lone))[cuts], pa.int64()),
            ],
            names=["bucket", "ids", "keys", "starts", "masks", "known", "hashes"],
        )
        told = np.flatnonzero(known)
        if len(told):
            none = lambda kind: pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], kind))
            ends = np.array([0, len(told)])
            where = -1 - int(anchor[0] % U(buckets))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([where], pa.int32()),
                    lists(row[told], ends, pa.int64()),
                    lists(key[told], ends, pa.int64()),
                    lists(offset[told], ends, pa.int32()),
                    none(pa.int32()),
                    lists(known[told].astype(np.int32), ends, pa.int32()),
                    none(pa.int64()),
                ],
                names=["bucket", "ids", "keys", "starts", "masks", "known", "hashes"],
            )


def repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which windows of its segments occur again, as bits of each segment."""
    join = lambda c, t: np.concatenate([np.asarray(v, t) for v in rows[c]]) if len(rows) else np.zeros(0, t)
    ids, keys, starts, known = join("ids", np.int64), join("keys", np.int64), join("starts", np.int32), join("known", np.int32)
    if rows["bucket"].iloc[0] < 0:
        return pd.DataFrame({"id": ids, "key": keys, "start": starts, "bits": known})
    masks, hashes = join("masks", np.int32).view(np.uint32), join("hashes", np.int64).view(U)
    per = np.bitwise_count(masks).astype(np.int64)
    seg = np.repeat(np.arange(len(masks)), per)
    begin = np.cumsum(per) - per
    bit = np.nonzero(np.unpackbits(masks.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))[1].astype(np.uint32)
    _, back = np.unique(hashes, return_inverse=True)
    count = np.bincount(back)
    more = np.bincount(back, weights=(known.view(np.uint32)[seg] >> bit) & 1, minlength=len(count))
    hit = (count + more)[back] > 1
    out = np.add.reduceat(np.where(hit, np.int64(1) << bit.astype(np.int64), 0), begin) if len(begin) else np.zeros(0, np.int64)
    on = out > 0
    return pd.DataFrame({"id": ids[on], "key": keys[on], "start": starts[on], "bits": out[on].astype(np.int32)})


def covered(n: int, starts, bits, size: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    change = np.zeros(n + 1, np.int64)
    s, b = np.asarray(starts, np.int64), np.asarray(bits, np.int64).astype(np.uint32)
    row, bit = np.nonzero((b[:, None] >> np.arange(32, dtype=np.uint32)) & 1)
    at = s[row] + bit
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def bucket_parts(texts: DataFrame, size: int, gram: int, buckets: int, limit: int, piece: int = PIECE) -> np.ndarray:
    """How many parts each bucket takes so that none has many more windows than limit; only buckets with more come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, (_, _, seg, anchor, *_) in sliced(batch.column(0), size, gram, piece):
                total += np.bincount(bucket_of(anchor, buckets)[seg], minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], names=["bucket", "n"])

    parts = np.ones(buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect():
        parts[bucket] = min(-(-n // limit), ((1 << 31) - 1) // buckets)  # a bucket's number is an int
    return parts


def repeated_windows(docs: DataFrame, size: int = 35, gram: int = 12, buckets: int | None = None, limit: int = 1 << 19, piece: int = PIECE) -> DataFrame:
    """id and key (whole_id, row_key), start (of a segment, in words) and bits (which of its windows repeat), docs being doc_id and text.

    ``size - gram`` is at most 30, as a segment's windows are bits of an int.
    """
    if not 1 <= size - gram <= 30:
        raise ValueError("size - gram must be from 1 to 30")
    buckets = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    texts = docs.select(whole_id().alias("id"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    parts = docs.sparkSession.sparkContext.broadcast(bucket_parts(texts.select("text"), size, gram, buckets, limit, piece))

    def run(batches):
        for batch in batches:
            yield from shipped(batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy(), size, gram, parts.value, piece)

    sent = texts.mapInArrow(run, SENT)
    back = sent.groupBy("bucket").applyInPandas(repeated, "id long, key long, start int, bits int")
    return back.groupBy("id", "key", "start").agg(F.bit_or("bits").alias("bits"))


def kept_words(text: bytes, gone: np.ndarray | None) -> bytes:
    """The words that stay, one space between, put together in runs."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_places(data, np.array([0, len(data)]))
    if gone is not None:
        starts, ends = starts[~gone], ends[~gone]
    runs = [b" ".join([text[a:b] for a, b in zip(starts[lo : lo + 65536].tolist(), ends[lo : lo + 65536].tolist())]) for lo in range(0, len(starts), 65536)]
    return b" ".join(runs)


def deduplicated(docs: DataFrame, size: int = 35, gram: int = 12, piece: int = PIECE) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept (the words left, one space between).

    A word goes if a window of ``size`` words that covers it starts anywhere else too,
    judged on the input. Rows count by themselves: of repeated rows all windows repeat.
    Null or empty texts and texts shorter than a window keep their words. Null ids are
    kept. Texts of any length. An empty table gives an empty one; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_windows(docs, size, gram, piece=piece).groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "bits"))).alias("found"))
    found = found.select("id", "key", F.col("found.start").alias("starts"), F.col("found.bits").alias("bits"))

    def run(batches):
        for batch in batches:
            ids, texts, starts, bits = batch.columns
            n_words, n_removed, kept = [], [], []
            for i in range(len(ids)):
                text, s = (texts[i].as_py() or "").encode(), starts[i].values
                if len(text) <= piece:
                    words = text.split()
                    n = len(words)
                else:
                    words = None
                    n = len(word_places(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
                gone = None if s is None else covered(n, s.to_numpy(), bits[i].values.to_numpy(), size)
                n_words.append(n)
                n_removed.append(0 if gone is None else int(gone.sum()))
                if words is None:
                    kept.append(kept_words(text, gone))
                else:
                    kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = docs.select("*", whole_id().alias("id"), row_key().alias("key")).join(found.hint("shuffle_hash"), ["id", "key"], "left")
    return joined.select("doc_id", "text", "starts", "bits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_digest(docs: DataFrame, size: int = 35) -> DataFrame:
    return deduplicated(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

