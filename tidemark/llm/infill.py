"""Fill-in-the-middle transformation by bit-parallel operations on big integers.

A text's bytes become class masks by ``bytes.translate``: integers whose bit 8i tells whether
byte i is of the class. Shifted boolean operations on them mark boundaries (where a code point
begins, where one of the three marks stands), ``bit_count`` gives the number of units, and the
byte at which the k-th unit begins is found by halving the mask again and again, going into the
half that holds the bit of that rank. Every step is a pass of C code over the bytes, and the
halves add up to two passes, so a long text takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")


def table(members) -> bytes:
    return bytes(1 if b in members else 0 for b in range(256))


#: All but the bytes that continue a code point in UTF-8.
STARTS = table({b for b in range(256) if b & 0xC0 != 0x80})
OPENS, LETTERS, CLOSES = table({0x3C}), table({PREFIX[1], SUFFIX[1], MIDDLE[1]}), table({0x3E})


def mask(data: bytes, members: bytes) -> int:
    return int.from_bytes(data.translate(members), "little")


def marks(data: bytes) -> int:
    """Bit 8i: one of the three marks begins at byte i."""
    opens = mask(data, OPENS)
    return opens and opens & (mask(data, LETTERS) >> 8) & (mask(data, CLOSES) >> 16)


def select(bits: int, width: int, rank: int) -> int:
    """The byte of the bit number ``rank`` (from 0) of a mask over ``width`` bytes; width if there are not so many."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << 8 * half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> 8 * half, width - half, rank - n, at + half
    return at


def lottery(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned numbers of 32 bits from the SHA-256 of seed and decimal id (nothing for null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def fill_in(data: bytes, doc_id: int | None, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix and middle in code points, output of one text."""
    starts = mask(data, STARTS)
    n = starts.bit_count()
    h1, h2, h3, h4 = lottery(seed, doc_id)
    if not data or h3 % 100 >= plain_from or marks(data):
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = select(starts, len(data), a), select(starts, len(data), b)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text of an output. What lies between marks has none, and no mark can arise across a border, so the three marks are the first three."""
    if form == "plain":
        return output
    found, at = marks(output), []
    for _ in range(3):
        at.append(((found & -found).bit_length() - 1) // 8)
        found &= found - 1
    one, two, three = output[at[0] + 3 : at[1]], output[at[1] + 3 : at[2]], output[at[2] + 3 :]
    return one + three + two if form == "psm" else two + three + one


def fim_documents(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts code points. A null text is an empty one. A text is left plain if it is empty, holds
    one of the marks, or the third number drawn for its id leaves ``plain_from`` or more of 100; of
    the others those whose fourth leaves less than ``spm_below`` begin with the suffix. Draws
    depend on seed and id only: rows that repeat an id share them, a null id counts as empty. Other
    columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                ids, texts = batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].cast(pa.binary()).to_pylist()
                rows = [(i, *fill_in(t or b"", i, seed, plain_from, spm_below)) for i, t in zip(ids, texts)]
                columns = list(zip(*rows)) or [()] * len(arrow)
                columns[5] = pa.array(columns[5], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def with_restored(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """rows, all their columns, with the text rebuilt from output and form; null where either is."""
    ship(rows.sparkSession)
    (new,) = fresh(rows, name)

    @F.udf("string", useArrow=True)
    def rebuilt(o, f):
        return None if o is None or f is None else restore(o.encode(), f).decode()

    return rows.withColumn(new, rebuilt(F.col(output), F.col(form)))


def sha(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def fim_digest(docs: DataFrame) -> DataFrame:
    out = with_restored(fim_documents(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
