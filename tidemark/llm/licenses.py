"""License scans by MinHash bands over text windows, in DataFrame operations only.

Templates are grouped by length. For each group a text has windows twice as long
as its longest template that overlap by half, so a notice of that length lies in
one of them. A window and a template that reaches ``containment`` in it have at
least a known Jaccard similarity of their word shingles; the number of one-row
bands is set so that such a pair shares none with a probability of ``miss`` at
most. Windows without any template shingle can contain none and are not hashed.
What the bands retrieve is verified by exact containment of shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import grams, words
from .license_texts import TEMPLATES

SHINGLE = 5
PIECE = 2048
#: Words under which a template must be there whole: notices of two licenses may differ in their last word only.
WHOLE = 16
#: Shingle hashes of the templates' bands (8 bytes each) up to which they are broadcast; more go through a shuffle join.
BROADCAST = 8_000_000

def template_table(spark: SparkSession, templates: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """license, n_words, shingles of each text of at least SHINGLE words; a license may have several. The table has a row for each text given, whatever the documents."""
    texts = [(name, text) for name, some in sorted(templates.items()) for text in ([some] if isinstance(some, str) else some)]
    rows = spark.createDataFrame(texts, "license string, text string").select("license", F.expr(words("text")).alias("ws"))
    return rows.where(F.size("ws") >= SHINGLE).select("license", F.size("ws").alias("n_words"), F.array_distinct(F.expr(grams("ws", SHINGLE))).alias("shingles"))


def groups(templates: list, containment: float, miss: float) -> list[tuple[int, int]]:
    """(words of a window, bands) for each group of templates; groups are by powers of two of the length."""
    out: dict[int, int] = {}
    for t in templates:
        half = max(8, 1 << (t["n_words"] - 1).bit_length())
        window = 2 * half - SHINGLE + 1
        common = math.ceil(containment * len(t["shingles"]))
        least = common / (window + len(t["shingles"]) - common)
        out[half] = max(out.get(half, 0), math.ceil(math.log(miss) / math.log(1 - least)) if least < 1 else 1)
    return sorted((2 * half, bands) for half, bands in out.items())


def licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """For each row of docs: doc_id, n_words, found (array of license, containment, by name; the best window's).

    Null and empty texts have no words and no licenses. Repeated rows, null ids and an
    empty table are as for any row-wise operator. Templates under five words are left
    out. Other columns are not read.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    rows = table.collect()
    kinds = groups(rows, containment, miss)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"), F.expr(words("text")).alias("ws"))
    widest = max((w for w, _ in kinds), default=SHINGLE)
    starts = f"if(size(ws) = 0, array(0), sequence(0, size(ws) - 1, {PIECE}))"
    pieces = cut.select("doc_id", "key", F.posexplode(F.expr(f"transform({starts}, s -> slice(ws, s + 1, {PIECE + widest}))")).alias("at", "piece"))
    known = sorted({s for r in rows for s in r["shingles"]})
    if not known:
        known = [0]
    hashed = pieces.select("doc_id", "key", "at", F.least(F.size("piece"), F.lit(PIECE)).alias("n"), F.explode(F.array(F.expr(grams("piece", SHINGLE)))).alias("sh"))
    hit = hashed.select("*", F.expr(f"filter(if(size(sh) = 0, cast(array() as array<int>), sequence(0, size(sh) - 1)), p -> get(sh, p) in ({', '.join(map(str, known))}))").alias("hit"))
    none = "cast(array() as array<struct<width:int,band:int,value:bigint,shingles:array<bigint>>>)"
    parts = [none]
    for width, bands in kinds:
        # windows that hold a hit: the one it is in the first half of, and the one before
        where = f"array_distinct(filter(flatten(transform(hit, p -> array(p div {width // 2}, p div {width // 2} - 1))), x -> x >= 0 and x * {width // 2} < {PIECE}))"
        parts.append(
            f"flatten(transform({where}, x -> element_at(transform(array(array_distinct(slice(sh, cast(x * {width // 2} + 1 as int), {width - SHINGLE + 1}))), "
            f"s -> transform(sequence(0, {bands - 1}), b -> struct({width} as width, b as band, array_min(transform(s, v -> xxhash64(b, v))) as value, s as shingles))), 1)))"
        )
    head = "array(struct(0 as width, -1 as band, xxhash64(key, at) as value, cast(array() as array<bigint>) as shingles))"
    bands = hit.select("doc_id", "key", "at", "n", F.explode(F.expr(f"concat({head}, if(size(hit) = 0, {none}, concat({', '.join(parts)})))")).alias("b"))
    least = F.when(F.col("n_words") < WHOLE, 1.0).otherwise(containment)
    signed = table.select("license", F.col("shingles").alias("t"), least.alias("least"), F.expr("case " + " ".join(f"when n_words <= {w // 2} then {w}" for w, _ in kinds) + " else 0 end" if kinds else "0").alias("width"))
    most = {w: b for w, b in kinds}
    sized = " ".join(f"when width = {w} then {b - 1}" for w, b in most.items())
    signed = signed.select("license", "t", "least", "width", F.explode(F.expr(f"sequence(0, case {sized} else 0 end)" if most else "array(0)")).alias("band"))
    signed = stored(signed.select("license", "t", "least", "width", "band", F.expr("array_min(transform(t, v -> xxhash64(band, v)))").alias("value")), "templates")
    flat = bands.select("doc_id", "key", "at", "n", "b.*")
    held = sum(len(r["shingles"]) * next(b for w, b in kinds if r["n_words"] <= w // 2) for r in rows)  # hashes that the bands of all templates hold
    joined = flat.join(F.broadcast(signed) if held <= BROADCAST else signed, ["width", "band", "value"], "left")
    share = joined.select(
        "doc_id", "key", F.expr("if(band = -1, n, 0)").alias("n"), F.expr("band = -1 and at = 0").alias("first"), "license", "least",
        F.expr("size(array_intersect(shingles, t)) / size(t)").alias("share"),
    )
    good = F.when(F.col("share") >= F.col("least"), F.struct("license", F.bround("share", 6).alias("containment")))
    out = share.groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.count(F.when(F.col("first"), 1)).alias("copies"), F.collect_set(good).alias("all"))
    best = "transform(array_sort(array_distinct(transform(all, x -> x.license))), l -> struct(l as license, array_max(transform(filter(all, x -> x.license = l), x -> x.containment)) as containment))"
    return out.select("doc_id", F.expr("cast(n div copies as bigint)").alias("n_words"), F.expr(best).alias("found"), F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def licenses_digest(docs: DataFrame) -> DataFrame:
    return licenses(docs).select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_licenses"), F.expr("array_join(found.license, ',')").alias("licenses"),
        F.expr("coalesce(array_max(found.containment), 0D)").alias("containment"),
    )
