"""Benchmark decontamination by winnowing, in DataFrame operations only.

A run of ``span`` words shared by a document and a benchmark item contains
``span - gram + 1`` grams of ``gram`` words, and both sides keep the grams whose
hash is the least of any that many in a row (all of them if equal), so both keep
a common one: no shared run is missed. Kept grams are joined by hash; each hit
is extended over the words around it, word for word, to the runs of ``span``
words that contain it. Items shorter than ``span`` are one gram each.

Documents are cut into pieces that overlap by ``span - 1`` words, so every run
lies in one piece and arrays stay short whatever a text's length. A kept gram
takes only the few words around it to the join, never its text.

The benchmark's kept grams are counted first. Up to ``few`` of them are sent to
all tasks and also tested inside the piece, before rows are made. Beyond that a
filter of SLOTS rows of 64 bits, whatever their number, is sent instead: documents'
grams that set none of its bits are dropped where they are, and only the others go
to the shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stored, whole_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = 512
#: Rows of the filter (a power of two): 2^20 rows of two longs stay under 64 MB in a task; 64 bits each tell 10 million grams from others 6 times in 7.
SLOTS = 1 << 20
#: All but ASCII digits and letters and what is outside ASCII separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(column: str) -> str:
    """SQL for a text's words, A-Z lowered; a null text has none. Words in ASCII take the fast way."""
    return (
        f"transform(array_remove(split(coalesce({column}, ''), r'{SEPARATOR}'), ''), "
        f"w -> if(length(w) = octet_length(w), lower(w), translate(w, '{UPPER}', '{LOWER}')))"
    )


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and uses it in body under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def grams(array: str, gram: int) -> str:
    """SQL for the hashes of all grams of an array of words (none if it is shorter)."""
    parts = ", ".join(f"get(wh, i + {j})" for j in range(gram))
    return let(
        f"transform({array}, w -> xxhash64(w))",
        "wh",
        f"if(size(wh) >= {gram}, transform(sequence(0, size(wh) - {gram}), i -> xxhash64({gram}, {parts})), cast(array() as array<bigint>))",
    )


def kept(kh: str, p: str, run: int) -> str:
    """SQL: is gram p the least of some run of grams that holds it? Runs cut off by an end count too."""
    if run == 1:
        return "true"
    mins = [f"least({', '.join(f'get({kh}, {p} - {j} + {i})' for i in range(run))})" for j in range(run)]
    return f"get({kh}, {p}) = greatest({', '.join(mins)})"


def picked(array: str, gram: int, span: int, test: str = "true") -> str:
    """SQL for the kept grams of an array of words: fp, kk (the span, which tells kinds of items apart), pos, ctx (the words up to span - gram before and after), lead (how many before)."""
    around = span - gram
    ctx = f"slice({array}, greatest(p - {around}, 0) + 1, least(p, {around}) + {gram + around})"
    body = (
        f"if(size(kh) = 0, array(), transform(filter(sequence(0, size(kh) - 1), p -> {test.format(x='get(kh, p)')} and {kept('kh', 'p', around + 1)}), "
        f"p -> struct(get(kh, p) as fp, {span} as kk, p as pos, {ctx} as ctx, least(p, {around}) as lead, 0 as n)))"
    )
    empty = "cast(array() as array<struct<fp:bigint,kk:int,pos:int,ctx:array<string>,lead:int,n:int>>)"
    return let(grams(array, gram), "kh", body.replace("array(), transform", f"{empty}, transform", 1))


def families(lengths: list[int], gram: int, span: int) -> list[tuple[int, int]]:
    """(gram, span) for each kind of item: the long ones, and each length under span that occurs."""
    return [(gram, span)] * any(n >= span for n in lengths) + [(n, n) for n in sorted({n for n in lengths if 0 < n < span})]


def item_grams(benchmark: DataFrame, gram: int, span: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(words("text")).alias("ws")).where("size(ws) > 0")
    own = stored(own, "items")
    lengths = [r[0] for r in own.select(F.least(F.size("ws"), F.lit(span))).distinct().collect()]  # at most span values
    kinds = families(lengths, gram, span)
    out = None
    for g, s in kinds:
        mine = own.where(f"size(ws) >= {span}" if (g, s) == (gram, span) else f"size(ws) = {s}")
        rows = mine.select("item", F.explode(F.expr(picked("ws", g, s))).alias("g")).select("item", "g.fp", "g.kk", F.col("g.ctx").alias("i_ctx"), F.col("g.lead").alias("i_lead")).distinct()
        out = rows if out is None else out.union(rows)
    if out is None:
        out = own.select("item", F.lit(0).cast("long").alias("fp"), F.lit(0).alias("kk"), F.col("ws").alias("i_ctx"), F.lit(0).alias("i_lead")).limit(0)
    return stored(out, "item-grams"), kinds


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = 7, span: int = 10, few: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """For each row of docs: doc_id, key, n_words, hits (array of start, n_words of shared runs in order), items (ids as strings, sorted).

    A null or empty text has no words and no hits; items without words match nothing;
    an item without an id hits words but is not listed; of items with one id each adds
    its runs. Repeated rows of docs give repeated rows. Empty tables are allowed on
    either side. Other columns are not read.
    """
    found, kinds = item_grams(benchmark, gram, span)
    small = found.count() <= few
    tests = {}
    for _, s in kinds:
        fps = [str(r[0]) for r in found.where(F.col("kk") == s).select("fp").distinct().collect()] if small else []
        tests[s] = f"{{x}} in ({', '.join(fps)})" if fps else "true"
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col).alias("key"), F.expr(words("text")).alias("ws"))
    starts = f"if(size(ws) = 0, array(0), sequence(0, size(ws) - 1, {PIECE}))"
    pieces = cut.select("doc_id", "key", F.posexplode(F.expr(f"transform({starts}, s -> slice(ws, s + 1, {PIECE + span - 1}))")).alias("at", "piece"))
    head = f"array(struct(xxhash64(key, at) as fp, -1 as kk, 0 as pos, cast(array() as array<string>) as ctx, 0 as lead, least(size(piece), {PIECE}) as n))"
    # the last words of a piece belong to the next one's count, unless there is none: size(piece) is then at most PIECE or the rest follows as a piece
    parts = ", ".join([head, *(picked("piece", g, s, tests[s]) for g, s in kinds)])
    rows = pieces.select("doc_id", "key", "at", F.explode(F.expr(f"concat({parts})")).alias("g")).select("doc_id", "key", "at", "g.*")
    if not small:
        slot, bit = f"fp & {SLOTS - 1}", "shiftleft(1L, cast(shiftrightunsigned(fp, 40) & 63 as int))"
        bits = found.select(F.expr(slot).alias("slot"), F.expr(bit).alias("bit")).groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits"))
        rows = rows.withColumn("slot", F.expr(slot)).join(F.broadcast(bits), "slot", "left").where(f"kk = -1 or bits & {bit} <> 0").drop("slot", "bits")
    joined = rows.join(F.broadcast(found) if small else found, ["fp", "kk"], "left")
    checks = "cast(array() as array<int>)"
    for g, s in kinds:
        same = f"slice(ctx, lead - o + 1, {s})"
        checks = (
            f"if(kk = {s}, filter(sequence(0, {s - g}), o -> lead >= o and i_lead >= o and size({same}) = {s} and {same} = slice(i_ctx, i_lead - o + 1, {s})), {checks})"
        )
    hit = joined.select(
        "doc_id",
        "key",
        "item",
        "n",
        F.expr("kk = -1 and at = 0").alias("first"),
        F.expr(f"if(item is null and i_ctx is null, null, transform({checks}, o -> struct(at * {PIECE} + pos - o as start, kk as n_words)))").alias("hits"),
    )
    found_hit = F.size("hits") > 0
    out = hit.groupBy("doc_id", "key").agg(
        F.sum("n").alias("n"),
        F.count(F.when(F.col("first"), 1)).alias("copies"),
        F.collect_set(F.when(found_hit, F.col("item"))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(found_hit, F.col("hits")))))).alias("hits"),
    )
    return out.select("doc_id", "key", F.expr("cast(n div copies as bigint)").alias("n_words"), "hits", F.array_sort("items").alias("items"), F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def hit_words() -> str:
    """SQL: how many words the runs in hits cover."""
    return (
        "aggregate(hits, struct(0L as total, 0L as reach), (acc, h) -> struct("
        "acc.total + greatest(0L, h.start + h.n_words - greatest(cast(h.start as bigint), acc.reach)) as total, greatest(acc.reach, cast(h.start + h.n_words as bigint)) as reach), acc -> acc.total)"
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs, benchmark).select("doc_id", "n_words", F.expr(hit_words()).alias("n_hit"), "items")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that share no run with the benchmark."""
    i, k = fresh(docs, "id", "key")
    bad = contamination(docs, benchmark).where("size(hits) > 0").select(whole_id().alias(i), F.col("key").alias(k)).distinct()
    return docs.withColumns({i: whole_id(), k: row_key()}).join(bad, [i, k], "left_anti").select(*docs.columns)
