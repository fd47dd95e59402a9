"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans come from fixed patterns. A pattern's matches and what lies between
them (``regexp_extract_all`` and ``split``) give positions by adding up lengths.

Terms that stand in a text with a protected value can give it away once it is
removed. For a term t and a value e the corpus tells how likely a text with t holds
e, p(e|t), and how many bits t tells about e, log2 p(e|t)/p(e), both over whole texts.
Terms that reach both thresholds and were seen between enough different words are
spans too, wherever they stand in a text that holds e. Different words are counted
once a text that holds e (so copies, exact or near, count once), or among all
places within CONTEXT of e if that gives more. Document frequencies of such terms are
counted over all documents.

Values that stand in the same texts have the same counts with every term, so terms are counted
with groups of such values: a list of a thousand addresses and its copies are one group, and
a text makes its terms times its groups of rows, not times its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stored, whole_id
from .decontaminate import words

# The kinds in order, what a text must contain, the pattern. Look-behinds and possessive
# quantifiers change no match; they keep long runs from being tried at each of their characters.
KINDS = (
    ("email", "instr(text, '@') > 0", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "digits", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "digits", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", "digits and instr(text, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters before and after a value in which each place of a term counts by itself.
CONTEXT = 60
SPAN = "start:bigint,rank:int,kind:string,stop:bigint,value:string"


def positions(pattern: str, kind: str, rank: int, text: str = "text") -> str:
    """SQL: the pattern's matches in text as spans, in order."""
    return (
        f"element_at(transform(array(struct(regexp_extract_all({text}, {pattern}, 0) as hits, split({text}, {pattern}, -1) as gaps)), "
        f"q -> aggregate(sequence(1, size(q.hits)), struct(0L as at, cast(array() as array<struct<{SPAN}>>) as out), (acc, i) -> struct("
        f"acc.at + length(q.gaps[i - 1]) + length(q.hits[i - 1]) as at, "
        f"concat(acc.out, array(struct(acc.at + length(q.gaps[i - 1]) as start, {rank} as rank, {kind} as kind, acc.at + length(q.gaps[i - 1]) + length(q.hits[i - 1]) as stop, q.hits[i - 1] as value))) as out), "
        f"acc -> acc.out)), 1)"
    )


def valid() -> str:
    """SQL on a span s: what its pattern alone does not say."""
    digits = "regexp_replace(s.value, r'[^0-9]', '')"
    luhn = (
        f"element_at(transform(array({digits}), d -> aggregate(sequence(1, length(d)), 0, (sum, i) -> sum + element_at(transform(array(cast(substring(d, length(d) - i + 1, 1) as int)), "
        "v -> if(i % 2 = 1, v, if(v > 4, 2 * v - 9, 2 * v))), 1)) % 10 = 0), 1)"
    )
    return (
        f"case s.kind when 'ip' then s.value rlike r'^{BYTE}(?:\\.{BYTE}){{3}}$' when 'card' then {luhn} "
        f"when 'phone' then length({digits}) between 9 and 15 else true end"
    )


def base_spans() -> str:
    """SQL on text and digits: the base spans by start, then kind."""
    none = f"cast(array() as array<struct<{SPAN}>>)"
    parts = [
        # an empty sequence would count down, so texts without a match are told apart first
        f"if({test} and text rlike r'{pattern}', {positions(f'''r'{pattern}' ''', f''' '{kind}' ''', rank)}, {none})"
        for rank, (kind, test, pattern) in enumerate(KINDS)
    ]
    return f"array_sort(filter(concat({', '.join(parts)}), s -> {valid()}))"


def beside(c: str = "c") -> str:
    """SQL on words ws and a place i: the words before and after, hashed."""
    return f"xxhash64(coalesce(get(ws, i - 1), ''), coalesce(get(ws, i + 1), '')) as {c}"


def text_terms() -> str:
    """SQL on text: its different terms, each with the least hash of the words beside it."""
    placed = f"element_at(transform(array({words('text')}), ws -> array_sort(transform(ws, (w, i) -> struct(w as term, {beside()})))), 1)"
    return f"element_at(transform(array({placed}), xs -> filter(xs, (x, i) -> i = 0 or get(xs, i - 1).term <> x.term)), 1)"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (spans) for each row, near (value, context words) of each base span, and terms (of the whole text) if it has any. A null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = rows.withColumn("digits", F.col("text").rlike("[0-9]")).withColumn("base", F.expr(base_spans()))
    left = f"substring(text, cast(greatest(s.start - {CONTEXT}, 0) + 1 as int), cast(least(s.start, {CONTEXT}) as int))"
    right = f"substring(text, cast(s.stop + 1 as int), {CONTEXT})"
    # a word cut off by the context's end is dropped with the piece it stands in
    context = f"concat(if(s.start > {CONTEXT}, regexp_replace({left}, r'^\\S*', ''), {left}), ' ', regexp_replace({right}, r'\\S*$', ''))"
    near = f"transform(base, s -> struct(concat(s.kind, ':', lower(s.value)) as value, {context} as context))"
    terms = f"if(size(base) > 0, {text_terms()}, cast(array() as array<struct<term:string,c:bigint>>))"
    return spans.select("doc_id", "key", "base", F.expr(near).alias("near"), F.expr(terms).alias("terms"))


def value_groups(rows: DataFrame) -> DataFrame:
    """value, group, with_value: values that the same texts hold share a group. rows: key, held. A group is told by how many texts hold it and two 64-bit sums over them."""
    each = rows.select("key", F.explode("held").alias("value"))
    two = each.groupBy("value").agg(F.count("*").alias("with_value"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64(F.lit(1), "key").cast("decimal(38,0)")).alias("s"))
    return stored(two.select("value", F.concat_ws(":", F.col("with_value").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")).alias("group"), "with_value"), "values")


def revealing(docs: DataFrame, base: DataFrame, support: int = 3, share: float = 0.5, bits: float = 4.0, few: int = 20_000) -> tuple[DataFrame, DataFrame] | None:
    """(value, group) and (group, term) of terms that reveal the values of a group; None if there are none. base is the stored result of found().

    A term that stands inside a value is none of its terms. Terms of one letter are terms like others.
    """
    seen = base.where("size(base) > 0").select("key", F.explode("near").alias("n")).select("key", "n.value", "n.context")
    ws = words("context")
    said = seen.select("value", F.explode(F.expr(f"element_at(transform(array({ws}), ws -> transform(ws, (w, i) -> struct(w as term, {beside()}))), 1)")).alias("t")).select("value", "t.*")
    close = said.where("not contains(value, term)").groupBy("value", "term").agg(F.count_distinct("c").alias("close")).where(F.col("close") >= support)
    rows = base.where("size(base) > 0").select("key", F.expr("array_distinct(near.value)").alias("held"), "terms").dropDuplicates(["key"])
    values = value_groups(rows)
    close = stored(close.join(values, "value").select("group", "term").distinct().withColumn("close", F.lit(True)), "close")
    # a value in fewer texts than support has as many contexts only by those close to it
    able = values.where(F.col("with_value") >= support).select("group").union(close.select("group")).distinct()
    held = rows.select("key", F.explode("held").alias("value")).join(values.select("value", "group"), "value").select("key", "group").distinct()
    held = held.join(able, "group").groupBy("key").agg(F.collect_list("group").alias("able"))
    both = rows.join(held, "key").select("terms", F.explode("able").alias("group")).select("group", F.explode("terms").alias("t")).select("group", "t.*")
    pairs = both.groupBy("group", "term").agg(F.count("*").alias("together"), F.count_distinct("c").alias("contexts"))
    pairs = pairs.join(close, ["group", "term"], "left").where((F.col("contexts") >= support) | F.col("close"))
    # a term is in no fewer documents than it is in with values of any kind, so most pairs are decided here
    least = rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("at_least"))
    pairs = pairs.join(least, "term").where(F.col("together") >= share * F.col("at_least")).select("group", "term", "together", F.coalesce("close", F.lit(False)).alias("close"))
    # some value of the group must not hold the term: the first and the last tell nearly always
    ends = values.groupBy("group").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("with_value").alias("with_value"))
    pairs = stored(pairs.join(ends, "group").withColumn("inside", F.expr("not close and contains(low, term) and contains(high, term)")).drop("low", "high"), "pairs")
    outside = pairs.where("inside").join(values.select("group", "value"), "group").where("not contains(value, term)").select("group", "term").distinct()
    pairs = pairs.where("not inside").unionByName(pairs.where("inside").join(outside, ["group", "term"], "left_semi")).drop("inside")
    terms = pairs.select("term").distinct()
    n = terms.count()
    if not n:
        return None
    told = docs.select(F.explode(F.expr(f"array_distinct({words('text')})")).alias("term"))
    if n <= few:
        counts = told.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    else:  # words are added up by each task before any are sent, so a common one is a row a task
        counts = told.groupBy("term").agg(F.count("*").alias("with_term")).join(terms, "term", "left_semi")
    total = base.count()
    gained = pairs.join(counts, "term").withColumn("p", F.col("together") / F.col("with_term"))
    gained = gained.where((F.col("p") >= share) & (F.log2(F.col("p") * total / F.col("with_value")) >= bits))
    gained = stored(gained.select("group", "term"), "revealing")
    return None if gained.isEmpty() else (values.select("value", "group"), gained)


def term_spans(docs: DataFrame, base: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, key and more (spans of kind term) for the rows that hold a revealed value: every place of its terms in the text."""
    held = base.where("size(base) > 0").select(whole_id().alias("id"), "key", F.explode("near.value").alias("value")).distinct()
    groups = held.join(values, "value").select("id", "key", "group").distinct()
    wanted = groups.join(pairs, "group").groupBy("id", "key").agg(F.collect_set("term").alias("terms"))
    texts = docs.select(whole_id().alias("id"), row_key().alias("key"), F.col("text").cast("string").alias("text")).join(wanted, ["id", "key"]).dropDuplicates(["id", "key"])
    letter = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]".replace("\\\\", "\\")
    pattern = f"concat(r'(?i)(?<!{letter})\\Q', t, r'\\E(?!{letter})')"
    each = f"if(text rlike {pattern}, {positions(pattern, ''' 'term' ''', len(KINDS))}, cast(array() as array<struct<{SPAN}>>))"
    return texts.select("id", "key", F.expr(f"flatten(transform(terms, t -> {each}))").alias("more"))


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """For each row of docs: doc_id, key, base and spans (base and term spans by start, then kind).

    A span is start, rank, kind, stop, value; positions are code points, stop exclusive.
    Null and empty texts have none. Repeated rows and null ids are rows like others; an
    empty table gives an empty one; other columns are not read.
    """
    base = stored(found(docs), "base-spans")
    pairs = revealing(docs, base, **thresholds)
    if pairs is None:
        return base.select("doc_id", "key", "base", F.col("base").alias("spans"))
    more = term_spans(docs, base, *pairs)
    return base.withColumn("id", whole_id()).join(more, ["id", "key"], "left").select("doc_id", "key", "base", F.expr(f"array_sort(concat(base, coalesce(more, cast(array() as array<struct<{SPAN}>>))))").alias("spans"))


def listed(column: str) -> str:
    return f"array_join(transform({column}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def pii_digest(docs: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, *_ in KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """docs, all their columns, with each span in text generalised to its kind in brackets (overlapping spans to the first one's); n_chars follows the text if there is such a column."""
    i, k, found = fresh(docs, "id", "key", "spans")
    change = spans(docs, **thresholds).where("size(spans) > 0").select(whole_id().alias(i), F.col("key").alias(k), F.col("spans").alias(found)).dropDuplicates([i, k])
    joined = docs.withColumns({i: whole_id(), k: row_key()}).join(change, [i, k], "left")
    text = (
        f"if({found} is null, text, aggregate({found}, struct(0L as at, '' as out), (acc, s) -> if(s.start >= acc.at, "
        "struct(s.stop as at, concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(s.start - acc.at as int)), '[', upper(s.kind), ']') as out), "
        "struct(greatest(acc.at, s.stop) as at, acc.out as out)), acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int)))))"
    )
    out = joined.withColumn("text", F.expr(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
