"""Text functions of the documentation analysis, Column to Column.

Patterns run in Java's engine with the flags that give Unicode classes and
folding ((?iu), (?U)) where the analysis means them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

BLANK = r"(?U)\s"
#: The characters of that class.
BLANKS = "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once. element_at knows its type; get would ask the whole body for it at each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holds(c: Column, *signs: str) -> Column:
    """Has the text one of the signs? A search of bytes, to ask before a pattern whose matches all have one of them."""
    out = F.contains(c, F.lit(signs[0]))
    for sign in signs[1:]:
        out = out | F.contains(c, F.lit(sign))
    return out


def any_of(words: list[str]) -> str:
    """A pattern of literal alternatives."""
    return "|".join("".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in w) for w in words)


def strip(c: Column | str) -> Column:
    """Trims Unicode white space at both ends; null becomes empty."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(BLANKS))


def norm(c: Column | str) -> Column:
    return F.lower(strip(c))


def norm_slashes(c: Column | str) -> Column:
    return F.lower(F.replace(strip(c), F.lit("\\"), F.lit("/")))


def strip_lead(c: Column | str) -> Column:
    """norm_slashes without one leading ./ and without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(norm_slashes(c), r"^\./", ""), r"/+$", "")


def norm_path(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(norm_slashes(c), r"^\./", ""), r"^/+|/+$", "")


def basename(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def path_parts(c: Column | str) -> Column:
    return F.array_remove(F.split(norm_slashes(c), "/"), "")


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final end makes no further line, an empty text has none."""
    text = F.coalesce(col(c), F.lit(""))
    cut = let(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    return F.when(text == "", F.array().cast("array<string>")).when(holds(text, *LINE_ENDS), cut).otherwise(F.array(text))


def prose(c: Column | str) -> Column:
    """Text without code, images, links, URLs and markup signs, white space collapsed: what language tests look at. A text without any sign of the first five is not searched for them; no cut makes such a sign, as it leaves a blank."""
    text = F.coalesce(col(c), F.lit(""))

    def cut(t: Column, patterns: list[str]) -> Column:
        for pattern in patterns:
            t = F.regexp_replace(t, pattern, " ")
        return strip(t)

    signs = F.contains(text, F.lit("`")) | F.contains(text, F.lit("](")) | F.contains(text, F.lit("://"))
    return F.when(signs, cut(text, R.PROSE_CUTS)).otherwise(cut(text, R.PROSE_CUTS[5:]))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)\b\w+\b"))


def alpha_tokens(prose_text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(prose_text), F.lit(R.ALPHA_TOKEN), F.lit(0)), F.lower)


def ascii_ratio(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(F.octet_length(col(c)) == n, n).otherwise(F.length(F.regexp_replace(col(c), r"[^\x00-\x7F]", ""))) / F.greatest(F.lit(1), n)


def function_ratio(tokens: Column | str) -> Column:
    hits = F.size(F.filter(col(tokens), lambda t: t.isin(R.FUNCTION_WORDS)))
    return hits / F.greatest(F.lit(1), F.size(col(tokens)))


def alpha_ratio(tokens: Column | str, prose_text: Column | str) -> Column:
    return F.size(col(tokens)) / F.greatest(F.lit(1), F.regexp_count(col(prose_text), F.lit(r"(?U)\S+")))


def normal_heading(c: Column | str) -> Column:
    t = norm(c)
    for pattern in R.HEADING_CUTS:
        t = F.regexp_replace(t, pattern, " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?U)^[\W_]*", ""), r"(?U)\s+", " "))


def without_enumerator(c: Column | str) -> Column:
    t = strip(c)
    for pattern in R.ENUMERATORS:
        t = F.regexp_replace(t, pattern, "")
    return strip(t)


def plain_heading(c: Column | str) -> Column:
    return without_enumerator(normal_heading(c))


def is_link_external(c: Column | str) -> Column:
    return norm(c).rlike(R.LINK_EXTERNAL)


def is_external(c: Column | str) -> Column:
    return let(norm(c), lambda n: holds(n, "://", "www.", "mailto:") & n.rlike(R.EXTERNAL))


def looks_like_domain(c: Column | str) -> Column:
    return let(norm(c), lambda n: ~F.contains(n, F.lit("/")) & n.rlike(rf"^[a-z0-9.-]+\.({R.DOMAIN_ENDINGS})$"))


def has_extension(c: Column | str, extensions: str) -> Column:
    """Does the name before ? or # end with one of the extensions?"""
    return let(norm(c), lambda n: F.contains(n, F.lit(".")) & F.when(holds(n, "?", "#"), F.regexp_replace(n, r"(?s)[?#].*$", "")).otherwise(n).rlike(rf"\.(?:{extensions})$"))


def canonical_path(c: Column | str) -> Column:
    """An artifact as named in text: trimmed, slashes forward, quotes, brackets, dots and commas off both ends, slashes squeezed; null if nothing is left.

    As dots go from both ends, ./run.sh becomes /run.sh and .env becomes env.
    """
    bare = F.btrim(F.replace(strip(c), F.lit("\\"), F.lit("/")), F.lit("`'\"()[]{}<>.,;:"))
    return let(bare, lambda t: F.when(F.contains(t, F.lit("//")) & ~is_external(t), F.regexp_replace(t, "/+", "/")).when(t != "", t))


def artifact_key(c: Column | str) -> Column:
    return F.lower(basename(F.coalesce(canonical_path(c), F.lit(""))))


def is_badge(c: Column | str) -> Column:
    return let(norm(c), lambda n: holds(n, *R.BADGES))


def is_link_heavy(c: Column | str) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    signs = holds(t, "://", "](") | F.contains(F.lower(t), F.lit("www."))
    return signs & (sum((F.regexp_count(t, F.lit(p)) for p in R.LINK_SIGNS), F.lit(0)) >= 2)


def is_bullet(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(R.BULLET)


def clean_command(c: Column | str) -> Column:
    """A command line without its prompt and leading assignments."""
    cut = lambda line: strip(F.regexp_replace(strip(F.regexp_replace(line, R.PROMPT, "")), R.ENVIRONMENT, ""))
    return let(strip(c), lambda line: F.when(may_be_prompted(line) | F.contains(line, F.lit("=")), cut(line)).otherwise(line))


def may_be_prompted(line: Column) -> Column:
    """Can a trimmed line begin with a prompt?"""
    return line.startswith("$") | line.startswith(">") | line.startswith("PS ")


def command_parts(c: Column | str) -> Column:
    """The commands of a line joined by &&, || or ;."""
    cut = lambda line: F.filter(F.transform(F.split(line, R.COMMAND_JOINTS), strip), lambda p: p != "")
    return let(strip(c), lambda line: F.when(holds(line, "&&", "||", ";"), cut(line)).when(line == "", F.array().cast("array<string>")).otherwise(F.array(line)))


def is_command_prose(c: Column | str) -> Column:
    return let(norm(c), lambda n: (n.startswith("make") | n.startswith("run") | n.startswith("go")) & n.rlike(f"(?U)^(?:{R.COMMAND_PROSE.replace('^', '')})"))


def is_shell_like(c: Column | str) -> Column:
    """Does a line read as a command: short or prompted, its first command starting with a known program, and no sentence?"""
    starts = lambda first: first.rlike(rf"(?iuU)^(?:{any_of(R.COMMAND_STARTERS)})\b") & ~is_command_prose(first)

    def reads(line: Column) -> Column:
        short = (F.length(line) <= R.LONGEST_COMMAND) | (may_be_prompted(line) & line.rlike(R.PROMPT))
        return (line != "") & short & let(F.try_element_at(command_parts(clean_command(line)), F.lit(1)), starts)

    return F.coalesce(let(strip(c), reads), F.lit(False))


def is_url_residue(artifact: Column | str, snippet: Column | str) -> Column:
    """Is the artifact part of a URL in the snippet, or its first segment a domain?"""
    a = F.regexp_replace(strip_lead(artifact), "^/+", "")
    inside = F.regexp_like(F.coalesce(col(snippet), F.lit("")), F.concat(F.lit(r"(?iuU)https?://\S*\Q"), a, F.lit(r"\E")))
    inside = F.contains(F.coalesce(col(snippet), F.lit("")), F.lit("://")) & inside  # without one no pattern is compiled for the row
    return (a != "") & (inside | F.get(F.split(a, "/"), 0).rlike(R.DOMAIN))


def is_runtime_like(c: Column | str) -> Column:
    a = F.regexp_replace(strip_lead(c), "^/+", "")
    parts = F.array_remove(F.split(a, "/"), "")
    return (F.size(parts) > 0) & (F.get(parts, 0).isin(R.RUNTIME_NAMES) | F.element_at(parts, -1).isin(R.RUNTIME_NAMES) | a.endswith(".egg-info"))


def holds_snippet(text: Column | str, snippet: Column | str) -> Column:
    """Is the snippet's beginning (80 characters, white space collapsed, any case) in the text? An empty one is not."""
    squeeze = lambda c: F.regexp_replace(strip(c), r"(?U)\s+", " ")
    start = F.lower(F.substring(squeeze(snippet), 1, 80))
    return (start != "") & F.contains(F.lower(squeeze(text)), start)


def npm_test_script(content: Column | str) -> Column:
    """1 if a package.json has a test script that is no placeholder; bad JSON, or no such script, gives 0."""
    c = col(content)
    value = norm(F.get_json_object(c, "$.scripts.test"))
    return F.when(F.get_json_object(c, "$.scripts.test").isNotNull() & (value != "") & ~value.isin(R.NPM_PLACEHOLDERS), 1).otherwise(0)


def utc(c: Column | str) -> Column:
    """An ISO time, with Z or an offset, as a timestamp; null if it is none."""
    return F.try_to_timestamp(col(c).cast("string"))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded down."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000)).cast("long")


def decoded(c: Column | str) -> Column:
    """Base64 to text; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.unbase64(F.regexp_replace(col(c), r"\s", "")).cast("string"))


def all_matches(c: Column | str, pattern: str, group: int = 1, flags: str = "(?iuU)") -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(flags + pattern), F.lit(group))


def joined_list(c: Column | str) -> Column:
    """A list of strings as one text, sorted, with ' || ' between."""
    return F.array_join(F.array_sort(col(c)), " || ")


def split_list(c: Column | str) -> Column:
    """A list written with ' || ' between: parts trimmed, empty ones left out; null and empty texts give an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|\|"), strip), lambda x: x != "")


def normalised_strings(df):
    """All string columns trimmed, null as empty."""
    return df.select(*[strip(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
