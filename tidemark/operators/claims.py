"""Claim extraction (C1 to C17): typed elements to executable claims, as array expressions and one union.

An element's commands are computed inside its row; rows are made once, when the
claims are known. ``claim_seq`` is the order in which a reader meets them.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .headings import is_relevant, is_softly_negative, is_strongly_negative

REFERENCES = ["artifact_ref", "local_link_ref"]


def nothing_local(t: Column) -> Column:
    return T.is_external(t) | T.looks_like_domain(t) | T.has_extension(t, R.IMAGE_EXTENSIONS) | T.has_extension(t, R.CLAIM_DOC_EXTENSIONS)


def is_local_path(t: Column) -> Column:
    """Does a canonical path name something in the repository?"""
    low = F.lower(t)
    shaped = low.isin(R.LOCAL_WHITELIST) | F.contains(low, F.lit("/")) | low.rlike(rf"^[A-Za-z0-9_.-]+\.({R.CODE_EXTENSIONS})$")
    return F.coalesce(shaped & ~nothing_local(t), F.lit(False))


def literal_start(pattern: str) -> str:
    """What every match of a pattern begins with, in lower case: its text up to the first sign that is no plain character."""
    plain = re.match(r"(?:\\b)?((?:\\\.|[A-Za-z0-9_ /-])*)(.?)", pattern)
    start = plain[1].replace("\\.", ".")
    return (start[:-1] if plain[2] in tuple("?*{") else start).lower()


def words_of(pattern: str) -> list[str]:
    """Words that every match of a pattern holds, in lower case: those that stand alone between white space, outside of brackets."""
    out, at = [], 0
    for piece in re.split(r"(\\s\+)", pattern):
        word = re.fullmatch(r"([A-Za-z0-9_-]+)(?:\\b)?", piece)
        if word and pattern[:at].count("(") == pattern[:at].count(")"):
            out.append(word[1].lower())
        at += len(piece)
    return out


def starts_of(pattern: str) -> list[str]:
    """What a match of a pattern begins with, in lower case, at the edge of a word: its literal start, or those of its first alternatives. None if they can't be told."""
    words = re.match(r"\\b\(\?:([^()]*)\)(?![?*{])", pattern)
    found = [literal_start(pattern)] if pattern.startswith("\\b") and literal_start(pattern) else [literal_start(x) for x in words[1].split("|")] if words else []
    return found if all(found) else []


def ends_of(pattern: str) -> list[str]:
    """What a match of a pattern ends with, if that is a dot and one of some alternatives."""
    last = re.search(r"\\\.\(\?:([^()]*)\)\)?\\b$", pattern)
    return ["." + literal_start(x) for x in last[1].split("|")] if last else []


def held(low: Column, *signs: list[str]) -> Column:
    """Does a text in lower case hold one of each list? Lists may be empty."""
    return reduce(and_, (T.holds(low, *one_of) for one_of in signs if one_of), F.lit(True))


def tried(text: Column, low: Column | None, patterns: list[tuple], matches, nothing: Column) -> Column:
    """The matches of patterns (their second entry) one after the other: matches(pattern, flags).

    low, an ASCII text in lower case, is asked first for what a match must hold, once for
    neighbours with one start, and flags are those that know ASCII only. Where low is None,
    as beyond ASCII cases and words are more, every pattern is tried, with Unicode's.
    """
    if low is None:
        return F.flatten(F.array(*[matches(p, "(?iuU)") for p in patterns]))
    groups = []
    for starts, group in groupby(patterns, lambda p: starts_of(p[1])):
        each = [F.when(held(low, words_of(p[1]), ends_of(p[1])), matches(p, "(?i)")).otherwise(nothing) if words_of(p[1]) or ends_of(p[1]) else matches(p, "(?i)") for p in group]
        found = F.flatten(F.array(*each)) if len(each) > 1 else each[0]
        groups.append(F.when(held(low, starts), found).otherwise(nothing) if starts else found)
    return F.flatten(F.array(*groups))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def all_matches_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The matches of patterns in a text, one pattern after the other."""
    rows, none = [(None, p) for p in patterns], F.array().cast("array<string>")
    each = lambda p, flags: T.all_matches(text, p[1], group, flags)
    return F.when(is_ascii(text), T.let(F.lower(text), lambda low: tried(text, low, rows, each, none))).otherwise(tried(text, None, rows, each, none))


def part_commands(part: Column) -> Column:
    """The claims of one command: type and artifact, in order of the patterns; generic_command if none matches."""
    none = F.array().cast("array<struct<kind:string,raw:string>>")

    def matches(command: tuple, flags: str) -> Column:
        kind, pattern, group = command
        if group is None:
            return F.when(part.rlike(flags + pattern), F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("raw")))).otherwise(none)
        return F.transform(T.all_matches(part, pattern, group, flags), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("raw")))

    plain = T.let(F.lower(part), lambda low: tried(part, low, R.COMMANDS, matches, none))
    found = F.when(is_ascii(part), plain).otherwise(tried(part, None, R.COMMANDS, matches, none))
    named = F.transform(found, lambda c: F.struct(c["kind"].alias("claim_type"), T.canonical_path(c["raw"]).alias("artifact")))
    low = lambda c: F.coalesce(F.lower(c["artifact"]), F.lit("x"))
    kept = F.filter(
        named,
        lambda c: ~((c["claim_type"] == "cd_dir") & F.coalesce(c["artifact"].rlike(f"(?iu){R.PLACEHOLDER_DIR}"), F.lit(False)))
        & ~((c["claim_type"] == "pip_install_pkg") & low(c).startswith("-"))
        & ~((c["claim_type"] == "python_module") & (low(c).isin("pip", "pip3") | low(c).startswith("-"))),
    )
    local = F.transform(kept, lambda c: F.struct(c["claim_type"], F.when((c["claim_type"] != "git_clone") & T.is_external(c["artifact"]), F.lit(None)).otherwise(c["artifact"]).alias("artifact")))
    target = lambda a: F.exists(a, lambda c: c["claim_type"] == "make_target")
    distinct = T.let(local, lambda a: F.array_distinct(F.filter(a, lambda c: (c["claim_type"] != "make_cmd") | ~target(a))))
    generic = F.array(F.struct(F.lit("generic_command").alias("claim_type"), F.lit(None).cast("string").alias("artifact")))
    return T.let(distinct, lambda a: F.when(F.size(a) > 0, a).otherwise(generic))


def shell_claims(text: Column, known: Column | None = None) -> Column:
    """The claims of a shell text: claim_type, artifact, snippet. known: is it one line that reads as a command?"""
    trimmed = F.transform(T.lines(text), T.strip)
    lines = F.filter(trimmed, T.is_shell_like)
    if known is not None:
        lines = F.when(known & (F.size(trimmed) == 1), trimmed).otherwise(lines)
    of_line = lambda line: F.filter(T.command_parts(T.clean_command(line)), lambda p: (p == line) | T.is_shell_like(p))
    parts = F.flatten(F.transform(lines, of_line))
    return F.flatten(F.transform(parts, lambda p: F.transform(part_commands(p), lambda c: F.struct(c["claim_type"], c["artifact"], p.alias("snippet")))))


#: The pattern of a path in Java's form: it starts where a name starts, and no name is shortened to look for a slash. As its second class holds the first and a slash, the matches are the same.
PATH_PATTERN = {R.ARTIFACTS[-2]: R.ARTIFACTS[-2].replace("(?:", "(?<![A-Za-z0-9_.-])(?:", 1).replace("[A-Za-z0-9_.-]+/", "[A-Za-z0-9_.-]++/", 1)}


def text_artifacts(text: Column) -> Column:
    """Local artifacts named in a text, in order of the patterns, each once."""
    none = F.array().cast("array<string>")
    patterns = [(None, p) for p in R.ARTIFACTS]

    def plain(text: Column) -> Column:
        return T.let(F.lower(text), lambda low: tried(text, low, patterns, lambda p, flags: T.all_matches(text, PATH_PATTERN.get(p[1], p[1]), 0, flags), none))

    # no match has a blank in it, and each a dot or the word file: of an ASCII text only such pieces are looked at
    pieces = F.filter(F.split(text, " "), lambda w: F.contains(w, F.lit(".")))
    short = F.when(F.contains(F.lower(text), F.lit("file")), text).otherwise(F.array_join(pieces, " "))
    found = F.when(is_ascii(text), T.let(short, lambda s: F.when(s == "", none).otherwise(plain(s)))).otherwise(tried(text, None, patterns, lambda p, flags: T.all_matches(text, p[1], 0, flags), none))
    good = F.filter(F.transform(F.array_distinct(found), T.canonical_path), is_local_path)  # what a text repeats is looked at once
    keys = lambda good: F.transform(good, lambda t: F.when(F.contains(t, F.lit("/")), F.lower(t)).otherwise(F.lower(T.basename(t))))
    first = lambda good: T.let(keys(good), lambda k: F.filter(good, lambda t, i: F.array_position(k, F.get(k, i)) == i + 1))
    return T.let(good, first)


def is_actionable_link(target: Column, kind: Column, link_text: Column) -> Column:
    def named(low: Column) -> Column:
        base = T.basename(low)
        bare = F.regexp_replace(base, r"\.[a-z0-9]+$", "")
        return base.isin(R.LOCAL_WHITELIST) | bare.isin(R.OPERATIONAL_DOCS) | (F.contains(low, F.lit("/")) & T.holds(low, *R.OPERATIONAL_DOCS))

    def actionable(t: Column) -> Column:
        fits = (kind == "local_artifact") | (kind.isin("local_path_other", "local_other", "local_doc") & T.let(T.norm(t), named))
        return F.coalesce(t.isNotNull() & ~T.is_external(t) & ~T.is_badge(t) & ~T.is_badge(link_text) & fits, F.lit(False))

    return T.let(T.canonical_path(target), actionable)


def raw_claims(elements: DataFrame, repos: DataFrame) -> DataFrame:
    """All claims of all elements before they are deduplicated. repos: full_name, curated_list_heuristic (absent repositories count as not curated)."""
    curated = repos.select("full_name", F.coalesce(F.col("curated_list_heuristic").cast("int"), F.lit(0)).alias("curated")).dropDuplicates(["full_name"])
    rows = elements.where((T.strip("content") != "") & ~T.is_badge("content")).join(curated, "full_name", "left").fillna({"curated": 0})
    kind, text, line = F.col("elem_type"), F.col("content"), F.col("_line")
    relevant = is_relevant("section_class", "operational_hint")
    shell_lang = F.coalesce(F.lower("code_lang"), F.lit("")).isin(R.SHELL_LANGS)
    rows = rows.withColumns({"_line": T.strip("content"), "_command": F.when(kind.isin("inline_code", "section_line"), T.is_shell_like(text)).otherwise(False), "negative": is_strongly_negative("heading")})
    negative, is_command = F.col("negative"), F.col("_command")
    bullet = (F.col("curated") == 1) & T.is_bullet(line) & ~is_command
    blank = F.array().cast("array<struct<claim_type:string,artifact:string,snippet:string>>")
    names = F.array().cast("array<string>")
    commands = F.when((kind == "fenced_code") & (~negative | shell_lang) | kind.isin("inline_code", "section_line") & is_command & ~((kind == "section_line") & bullet), shell_claims(text, is_command)).otherwise(blank)
    seen = rows.withColumn("commands", commands).withColumn("relevant", relevant)
    fenced = (kind == "fenced_code") & (~F.col("negative") | shell_lang) & F.col("relevant") & (F.size("commands") == 0)
    inline = T.canonical_path(line)
    in_line = (kind == "section_line") & F.col("relevant") & ~F.col("negative") & ~bullet & ~T.is_external(line) & ~T.is_link_heavy(line)
    in_code = (kind == "inline_code") & ~is_command & F.col("relevant") & ~F.col("negative") & ~is_softly_negative("heading") & is_local_path(inline)
    in_link = (kind == "markdown_link") & F.col("relevant") & ~F.col("negative") & is_actionable_link(F.col("link_target"), F.col("link_target_type"), F.col("link_text"))
    refs = F.when(fenced | in_line, text_artifacts(text)).when(in_code, F.array(inline)).when(in_link, F.array(T.canonical_path("link_target"))).otherwise(names)

    def claim(context, kind_of, family, artifact, snippet, level):
        return F.struct(
            context.alias("context_type"), kind_of.alias("claim_type"), F.lit(family).alias("claim_family"), artifact.alias("artifact_or_path"), snippet.alias("snippet"), level.alias("evidence_level")
        )

    command_context = F.when(kind == "fenced_code", "fenced_code").when(kind == "inline_code", "inline_code_command").otherwise("section_line_command")
    ref_context = (
        F.when(kind == "fenced_code", "fenced_code_artifact").when(kind == "inline_code", "inline_code_artifact").when(kind == "markdown_link", "markdown_link").otherwise("section_line_artifact")
    )
    level = F.when(kind.isin("fenced_code", "inline_code"), "medium").otherwise("low")
    both = F.concat(
        F.transform("commands", lambda c: claim(command_context, c["claim_type"], "command", c["artifact"], c["snippet"], F.when(kind == "fenced_code", "high").otherwise("medium"))),
        F.transform(
            "refs",
            lambda a: claim(ref_context, F.when(kind == "markdown_link", "local_link_ref").otherwise("artifact_ref"), "artifact_reference", a, F.when(kind == "fenced_code", a).when(kind == "markdown_link", text).otherwise(line), level),
        ),
    )
    keep = ["full_name", "line_no", "heading", "section_class", "operational_hint", F.col("curated").alias("repo_curated_heuristic")]
    exploded = seen.withColumn("refs", refs).select(*keep, "elem_no", "elem_type", F.posexplode(both).alias("claim_no", "c"))
    rank = F.when(F.col("elem_type") == "section_line", 1).otherwise(0)
    order = Window.partitionBy("full_name").orderBy("line_no", rank, "elem_no", "claim_no")
    return exploded.withColumn("claim_seq", F.row_number().over(order).cast("long")).drop("elem_no", "elem_type", "claim_no").select("*", "c.*").drop("c")


def best_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def deduplicated(claims: DataFrame) -> DataFrame:
    """First of equal claims; of references to one artifact the one with the best evidence, context and place."""
    keyed = claims.withColumn("artifact_key", T.artifact_key("artifact_or_path")).withColumn("snippet_norm", T.norm("snippet"))
    once = best_per_key(keyed, ["full_name", "line_no", "heading", "section_class", "context_type", "claim_type", "artifact_key", "snippet_norm"], "claim_seq")
    is_ref = F.col("claim_type").isin(REFERENCES) & (F.col("artifact_key") != "")
    evidence = F.when(F.col("evidence_level") == "high", 3).when(F.col("evidence_level") == "medium", 2).otherwise(1)
    context = F.when(F.col("context_type") == "inline_code_artifact", 4).when(F.col("context_type") == "fenced_code_artifact", 3).when(F.col("context_type") == "markdown_link", 2).otherwise(1)
    # one pass: rows that are no reference are alone in their group. Two filtered branches would each extract all claims again.
    alone = F.when(~is_ref, F.col("claim_seq"))
    grouped = once.withColumns({"_ref": F.when(is_ref, F.col("artifact_key")), "_alone": alone})
    return best_per_key(grouped, ["full_name", "_ref", "_alone"], evidence.desc(), context.desc(), "line_no", "claim_seq").drop("artifact_key", "snippet_norm", "_ref", "_alone")


def extract(elements: DataFrame, repos: DataFrame) -> DataFrame:
    return deduplicated(raw_claims(elements, repos))
