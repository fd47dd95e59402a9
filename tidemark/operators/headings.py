"""Classes of headings and links (K1 to K5): first match over ordered rules, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for test, name in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def section_class(heading: Column | str) -> Column:
    """The class of a heading: by its words, else by the instruction it begins with, else other."""
    return plain_class(T.plain_heading(heading))


def plain_class(h: Column) -> Column:
    """section_class of a heading that is already plain."""
    by_word = [(h.rlike(rf"(?iuU)\b(?:{words})\b"), name) for name, words in R.SECTION_WORDS.items()]
    by_order = [(h.rlike(rf"(?iuU)^(?:{words})\b"), name) for name, words in R.IMPERATIVES.items()]
    return first_match(by_word + by_order, "other")


def operational_hint(heading: Column | str) -> Column:
    return plain_hint(T.plain_heading(heading))


def plain_hint(h: Column) -> Column:
    return h.rlike(rf"(?iuU)\b(?:{R.OPERATIONAL_WORDS})\b").cast("int")


def link_type(target: Column | str) -> Column:
    """One of nine kinds of link target."""
    t = T.norm(target)
    base = F.regexp_replace(t, r"(?s)[?#].*$", "")
    ends = lambda extensions: base.rlike(rf"\.(?:{extensions})$")
    name = T.basename(base)
    return first_match(
        [
            (t == "", "unknown"),
            (T.is_link_external(target), "external"),
            (t.startswith("#"), "anchor"),
            (ends(R.IMAGE_EXTENSIONS), "image"),
            (ends(R.DOC_EXTENSIONS), "local_doc"),
            (ends(R.ARTIFACT_EXTENSIONS), "local_artifact"),
            (base.endswith("/"), "local_dir"),
            (name.isin(R.LINK_ARTIFACT_NAMES), "local_artifact"),
            (name.isin(R.LINK_DOC_NAMES), "local_doc"),
            (base.contains("/"), "local_path_other"),
        ],
        "local_other",
    )


def is_relevant(section: Column | str, hint: Column | str) -> Column:
    return T.norm(section).isin(R.RELEVANT_SECTIONS) | (F.coalesce(T.col(hint), F.lit(0)) == 1)


def is_strongly_negative(heading: Column | str) -> Column:
    return T.let(T.norm(heading), lambda h: T.holds(h, *R.STRONG_NEGATIVE))


def is_softly_negative(heading: Column | str) -> Column:
    return T.let(T.norm(heading), lambda h: T.holds(h, *R.SOFT_NEGATIVE))
