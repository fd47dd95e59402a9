"""README parser (R1 to R10) as a lexer over line classes.

Each line has a class that depends on it and the next line only. A document's
classes form a string, and one regular expression cuts it the way the parser
reads: a heading, a heading with the underline it consumes, a closed fence, a
fence that never closes, any other line. That gives every line its role, without
state carried from row to row; headings are then carried forward by a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .headings import link_type, plain_class, plain_hint

ATX = r"(?Ud)^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE = r"(?Ud)^\s*```([A-Za-z0-9_+\-#. ]*)\s*$"
UNDERLINE = r"(?Ud)^\s*(?:=\s*=+|-\s*-+|[=-]{3,})\s*$"
#: A heading; B, S: text over an underline (B is a fence line too); F: a fence line; p: any other line.
CUT = "A|[SB].|F[^FB]*[FB]|F[^FB]*$|."
COLUMNS = ["full_name", "elem_type", "line_no", "heading", "heading_norm", "section_class", "operational_hint", "content", "code_lang", "link_text", "link_target", "link_target_type", "elem_no"]


def coded(readmes: DataFrame) -> DataFrame:
    """full_name, lines and the roles of all lines, an array each a document."""
    rows = readmes.select("full_name", T.lines("readme_text").alias("lines"))
    fence = lambda line: F.contains(line, F.lit("```")) & line.rlike(FENCE)
    # a line that holds anything but blanks and these two signs underlines nothing
    underlines = lambda line: (F.ltrim(line, F.lit(T.BLANKS + "=-")) == "") & line.rlike(UNDERLINE)
    cls = F.transform(
        "lines",
        lambda line, i: F.when(F.contains(line, F.lit("#")) & line.rlike(ATX), "A").otherwise(
            F.when(underlines(F.coalesce(F.get("lines", i + 1), F.lit(""))) & (T.strip(line) != ""), F.when(fence(line), "B").otherwise("S")).otherwise(F.when(fence(line), "F").otherwise("p"))
        ),
    )
    classes = rows.select("full_name", "lines", F.array_join(cls, "").alias("codes"))
    tokens = F.regexp_extract_all("codes", F.lit(CUT), F.lit(0))

    def roles(t):
        n = F.length(t)
        closed = t.rlike("^F.*[FB]$")
        return (
            F.when(t == "p", "L")
            .when(t == "A", "H")
            .when(t.rlike("^[SB].$"), "TU")
            .when(closed, F.concat(F.lit("O"), F.repeat(F.lit("I"), n - 2), F.lit("C")))
            .when(t.startswith("F"), F.repeat(F.lit("X"), n))
            .otherwise("L")
        )

    return classes.select("full_name", "lines", F.array_join(F.transform(tokens, roles), "").alias("roles"))


def line_roles(readmes: DataFrame) -> DataFrame:
    """full_name, line_no (from 1), line, role of every line.

    Roles: H heading, T heading over an underline, U that underline, O I C opening,
    inside and closing of a fence, X in a fence that never closes, L any other line.
    """
    spread = coded(readmes).select("full_name", "lines", F.split("roles", "").alias("roles"))
    return spread.select("full_name", F.posexplode(F.arrays_zip("lines", "roles")).alias("i", "z")).select(
        "full_name", (F.col("i") + 1).alias("line_no"), F.col("z.lines").alias("line"), F.col("z.roles").alias("role")
    ).where("role <> ''")


def read_lines(readmes: DataFrame) -> DataFrame:
    """Of line_roles the lines that make an element: headings, plain lines, and openings of fences with what is inside as block."""

    def row(z, i):
        inside = F.array_join(F.slice("lines", i + 2, F.position(F.lit("C"), F.col("roles"), i + 1) - i - 2), "\n")
        return F.struct((i + 1).alias("line_no"), z["line"].alias("line"), z["role"].alias("role"), F.when(z["role"] == "O", inside).alias("block"))

    each = F.transform(F.arrays_zip(F.col("lines").alias("line"), F.split("roles", "").alias("role")), row)
    kept = F.filter(each, lambda r: r["role"].isin("H", "T", "O", "L"))
    return coded(readmes).select("full_name", F.explode(kept).alias("r")).select("full_name", "r.*")


def elements(readmes: DataFrame) -> DataFrame:
    """readmes (full_name, readme_text) to typed elements with the heading they stand under.

    A null or empty text has none. One repository's lines are one group of a window.
    """
    rows = read_lines(readmes)
    title = F.when(F.col("role") == "H", T.strip(F.regexp_extract("line", ATX, 2))).when(F.col("role") == "T", T.strip("line"))
    # a heading is classed where it stands; lines below it get what was found
    told = T.let(T.plain_heading("title"), lambda p: F.struct(F.col("title").alias("heading"), p.alias("heading_norm"), plain_class(p).alias("section_class"), plain_hint(p).alias("operational_hint")))
    upto = Window.partitionBy("full_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = rows.withColumn("title", title).withColumn("head", F.when(F.col("title").isNotNull(), told)).drop("title")
    under = heads.withColumn("head", F.last("head", ignorenulls=True).over(upto))
    root = F.struct(F.lit("ROOT").alias("heading"), F.lit("root").alias("heading_norm"), F.lit("other").alias("section_class"), F.lit(0).alias("operational_hint"))
    placed = under.select("full_name", "line_no", "line", "role", "block", F.coalesce("head", root).alias("head")).select("full_name", "line_no", "head.*", "line", "role", "block")
    null = F.lit(None).cast("string")

    def row(kind, content, lang=null, link_text=null, target=null, target_type=null):
        return F.struct(F.lit(kind).alias("elem_type"), content.alias("content"), lang.alias("code_lang"), link_text.alias("link_text"), target.alias("link_target"), target_type.alias("link_target_type"))

    line = F.col("line")
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    inline = F.transform(F.regexp_extract_all("line", F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda c: row("inline_code", c))
    links = F.transform(
        F.arrays_zip(F.regexp_extract_all("line", F.lit(link), F.lit(1)).alias("t"), F.regexp_extract_all("line", F.lit(link), F.lit(2)).alias("u")),
        lambda z: row("markdown_link", T.strip(line), null, z["t"], z["u"], link_type(z["u"])),
    )
    plain = F.array(row("section_line", line))
    per_line = (
        F.when(F.col("role").isin("H", "T"), F.array(row("heading", line)))
        .when(F.col("role") == "O", F.array(row("fenced_code", F.col("block"), F.lower(T.strip(F.regexp_extract("line", FENCE, 1))))))
        .when(T.holds(line, "`", "]("), F.concat(inline, links, plain))
        .otherwise(plain)
    )
    place = ["full_name", "line_no", "heading", "heading_norm", "section_class", "operational_hint"]
    return placed.select(*place, F.posexplode(per_line).alias("elem_no", "e")).select(*place, "elem_no", "e.*").select(*COLUMNS)
