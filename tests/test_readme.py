"""The lexer against a plain reading of the same rules, line by line."""

import random
import re

from tidemark.operators import readme

ATX = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*```([A-Za-z0-9_+\-#. ]*)\s*$")


def roles_by_hand(lines):
    out, i, inside = [], 0, None
    under = lambda s: any(re.match(p, s.rstrip()) for p in (r"^\s*=\s*=+\s*$", r"^\s*-\s*-+\s*$", r"^\s*[=-]{3,}\s*$"))
    while i < len(lines):
        line = lines[i]
        if inside is None and ATX.match(line):
            out.append("H")
        elif inside is None and line.strip() and i + 1 < len(lines) and under(lines[i + 1]):
            out += ["T", "U"]
            i += 1
        elif FENCE.match(line):
            if inside is None:
                inside = len(out)
                out.append("O")
            else:
                inside = None
                out.append("C")
        else:
            out.append("L" if inside is None else "I")
        i += 1
    if inside is not None:
        out[inside:] = "X" * (len(out) - inside)
    return out


def test_roles_match_a_line_by_line_reading(spark):
    r = random.Random(3)
    pool = ["# A", "text", "---", "===", "- -", "```", "```bash", "", "  ", "## B ##", "`x` [a](b)", "``` two words! ```", "-", "* x"]
    docs = [(f"r{i}", "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(300)] + [("null", None), ("empty", "")]
    rows = readme.line_roles(spark.createDataFrame(docs, "full_name string, readme_text string")).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x["full_name"], x["line_no"])):
        got.setdefault(x["full_name"], []).append(x["role"])
    for name, text in docs:
        lines = (text or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got.get(name, []) == roles_by_hand(lines), (name, text)


def test_elements(spark):
    text = "intro\n# One\n```py\na\nb\n```\nSee `x` and [t](u.md)\nTwo\n---\nend\n```\nopen"
    rows = readme.elements(spark.createDataFrame([("r", text)], "full_name string, readme_text string")).orderBy("line_no", "elem_no").collect()
    got = [(r["line_no"], r["elem_type"], r["heading"], r["content"], r["code_lang"]) for r in rows]
    assert got == [
        (1, "section_line", "ROOT", "intro", None),
        (2, "heading", "One", "# One", None),
        (3, "fenced_code", "One", "a\nb", "py"),
        (7, "inline_code", "One", "x", None),
        (7, "markdown_link", "One", "See `x` and [t](u.md)", None),
        (7, "section_line", "One", "See `x` and [t](u.md)", None),
        (8, "heading", "Two", "Two", None),
        (10, "section_line", "Two", "end", None),
    ]
