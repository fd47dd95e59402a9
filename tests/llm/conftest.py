import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, ids string, base string"


def extra(rows):
    """Rows of documents with further columns whose names operators use themselves."""
    return [(i, t, "en", "s", len(t or ""), "k", "f", "i", "b") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        return spark.createDataFrame(extra(rows), SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, with copies, near copies, shared passages, nulls, blanks, repeated rows and one long text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "the", "Or", "éa", "ti", "ß", "x1"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, text(r.randint(0, 90))) for i in range(40)]
    rows += [(40 + i, text(20) + "\n" + shared + "\t" + text(15)) for i in range(6)]
    rows += [(50, rows[7][1]), (51, rows[7][1]), (52, text(90))]
    near = rows[-1][1].split(" ")
    near[40] = "changed"
    rows += [(53, " ".join(near)), (54, None), (55, ""), (56, " \n\t"), (None, text(30)), (None, None), (57, text(3000)), (58, "one"), (59, "the " * 80), (3, rows[3][1]), (60, "x y z a\x1cb " * 12)]
    return rows
