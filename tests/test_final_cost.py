"""The final detector makes what README steps create once, and looks for it only where a pattern can match."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import claims, sequence

from test_labels import tables


def test_created_paths_are_made_once(spark, monkeypatch):
    from tidemark.operators import baseline

    made = []
    keep = sequence.staged
    monkeypatch.setattr(sequence, "staged", lambda df, name: made.append((name, df.columns)) or keep(df, name))
    elements, found, index, keys = tables(spark)
    out = sequence.final_labels(baseline.baseline(found, index, keys), elements, index, keys)
    assert out.count() and ("created", ["full_name", "key", "since"]) in made


def test_patterns_of_created_paths_find_what_they_did(spark):
    r = random.Random(5)
    words = "mkdir|-p|a/b|cp|mv|-r|x|touch|curl|-o|wget|-O|git|clone|https://h.org/x/y.git/|--depth|1|python3|-m|venv|env|virtualenv|conda|create|-n|unzip|-d|saved|as|`k.json`|copy|to|`z`|save|it|a file named|file|folder|will|generate|generates|out.csv|GIT|ſave|MKDIR|git clone u.org/v|git clone -b w|saved as `k.json`|copy x to `z`|save it as q.py|create a file named `f`|generates out.csv|;|&&|the".split("|")
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for patterns in (R.CREATING, R.PROSE_CREATING, [R.CLONE_URL]):
        plain = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce("x", F.lit("")), F.lit("(?iuU)" + p), F.lit(1)) for p in patterns]))
        got = rows.select(claims.all_matches_of(F.col("x"), patterns).alias("a"), plain.alias("b"))
        assert got.where("a <> b or a is null").count() == 0 and got.where("size(a) > 0").count() > 20
        for p in patterns:
            for t in texts[:-2]:
                if t.isascii() and re.search(f"(?i){p}", t):
                    assert all(not some or any(w in t.lower() for w in some) for some in (claims.starts_of(p), claims.ends_of(p)))
                    assert all(w in t.lower() for w in claims.words_of(p))
