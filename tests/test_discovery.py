"""Input discovery: files that do not fit are never opened; and frames for figures."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.sources import tables

ROW = "a/b,README.md,text\n"
HEAD = "full_name,readme_path,readme_text\n"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_files_that_do_not_fit_are_not_opened(spark, tmp_path):
    put(f"{tmp_path}/x/My_Readmes_1.csv", HEAD + ROW)
    put(f"{tmp_path}/x/y/readmes_2.CSV", HEAD + "c/d,README.md,other\n")
    for bad in ("readmes_v4.csv", "x/other.csv", "readmes.txt", "x/y/V4_readmes.csv"):
        put(f"{tmp_path}/{bad}", "not,a\n\"broken")
        os.chmod(f"{tmp_path}/{bad}", 0o000)
    df = tables.read_found(spark, f"file://{tmp_path}", "readmes", "readmes")
    assert sorted(r["full_name"] for r in df.collect()) == ["a/b", "c/d"]
    assert len(df.inputFiles()) >= 2 and tables.listed_files(spark, f"file://{tmp_path}", "readmes").count() == 2
    scan = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scan and "file_name" in scan[0]
    with pytest.raises(FileNotFoundError, match="nothing"):
        tables.read_found(spark, f"file://{tmp_path}", "nothing", "readmes")


def test_newest_and_since(spark, tmp_path):
    put(f"{tmp_path}/readmes_a.csv", HEAD + ROW)
    put(f"{tmp_path}/readmes_b.csv", HEAD + "new/one,README.md,x\n")
    old = time.time() - 10**6
    os.utime(f"{tmp_path}/readmes_a.csv", (old, old))
    for extra in ({"newest": True}, {"since": time.strftime("%Y-%m-%d", time.gmtime(time.time() - 10**5))}):
        assert [r["full_name"] for r in tables.read_found(spark, f"file://{tmp_path}", "readmes", "readmes", **extra).collect()] == ["new/one"]


def test_parquet_too(spark, tmp_path):
    spark.createDataFrame([("a", "b", "c")], tables.SCHEMAS["readmes"]).coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next(f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/one/{part}", f"{tmp_path}/readmes_z.parquet")
    put(f"{tmp_path}/readmes_v4.parquet", "no parquet")
    put(f"{tmp_path}/one/readmes.parquet.bak", "no parquet")
    assert tables.read_found(spark, f"file://{tmp_path}", "readmes", "readmes", ".parquet").count() == 1


def drawn(points, low, high, width):
    """For each pixel column how a step curve goes through it: heights at its entry, exit, least and greatest."""
    out, y = {}, None
    for x, v in sorted(points):
        if x < low:
            y = v
            continue
        if x > high:
            break
        p = min(int((x - low) / ((high - low) / width)), width - 1)
        out.setdefault(p, [y]).append(v)
        y = v
    return {p: (v[0], v[1], v[-1], min(v[1:]), max(v[1:])) for p, v in out.items()}


def test_pixel_frame_draws_the_same_curve(spark):
    points = [(i / 100, ((i * 7919) % 1000) / 10) for i in range(-50, 5000)]
    df = spark.createDataFrame(points, "x double, y double").repartition(4)
    frame = metrics.pixel_frame(df, "x", "y", 0.0, 40.0, 120)
    rows = [(r["x"], r["y"]) for r in frame.collect()]
    assert len(rows) <= 4 * 120 + 1 and frame.groupBy("pixel").count().agg(F.max("count")).first()[0] <= 4
    assert drawn(rows, 0.0, 40.0, 120) == drawn(points, 0.0, 40.0, 120)
    assert metrics.pixel_frame(df.limit(0), "x", "y", 0.0, 1.0, 10).count() == 0
