import os

from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.sources import tables


def test_score_line(spark):
    df = spark.createDataFrame([("final", 0.5, 0.324, 13, 66, 1), ("none", 1.0, 0.0, 0, 0, 0)], "n string, a double, k double, tp long, fp long, fn long")
    got = [r[0] for r in df.select(reports.score_line(*[F.col(c) for c in ("n", "a", "k", "tp", "fp", "fn")])).collect()]
    assert got == ["[final] accuracy=0.500 kappa=0.324 drift P=0.165 (13/79) R=0.929 (13/14) F1=0.280", "[none] accuracy=1.000 kappa=0.000 drift P=nan (0/0) R=nan (0/0) F1=nan"]


def test_crosstab_and_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), (None, "x")], "d string, c string")
    lines = reports.crosstab_lines(df, "d", "c", ["x", "y", "zz"])
    reports.write_report(lines, f"file://{tmp_path}/r", ["place"])
    files = [f for f in os.listdir(tmp_path / "r") if f.endswith(".txt")]
    assert len(files) == 1
    assert [x.split() for x in open(tmp_path / "r" / files[0])] == [["x", "y", "zz"], ["1", "0", "0"], ["a", "1", "1", "0"], ["b", "0", "2", "0"]]
    one = spark.createDataFrame([(3, 0.12345678, None)], "n long, x double, s string")
    assert reports.frame_lines(one, "km").first()[0] == "km: n=3 x=0.123457 s=none"


def test_routes(spark, tmp_path):
    for name in ("my_Readmes (1).csv", "README_structure.csv", "trees_all.csv", "notes.csv", "old/readmes.csv"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write("x")
    os.utime(tmp_path / "old" / "readmes.csv", (1, 1))
    files = tables.listed_files(spark, f"file://{tmp_path}", "")
    got = {r["table"]: r["path"].rsplit("/", 1)[-1] for r in reports.routed(files).collect()}
    assert got == {"readmes": "my_Readmes (1).csv", "readme_structure": "README_structure.csv", "trees": "trees_all.csv"}
