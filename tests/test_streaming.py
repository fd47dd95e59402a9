from tidemark.operators import artifacts
from tidemark.streaming.relabel import relabel


def test_stream_labels_what_changed(spark, tmp_path):
    repos = spark.createDataFrame([("o/a", False)], "full_name string, curated_list_heuristic boolean")
    trees = spark.createDataFrame([("o/a", "run.py", "blob")], "full_name string, path string, type string")
    configs = spark.createDataFrame([], "full_name string, path string, basename string, content string")
    source = str(tmp_path / "in")
    spark.createDataFrame([("o/a", "# Run\n```\npython run.py\npython gone.py\n```")], "full_name string, readme_text string").write.parquet(source)
    changed = spark.readStream.schema("full_name string, readme_text string").parquet(source)
    q = relabel(changed, repos, artifacts.artifact_index(trees, configs), artifacts.path_keys(trees), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["artifact_or_path"], r["label_v4"]) for r in rows} == {("run.py", "supported"), ("gone.py", "drifted_high")}
