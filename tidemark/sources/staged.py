"""Tables between the stages of an analysis."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where that is unset a local folder is made, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


#: Rows of a narrow table that one task takes where each of them makes dozens.
ROWS_A_TASK = 4096


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """df dealt to tasks of so many rows: for narrow tables whose rows make many, as a file's size tells nothing of the work on it. Tasks grow in number with the table, not in size."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


def tasks_of(count: int, rows: int = 2**18) -> int:
    """Tasks for so many rows of a wide table or of steps that hold several of its sorts: with more rows tasks grow in number, not in size."""
    return max(1, math.ceil(count / rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: later plans start from the table, and a lost executor costs no more than its tasks. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = passing_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context, unless they find it by PYTHONPATH or in the folder the driver was started in."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] or spark.conf.get("spark.tidemark.shipped", None):
        return
    spark.conf.set("spark.tidemark.shipped", "true")
    archive = Path(tempfile.mkdtemp()) / "tidemark.zip"  # read by the driver only, which serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
