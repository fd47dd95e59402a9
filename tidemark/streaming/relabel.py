"""Extension without a counterpart in the reference: labels of READMEs that change, as a stream.

Each micro-batch of changed READMEs goes through the batch operators as it is, so
a streamed label is the label a full run would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import baseline, claims, readme, sequence
from ..sources.staged import staged


def relabel(changed: DataFrame, repos: DataFrame, index: DataFrame, keys: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """changed: a stream of full_name, readme_text. Appends each batch's final labels to ``path`` as Parquet; of two versions in a batch the one greater in order is taken."""

    def label(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("full_name").agg({"readme_text": "max"}).toDF("full_name", "readme_text")
        elements = staged(readme.elements(once), "elements")
        found = staged(claims.extract(elements, repos), "claims")
        out = sequence.final_labels(baseline.baseline(found, index, keys), elements, index, keys)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch writes the same folder again

    return changed.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
