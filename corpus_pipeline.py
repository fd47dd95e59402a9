"""The corpus pipeline: five stages, each a call of one training-data operator.

Each stage takes all that the one before has kept, as written to Parquet and read
again. All but the last return the columns of documents. Empty tables, null texts
and ids and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, pii, simhash, toxicity
from tidemark.llm.common import load, small_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the clause grammar, fitted on labels, scores at 0.5 or more."""
    small_batches(spark)
    model = toxicity.grammar(docs, load(spark, sf_dir, "labels"), language.fold_of("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near-duplicates."""
    small_batches(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that share ten words in a row, or a whole shorter item, with the benchmark."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of personal data."""
    return pii.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with what they decode to as a digest."""
    small_batches(spark)
    out = bpe.bpe_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("bpe", encode),
]

#: SQL can't express the fitted grammar; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
