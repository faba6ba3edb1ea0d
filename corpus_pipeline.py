"""A corpus pipeline over ``documents``: classify, dedup, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame that is written as Parquet and reread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import crf, decontaminate, mixing, near_dup, sharding
from gridloom.llm.common import release, stored_paths, table, written
from gridloom.llm.queries import MIX_EPOCHS, MIX_SEED, WEIGHTS

#: Share of the tokens that reach the mixture and stay in it.
MIX_FRACTION = 0.8
SHARDS = 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# All stages: an empty table stays empty, columns beyond those of documents pass through
# whatever their names, and whole texts count, however long they are.


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field finds good; labels train it.

    Null and empty texts have no line and go.  Repeated rows are judged alike; a
    score of just 0.5 stays.
    """
    return crf.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id.

    Rows that repeat a kept doc_id, rows of a null doc_id and texts without words stay.
    """
    return near_dup.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents made mostly of them go.

    Null and empty texts stay; repeated rows are treated alike; half a text is not most of it.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its leaf's budget takes it.

    A null lang or source is a leaf "unknown"; null texts have no tokens; rows that
    repeat a doc_id in one leaf go together.
    """
    return mixing.mixture(docs, WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns plus shard and slot: runs of a seeded key order of near-equal bytes.

    A null text counts one byte; rows that agree in doc_id and text share a shard.
    Columns named shard or slot are replaced.
    """
    return sharding.shard_rows(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("near_dedup", deduplicate),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: SQL can express neither the classifier nor the near-duplicate search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every result is written and reread, and then
    what the stage stored and the result before it are deleted."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        before = set(stored_paths())
        docs, path = written(step(spark, docs, sf_dir), name)
        release(spark, [p for p in stored_paths() if p not in before] + last)
        last = [path]
    return docs
