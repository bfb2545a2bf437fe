"""Training corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token output.

Each stage works on all documents its predecessor kept. Stages take ``(spark, docs, sf_dir)``; all
but the last return the columns of ``documents``. Between stages documents are written as Parquet
and read again, so a lost executor never sends work back beyond the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitwright.llm import decontam, mixing, omh, quality, rans
from gaitwright.llm.common import discard, materialize, table
from gaitwright.session import ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality model scores 0.5 or more."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the least doc_id."""
    ship_package(spark)
    return omh.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item (or a whole shorter item)."""
    ship_package(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit_copies(mixing.mix(docs)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rANS blocks, in ascending doc_id order; the index read back from their folder, ``files``."""
    import public_tokenizers

    ship_package(spark)
    folder = rans.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rans.read_tokens(spark, folder).withColumn("files", F.lit(folder))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("tokens", write_tokens),
]

#: A fitted classifier and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
