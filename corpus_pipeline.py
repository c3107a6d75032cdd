"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm import bpe, decontaminate, jaccard, langid, lines
from signalframe.llm.common import settled, stored

#: The least share of the softmax of all languages' values that an accepted document's language has.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no learned language has half of the score (LEAST_SHARE).

    The model learns from the labelled documents; where none has a label, all go.
    """
    return langid.accepted(docs, langid.fit(docs), least=LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; documents of which nothing is left go too."""
    return lines.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 5-word similarity 0.8 one stays: that with the least id (null ids last), of rows with one id the first read."""
    rows = settled(docs).withColumn("row__", F.monotonically_increasing_id())
    groups = stored(jaccard.join_components(rows, key="row__", size=5, num=4, den=5))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row__")).alias("first")
    kept = groups.join(rows.select("row__", "doc_id"), "row__").groupBy("component_id").agg(first).select("first.row__")
    gone = groups.select("row__").join(kept, "row__", "left_anti")
    return rows.join(stored(gone), "row__", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digests of the ids and of the text decoded from them."""
    return bpe.encode_and_digest(docs, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_ids", bpe_ids),
]

#: SQL can't express language identification, winnowing or BPE; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
