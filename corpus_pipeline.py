"""A training corpus from the documents table: filter, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, line_dedup, mixing, packing, quality
from quillspark.llm.common import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, trained on the rows labelled good; null and empty texts stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat across documents; n_chars, where docs has it, follows the text.

    Null text comes out empty; other columns pass through, whatever their names. See line_dedup for ties and repeats.
    """
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    out = line_dedup.without_lines(docs)
    return out.select(*(new[c].alias(c) if c in new else F.col(f"whole.`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that similarity joins; of repeated rows one, of rows without words all."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is one of its own, rows without words count nothing."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences; null text is a piece with the end id, repeated rows are packed each by itself."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_filter), ("lines", drop_lines), ("near-copies", drop_near_copies), ("mix", mix), ("pack", pack)]

#: The stages are a trained model, a random mix and a packing search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder first. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
