"""Exact deduplication by a keyed streaming state on disk, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize, scratch_path, settings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The state store for the time a stream runs: RocksDB with a fixed share of memory, whatever the number of partitions.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no megabytes set aside for each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """Lower case for A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _globbed(path: str) -> str:
    """The same path as a pattern: a stream takes a pattern for single files and folders alike."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def advance_state(spark: SparkSession, path: str, checkpoint: str, id_col: str, text_col: str, digest_bits: int = 256) -> None:
    """Bring the keyed state in `checkpoint` up to date with the parquet files under `path`; earlier files aren't read again.

    State of a digest, kept without expiry: the largest stable identifier, its content locator (file and row within it)
    and the number of rows.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(_globbed(path))
    at = F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = rows.select(_digest(text_col, digest_bits).alias("digest"), at.alias("at")).groupBy("digest").agg(F.max("at").alias("keeper"), F.count("*").alias("n"))
    with settings(spark, STORE):
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _digest(text_col: str, bits: int) -> Column:
    full = F.sha2(normalised(F.col(text_col)), 256)
    return full if bits == 256 else F.left(full, F.lit(bits // 4))


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, file, row, n) of every key that the state holds."""
    with settings(spark, STORE):
        state = spark.read.format("statestore").load(checkpoint)
        return state.select("key.digest", F.col("value.*")).toDF("digest", "keeper", "n").select("digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.file").alias("file"), F.col("keeper.row").alias("row"), "n")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, digest_bits: int = 256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of the parquet table at `path`; the largest id of equal texts stays.

    A stream keeps one state row for each digest (see advance_state); with a `checkpoint` of an earlier call only new
    files go through it. Rows whose digest was hit more than once are compared with the bytes found at the keeper's
    locator. Rows that differ there (a digest collision), and such of a digest whose keeper or rows have gone with a
    file since the state saw them, are grouped by their whole texts instead.

    Null text equals empty text. A null id is less than any other; rows of equal id and text are all `kept` when theirs
    is the largest id. An empty table gives an empty one. Extra columns are ignored.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    docs = spark.read.parquet(path)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.col("sha") if digest_bits == 256 else F.left("sha", F.lit(digest_bits // 4)))
    if not docs.take(1):
        return rows.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    advance_state(spark, path, checkpoint, id_col, text_col, digest_bits)
    hits, _ = materialize(read_state(spark, checkpoint).where("n > 1"), "dedup-hits")

    # rows with a digest that was hit, and which of them is at the locator
    found = keyed_join(rows.select("id", "digest", "norm", "file", "row"), hits.toDF("digest", "keep_id", "keep_file", "keep_row", "n"), ["digest"], "inner", 240)
    found, _ = materialize(found.select("id", "digest", "norm", ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("here")), "dedup-found")
    kept_text = found.where("here").select("digest", F.col("norm").alias("keep_norm"))
    # written before it is made distinct, so that the join may deal a hot digest to many tasks
    differ, _ = materialize(found.select("digest", "norm").join(kept_text.hint("merge"), "digest").where("norm <> keep_norm").select("digest"), "dedup-differ")
    # where files that the state knows are gone, the keeper or the number of rows no longer holds
    there = found.groupBy("digest").agg(F.count("*").alias("rows"), F.max("here").alias("here"))
    stale = there.join(hits.select("digest", "n"), "digest").where("rows <> n or not here").select("digest")
    clash, _ = materialize(differ.union(stale).distinct(), "dedup-clash")
    plain = keyed_join(rows.select("id", "digest", "sha"), hits.select("digest", "keep_id", "n"), ["digest"], "left", 120)
    out = plain.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"), "digest")
    if clash.take(1):
        again = rows.join(clash, "digest", "left_semi")
        exact = again.groupBy("norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        exact, _ = materialize(exact, "dedup-exact")
        out = out.join(clash, "digest", "left_anti").unionByName(again.join(exact, "norm").select("id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), "digest"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("id", "doc_id")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
