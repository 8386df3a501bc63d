"""Files of a session to its chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.segment import bag_distances, number_chunks, semantic_chunks
from quillspark.sources.parsers import parse_files, read_uploads
from quillspark.sources.stores import write_session


def chunk_sections(sections: DataFrame, session: str, distances=bag_distances) -> DataFrame:
    """Chunks (id, parent_id, chunk_seq, source_file, source_type, page_or_slide, heading, text, start, end) of a session's sections."""
    keys = ["source_file", "page_or_slide", "heading"]
    cut = semantic_chunks(sections, keys, distances=distances).withColumn("session_id", F.lit(session))
    numbered = number_chunks(cut, "session_id", ["source_file", "page_or_slide", "heading", "cut"])
    return numbered.select("id", T.parent_id(F.col("source_file"), F.col("heading"), F.col("page_or_slide")).alias("parent_id"), "chunk_seq", "source_file", T.source_type(F.col("source_file")).alias("source_type"), "page_or_slide", "heading", "text", "start", "end")


def ingest(spark: SparkSession, uploads: str, table: str, session: str, distances=bag_distances) -> DataFrame:
    """Parse the files of a folder, chunk them and replace the session's part of the chunk table."""
    chunks = chunk_sections(parse_files(read_uploads(spark, uploads)), session, distances)
    write_session(chunks, table, session)
    return spark.read.parquet(table).where(F.col("session_id") == session)
