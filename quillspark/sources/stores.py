"""Tables of sessions: chunks, vectors, answers, extractions and the sessions themselves, parted by session."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = "id string, parent_id string, source_file string, source_type string, page_or_slide int, heading string, text string"
CLAIM = "struct<text:string,support:array<string>,kind:string,support_score:double,verified:boolean>"
ANSWER_SCHEMA = (
    "id string, ts string, question string, status string, partial boolean, answer string, "
    f"claims array<{CLAIM}>, dropped_claims array<{CLAIM}>, timings map<string,double>, versions map<string,string>, "
    "polished struct<text:string,words:int>, consolidated struct<lead:struct<text:string>,points:array<struct<text:string>>>"
)
SESSION_SCHEMA = "session_id string, name string, created_at timestamp, document_count int, chunk_count int, is_processed boolean"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(ANSWER_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def write_session(df: DataFrame, path: str, session: str, mode: str = "overwrite", form: str = "parquet") -> None:
    """Replace (or append to) one session's part of a table."""
    df.withColumn("session_id", F.lit(session)).write.mode(mode).partitionBy("session_id").option("partitionOverwriteMode", "dynamic").format(form).save(path)


def append_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").json(path)


def content_key(chunks: DataFrame, order: str = "chunk_seq") -> DataFrame:
    """One row (key): a hash of all headings and texts, for a store to tell whether it is up to date.

    Hashes of rows are summed with their places, so no task sees all texts.
    """
    row = F.xxhash64(order, "heading", "text")
    return chunks.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(row), F.lit(0)).cast("string")), 256).alias("key"))


class Sessions:
    """A table of sessions under a folder; each change rewrites that small table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/sessions"

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def list(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SESSION_SCHEMA)
        return self.spark.read.schema(SESSION_SCHEMA).json(self.path).orderBy(F.desc("created_at"), "session_id")

    def _write(self, rows: list) -> None:
        schema = T._parse_datatype_string(SESSION_SCHEMA)
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(self.path)

    def create(self, name: str) -> str:
        session = uuid.uuid4().hex[:8]
        self._write([*map(tuple, self.list().collect()), (session, name, datetime.datetime.now(), 0, 0, False)])
        return session

    def update(self, session: str, **values) -> None:
        self._write([tuple((r.asDict() | (values if r["session_id"] == session else {})).values()) for r in self.list().collect()])

    def delete(self, session: str) -> None:
        self._write([tuple(r) for r in self.list().collect() if r["session_id"] != session])
