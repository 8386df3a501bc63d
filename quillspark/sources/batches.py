"""Tables that grow by batches with commit marks, and results that are kept by the content of what they were made from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "batch string, key string, folder string, seq long, n long, total long"


def table_key(df: DataFrame, columns: list[str] | None = None) -> str:
    """A hash of all rows, whatever their order: hashes of rows are summed, so no task sees the whole table."""
    row = F.xxhash64(*(columns or df.columns))
    again = F.xxhash64(F.lit(1), *(columns or df.columns))
    sums = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in (row, again))).first()
    return hashlib.sha256(":".join(map(str, [df.schema.simpleString(), *sums])).encode()).hexdigest()


class Batches:
    """Folders of data under `path`, of which those count that a mark names; a mark is one row in a file of its own.

    Data is written to a fresh folder first and marked then, so a job that is lost on the way leaves nothing that counts. The
    last mark of a batch holds: writing a batch again replaces it. There is a mark for each batch, not for each row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def marks(self) -> dict:
        """The mark of each batch."""
        if not self._exists(f"{self.path}/marks"):
            return {}
        rows = self.spark.read.schema(_MARK).parquet(f"{self.path}/marks").collect()
        return {r["batch"]: r for r in sorted(rows, key=lambda r: (r["seq"], r["folder"]))}

    def folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def commit(self, batch: str, key: str, folder: str, n: int = 0, total: int = 0) -> None:
        seq = max((m["seq"] for m in self.marks().values()), default=0) + 1
        row = self.spark.createDataFrame([(batch, key, folder, seq, n, total)], _MARK)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    def read(self, part: str, schema: str) -> DataFrame:
        """A part of all batches that count; an empty table of that schema if there is none."""
        folders = [f"{m['folder']}/{part}" for m in self.marks().values()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in folders])


class StageCache:
    """Results of stages, each under a key made of its name, its parameters and the content of its inputs."""

    def __init__(self, spark: SparkSession, path: str):
        self.batches = Batches(spark, path)
        self.hits = self.misses = 0

    def run(self, name: str, inputs: list[DataFrame], build: Callable[..., DataFrame], **parameters) -> DataFrame:
        """build(*inputs, **parameters) from a table: made and marked at the first call, read as long as nothing has changed.

        A changed row of an input, another parameter or another schema makes another key. What was made before stays, so
        going back to old inputs reads again.
        """
        said = [name, *(table_key(df) for df in inputs), *(f"{k}={parameters[k]!r}" for k in sorted(parameters))]
        key = hashlib.sha256("\n".join(said).encode()).hexdigest()
        mark = self.batches.marks().get(key)
        if mark:
            self.hits += 1
            return self.batches.spark.read.parquet(mark["folder"])
        self.misses += 1
        folder = self.batches.folder()
        build(*inputs, **parameters).write.parquet(folder)
        self.batches.commit(key, key, folder)
        return self.batches.spark.read.parquet(folder)
