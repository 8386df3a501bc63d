"""Calls of a model on the rows of a table: replies are checked against a schema, failures retried once and told in a log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.ranges import running
from quillspark.plans.lineage import written
from quillspark.sources.batches import Batches

# Calls of a row, and failures in a row that end a run.
CALLS, MOST_FAILURES = 2, 5

_KINDS = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.BooleanType: bool, T.DoubleType: (int, float)}


def fits(value, kind: T.DataType, nullable: bool = True) -> bool:
    """Whether a value of JSON has the type; a missing or null field is right where the schema lets it be null."""
    if value is None:
        return nullable
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(fits(value.get(f.name), f.dataType, f.nullable) for f in kind)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(fits(v, kind.elementType, kind.containsNull) for v in value)
    known = _KINDS.get(type(kind))
    if known is None:
        raise TypeError(f"replies can't hold {kind.simpleString()}")
    return isinstance(value, known) and (known is bool or not isinstance(value, bool))


def _caller(model: Callable[[str], str], kind: T.StructType):
    def checked(prompt: str) -> tuple[str | None, str | None, int]:
        said = None
        for turn in range(1, CALLS + 1):
            try:
                reply = model(prompt)
                if fits(json.loads(reply), kind, False):
                    return reply, None, turn
                said = "reply doesn't fit the schema"
            except Exception as e:  # whatever a model raises is a failed call
                said = f"{type(e).__name__}: {e}"
        return None, said, CALLS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [(None, "no prompt", 0) if p is None else checked(p) for p in f["prompt"]]
            yield f[["id", "place"]].assign(reply=[t[0] for t in told], error=[t[1] for t in told], calls=[t[2] for t in told])

    return run


class ModelRun:
    """Replies of a model under `path`, a batch of rows at a time, each marked when it is whole.

    A run that is lost or stopped goes on where its marks end. Of rows, `id` tells them apart and `order` (total)
    says which come one after another.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, most_failures: int = MOST_FAILURES):
        self.spark, self.schema, self.most = spark, schema, most_failures
        self.batches = Batches(spark, path)

    def log(self) -> DataFrame:
        """(id, place, reply, error, calls, run) of every call that counts, failed ones too."""
        return self.batches.read("calls", "id string, place long, reply string, error string, calls int, run string")

    def replies(self) -> DataFrame:
        """(id, reply) as a struct of the schema; a row has one reply at most."""
        return self.log().where("error is null").select("id", F.from_json("reply", self.schema).alias("reply"))

    def summary(self) -> DataFrame:
        """One row: n_calls, n_ok, n_failed (rows whose last call failed), n_retried."""
        rows = self.log().groupBy("id").agg(F.sum("calls").alias("calls"), F.max(F.col("error").isNull()).alias("ok"))
        count = lambda c: F.count_if(c).alias
        return rows.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n_calls"), count(F.col("ok"))("n_ok"), count(~F.col("ok"))("n_failed"), count(F.col("calls") > 1)("n_retried"))

    def _first_stop(self, told: DataFrame, held: int) -> tuple[int | None, int]:
        """The place of the failure that makes `most` in a row, counting the `held` ones before; and how many stand at the end."""
        # failures in a row share the number of replies before them
        rows = running(told, [], [F.col("place")], {"good": F.col("error").isNull().cast("long")}).where("error is not null")
        rows = running(rows, ["good"], [F.col("place")], {"nth": F.lit(1).cast("long")})
        rows = rows.withColumn("nth", F.col("nth") + F.when(F.col("good") == 0, held).otherwise(0))
        stop = rows.where(F.col("nth") == self.most).agg(F.min("place").alias("at")).first()["at"]
        good = told.where("error is null").count()
        end = rows.where(F.col("good") == good).agg(F.max("nth").alias("n")).first()["n"]
        return stop, end if end is not None else (0 if good else held)

    def run(self, rows: DataFrame, model: Callable[[str], str], prompt: str = "prompt", id_col: str = "id", order: str = "order", batch: int = 10_000, tasks: int | None = None, retry_failed: bool = False) -> str:
        """Call the model for all rows that the log doesn't have (`retry_failed`: or has without a reply); `ok`, or `stopped` after failures in a row, which batches don't part.

        `batch` rows are called between two looks at the failures, by `tasks` tasks (as many as there are cores), so at most
        so many calls are made in vain; replies to rows after the stop don't count. A null prompt is a failure without a
        call, a null id is left out, of rows with one id the first by order is called. Values of `order` are numbers.
        """
        spark = self.spark
        rows = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(F.struct(F.col(order).cast("long").alias("place"), F.col(prompt).alias("prompt"))).alias("r"))
        done = self.log().where("error is null") if retry_failed else self.log()
        todo = written(rows.join(done.select("id"), "id", "left_anti").select("id", "r.place", "r.prompt"), "model-todo")
        numbered = written(running(todo, [], [F.col("place"), F.col("id")], {"nth": F.lit(1).cast("long")}).withColumn("place", F.col("nth")), "model-order")
        total, held, begun = numbered.count(), 0, len(self.batches.marks())
        for at in range(0, total, batch):
            part = numbered.where(F.col("nth").between(at + 1, at + batch)).select("id", "place", "prompt")
            dealt = part.repartition(tasks or spark.sparkContext.defaultParallelism, "id")
            told = written(dealt.mapInPandas(_caller(model, self.schema), "id string, place long, reply string, error string, calls int"), "model-told")
            stop, held = self._first_stop(told, held)
            name, folder = f"{begun + at // batch:08d}", self.batches.folder()
            counted = told if stop is None else told.where(F.col("place") <= stop)
            counted.withColumn("run", F.lit(name)).write.parquet(f"{folder}/calls")
            self.batches.commit(name, name, folder)
            if stop is not None:
                return "stopped"
        return "ok"
