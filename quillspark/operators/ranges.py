"""Running sums within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.lineage import written

#: Rows of a group that one task sorts; larger groups are dealt by ranges.
CROWDED = 1_000_000


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], crowded: int = CROWDED) -> DataFrame:
    """rows with, for each name of `sums`, the sum of its column over the rows of the group up to this one, in `order`.

    `order` should be total: rows that tie are summed in any order. Groups of up to `crowded` rows are sorted by a window.
    If any is larger, all rows are dealt by ranges of group and order instead; each range sums by itself and gets what the
    ranges before it hold, so no task takes a whole group. Null is a group of its own. The sums are the same either way.
    """
    if not rows.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > crowded).limit(1).count():
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // crowded))
    dealt = written(rows.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*group, "__range").agg(*(F.sum(c).alias(f"__in_{k}") for k, c in sums.items()))
    # a row for each range and group: few, also of the largest group
    past = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__range").alias("__r"), *(F.sum(f"__in_{k}").over(past).alias(f"__to_{k}") for k in sums))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.col("__range") == F.col("__r"))
    w = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(before, same).withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    return out.select(*rows.columns, *(F.when(F.col(f"__to_{k}").isNull(), F.col(k)).otherwise(F.col(k) + F.coalesce(F.col(f"__to_{k}"), F.lit(0))).alias(k) for k in sums))
