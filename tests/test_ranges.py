import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.ranges import running


@pytest.mark.parametrize("crowded", [1_000_000, 50])
def test_running_sums(spark, crowded):
    """Windows and ranges give the same; one group holds most rows, one key is null, values repeat."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = running(df, ["g"], [F.col("i")], {"seq": F.lit(1), "total": F.col("v")}, crowded).collect()
    seen: dict = {}
    want = set()
    for g, i, v in rows:
        n, t = seen.get(g, (0, 0))
        seen[g] = (n + 1, t + v)
        want.add((g, i, v, *seen[g]))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i long")
    assert running(df, ["g"], [F.col("i")], {"seq": F.lit(1)}).columns == ["g", "i", "seq"]
