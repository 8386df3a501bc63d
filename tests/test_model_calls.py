import json

from pyspark.sql import types as T

from quillspark.plans.model_calls import ModelRun, fits

SCHEMA = T.StructType([T.StructField("topic", T.StringType(), True), T.StructField("names", T.ArrayType(T.StringType(), False), False)])


def fake(bad, flaky=(), folder=None):
    """A model that fails on some numbers, and on some at the first call only."""

    def model(prompt):
        import pathlib

        n = int(prompt.split()[1])
        if n in flaky:
            seen = pathlib.Path(folder, f"seen-{n}")
            if not seen.exists():
                seen.touch()
                raise TimeoutError("slow")
        if n in bad:
            return '{"topic": 3, "names": []}' if n % 2 else "no json"
        return json.dumps({"topic": f"t{n}", "names": [f"n{n}"]})

    return model


def rows(spark, n):
    return spark.createDataFrame([(f"c{i}", i, f"text {i}") for i in range(n)], "id string, order long, prompt string")


def test_fits():
    assert fits({"topic": None, "names": ["a"]}, SCHEMA) and fits({"names": []}, SCHEMA)
    for wrong in ({"topic": "a"}, {"topic": 1, "names": []}, {"names": [None]}, {"names": "a"}, [], "a"):
        assert not fits(wrong, SCHEMA)
    assert not fits(True, T.LongType()) and fits(True, T.BooleanType()) and fits(2, T.DoubleType())


def test_failures_are_told_and_called_again(spark, tmp_path):
    run = ModelRun(spark, f"file://{tmp_path}/m", SCHEMA)
    table = rows(spark, 12).union(spark.createDataFrame([(None, 50, "text 50"), ("c1", 60, "text 60"), ("x", 70, None)], "id string, order long, prompt string"))
    assert run.run(table, fake({2, 3, 8}, {5}, str(tmp_path)), batch=5) == "ok"
    log = {r["id"]: r for r in run.log().collect()}
    assert len(log) == 13 and {i for i, r in log.items() if r["error"]} == {"c2", "c3", "c8", "x"}
    assert log["c3"]["error"] == "reply doesn't fit the schema" and log["c2"]["error"].startswith("JSONDecodeError") and log["x"]["calls"] == 0
    assert [log[i]["calls"] for i in ("c1", "c2", "c5")] == [1, 2, 2]
    assert {r["id"]: r["reply"]["topic"] for r in run.replies().collect()} == {f"c{i}": f"t{i}" for i in range(12) if i not in (2, 3, 8)}
    # nothing is left to do, but what has failed may be called again
    assert run.run(table, fake({8}), batch=5) == "ok" and run.log().count() == 13
    assert run.run(table, fake({8}), batch=5, retry_failed=True) == "ok"
    # calls: 8 rows at once, c5 twice, three failures twice; then c2 and c3 once and c8 twice
    assert tuple(run.summary().first()) == (8 + 2 + 6 + 1 + 1 + 2, 11, 2, 4)


def test_stop_after_failures_that_batches_part(spark, tmp_path):
    """Places 2 to 6 fail over the edge of two batches; nothing after the fifth counts, and a better model goes on there."""
    run = ModelRun(spark, f"file://{tmp_path}/m", SCHEMA)
    assert run.run(rows(spark, 30), fake({0, *range(2, 9)}), batch=4) == "stopped"
    assert {(r["id"], r["error"] is None) for r in run.log().collect()} == {("c1", True)} | {(f"c{i}", False) for i in (0, *range(2, 7))}
    assert run.run(rows(spark, 30), fake(set()), batch=50) == "ok"
    assert run.replies().count() == 24
    assert run.run(rows(spark, 30), fake(set()), batch=50, retry_failed=True) == "ok"
    assert run.replies().count() == 30 and run.replies().select("id").distinct().count() == 30
    empty = ModelRun(spark, f"file://{tmp_path}/e", SCHEMA)
    assert empty.run(rows(spark, 0), fake(set())) == "ok" and empty.log().count() == 0
