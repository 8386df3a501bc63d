"""Edge weights over restarts, numbers and budgets of large groups, and the second ranking."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import passages as P
from quillspark.operators import ranges, retrieval as R, segment as S
from quillspark.streaming import logs

SCHEMA = "id long, ts timestamp, a string, b string"
T0 = datetime.datetime(2024, 1, 1)


def _rows(n, seed):
    rng = random.Random(seed)
    return [(1000 * seed + i, T0 + datetime.timedelta(minutes=i), rng.choice("abc"), rng.choice("abcd")) for i in range(n)]


def _weights(df):
    return {(r["u"], r["v"]): r["w"] for r in df.collect()}


def test_edges_over_restarts(spark, tmp_path):
    """Two runs over a checkpoint equal one batch; a run without news changes nothing; repeated rows count once."""
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    pairs = lambda rows: rows.select(F.col("a").alias("e1"), F.col("b").alias("e2"))
    one, two = _rows(200, 1), _rows(150, 2)
    go = lambda: logs.grow_edges(logs.stream_files(spark, src, SCHEMA), out, state, pairs, "id")
    spark.createDataFrame(one, SCHEMA).repartition(2).write.parquet(src)
    go()
    want = Counter(tuple(sorted(r[2:])) for r in one)
    assert _weights(logs.read_edges(spark, out)) == want
    go()
    assert _weights(logs.read_edges(spark, out)) == want
    spark.createDataFrame([*two, *one[:50], *two[:10]], SCHEMA).repartition(2).write.mode("append").parquet(src)
    go()
    assert _weights(logs.read_edges(spark, out)) == want + Counter(tuple(sorted(r[2:])) for r in two)
    assert _weights(logs.edge_weights(pairs(spark.createDataFrame(one + two, SCHEMA)))) == want + Counter(tuple(sorted(r[2:])) for r in two)


def test_late_and_repeated_rows(spark, tmp_path):
    """With a time, repeats within the limit count once, and rows later than it are left out."""
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    pairs = lambda rows: rows.select(F.col("a").alias("e1"), F.col("b").alias("e2"))
    go = lambda: logs.grow_edges(logs.stream_files(spark, src, SCHEMA), out, state, pairs, "id", "ts", "1 hour")
    day = T0 + datetime.timedelta(days=1)
    spark.createDataFrame([(1, T0, "a", "b"), (2, day, "a", "b")], SCHEMA).coalesce(1).write.parquet(src)
    go()
    spark.createDataFrame([(2, day + datetime.timedelta(minutes=5), "a", "b"), (3, T0, "a", "b"), (4, day, "b", "a")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    go()
    assert _weights(logs.read_edges(spark, out)) == {("a", "b"): 3}


def test_large_groups_are_numbered_by_ranges(spark, monkeypatch):
    rows = [("s" if i % 4 else "t", i, 10 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "session string, at long, n long").repartition(5)
    plain = {tuple(r) for r in S.number_chunks(df, "session", ["at"]).select("at", "id").collect()}
    kept = {r["at"] for r in P.within_budget(df, 500, "at", F.col("n"), "session").collect()}
    monkeypatch.setattr(S, "running", lambda *a: ranges.running(*a, crowded=30))
    monkeypatch.setattr(P, "running", lambda *a: ranges.running(*a, crowded=30))
    assert {tuple(r) for r in S.number_chunks(df, "session", ["at"]).select("at", "id").collect()} == plain and (0, "t_chunk_0000") in plain
    assert {r["at"] for r in P.within_budget(df, 500, "at", F.col("n"), "session").collect()} == kept == {r["at"] for r in P.within_budget(df, 500, "at", F.col("n"), "session", few=True).collect()}


def test_second_ranking_sees_other_forms(spark):
    """A text with other forms of all asked words comes before one that repeats a single word, against the first ranking."""
    texts = spark.createDataFrame([(1, "pumps heating valves pressures"), (2, "pump pump pump"), (3, "nothing here"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "pump heated valve pressure")], "question_id long, query string")
    first = R.top(R.bm25(texts, asked.withColumnRenamed("question_id", "query_id"), "id", F.col("text")), 30)
    assert [r["id"] for r in first.orderBy("rank").collect()] == [2]
    ranked = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4)], "question_id long, id long")
    got = [(r["id"], round(r["maxsim"], 6)) for r in R.late_interaction(ranked, asked, texts, "id", F.col("text")).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4] and got[1][1] == 1.0 and got[3] == (4, 0.0)


def test_cosines_of_chunk_sets(spark):
    """A chunk that holds all concepts is dealt to many keys; nulls and repeats don't count."""
    from quillspark.operators.concepts import incidence_cosine

    rng = random.Random(9)
    held = {(f"c{i}", rng.randrange(12)) for i in range(40) for _ in range(rng.randrange(1, 6))} | {(f"c{i}", 99) for i in range(40)}
    df = spark.createDataFrame([*held, *list(held)[:9], (None, 1), ("c1", None)], "concept string, chunk long").repartition(3)
    sets = {c: {k for x, k in held if x == c} for c, _ in held}
    want = {(a, b): len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5 for a in sets for b in sets if a < b}
    for least in (0.0, 0.6):
        for block in (256, 5):
            got = {(r["u"], r["v"]): r["cosine"] for r in incidence_cosine(df, least, block).collect()}
            assert set(got) == {p for p, c in want.items() if c >= least} and all(abs(got[p] - want[p]) < 1e-12 for p in got)
