"""Stores that grow by batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import retrieval as R
from quillspark.sources.batches import StageCache, table_key
from quillspark.sources.lexical_index import LexicalIndex
from quillspark.sources.parsers import parse_files
from quillspark.sources.vector_store import VectorStore


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups of like vectors, one of them with a third of all rows; a null, a zero and a repeated vector."""
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(12, 16))
    rows = [(i, (heart[0 if i % 3 == 0 else i % 12] + 0.4 * rng.normal(size=16)).tolist(), f"p{i % 7}") for i in range(900)]
    rows += [(900, None, "p0"), (901, [0.0] * 16, "p0"), (902, rows[5][1], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, parent string").repartition(4).cache()


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_batches_equal_one_build(spark, vectors, tmp_path):
    one = VectorStore.create(vectors, f"{tmp_path}/one", lists=12)
    assert one.append(vectors, "all") and not one.append(vectors, "all")
    many = VectorStore.create(vectors, f"{tmp_path}/many", centres=one.centres())
    for i in range(3):
        many.append(vectors.where(F.col("vec_id") % 3 == i), f"b{i}")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert many.vectors().count() == one.vectors().count() == 901
    for probes in (2, 12):
        assert _rows(one.search(asked, 10, probes)) == _rows(many.search(asked, 10, probes))
    # adding a batch again with other rows replaces it
    assert many.append(vectors.where("vec_id % 3 = 1 and vec_id > 100"), "b1")
    assert many.vectors().where("id % 3 = 1 and id <= 100").count() == 0
    assert {tuple(r) for r in one.siblings(spark.createDataFrame([(8,)], "id long"), "parent").collect()} == {(8, i) for i in range(900) if i % 7 == 1}


def test_probes_reach_the_recall(spark, vectors, tmp_path):
    store = VectorStore.create(vectors, f"{tmp_path}/v", lists=12)
    store.append(vectors, "all")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = store.probes_for(asked, 10, 0.95)
    assert probes < 12
    units = vectors.select("vec_id", V.l2_normalize(F.col("embedding")).alias("v")).where("vec_id not in (900, 901)").toPandas()
    x, ids = np.stack(units["v"]), units["vec_id"].to_numpy()
    found: dict = {}
    for r in store.search(asked, 10, probes).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    want = {q: set(ids[np.lexsort((ids, -(x @ x[list(ids).index(q)])))[:10]]) for q in found}
    assert len(found) == 90 and np.mean([len(found[q] & want[q]) / 10 for q in found]) >= 0.9


def test_an_unmarked_batch_does_not_count(spark, vectors, tmp_path):
    store = VectorStore.create(vectors, f"{tmp_path}/v", lists=4)
    with pytest.raises(Exception):
        store.append(vectors.select("vec_id", F.when(F.col("vec_id") == 500, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("embedding")).alias("embedding"), "parent"), "b")
    assert store.vectors().count() == 0 and store.append(vectors, "b") and store.vectors().count() == 901


@pytest.fixture(scope="module")
def chunks(spark):
    words = "solar heat pump valve pressure engine torque".split()
    rows = [(i, f"h{i % 3} engine" if i % 4 else None, " ".join(words[(i * k) % 7] for k in range(1, i % 9 + 1)) if i % 11 else None) for i in range(120)]
    return spark.createDataFrame(rows, "id long, heading string, text string").repartition(3).cache()


def _scores(df):
    return {(r["query_id"], r["id"]): round(r["score"], 9) for r in df.collect()}


def test_index_grows_by_batches(spark, chunks, tmp_path):
    asked = spark.createDataFrame([(1, "solar heat heat"), (2, "engine torque nothing"), (3, "of the")], "query_id long, query string")
    want = _scores(R.bm25(chunks, asked, "id", R.index_text(F.col("heading"), F.col("text"))))
    index = LexicalIndex(spark, f"{tmp_path}/i")
    assert not index.search(asked).collect()
    assert index.append(chunks.where("id % 2 = 0"), "a", "id", "text", "heading")
    before = index.batches.marks()["a"]
    # a new batch leaves the first one's files alone: its texts aren't given again
    assert index.append(chunks.where("id % 2 = 1"), "b", "id", "text", "heading")
    assert index.batches.marks()["a"] == before and _scores(index.search(asked)) == want and len(want) > 50
    assert not index.append(chunks.where("id % 2 = 0"), "a", "id", "text", "heading")


def test_a_changed_heading_makes_the_batch_anew(spark, chunks, tmp_path):
    index = LexicalIndex(spark, f"{tmp_path}/i")
    index.append(chunks, "a", "id", "text", "heading")
    other = chunks.withColumn("heading", F.when(F.col("id") == 7, "unheard").otherwise(F.col("heading")))
    assert index.append(other, "a", "id", "text", "heading")
    asked = spark.createDataFrame([(1, "unheard")], "query_id long, query string")
    assert [r["id"] for r in index.search(asked).collect()] == [7]
    assert _scores(index.search(asked)) == _scores(R.bm25(other, asked, "id", R.index_text(F.col("heading"), F.col("text"))))


def test_stage_cache_reads_what_has_not_changed(spark, chunks, tmp_path):
    calls = []

    def count(df, least):
        calls.append(least)
        return df.where(F.col("id") >= least).groupBy("heading").count()

    cache = StageCache(spark, f"{tmp_path}/c")
    first = {tuple(r) for r in cache.run("count", [chunks], count, least=3).collect()}
    again = StageCache(spark, f"{tmp_path}/c")
    assert {tuple(r) for r in again.run("count", [chunks.orderBy(F.desc("id"))], count, least=3).collect()} == first
    assert calls == [3] and (again.hits, again.misses) == (1, 0)
    again.run("count", [chunks], count, least=4)
    again.run("count", [chunks.where("id <> 5")], count, least=3)
    assert calls == [3, 4, 3] and again.misses == 2
    # a chain: the second stage's key is what the first one gave
    steps = [StageCache(spark, f"{tmp_path}/c") for _ in range(2)]
    for c in steps:
        c.run("sum", [c.run("count", [chunks], count, least=3)], lambda df: df.agg(F.sum("count").alias("n")))
    assert (steps[1].hits, steps[1].misses) == (2, 0)


def test_keys_tell_tables_apart(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert table_key(a) == table_key(a.orderBy(F.desc("i")))
    assert table_key(a) != table_key(a.union(a)) and table_key(a) != table_key(a.limit(1)) and table_key(a) != table_key(a.withColumnRenamed("s", "t"))


def test_bad_bytes_are_replaced(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"caf\xe9 one two three.")), ("b.txt", bytearray("fine ü.".encode()))], "name string, content binary")
    got = {r["source_file"]: r["content"] for r in parse_files(files).collect()}
    assert "�" in got["a.txt"] and got["b.txt"] == "fine ü."
