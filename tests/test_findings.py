"""Findings of a review: steps that grew faster than their input or differed from their SQL."""

import difflib
import random
import time

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import concepts as C
from quillspark.operators import graph as G
from quillspark.operators import layout as L
from quillspark.operators import passages as P


def test_fuzzy_pairs_meet_in_blocks(spark, monkeypatch):
    """Keys of one letter are dealt to many tasks; all pairs are found, long and accented keys too (F1)."""
    monkeypatch.setattr(C, "FUZZY_BLOCK", 16)
    rng = random.Random(1)
    keys = {"a" + "".join(rng.choice("ab ï") for _ in range(rng.randint(0, 14))) for _ in range(150)}
    keys |= {("abc abd " * 12)[i : i + 61 + i % 9] + "xy"[i % 2] for i in range(0, 24, 8)} | {"", "a b", "b a"}
    want = {}
    for a in keys:
        for b in keys:
            words = set(a.split(" ")), set(b.split(" "))
            if a < b and a[:1] == b[:1] and abs(len(a) - len(b)) <= 3 and words[0] - words[1] and words[1] - words[0]:
                r = difflib.SequenceMatcher(None, a, b).ratio()
                if r >= 0.7:
                    want[a, b] = r
    got = C.fuzzy_pairs(spark.createDataFrame([(k,) for k in [*keys, None]], "key string"), least=0.7)
    assert {(r["a"], r["b"]): r["ratio"] for r in got.collect()} == want and len(want) > 50


def test_best_span_rounds_as_sql():
    """A weight of 0.90625 counts 0.9063, as in SQL; lengths of documents where that decides between two windows (F4)."""
    x = [110, 105, 34, 17, 241, 126, 376, 29, 45, 59, 24, 178, 68, 208, 19, 128]
    y = [73, 156, 173, 152, 177, 30, 173, 96, 20, 40, 53, 72, 214, 55, 46, 145]
    assert [P.best_span(["x" * n for n in z])[:2] for z in (x, y)] == [(7, 16), (3, 12)]


def test_graph_of_chunks_equals_pairs_of_names(spark, monkeypatch):
    """Edges by id, formed within chunks and in more than one array, are those of names that meet in a chunk (F6, F7, F8)."""
    monkeypatch.setattr(C, "PAIRS_AT_ONCE", 50)
    rng = random.Random(2)
    held = {(k, f"n{rng.randrange(60)}") for k in range(12) for _ in range(rng.randrange(40))} | {(99, "alone"), (98, "Éa")}
    df = spark.createDataFrame([*held, (1, None), (None, "n1")], "k long, e string").repartition(5)
    names, edges = C.cooccurrence_graph(df, "k", "e")
    name = {r["id"]: r["e"] for r in names.collect()}
    assert sorted(name) == list(range(len(name))) and [name[i] for i in sorted(name)] == sorted(name.values())
    want = {(r["e1"], r["e2"]): float(r["weight"]) for r in C.cooccurrence(df, "k", "e").collect()}
    assert {(name[r["u"]], name[r["v"]]): r["w"] for r in edges.collect()} == want


def test_ordered_terms_of_a_long_text(spark):
    """60,000 words take time by their number, not by its square (F9)."""
    df = spark.createDataFrame([("Ab ab  AB cd é " * 3 + "x" * 9 + " ab" * 60_000,), ("",), (None,)], "t string")
    start = time.time()
    got = [r[0] for r in df.select(T.ordered_distinct(F.split("t", " "), 4, 6)).collect()]
    assert got == [["Ab", "cd", "é", "xxxx"], [], None] and time.time() - start < 30


def test_search_holds_few_scores_at_once(spark, tmp_path, monkeypatch):
    """Lists are put to groups and scored in slices; few probes look into their lists alone, all find the nearest (F11)."""
    import numpy as np

    from quillspark.sources import vector_store as S

    for name, value in (("BLOCK", 40), ("PROBED_AT_ONCE", 30), ("ROWS_AT_ONCE", 4), ("SCORES_AT_ONCE", 100)):
        monkeypatch.setattr(S, name, value)
    x = np.random.default_rng(4).normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    store = S.VectorStore.create(rows, f"{tmp_path}/store", lists=9)
    store.append(rows, "one")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = store.centres()
    of = (unit @ centres.T).argmax(1)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "query_id long, vector array<double>")
    for probes in (2, 9):
        got = {}
        for r in store.search(asked, 5, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        for q in range(30):
            lists = np.argsort(-(unit[q] @ centres.T), kind="stable")[:probes]
            at = np.flatnonzero(np.isin(of, lists))
            assert got[q] == at[np.argsort(-(unit[at] @ unit[q]), kind="stable")[:5]].tolist()


def _planted(rng, groups, each, inside, across):
    """Edges of groups of names that know each other more than others."""
    names = [f"g{g}n{i:02d}" for g in range(groups) for i in range(each)]
    return [(a, b, float(rng.randint(1, 3))) for i, b in enumerate(names) for a in names[:i] if rng.random() < (inside if a[:2] == b[:2] else across)]


def test_large_graphs_are_contracted_by_all_tasks(spark, monkeypatch):
    """A graph beyond the bound is contracted in rounds and finds the groups that one task finds; sessions stay apart (F2)."""
    rng = random.Random(5)
    big, small = _planted(rng, 5, 12, 0.8, 0.02) + [("o1", "o2", 1.0)], _planted(rng, 2, 4, 1.0, 0.1)
    rows = [("big", *e) for e in big] + [("small", *e) for e in small]
    df = spark.createDataFrame(rows, "s string, u string, v string, w double").repartition(3)
    want = {(r["session"], r["node"]): (r["community"], r["resolution"], round(r["modularity"], 9)) for r in G.communities(df, "s").collect()}
    monkeypatch.setattr(G, "FEW_EDGES", 60)
    got = {(r["session"], r["node"]): (r["community"], r["resolution"], round(r["modularity"], 9)) for r in G.communities(df, "s").collect()}
    assert got == want and len({c for (s, _), (c, *_) in got.items() if s == "big"} - {None}) == 5 and got["big", "o1"][0] is None


def test_small_communities_join_at_once_as_in_order(spark):
    """Turns taken at once end as turns taken from the largest label down; 20,000 orphans take little time (F2)."""
    rng = random.Random(6)
    community = {i: i if rng.random() < 0.5 else rng.randrange(i, 60) for i in range(60)}
    links = {(a, b): float(rng.randint(1, 3)) for b in range(60) for a in range(b) if rng.random() < 0.04}
    adj = G._neighbours([(a, b, w) for (a, b), w in links.items()])
    want, orphans = G.merge_small(adj, community)
    sizes = spark.createDataFrame([(c, list(community.values()).count(c)) for c in set(community.values())], "x long, n long")
    ways = [(community[a], community[b], w) for (a, b), w in links.items()] + [(community[b], community[a], w) for (a, b), w in links.items()]
    table = spark.createDataFrame(ways, "x long, y long, w double").groupBy("x", "y").agg(F.sum("w").alias("w"))
    to = {r["x"]: r["to"] for r in G._merged_small(sizes, table).collect()}
    assert {n: to[c] for n, c in community.items()} == {n: want.get(n) for n in community} and orphans and len(set(want.values())) > 1
    start = time.time()
    pairs = [(2 * i, 2 * i + 1, 1.0) for i in range(20_000)]
    assert G.merge_small(G._neighbours(pairs), {n: a for a, b, _ in pairs for n in (a, b)}) == ({}, list(range(40_000))) and time.time() - start < 10


def test_members_of_a_map_are_ranked_without_one_task(spark):
    """Importance and membership come from sums by session and cluster; no window takes a session (F3)."""
    rows = [("s", c, f"n{i:03d}", 1 + i * c, float(i)) for c in (0, 1) for i in range(80)]
    df = L.scaled_members(spark.createDataFrame(rows, "session string, cluster long, name string, support long, weight double"))
    assert "windowspecdefinition(session#" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "cluster#" not in x)
    got = {(r["cluster"], r["name"]): (r["imp"], r["mem"], r["rank"]) for r in df.collect()}
    assert len(got) == 120 and got[1, "n079"] == (1.0, 1.0, 0) and got[0, "n079"] == (0.11, 1.0, 0) and got[1, "n020"] == (round((21 / 80) ** 0.5, 2), round(20 / 79, 2), 59)


def test_pairs_of_vectors_are_not_shuffled(spark, monkeypatch):
    """Signals meet in the task of two blocks of vectors, chunks of many concepts too; equal to pairs by hand (F5)."""
    import numpy as np

    rng, x = random.Random(7), np.random.default_rng(7).normal(size=(30, 4))
    held = {(i, k) for k in range(8) for i in range(40) if rng.random() < 0.15} | {(i, 99) for i in range(0, 40, 3)}
    rels = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 4)) for _ in range(60)]
    met = C._met
    monkeypatch.setattr(C, "_met", lambda rows, block: met(rows, 6))
    args = (spark.createDataFrame(rels, "source long, target long, weight long"), spark.createDataFrame([*held, *list(held)[:5]], "concept long, chunk long"), spark.createDataFrame([*enumerate(x.tolist()), (35, None)], "id long, v array<double>"))
    out = C.measured_affinity(*args, 0.4, block_rows=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInPandas")]
    sets = {i: {k for j, k in held if j == i} for i in range(40)}
    both = {}
    for a, b, w in rels:
        if a != b:
            both[min(a, b), max(a, b)] = both.get((min(a, b), max(a, b)), 0) + w
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = {}
    for b in range(40):
        for a in range(b):
            one = (both[a, b] / max(both.values()) if (a, b) in both else None, len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5 if sets[a] & sets[b] else None, float(cos[a, b]) if b < 30 and cos[a, b] >= 0.4 else None)
            if any(s is not None for s in one):
                want[a, b] = tuple(s and round(s, 9) for s in one)
    got = {(r["u"], r["v"]): tuple(s and round(s, 9) for s in (r["relation"], r["cooccur"], r["semantic"])) for r in out.collect()}
    assert got == want


def test_texts_are_read_once_for_a_ranking(spark):
    """BM25, shared tokens and phrases come from one pass over the texts; headings count for BM25 (F10)."""
    from quillspark.operators import retrieval as R

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    texts = [(1, "pump", "pumps and valves"), (2, None, "pump pump heat"), (3, "heat", None), (4, "", "nothing here")]
    chunks = spark.createDataFrame(texts, "id long, head string, text string").mapInPandas(count, "id long, head string, text string")
    asked = spark.createDataFrame([(1, ["pump heat"], ["valve"], ["heat"], "", "pump", ["none"])], "question_id long, queries array<string>, key_terms array<string>, sub_questions array<string>, hypothetical_answer string, focus string, hinted_files array<string>")
    got = [(r["id"], r["retrieval_score"]) for r in R.composite_rank(chunks, asked, "id", "text", F.col("head"), F.lit("f")).orderBy("rank").collect()]
    assert seen.value == 4 and [i for i, _ in got] == [1, 2, 3] and got[0][1] > 3


def test_places_that_follow_in_arrays_and_joined(spark):
    """Places held twice, nulls and chunks beyond the block give the rows of a join (F5)."""
    rng = random.Random(3)
    rows = [(c, rng.randrange(6), rng.randrange(9)) for c in range(12) for _ in range(2 + 3 * c)] + [(None, 1, 2), (None, 2, 3), (1, None, 4), (40, 1, 1)]
    want = sorted((a[2], b[2]) for a in rows for b in rows if None not in (*a[:2], *b[:2]) and a[0] == b[0] and b[1] == a[1] + 1)
    df = spark.createDataFrame(rows, "chunk long, place int, concept long")
    for block in (8, 256):
        assert sorted(map(tuple, C.followers(df, block).collect())) == want


def test_concepts_without_vectors_are_dealt_to_tasks(spark):
    """Pairs of concepts that have no vectors were all one block's; rows of a pair of blocks come by falling cosine (F5)."""
    import numpy as np
    from pyspark.sql import functions as F

    held = spark.createDataFrame([(i, k) for k in range(30) for i in range(k, k + 9)], "concept long, chunk long")
    rels = spark.createDataFrame([(i, i + 1, 1) for i in range(200, 210)], "source long, target long, weight long")
    x = np.random.default_rng(5).normal(size=(3, 4))
    out = C.measured_affinity(rels, held, spark.createDataFrame([*enumerate(x.tolist())], "id long, v array<double>"), -1.0, block_rows=8)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["u"], r["v"]) for r in rows}) == len(rows) == sum(min(8, 37 - i) for i in range(38)) + 10
    assert len({r["task"] for r in rows}) > 1
    out = C.measured_affinity(rels, held, spark.createDataFrame([(i, [1.0, i * 0.1]) for i in range(30)], "id long, v array<double>"), 0.5, block_rows=4096)
    got = [r["semantic"] for r in out.collect()]
    some = [s for s in got if s is not None]
    assert len(some) > 100 and got == sorted(some, reverse=True) + [None] * (len(got) - len(some))


def test_windows_are_sought_in_whole_texts(spark, tmp_path):
    """The best window may lie beyond the first 1,800 characters; a text without sentences is taken whole (F6 of round 4)."""
    from quillspark import catalog
    from tests.compare import differences

    late = "\n".join(["A" + "b" * 399] * 10 + [f"Short one number {i:02d}." for i in range(45)])
    spark.createDataFrame([(1, late), (2, "ab\n" * 500), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["window_best"](spark, str(tmp_path))
    assert {r["doc_id"]: (r["start"], r["end"]) for r in df.collect()} == {1: (10, 55), 2: (0, 1)}
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not differences(df, con, catalog.SQL["window_best"])


def test_local_moving_puts_little_through_the_driver(spark, monkeypatch):
    """Two tables of three numbers a node are broadcast in a round, and large graphs try one resolution after another (F1 and F2 of round 4)."""
    import threading

    fit, moved, cells, running, most = G._fit, G._moved, [], [], []
    monkeypatch.setattr(G, "_fit", lambda df, rows: cells.append(len(df.columns)) or fit(df, rows))
    ways = G.both_ways(spark.createDataFrame(_planted(random.Random(7), 3, 8, 0.8, 0.05), "u string, v string, w double").select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"), "w"))
    nodes = ways.groupBy("x").agg(F.sum("w").alias("k"))
    monkeypatch.setattr(G, "RESTLESS", -1)
    monkeypatch.setattr(G, "MOST_ROUNDS", 2)
    G._settle(ways, nodes, 24, nodes.agg(F.sum("k")).first()[0], 1.0)
    assert sum(cells) <= 2 * 6

    def alone(*args):
        running.append(threading.get_ident())
        most.append(len(running))
        time.sleep(0.2)
        out = moved(*args)
        running.remove(threading.get_ident())
        return out

    monkeypatch.setattr(G, "NODES_AT_ONCE", 1, raising=False)
    monkeypatch.setattr(G, "_moved", alone)
    G._large_communities(spark.range(30).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w")))
    assert most == [1] * len(G.RESOLUTIONS)
