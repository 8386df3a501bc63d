"""Near duplicates among embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize
from quillspark.llm.components import components

#: Trees, the share of rows near a split that goes to both sides, and the leaf size at which all are compared.
TREES, SPILL, LEAF = 8, 0.16, 192
#: Vectors that the upper splits are fitted on for each upper leaf, the most levels of these splits, and rows that an upper
#: leaf of a label should hold.
SAMPLE, MAX_DEPTH, TOP_ROWS = 32, 12, 2048
#: Vectors of a component that make up a block when its links are counted.
BLOCK = 1024


def fit_top(sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 5) -> list[list]:
    """Upper splits of each tree in heap order: (direction, low, high); rows between low and high go both ways.

    A node with too few sample rows repeats no split: it stays a leaf (None).
    """
    forest = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        nodes: list = [None] * ((1 << depth) - 1)
        held = {0: np.arange(len(sample))}
        for i in range(len(nodes)):
            d = rng.normal(size=sample.shape[1])
            rows = held.pop(i, np.zeros(0, int))
            if len(rows) < 16:
                continue
            p = sample[rows] @ d
            low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
            nodes[i] = (d, float(low), float(high))
            held[2 * i + 1], held[2 * i + 2] = rows[p <= high], rows[p >= low]
        forest.append(nodes)
    return forest


def leaves(x: np.ndarray, nodes: list) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of a tree's upper splits; a row can be in several."""
    todo, out = [(0, np.arange(len(x)))], []
    while todo:
        i, rows = todo.pop()
        if i >= len(nodes) or nodes[i] is None:
            out.append((i, rows))
            continue
        d, low, high = nodes[i]
        p = x[rows] @ d
        todo += [(2 * i + 1, rows[p <= high]), (2 * i + 2, rows[p >= low])]
    return [(i, r) for i, r in out if len(r)]


def leaf_groups(x: np.ndarray, least: float, rng: np.random.Generator, leaf: int = LEAF, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that span what rows with cosine of at least `least` join within leaves of a random tree over x (unit rows).

    Splits go on until `leaf` rows are left. Where splits no longer part the rows, all of them are compared, in blocks.
    Each row of a group comes with one other at most, so the output doesn't grow with the pairs.
    """
    found = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) > leaf:
            p = x[rows] @ rng.normal(size=x.shape[1])
            low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
            a, b = rows[p <= high], rows[p >= low]
            if max(len(a), len(b)) <= 0.8 * len(rows):
                todo += [a, b]
                continue
        label = np.arange(len(rows))
        while True:  # the least row reachable: every row takes over what the rows it is linked with have
            before = label.copy()
            for s in range(0, len(rows), 1024):
                c = x[rows[s : s + 1024]] @ x[rows].T >= least
                label[s : s + 1024] = np.minimum(label[s : s + 1024], np.where(c, label, len(rows)).min(1))
            label = label[label]
            if np.array_equal(label, before):
                break
        m = np.flatnonzero(label != np.arange(len(rows)))
        found.append(np.stack([rows[m], rows[label[m]]], 1))
    out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return out[:, 0], out[:, 1]


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vector_groups(vectors: DataFrame, least: float, seed: int = 5) -> DataFrame:
    """(a, b) that span the groups of vectors (rep, label, embedding) of equal label and cosine >= least that meet in a leaf."""
    spark = vectors.sparkSession
    per = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = min(max(0, int(np.ceil(np.log2(max(1, per / TOP_ROWS))))), MAX_DEPTH)
    taken = vectors.orderBy(F.xxhash64("rep")).limit(max(1024, SAMPLE << depth)).select("embedding").toPandas()["embedding"]
    widths = {len(v) for v in taken}
    # vectors of unequal length have no cosine: they meet only their own kind, and mixed tables do without upper splits
    forest = fit_top(_unit(taken), depth, seed=seed) if len(widths) == 1 else [[] for _ in range(TREES)]
    sent = spark.sparkContext.broadcast(forest)  # TREES * 2**MAX_DEPTH directions at most

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            one = len({len(v) for v in pdf["embedding"]}) == 1
            x = _unit(pdf["embedding"]) if one else None
            for t, nodes in enumerate(sent.value):
                for leaf, rows in leaves(x, nodes) if one and (not nodes or nodes[0] is None or len(nodes[0][0]) == x.shape[1]) else [(0, np.arange(len(pdf)))]:
                    yield pdf.iloc[rows].assign(tree=t, leaf=leaf, width=[len(v) for v in pdf["embedding"].iloc[rows]])

    kind = dict(vectors.dtypes)
    dealt = vectors.select("rep", "label", "embedding").mapInPandas(deal, f"rep long, label {kind['label']}, embedding {kind['embedding']}, tree int, leaf long, width int")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = leaf_groups(_unit(pdf["embedding"]), least, np.random.default_rng([seed, int(key[0]), int(key[2])]))
        rep = pdf["rep"].to_numpy()
        return pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})

    return dealt.groupBy("tree", "label", "leaf", "width").applyInPandas(compare, "a long, b long").distinct()


def count_links(vectors: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(rep, linked): how many vectors, each counted n times, of a vector's component (rep, root) have cosine >= least with it.

    Blocks of a component meet each other in tasks of their own and give a number for each vector, so a component of any
    size is shared out and no pair is written.
    """
    rows = vectors.select("rep", "embedding", "n").join(roots.hint("merge"), "rep").withColumn("width", F.size("embedding"))
    size = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(size.hint("merge"), "root").withColumn("block", F.expr("pmod(xxhash64(rep), blocks)").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, lo, hi), g in pdf.groupby(["root", "width", "lo", "hi"]):
            x, n, rep, block = _unit(g["embedding"]), g["n"].to_numpy(), g["rep"].to_numpy(), g["block"].to_numpy()
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            near = x[a] @ x[b].T >= least
            if lo == hi:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"rep": rep[a], "linked": near @ n[b]}))
            if lo != hi:
                out.append(pd.DataFrame({"rep": rep[b], "linked": n[a] @ near}))
        return pd.concat(out).groupby("rep", as_index=False).sum()

    cell = F.expr(f"CASE WHEN hi = 0 THEN pmod(xxhash64(root), {max(1, -(-vectors.count() // BLOCK))}) ELSE xxhash64(root, lo, hi) END")
    counted = rows.withColumn("cell", cell).groupBy("cell").applyInPandas(count, "rep long, linked long")
    return counted.groupBy("rep").agg(F.sum("linked").alias("linked"))


def vector_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: near duplicates of equal label with cosine >= least, in double precision.

    Equal vectors of a label link with each other and go through the forest once, with their number. Each tree deals
    vectors to leaves by random directions split at the median, rows near a split to both sides; vectors are compared
    within leaves and what is linked there in any tree makes up components. Within a component all links are counted,
    in blocks. Groups that meet in no leaf stay apart (recall is tested against brute force); no pair below `least` is
    linked. The upper splits are fitted on a bounded sample (SAMPLE rows for each leaf), every row is indexed.

    Null or zero vectors, such with null or non-finite parts, rows without label or without id link with nothing:
    n_links 0, component_id their own id. Rows that share an id count as one node. An empty table gives an empty one.
    Extra columns are ignored.
    """
    v = F.col("embedding")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0), F.lit(False))
    table = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    good = table.where(sound & F.col("id").isNotNull() & F.col("label").isNotNull())
    reps, _ = materialize(good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vec-reps")
    spans, _ = materialize(vector_groups(reps, least, seed), "vec-spans")
    roots, _ = materialize(components(spans).toDF("rep", "root"), "vec-roots")
    degree, _ = materialize(count_links(reps, roots, least), "vec-degree")
    info, _ = materialize(degree.join(roots, "rep", "full"), "vec-info")
    # only vectors with copies have another representative
    copies, _ = materialize(reps.where("n > 1").select("label", "embedding", "rep", "n"), "vec-copies")
    keyed = keyed_join(table, copies, ["label", "embedding"], "left", 400)
    keyed = keyed.select("id", F.when(sound & F.col("label").isNotNull(), F.coalesce("rep", "id")).alias("rep"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("n")), F.lit(1)).alias("n"))
    out = keyed_join(keyed, info, ["rep"], "left", 40)
    root = F.coalesce("root", "rep", "id")
    out = out.select("id", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), root).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
