"""Connected components of a link table: contraction within tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, release, remove

#: A task contracts that many edges at a time; more edges mean more tasks.
TASK_EDGES = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node that these edges reach from it) in place of the edges; the least node itself isn't listed."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
    hung = up != np.arange(len(nodes))
    return nodes[hung], nodes[up[hung]]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contract(u, v)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= TASK_EDGES:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()
    release()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. One star step; every u meets its least neighbour through a join that AQE can split."""
    spark = edges.sparkSession
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        near = near.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least, path = materialize(near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
    if large:
        out = near.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    out, made = materialize(out.where("u > v").distinct(), "star")
    remove(spark, path)
    return out, made


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node and that one none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 and below > 0").take(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; nodes are longs, root is the least node reachable. Self links and repeats do no harm.

    Each round first contracts what edges stand together in a task to stars, which no shuffle needs, and then takes a large
    and a small star step over all edges, unless the first did it. All three keep the components and let no sum of an edge's
    ends grow, so the rounds end; they do where every edge leads to a root. Nulls link with nothing.
    """
    spark = links.sparkSession
    edges, path = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")), "edges")
    while True:
        tasks = max(1, -(-edges.count() // TASK_EDGES))
        nxt, made = materialize(edges.coalesce(tasks).mapInArrow(_contract_batches, "u long, v long"), "contracted")
        remove(spark, path)
        edges, path = nxt, made
        if _settled(edges):
            break
        for large in (True, False):
            nxt, made = _star(edges, large)
            remove(spark, path)
            edges, path = nxt, made
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
