"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one rounding task.
BUCKET_ROWS = 2_000
#: Tasks whose residuals meet in one task of the next level of the tree, and rows of each order of size that a task hands up unsettled.
FAN_IN, RESERVE = 32, 4
#: Probabilities this near to 0 or 1 are integral.
EPS = 1e-9
#: Parts in which the rows of one content are numbered.
PARTS = 4096


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share the sum of sizes by weight; a source stops at `most` times its size and its excess is shared again."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if w > 0 and left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w if w > 0 else 0.0
            return out
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _draw(key: int, salt: int) -> float:
    x = (key ^ (salt * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def _step(p: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, draw: float) -> None:
    """Move mass between row i and the others together until one of them all is 0 or 1.

    Which way is drawn so that each p keeps its expectation; the sum of size * p stays.
    """
    q = p[others]
    share = q * (1 - q)  # those near 0 or 1 move less, or they would be in the way of the rest
    of_others = (size[others] * share).sum()
    up = min((1 - p[i]) * size[i], of_others / (1 - q).max())
    down = min(p[i] * size[i], of_others / q.max())
    move = up if draw * (up + down) < down else -down
    p[i] += move / size[i]
    p[others] = q - share * (move / of_others)
    for k in (i, others):
        x = p[k]
        p[k] = np.where(x <= EPS, 0.0, np.where(x >= 1 - EPS, 1.0, x))


def pivot(keys, sizes, probs, seed: int, last: bool = True, reserve: int = 1) -> np.ndarray:
    """Pivotal rounding of probs (sorted by falling size) so that sum(size * p) stays.

    The open row is paired with the next one, and one of the two becomes integral. Rows meet those of their own order of
    size (powers of two) only, and `reserve` rows of each order stay open; with `last` the open row of an order is then
    paired with all shorter ones together, which settles it by a small change of theirs. So large rows are settled
    first. What rounding the very last row adds or takes is made up by turning ever shorter rows round.
    """
    p, size = np.asarray(probs, float).copy(), np.asarray(sizes, float)
    p = np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))
    order, step = np.frexp(size)[1], 0
    for o in np.unique(order)[::-1]:
        live = np.flatnonzero((order == o) & (p > 0) & (p < 1))
        while len(live) > (1 if last else reserve):
            i, j, step = live[0], live[1], step + 1
            _step(p, size, i, live[1:2], _draw((int(keys[i]) * 31 + int(keys[j])) * 31 + step, seed))
            live = np.concatenate([live[:2][(p[live[:2]] > 0) & (p[live[:2]] < 1)], live[2:]])
        while last and len(live):
            rest, step = np.flatnonzero((order < o) & (p > 0) & (p < 1)), step + 1
            if not len(rest):
                break
            _step(p, size, live[0], rest, _draw(int(keys[live[0]]) * 31 + step, seed))
            live = live[(p[live] > 0) & (p[live] < 1)]
    return _made_up(np.round(p), size, float((size * (np.round(p) - p)).sum())) if last else p


def _made_up(p: np.ndarray, size: np.ndarray, over: float) -> np.ndarray:
    """Turn rows round so that the sum of size * p falls by about `over`: one row or none first, then ever shorter ones."""

    def nearer(p: np.ndarray, over: float) -> tuple[float, np.ndarray]:
        p = p.copy()
        for k in np.flatnonzero(size < 2 * abs(over)):
            if size[k] < 2 * abs(over) and p[k] == (over > 0):
                over -= size[k] if p[k] else -size[k]
                p[k] = 1 - p[k]
        return abs(over), p

    best = nearer(p, over)
    turned = np.flatnonzero(p == (over > 0))
    for k in turned[np.argsort(np.abs(size[turned] - abs(over)), kind="stable")[:8]]:
        q = p.copy()
        q[k] = 1 - q[k]
        found = nearer(q, over - (size[k] if p[k] else -size[k]))
        if found[0] < best[0] - 0.5:
            best = found
    return best[1]


def _round_group(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k"], ascending=[False, True], kind="stable").reset_index(drop=True)
        last = bool(pdf["last"].iloc[0])
        p = pivot(pdf["k"].to_numpy(), pdf["size"].to_numpy(), pdf["p"].to_numpy(), seed, last, RESERVE)
        live = (p > 0) & (p < 1) & (not last)
        return pdf.assign(p=np.where(live, p, np.round(p)), live=live)[["k", "src", "size", "units", "p", "live"]]

    return run


def mix_key(id_col: str, text_col: str, source_col: str):
    """Identical rows share this key, whatever the layout of the input."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col, F.col(source_col).isNull(), source_col)


def _copies(docs: DataFrame, keep: list, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """The columns `keep` of every row, with mix_key, size, source_size, target and copies."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(source_col).alias("source"), size.alias("size"), mix_key(id_col, text_col, source_col).alias("mix_key"))
    rows, _ = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "mix-rows")
    per = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(s for s in per if s is not None) + [None] * (None in per)
    goal = targets([per[s] for s in names], [float(weights[i % len(weights)]) for i in range(len(names))], most)
    table = spark.createDataFrame([(i, s, int(per[s]), goal[i]) for i, s in enumerate(names)], "src int, name string, source_size long, target double")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    # a row for each name, which the driver has just held
    placed = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source").withColumn("ratio", ratio)
    # rows of one content are one unit: their whole number of extra copies is certain, one more is drawn
    part = F.col("ratio") - F.floor("ratio")
    units = placed.where("size > 0 and ratio > floor(ratio)").groupBy("mix_key", "src", "size").agg(F.count("*").alias("n"), (F.first(part) * F.count("*")).alias("extra"))
    units, _ = materialize(units, "mix-units")
    sums = units.groupBy("src").agg(F.count("*").alias("units"), F.max("n").alias("n")).collect()  # a row for each source
    counts = spark.createDataFrame([(r["src"], r["units"]) for r in sums], "src int, units long")
    level = units.join(F.broadcast(counts), "src").select(F.col("mix_key").alias("k"), "src", "size", "units", (F.col("extra") - F.floor("extra")).alias("p"))
    schema, done, rows_each = "k long, src int, size long, units long, p double, live boolean", [], BUCKET_ROWS
    top = max((r["units"] for r in sums), default=0)
    while top:
        buckets = F.ceil(F.col("units") / rows_each)
        dealt = level.withColumn("bucket", F.pmod(F.xxhash64("k"), buckets)).withColumn("last", buckets == 1)
        rounded, _ = materialize(dealt.groupBy("src", "bucket").applyInPandas(_round_group(seed), schema), "mix-level")
        done.append(rounded.where("not live").select(F.col("k").alias("mix_key"), F.col("p").cast("long").alias("up")))
        if top <= rows_each:
            break
        level = rounded.where("live").drop("live")
        rows_each *= FAN_IN
    if not done:
        return placed.select("kept.*", "mix_key", "size", "source_size", "target", F.floor("ratio").cast("long").alias("copies"))
    ups = done[0]
    for d in done[1:]:
        ups = ups.unionByName(d)
    extra = units.join(ups, "mix_key").select("mix_key", "n", (F.floor("extra").cast("long") + F.col("up")).alias("extra"))
    extra, _ = materialize(extra.where("extra > 0"), "mix-extra")
    out = keyed_join(placed, extra, ["mix_key"], "left", 32)
    more = F.coalesce("extra", F.lit(0))
    if max(r["n"] for r in sums) > 1:
        # equal rows get whole rounds of extra copies, and the first of them, counted in parts, one more
        again = placed.join(extra.where("n > 1").hint("merge"), "mix_key").select("mix_key", "at", F.pmod("at", F.lit(PARTS)).alias("part"))
        again, _ = materialize(again, "mix-again")
        counted = again.groupBy("mix_key", "part").agg(F.count("*").alias("c"))
        before = counted.select("mix_key", "part", (F.sum("c").over(Window.partitionBy("mix_key").orderBy("part")) - F.col("c")).alias("before"))
        nth = again.withColumn("nth", F.row_number().over(Window.partitionBy("mix_key", "part").orderBy("at")))
        ranks, _ = materialize(nth.join(before, ["mix_key", "part"]).select("at", (F.col("nth") + F.col("before")).alias("rank")), "mix-ranks")
        out = keyed_join(out, ranks, ["at"], "left", 24)
        more = F.when(F.col("rank").isNull(), more).otherwise(F.floor(F.col("extra") / F.col("n")) + F.when(F.col("rank") <= F.col("extra") % F.col("n"), 1).otherwise(0))
    return out.select("kept.*", "mix_key", "size", "source_size", "target", (F.floor("ratio") + more).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """(id, source, mix_key, size, source_size, target, copies) of every row; copies is a whole number.

    Copies average target / source_size in every source and exceed that by less than one. Whole parts are taken by all;
    fractions are rounded by pivots within tasks of hash-dealt rows of a source, among rows of like size. A task leaves
    RESERVE rows of each order of size open; they go up a tree, FAN_IN tasks to one, and meet the like. At its root large
    rows are settled first, at the cost of all shorter ones, until one row is left. It is rounded to the nearer side, so a source misses its target by about half of one of its shortest rows. Draws depend on row contents and seed, so reruns agree.

    Null text: size 0, like empty text; rows of size 0 take as many copies as the whole part says. Null source: a source
    of its own, after the others. Repeated rows (same id, text and source) share their extra copies as evenly as whole
    numbers go. An empty table gives an empty one. The driver keeps the table of sources, a row for each source name.
    """
    keep = [F.col(id_col).alias("id"), F.col(source_col).alias("source")]
    return _copies(docs, keep, id_col, text_col, source_col, weights, most, seed)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as mix_sources (see there for nulls, repeats and ties) takes them.

    Columns are those of docs, whatever their names; an empty table gives an empty one.
    """
    out = _copies(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")], id_col, text_col, source_col, (5, 2, 1), 3.0, 17)
    return out.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("each")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 has besides its draws: sizes of documents and targets of sources."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 4).alias("target"))


#: The rounds of sharing out written as a chain: a source that would pass three times its size stops there.
_ROUNDS = 12
TARGETS_SQL = (
    """
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
r0 AS (SELECT *, CAST(NULL AS DOUBLE) AS fixed FROM s)"""
    + "".join(
        f""",
r{i + 1} AS (SELECT source, source_size, w, CASE WHEN fixed IS NOT NULL THEN fixed WHEN sh > 3.0 * source_size THEN 3.0 * source_size END AS fixed
  FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER () AS sh FROM r{i}))"""
        for i in range(_ROUNDS)
    )
    + f"""
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(t.source_size AS BIGINT) AS source_size, round(coalesce(fixed, sh), 4) AS target
FROM d JOIN (SELECT *, (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER () AS sh FROM r{_ROUNDS}) t ON d.source IS NOT DISTINCT FROM t.source"""
)
