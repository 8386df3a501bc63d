"""Nearest neighbours by inner product from randomly rotated one-bit codes, reranked within their error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Standard deviations of an estimate that its bounds are wide.
BOUND = 3.5
#: Bits of a code for each part of a vector: vectors are padded before they are turned, which narrows the bounds.
BITS = 4
#: Bits of each part of a query.
QUERY_BITS = 4
#: Bytes of vectors on either side of a block at most; queries of a block if there are fewer.
BLOCK_BYTES, LEAST_QUERIES = 64 << 20, 256
#: Bytes of vectors whose mean is the centre.
SAMPLE_BYTES = 4 << 20


def rotate(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """Rows turned at random: three rounds of random signs and a Hadamard transform, padded to a power of two of at least BITS times their length."""
    n = max(64, 1 << (BITS * x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, n]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        out *= s
        half = 1
        while half < n:
            pairs = out.reshape(len(x), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
            half *= 2
        out /= np.sqrt(n)
    return out


def encode(x: np.ndarray, centre: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs of the rotated rows less the centre, their lengths, their inner products with their own code)."""
    with np.errstate(all="ignore"):
        x = x - centre
        norm = np.sqrt((x * x).sum(1))
        r = rotate(x / np.where(norm > 0, norm, 1)[:, None], seed)
        return np.packbits(r > 0, axis=1, bitorder="little").view("<u8"), norm, np.abs(r).sum(1) / np.sqrt(r.shape[1])


class Queries:
    """Rotated queries in QUERY_BITS planes of packed bits."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, seed: int = 13):
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((q * q).sum(1))
            r = rotate(q / self.norm[:, None], seed)
            self.base = q @ centre
            self.low, self.step = r.min(1), (r.max(1) - r.min(1)) / ((1 << QUERY_BITS) - 1)
            level = np.nan_to_num(np.rint((r - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None])).astype(np.uint8)
        self.total, self.n = level.sum(1, dtype=np.int64), r.shape[1]
        self.planes = np.stack([np.packbits(level >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(QUERY_BITS)], 1)

    def bounds(self, i: int, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of query i with all coded vectors, and the most that they may be."""
        hits = np.zeros(coded.codes.shape[1], np.uint16 if self.n << QUERY_BITS < 1 << 16 else np.uint32)
        for j in range(QUERY_BITS):
            ones = np.zeros(len(hits), hits.dtype)
            for w, word in enumerate(coded.codes):
                ones += np.bitwise_count(self.planes[i, j, w] & word)
            hits += ones << hits.dtype.type(j)
        low, step, norm = self.low[i], self.step[i], self.norm[i]
        with np.errstate(all="ignore"):
            est = hits * coded.scale
            est *= 2 * step * norm
            est += coded.ones_scale * (2 * low * norm)
            est += coded.scale * (norm * (-step * self.total[i] - self.n * low)) + self.base[i]
            return est, est + (coded.spread * norm + coded.scale * (norm * BOUND * step * np.sqrt(self.n / 12)))


class Coded:
    """Codes of a block, word by word, with what estimates take from each vector."""

    def __init__(self, codes: np.ndarray, norm: np.ndarray, corr: np.ndarray, longest: float):
        n, self.longest = 64 * codes.shape[1], longest
        with np.errstate(all="ignore"):
            self.codes, self.scale = np.ascontiguousarray(codes.T), norm / np.where(corr > 0, corr, 1) / np.sqrt(n)
            self.ones_scale = np.bitwise_count(codes).sum(1) * self.scale
            # chance, and a little for rounding
            self.spread = self.scale * np.sqrt(n) * (BOUND * np.sqrt(np.maximum(0, 1 - corr * corr) / (n - 1)) + 1e-9)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with the rows, summed part after part as a loop would."""
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        parts = np.ascontiguousarray(x.T)
        for part, y in zip(parts, q):
            out += part * y
    return out


def best_in_block(q: np.ndarray, names: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, corr: np.ndarray, centre: np.ndarray, k: int, seed: int = 13):
    """For each query (place in q, names, scores) of its k nearest rows, ties to the smaller name.

    The k best by estimate are scored exactly; the worst of these is a floor for the result. What can't reach it by its upper
    bound is left out, all else is scored.
    """
    coded, asked = Coded(codes, norm, corr, np.sqrt((x * x).sum(1).max())), Queries(q, centre, seed)
    for i, one in enumerate(q):
        rows = np.arange(len(x))
        if len(x) > k:
            est, high = asked.bounds(i, coded)
            # rounding of a sum of products, whatever their order
            slack = 1e-15 * len(one) * asked.norm[i] * float(coded.longest)
            floor = (x[np.argpartition(-est, k - 1)[:k]] @ one).min() - slack
            rows = np.flatnonzero(~(high < floor))
            if len(rows) > k:
                near = x[rows] @ one
                rows = rows[~(near < np.partition(near, -k)[-k] - 2 * slack)]
        score = _exact(one, x[rows])
        first = np.lexsort((names[rows], -score))[:k]
        yield i, names[rows[first]], score[first]


def _matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, width)


def search(rows: DataFrame, asked, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of every row for which the column `asked` holds, best first.

    Nearness is the inner product of the vectors as they are, in double precision; ties go to the smaller id. Equal vectors
    are searched for and compared once, with their k + 1 smallest ids. Every vector is coded; queries and vectors meet in
    blocks of bounded bytes, and each block gives at most k + 1 vectors for a query, so no task or row count grows with a
    group of like vectors. A vector that misses its bound by chance (BOUND standard deviations) can be lost; the tests
    measure recall. The centre is the mean of at most SAMPLE_BYTES of vectors.

    Vectors that are null, empty, zero or hold null or non-finite parts, and rows without id, take no part; vectors of unequal
    length don't meet. Of rows that share an id the one with the least vector counts. An empty table gives no rows. Extra
    columns are ignored, but for those of `asked`.
    """
    spark = rows.sparkSession
    v = F.col("v")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0), F.lit(False))
    table = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    table = table.where(sound & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    # -0.0 and 0.0 are one value to the grouping
    ranked = table.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors, _ = materialize(grouped.select(F.col("ids")[0].alias("rep"), "ids", "v", F.size("v").alias("width")), "bit-vectors")
    queries, _ = materialize(table.where("asked").join(vectors.select("v", "rep"), "v").select("id", "rep"), "bit-queries")
    size = vectors.agg(F.count("*").alias("n"), F.max("width").alias("w")).first()
    n_queries = queries.agg(F.count_distinct("rep")).first()[0]
    width = size["w"] or 1
    fits = max(1, block_bytes // (8 * width))
    sides = -(-size["n"] // fits) or 1
    parts = max(-(-n_queries // fits), min(-(-n_queries // LEAST_QUERIES), 2 * spark.sparkContext.defaultParallelism), 1)
    taken = vectors.orderBy(F.xxhash64("rep"), "rep").limit(max(1, SAMPLE_BYTES // (8 * width))).select("v").toPandas()["v"]
    centres = {w: np.mean([x for x in taken if len(x) == w], 0) for w in {len(x) for x in taken}}

    def code(batches):
        for pdf in batches:
            for w, g in pdf.groupby("width"):
                x = np.stack(g["v"]).astype("<f8")
                codes, norm, corr = encode(x, centres.get(w, np.zeros(w)), seed)
                yield pd.DataFrame({"rep": g["rep"], "width": w, "blob": [r.tobytes() for r in x], "code": [r.tobytes() for r in codes], "norm": norm, "corr": corr})

    coded = vectors.select("rep", "width", "v").mapInPandas(code, "rep long, width int, blob binary, code binary, norm double, corr double")
    left = coded.withColumns({"side": F.expr(f"CAST(pmod(xxhash64(rep), {sides}) AS INT)"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    wanted = vectors.join(queries.select("rep").distinct(), "rep", "left_semi")
    raw = wanted.select("rep", "width", "v").mapInPandas(lambda batches: (pd.DataFrame({"rep": p["rep"], "width": p["width"], "blob": [np.asarray(x, "<f8").tobytes() for x in p["v"]]}) for p in batches), "rep long, width int, blob binary")
    right = raw.withColumns({"part": F.expr(f"CAST(pmod(xxhash64(rep, 7), {parts}) AS INT)"), "side": F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))})

    def compare(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        w = int(key[2])
        out = []
        if len(x) and len(q):
            codes = np.frombuffer(b"".join(x["code"]), "<u8").reshape(len(x), -1)
            found = best_in_block(_matrix(q["blob"], w), x["rep"].to_numpy(), _matrix(x["blob"], w), codes, x["norm"].to_numpy(), x["corr"].to_numpy(), centres.get(w, np.zeros(w)), k + 1, seed)
            reps = q["rep"].to_numpy()
            out = [pd.DataFrame({"asker": reps[i], "rep": names, "score": score}) for i, names, score in found]
        return pd.concat(out) if out else pd.DataFrame({"asker": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["side", "part", "width"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "asker long, rep long, score double")
    top = lambda df, by, then, most: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), then))).where(F.col("rank") <= most)
    best, _ = materialize(top(hits, "asker", "rep", k + 1).select("asker", "rep", "score"), "bit-hits")
    ids = best.join(vectors.select("rep", "ids"), "rep").select("asker", "score", F.explode("ids").alias("id"))
    lists = top(ids, "asker", "id", k + 1).select(F.col("asker").alias("rep"), "score", F.col("id").alias("found"))
    out = queries.join(lists, "rep").where("id != found")
    return top(out, "id", "found", k).select(F.col("id").alias("query_id"), "rank", F.col("found").alias("id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")


#: All neighbours; the search finds the same where no vector misses its bound.
SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
