"""Quality classification by an interpolated modified Kneser-Ney trigram model of characters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of, keyed_join, materialize, mix, release

#: A key holds three code points of 21 bits; these stand for no character, the start and the end.
NONE, START, END = 0x1FFFFF, 0x1FFFFD, 0x1FFFFE
#: Shards of the model at least, and its grams that one of them holds.
SHARDS, SHARD_GRAMS = 16, 500_000
#: Documents whose counts meet in one task with one shard of the model; each such cell gets a copy of the model.
CELL_DOCS = 50_000
#: Characters' worth of the language's mean that each document's mean is drawn to, so that short ones aren't judged by chance.
PRIOR_CHARS = 60


def key_of(a, b, c):
    return (np.asarray(a, np.int64) << 42) | (np.asarray(b, np.int64) << 21) | np.asarray(c, np.int64)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, count) of the distinct trigrams of each text, which is two starts, its code points and an end."""
    parts = []
    for t in texts:
        parts += [_STARTS, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), _ENDS]
    x = np.concatenate(parts)
    n = np.array([len(t) + 1 for t in texts])
    alphabet, y = np.unique(x, return_inverse=True)
    k = len(alphabet)
    y = y.astype(np.int64)
    # every place but the two starts of each document ends a trigram
    ok = np.ones(len(x), bool)
    begin = np.cumsum(n + 2) - n - 2
    ok[begin] = ok[begin + 1] = False
    at = np.flatnonzero(ok)
    code = (np.repeat(np.arange(len(texts)), n) * k + y[at - 2]) * k * k + y[at - 1] * k + y[at]
    code, count = np.unique(code, return_counts=True)
    doc, rest = np.divmod(code, k * k * k)
    a, rest = np.divmod(rest, k * k)
    b, c = np.divmod(rest, k)
    w = alphabet.astype(np.int64)
    return doc, key_of(w[a], w[b], w[c]), count


_STARTS, _ENDS = np.array([START, START], np.uint32), np.array([END], np.uint32)


def _lower(doc: np.ndarray, key: np.ndarray, count: np.ndarray, order: int):
    """Counts of the last one or two characters of each key instead."""
    short = key_of(NONE, NONE if order == 1 else (key >> 21) & NONE, key & NONE)
    names, short = np.unique(short, return_inverse=True)
    code, where = np.unique(doc * len(names) + short, return_inverse=True)
    return code // len(names), names[code % len(names)], np.bincount(where, count).astype(np.int64)


def _count(batches):
    """Trigram counts of all texts of a task."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        texts = [t for t in pdf["text"] if t]
        for a, b in chunks_of(texts, 1 << 19):
            _, key, count = trigram_counts(texts[a:b])
            u, where = np.unique(key, return_inverse=True)
            held.append(pd.DataFrame({"k": u, "n": np.bincount(where, count).astype(np.int64)}))
        if held:
            held = [pd.concat(held).groupby("k", as_index=False).sum()]
        release()
    yield from held


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float, float]:
    """Weights (k, w) of all trigrams, pairs and characters from trigram counts (k, n); the constant of a document; the weight of an unknown character.

    Lower orders count distinct left neighbours; each order has three discounts from its counts of counts. The log
    probability of a text is the sum of the weights of its trigrams, pairs and characters and the constant, with
    nothing for unseen trigrams and pairs: the weight of a longer gram takes back what its parts would have given, and
    a pair or character also brings the backing-off weight of the contexts it serves as.
    """
    c3 = counts.select(F.shiftright("k", 42).alias("a"), F.shiftright("k", 21).bitwiseAND(NONE).alias("b"), F.col("k").bitwiseAND(NONE).alias("c"), "n")
    c2 = c3.groupBy("b", "c").agg(F.count("*").alias("n"))
    c1 = c2.groupBy("c").agg(F.count("*").alias("n"))
    c2, _ = materialize(c2, "kn-2")
    c1, _ = materialize(c1, "kn-1")

    def discounts(t: DataFrame) -> list[float]:
        n1, n2, n3, n4 = (float(x or 0) for x in t.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        pairs = ((n1, n2), (n2, n3), (n3, n4))
        return [min(max((i + 1) - (i + 2) * y * q / p if p else 0.5, 0.1), i + 0.9) for i, (p, q) in enumerate(pairs)]

    def cut(d: list[float]):
        return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

    d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)
    total, back, kinds = c1.agg(F.sum("n"), F.sum(cut(d1)), F.count("*")).first()
    rest = back / total / (kinds + 1)
    p1 = c1.select("c", ((F.col("n") - cut(d1)) / total + rest).alias("p1"))
    x2 = c2.groupBy("b").agg(F.sum("n").alias("t"), F.sum(cut(d2)).alias("back")).select("b", "t", (F.col("back") / F.col("t")).alias("l2"))
    p2 = c2.join(x2, "b").join(p1, "c").select("b", "c", "p1", "l2", ((F.col("n") - cut(d2)) / F.col("t") + F.col("l2") * F.col("p1")).alias("p2"))
    p2, _ = materialize(p2, "kn-p2")
    x3 = c3.groupBy("a", "b").agg(F.sum("n").alias("t"), F.sum(cut(d3)).alias("back")).select("a", "b", "t", (F.col("back") / F.col("t")).alias("l3"))
    x3, _ = materialize(x3, "kn-x3")
    p3 = c3.join(x3, ["a", "b"]).join(p2.select("b", "c", "p2"), ["b", "c"])

    def pack(a, b, c):
        return F.shiftleft(a, 42).bitwiseOR(F.shiftleft(b, 21)).bitwiseOR(c)

    none = F.lit(NONE).cast("long")
    w3 = p3.select(pack(F.col("a"), F.col("b"), F.col("c")).alias("k"), (F.ln((F.col("n") - cut(d3)) / F.col("t") + F.col("l3") * F.col("p2")) - F.ln("l3") - F.ln("p2")).alias("w"))
    parts = [
        w3,
        p2.select(pack(none, F.col("b"), F.col("c")).alias("k"), (F.ln("p2") - F.ln("l2") - F.ln("p1")).alias("w")),
        x3.select(pack(none, F.col("a"), F.col("b")).alias("k"), F.ln("l3").alias("w")),
        p1.select(pack(none, none, F.col("c")).alias("k"), F.ln("p1").alias("w")),
        x2.select(pack(none, none, F.col("b")).alias("k"), F.ln("l2").alias("w")),
    ]
    weights = parts[0]
    for p in parts[1:]:
        weights = weights.unionByName(p)
    weights, _ = materialize(weights.groupBy("k").agg(F.sum("w").alias("w")), "kn-weights")
    first = x3.where((F.col("a") == START) & (F.col("b") == START)).select(F.ln("l3")).first()
    second = x2.where(F.col("b") == START).select(F.ln("l2")).first()
    # a start is a character that is never foretold: what it weighs as one is taken back by these two alone
    return weights, first[0] + second[0], math.log(rest)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _deal(cells: int, shards: int):
    """Per block of documents and shard: the keys, for each the documents that have it, and how often."""

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["row_key"].to_numpy(), [t or "" for t in pdf["text"]]
            for a, b in chunks_of(texts, 1 << 19):
                doc, key, count = trigram_counts(texts[a:b])
                sets = [(doc, key, count), _lower(doc, key, count, 2), _lower(doc, key, count, 1)]
                doc, key, count = (np.concatenate(x) for x in zip(*sets))
                names, inv = np.unique(key, return_inverse=True)
                order = np.argsort(inv * np.int64(b - a) + doc, kind="stable")
                doc, inv, count = doc[order], inv[order], count[order]
                shard = _shard(names, shards)
                of = shard[inv]
                rows = []
                for s in range(shards):
                    m = of == s
                    mine = np.flatnonzero(shard == s)
                    runs = np.bincount(inv[m], minlength=len(names))[mine]
                    packed = _pack(names[mine], runs.astype("<u4"), doc[m].astype("<u2" if b - a <= 1 << 16 else "<u4"), count[m].astype("<u4"))
                    rows.append((s, int(ids[a] % cells), ids[a:b].tobytes(), b - a, *packed))
                yield pd.DataFrame(rows, columns=["shard", "cell", "rows", "n", "keys", "runs", "docs", "counts"])
            release()

    return run


_PAYLOAD = "shard int, cell int, rows binary, n int, keys binary, runs binary, docs binary, counts binary"


def _score(unknown: float):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        release()
        right = right.sort_values("k")
        known, weight = right["k"].to_numpy(), right["w"].to_numpy()
        out = []
        for r in left.itertuples():
            keys = _unpack(r.keys, np.int64)
            w = np.where(keys >> 21 == (NONE << 21 | NONE), unknown, 0.0)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                w = np.where(known[at] == keys, weight[at], w)
            docs = _unpack(r.docs, "<u2" if r.n <= 1 << 16 else "<u4")
            total = np.bincount(docs, np.repeat(w, _unpack(r.runs, "<u4")) * _unpack(r.counts, "<u4"), minlength=r.n)
            out.append(pd.DataFrame({"row_key": np.frombuffer(r.rows, np.int64), "s": total, "m": np.int64(r.shard == 0)}))
        return pd.concat(out) if out else pd.DataFrame({"row_key": [], "s": [], "m": []})

    return run


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, logp) of every row, by a model of the texts whose id is in `trusted` (one column, no repeats)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = keyed_join(rows, trusted.toDF("id"), ["id"], "left_semi", 16)
    counts, _ = materialize(taught.select("text").mapInPandas(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "kn-counts")
    if not counts.take(1):
        return spark.createDataFrame([], "row_key long, logp double")
    weights, constant, unknown = kneser_ney(counts)
    cells = max(1, -(-docs.count() // CELL_DOCS))
    shards = max(SHARDS, -(-weights.count() // SHARD_GRAMS))
    payload = rows.select(_row_key("id", "text").alias("row_key"), "text").mapInPandas(_deal(cells, shards), _PAYLOAD)

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(_shard(k.to_numpy(), shards))

    model = weights.select(shard("k").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "k", "w")
    sums = payload.groupBy("shard", "cell").cogroup(model.groupBy("shard", "cell")).applyInPandas(_score(unknown), "row_key long, s double, m long")
    total = sums.groupBy("row_key").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    return total.select("row_key", (F.col("s") / F.col("m") + constant).alias("logp"))


def score_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 0.06) -> DataFrame:
    """(row_key, id, lang, perplexity, surprise, limit, rejected) of every row.

    The model is trained on all texts with an id in `trusted` (one column). Documents send the counts of their grams to
    shards of the model and get sums of log probabilities back; no task sees the whole model. `surprise` is the mean
    negative log probability of a character, drawn towards the mean of trusted text in the language as if by
    PRIOR_CHARS characters of it. `limit` is the language's `quantile` of the surprise of trusted rows and `slack` on
    top; rows beyond it are rejected. Languages without trusted text (null is a language too) use the limit of all.

    Null and empty texts have no characters to surprise and stay. Repeated rows get equal results. Without trusted text
    nothing is rejected and perplexity is null. An empty table gives an empty one. Extra columns are ignored.
    """
    ids = trusted.toDF("id").where("id is not null").distinct()
    ids, _ = materialize(ids, "kn-trusted")
    logp, _ = materialize(perplexities(docs, ids, id_col, text_col), "kn-logp")
    rows = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), (F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).alias("n"))
    rows = rows.join(logp, "row_key", "left").join(ids.withColumn("taught", F.lit(True)), "id", "left")
    rows, _ = materialize(rows, "kn-rows")
    good = rows.where("taught and n > 1")

    def stats(t: DataFrame, *by) -> DataFrame:
        return t.groupBy(*by).agg((-F.sum("logp") / F.sum("n")).alias("mean"))

    whole = stats(good)
    mean = whole.first()[0]
    per = {r["lang"]: r["mean"] for r in stats(good, "lang").collect()}  # a row for each language
    spark = docs.sparkSession
    means = spark.createDataFrame([(k, v) for k, v in per.items()], "l string, mean double")
    surprise = (-F.col("logp") + PRIOR_CHARS * F.coalesce("mean", F.lit(mean).cast("double"))) / (F.col("n") + PRIOR_CHARS)
    seen = rows.join(F.broadcast(means), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").withColumn("surprise", surprise)
    bounds = seen.where("taught and n > 1").groupBy("lang").agg(F.percentile_approx("surprise", quantile, 10_000).alias("q")).collect()
    overall = max((r["q"] for r in bounds), default=None)
    limits = spark.createDataFrame([(r["lang"], r["q"] + slack) for r in bounds], "l string, limit double")
    seen = seen.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce("limit", F.lit(None if overall is None else overall + slack).cast("double"))
    out = seen.select("row_key", "id", "lang", F.exp(-F.col("logp") / F.col("n")).alias("perplexity"), "surprise", limit.alias("limit"), "n")
    return out.withColumn("rejected", F.coalesce((F.col("n") > 1) & (F.col("surprise") > F.col("limit")), F.lit(False))).drop("n")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score_quality (see there for nulls, ties, repeats) doesn't reject.

    Columns are those of docs, whatever their names; an empty table gives an empty one.
    """
    bad, _ = materialize(score_quality(docs, trusted_ids(labels)).where("rejected").select("row_key").distinct(), "kn-bad")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), _row_key("doc_id", "text").alias("row_key"))
    return keyed_join(rows, bad, ["row_key"], "left_anti", 16).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, trusted_ids(labels)).select(F.col("id").alias("doc_id"), "lang", "perplexity", "surprise", "limit", "rejected")
