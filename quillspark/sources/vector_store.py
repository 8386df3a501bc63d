"""A persisted inverted-file index of vectors that grows by batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.sources.batches import Batches, table_key

#: Lists at most, bytes of the vectors that centres are fitted on, and rounds of the fit.
MAX_LISTS, SAMPLE_BYTES, ROUNDS = 4096, 32 << 20, 10
#: Vectors, and queries, that meet in one task.
BLOCK = 8192
#: Lists of queries, rows of them, and scores that a task holds at once.
PROBED_AT_ONCE, ROWS_AT_ONCE, SCORES_AT_ONCE = 1 << 20, 1 << 13, 1 << 21
#: Queries that the number of probes is measured with.
TUNING_QUERIES = 64


def fit_centres(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Unit centres of `lists` groups of unit rows by spherical k-means; a group that runs empty starts anew at a row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        of = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), sample[rng.integers(len(sample), size=len(centres))])
    return centres


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


class VectorStore:
    """Vectors of unit length in lists around centres; search looks into the lists nearest to a query.

    Centres are fitted once, on a bounded sample; batches are added later without touching what is there. Batches count from
    their commit mark on, and adding a batch again with the same rows changes nothing. Lists are folders, so a search reads
    those asked for. Rows with a null or zero vector are kept out. Other columns of a batch (text, source, parent) stay with
    the vectors; all batches have to bring the same ones.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches = spark, Batches(spark, f"{path.rstrip('/')}/vectors")
        self._centres_path = f"{path.rstrip('/')}/centres"

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", centres: np.ndarray | None = None) -> VectorStore:
        """An empty store with centres fitted on a sample of `vectors`, or with given ones."""
        store = cls(vectors.sparkSession, path)
        if centres is None:
            width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 1
            n = vectors.count()
            lists = min(lists or max(1, int(np.sqrt(n))), MAX_LISTS)
            rows = min(max(64 * lists, 1024), max(lists, SAMPLE_BYTES // (8 * width)))
            taken = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows).select(vector_col).toPandas()[vector_col]
            centres = fit_centres(_unit(taken), lists) if len(taken) else np.zeros((1, width))
        rows = [(i, [float(y) for y in c]) for i, c in enumerate(centres)]
        store.spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(store._centres_path)
        return store

    def centres(self) -> np.ndarray:
        """At most MAX_LISTS rows."""
        return np.array([r["centre"] for r in self.spark.read.parquet(self._centres_path).orderBy("list").collect()], np.float64)

    def append(self, vectors: DataFrame, batch: str, id_col: str = "vec_id", vector_col: str = "embedding") -> bool:
        """Add (or replace) a batch; False if the same rows are there already."""
        key, mark = table_key(vectors), self.batches.marks().get(batch)
        if mark and mark["key"] == key:
            return False
        centres = self.centres()
        others = [c for c in vectors.columns if c not in (id_col, vector_col)]
        unit = V.l2_normalize(F.col(vector_col))
        rows = vectors.where(F.coalesce(V.norm(F.col(vector_col)) > 0, F.lit(False))).select(F.col(id_col).alias("id"), unit.alias("vector"), *others)

        def assign(batches):
            for pdf in batches:
                if len(pdf):
                    pdf["list"] = (np.stack(pdf["vector"]) @ centres.T).argmax(1)
                yield pdf

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int"
        listed = rows.mapInPandas(assign, schema)
        folder = self.batches.folder()
        # a crowded list is dealt by hash too
        listed.repartitionByRange("list", F.xxhash64("id")).write.partitionBy("list").parquet(f"{folder}/rows")
        self.batches.commit(batch, key, folder)
        return True

    def vectors(self) -> DataFrame:
        return self.batches.read("rows", "id long, vector array<double>, list int")

    def _probed(self, queries: DataFrame, probes: int, groups: int) -> DataFrame:
        """(query_id, vector, group, lists) for the nearest lists of each query (query_id, vector), a row for each group of lists."""
        centres = self.centres()
        step = max(1, PROBED_AT_ONCE // max(1, min(probes, len(centres))))

        def near(batches):
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    x = _unit(part["vector"])
                    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                    rows = []
                    for i, (q, lists) in enumerate(zip(part["query_id"], order)):
                        of = lists % groups
                        rows += [(q, x[i], g, lists[of == g].astype(np.int32)) for g in np.unique(of).tolist()]
                        if len(rows) >= ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=["query_id", "vector", "group", "lists"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["query_id", "vector", "group", "lists"])

        return queries.where("vector IS NOT NULL").mapInPandas(near, f"query_id {dict(queries.dtypes)['query_id']}, vector array<double>, group int, lists array<int>")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, score, rank): the k largest cosines in the `probes` lists nearest to each query (query_id, vector).

        Lists are put together to groups of about BLOCK rows. Groups meet their queries in blocks of either side, so neither a
        crowded list nor one that all queries ask for is one task's work; a task scores a bounded number of pairs at once.
        Ties go to the smaller id. With as many probes as lists the search is exact.
        """
        rows = self.vectors().select("id", "vector", "list")
        groups = max(1, -(-rows.count() // BLOCK))
        rows = rows.withColumn("group", F.pmod("list", F.lit(groups)))
        asked = self._probed(queries, probes, groups)
        # a row for each group
        sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        wanted = asked.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sides"))
        cells = F.broadcast(sizes.join(wanted, "group"))
        deal = lambda df, key, own, n, other, m: df.join(cells, "group").withColumns({own: F.expr(f"pmod(xxhash64({key}), {n})").cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(m) - 1))}).drop("parts", "sides")
        left, right = deal(rows, "id", "part", "parts", "side", "sides"), deal(asked, "query_id", "side", "sides", "part", "parts")
        kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"

        def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(q):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            x = x.sort_values("id", ignore_index=True)
            ids, vectors = x["id"].to_numpy(), np.stack(x["vector"])
            held, at = np.unique(x["list"].to_numpy(), return_inverse=True)
            step, out = max(1, SCORES_AT_ONCE // len(x)), []
            for a in range(0, len(q), step):
                some = q.iloc[a : a + step]
                scores = np.stack(some["vector"]) @ vectors.T
                asks = np.stack([np.isin(held, lists) for lists in some["lists"]])
                if not asks.all():
                    scores = np.where(asks[:, at], scores, -np.inf)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})
                out.append(found[found["score"] > -np.inf])
            return pd.concat(out, ignore_index=True)

        keys = ["group", "part", "side"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, kinds)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, k: int, recall: float) -> int:
        """The fewest probes that find this share of the k nearest, measured on TUNING_QUERIES queries against all vectors."""
        some = queries.where("vector IS NOT NULL").orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES)
        asked = some.collect()
        if not asked:
            return 1
        centres = self.centres()
        exact = V.top_k(self.vectors(), [(i, _unit([r["vector"]])[0].tolist()) for i, r in enumerate(asked)], k, "id", "vector")
        lists = exact.join(self.vectors().select("id", "list"), "id").select("query_id", "list").collect()  # k rows a query
        order = np.argsort(-(_unit([r["vector"] for r in asked]) @ centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        needed = np.sort([place[r["query_id"], r["list"]] + 1 for r in lists])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1

    def parents_of(self, ids: DataFrame, parent_col: str) -> DataFrame:
        """(asked_id, parent) of the given ids (id)."""
        return ids.select(F.col("id").alias("asked_id")).join(self.vectors().select(F.col("id").alias("asked_id"), F.col(parent_col).alias("parent")), "asked_id")

    def siblings(self, ids: DataFrame, parent_col: str) -> DataFrame:
        """(asked_id, id) of all rows with the parent of a given id, itself among them."""
        rows = self.vectors().select("id", F.col(parent_col).alias("parent"))
        return self.parents_of(ids, parent_col).join(rows, "parent").select("asked_id", "id")
