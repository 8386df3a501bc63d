"""A persisted BM25 index that grows by batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.retrieval import idf, index_text, weight
from quillspark.sources.batches import Batches, table_key

#: Folders that the tokens of a batch are dealt to by their hash.
PARTS = 64


def _part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


class LexicalIndex:
    """Postings of chunks by token, with document frequencies for each batch.

    A batch is written once: its postings (token, id, dl, tf) in folders by the token's hash, and how many of its documents
    hold each token. A new batch reads no old text; frequencies and mean length are sums over batches. A batch counts from its
    mark on and is valid as long as the key of its ids, headings and texts is the same: with other content it is replaced.
    Ids have to be of one batch only. Null text and heading are empty; documents without tokens count towards the mean length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches = spark, Batches(spark, path)

    def append(self, chunks: DataFrame, batch: str, id_col: str, text_col: str, heading_col: str | None = None) -> bool:
        """Index a batch (or replace it, where anything of it has changed); False if it is there as it is."""
        heading = F.col(heading_col) if heading_col else F.lit("")
        named = chunks.select(F.col(id_col).alias("id"), heading.alias("heading"), F.col(text_col).alias("text"))
        key, mark = table_key(named), self.batches.marks().get(batch)
        if mark and mark["key"] == key:
            return False
        rows = named.select("id", T.content_tokens(index_text(F.col("heading"), F.col("text"))).alias("tokens")).withColumn("dl", F.size("tokens"))
        folder = self.batches.folder()
        hits = rows.select("id", "dl", F.explode("tokens").alias("token")).groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
        # a token that most documents hold is dealt by id too
        hits.withColumn("part", _part(F.col("token"))).repartitionByRange("part", "token", "id").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{folder}/postings")
        written = self.spark.read.schema(f"id {dict(named.dtypes)['id']}, dl int, token string, tf long, part int").parquet(f"{folder}/postings")
        written.groupBy("token").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")
        # texts are parted into tokens once: their number is that of the postings' occurrences
        total = written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).first()["total"]
        self.batches.commit(batch, key, folder, named.count(), total)
        return True

    def size(self) -> tuple[int, int]:
        """Documents and tokens of all batches, from the marks alone."""
        marks = self.batches.marks().values()
        return sum(m["n"] for m in marks), sum(m["total"] for m in marks)

    def search(self, questions: DataFrame) -> DataFrame:
        """(query_id, id, score) of all chunks with a token of the question (query_id, query), as operators.retrieval.bm25.

        Only folders of asked tokens are read.
        """
        asked = questions.select("query_id", F.explode(T.content_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        n, total = self.size()
        some = asked.select("token").distinct()
        parts = [r[0] for r in some.select(_part(F.col("token"))).distinct().collect()]  # PARTS at most
        postings = self.batches.read("postings", "id long, dl int, token string, tf long, part int").where(F.col("part").isin(parts) if parts else F.lit(False))
        df = self.batches.read("terms", "token string, df long").join(some, "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
        terms = df.select("token", idf(F.lit(float(n)), F.col("df")).alias("idf")).join(asked, "token")
        mean = F.lit(total / n if n else 0.0)
        scored = postings.join(terms, "token")
        return scored.groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("idf") * weight(F.col("tf"), F.col("dl"), mean)).alias("score"))
