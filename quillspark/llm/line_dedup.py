"""Line deduplication: two Bloom filters name the suspects, and only those shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of, keyed_join, materialize, mix, release

#: Bits of a filter for each distinct line of a task, and in all; beyond MAX_BITS more lines become suspects, and none is lost.
BITS_PER_LINE, MAX_BITS, PROBES, SHARDS = 12, 1 << 28, 4, 16
#: Hashes of a shard whose filters one task fills, and filters that meet in one task of the next level of the tree.
PART_LINES, FAN_IN = 4 << 20, 16
_WHITE = b" \t\n\r\x0b\x0c"


def line_keys(text: str | None, least: int) -> dict[bytes, list[int]]:
    """Positions of each key of at least `least` code points: both ends stripped, A-Z in lower case."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").split("\n")):
        key = line.encode("utf-8", "surrogatepass").strip(_WHITE).lower()
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least):
            found.setdefault(key, []).append(i)
    return found


def _hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of `bits` bits, a column for each probe."""
    a, b = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)], 1).astype(np.int64)


def _holds(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(1)


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bitmap, flat >> 3, (1 << (flat & 7)).astype(np.uint8))


def _shard(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(60)).astype(np.int64) % SHARDS


def _hashes(least: int):
    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks_of(texts, 8 << 20):
                h = np.array([_hash(k) for t in texts[a:b] for k in line_keys(t, least)], np.uint64)
                once, n = np.unique(h, return_counts=True)
                shard = _shard(once)
                rows = [(s, int(m.sum()), once[m].tobytes(), once[m & (n > 1)].tobytes()) for s in range(SHARDS) if (m := shard == s).any()]
                yield pd.DataFrame(rows, columns=["shard", "n", "once", "twice"])

    return run


def _filters(bits: int):
    """Of a part of a shard: a filter of its hashes, and one of those that come again within it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for once, twice in zip(pdf["once"], pdf["twice"]):
            places = _probes(np.frombuffer(once, np.uint64), bits)
            _put(again, places[_holds(seen, places)])
            _put(again, _probes(np.frombuffer(twice, np.uint64), bits))
            _put(seen, places)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "seen": [seen.tobytes()], "again": [again.tobytes()]})

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filters of several parts as one: a hash of two parts has all its bits in both, so none is lost."""
    seen, again = (np.frombuffer(pdf[c].iloc[0], np.uint8).copy() for c in ("seen", "again"))
    for s, a in zip(pdf["seen"].iloc[1:], pdf["again"].iloc[1:]):
        s = np.frombuffer(s, np.uint8)
        again |= np.frombuffer(a, np.uint8) | (seen & s)
        seen |= s
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "part": [int(pdf["part"].iloc[0]) // FAN_IN], "seen": [seen.tobytes()], "again": [again.tobytes()]})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(row_key, gone): for each row that loses lines, the positions of those lines.

    A first scan sends the hashes of each task's distinct lines to shards, where a filter of hashes seen once and one
    of hashes seen again are filled; hash after hash goes to the second filter if the first holds it already. A shard of
    many hashes is filled in parts, whose filters meet in a tree: bits that two parts have go to the second one. The second
    scan passes only lines that the second filter holds. They are grouped by their whole keys; those in `least_docs`
    rows or more lose all lines but those of the largest id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    hashes, _ = materialize(rows.select("text").mapInPandas(_hashes(least_chars), "shard int, n long, once binary, twice binary"), "line-hashes")
    n = hashes.agg(F.sum("n")).first()[0] or 0
    bits = max(1024, min(MAX_BITS, int(BITS_PER_LINE * n)) // SHARDS // 8 * 8)
    parts, schema = max(1, -(-int(n) // SHARDS // PART_LINES)), "shard int, part int, seen binary, again binary"
    dealt = hashes.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    filters = dealt.groupBy("shard", "part").applyInPandas(_filters(bits), schema)
    while parts > 1:
        filters, _ = materialize(filters, "line-filters")
        filters, parts = filters.groupBy("shard", F.floor(F.col("part") / FAN_IN)).applyInPandas(_merged, schema), -(-parts // FAN_IN)
    # SHARDS bitmaps of MAX_BITS together at most
    parts = filters.select("shard", "again").collect()
    again = spark.sparkContext.broadcast({r["shard"]: bytes(r["again"]) for r in parts})

    def suspects(batches):
        maps = {s: np.frombuffer(b, np.uint8) for s, b in again.value.items()}
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks_of(texts, 4 << 20):
                found = [(r, k, v) for r, t in zip(range(a, b), texts[a:b]) for k, v in line_keys(t, least_chars).items()]
                h = np.array([_hash(k) for _, k, _ in found], np.uint64)
                keep, shard = np.zeros(len(h), bool), _shard(h)
                for s, bitmap in maps.items():
                    m = np.flatnonzero(shard == s)
                    keep[m] = _holds(bitmap, _probes(h[m], bits))
                found = [found[i] for i in np.flatnonzero(keep)]
                at = [x[0] for x in found]
                yield pd.DataFrame({"id": pdf["id"].iloc[at].to_numpy(), "row_key": pdf["row_key"].iloc[at].to_numpy(), "line": [x[1] for x in found], "at": [x[2] for x in found]})
            release()

    kind = dict(docs.dtypes)[id_col]
    lines, _ = materialize(rows.mapInPandas(suspects, f"id {kind}, row_key long, line binary, at array<int>"), "line-suspects")
    told, _ = materialize(lines.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).drop("n"), "line-told")
    gone = keyed_join(lines, told, ["line"], "inner", 1024).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # the lines of one row: its own text bounds them; identical rows lose the same lines
    return gone.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """The rows of docs with repeated lines taken out of the text, and n_lines (before), n_dropped.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of `least_chars` code
    points or more in `least_docs` rows or more lose all their lines except in the row of the largest id that holds it.

    Null text counts as one empty line and comes out empty. A null id is less than any other. Each row counts as a
    document of its own; of rows with the largest id all keep the line. Other columns pass through; n_lines and
    n_dropped replace columns of that name. An empty table gives an empty one.
    """
    out = without_lines(docs, id_col, text_col, least_chars, least_docs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"whole.`{c}`") for c in names), "n_lines", "n_dropped")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(whole, text, n_lines, n_dropped): each row of docs as a struct, and what line_dedup makes of it."""
    gone, _ = materialize(repeated_lines(docs, id_col, text_col, least_chars, least_docs), "line-gone")

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone):
            if t is None or g is None:
                out.append(t)
            else:
                g = set(g.tolist())
                out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in g))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), row_key(id_col, text_col).alias("row_key"))
    joined = keyed_join(rows, gone, ["row_key"], "left", 160)
    text = F.coalesce(F.col(f"whole.`{text_col}`"), F.lit(""))
    cut = F.when(F.col("gone").isNull(), text).otherwise(without(F.when(F.col("gone").isNotNull(), text), F.col("gone")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select("whole", cut.alias("text"), lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), told AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, t.k IS NOT NULL AND l.doc_id <> t.keeper AS gone FROM lines l LEFT JOIN told t ON l.k = t.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
