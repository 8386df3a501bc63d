"""Streams: extraction that resumes, first-seen rows, growing graphs and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def resume_extraction(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """Append extract(rows) of files in `source` that no earlier call has seen; the checkpoint remembers them."""
    rows = spark.readStream.schema(schema).json(source)
    extract(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Batch form: rows whose key the log doesn't have yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows with a key not seen within the time that late rows may take."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def edge_weights(edges: DataFrame, a: str = "e1", b: str = "e2") -> DataFrame:
    """Running weights of edges, for update mode."""
    return edges.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.count("*").alias("w"))


def stream_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet file or folder at `path`; a stream takes a pattern for either."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def grow_edges(rows: DataFrame, out: str, checkpoint: str, pairs: Callable[[DataFrame], DataFrame], key: str | None = None, time: str | None = None, late: str = "1 day") -> None:
    """Bring the edge weights in `out` up to date with what the stream `rows` has now; call it again for what comes later.

    pairs(rows) gives (e1, e2). Running weights are state in `checkpoint`, so a restart goes on from them. Each batch puts
    the edges that it touched into a folder of its number, which a batch that is run again replaces. With `key` a row that
    is delivered again counts once: for ever, or, with `time`, within `late` of its time, and rows later than that are left
    out. Edges with a null end count under null, as in edge_weights.
    """
    if key:
        rows = first_seen(rows, key, time, late) if time else rows.dropDuplicates([key])

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    edge_weights(pairs(rows)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_edges(spark: SparkSession, out: str) -> DataFrame:
    """(u, v, w) as of the last batch; weights only grow, so the largest is the last."""
    return spark.read.parquet(out).groupBy("u", "v").agg(F.max("w").alias("w"))


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, by, n): counts by tumbling or sliding windows; works on streams and tables."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def session_counts(events: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """(by, session_start, session_end, n) with sessions that end after `gap` without an event."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    g = timed.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class Progress(StreamingQueryListener):
    """Calls back with the number of input rows of each batch."""

    def __init__(self, on_progress: Callable[[str, int], None]):
        self.on_progress = on_progress

    def onQueryStarted(self, event) -> None:
        self.on_progress("started", 0)

    def onQueryProgress(self, event) -> None:
        self.on_progress("progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_progress("ended", 0)


def run_to_end(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()
