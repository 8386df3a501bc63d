"""WARC archives with records compressed one by one against a dictionary that leads the file."""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize, read_blobs, scratch_path, write_blobs

#: Skippable frame that holds the dictionary, by the WARC zstd convention.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages the dictionary is trained on at most, the largest of them, and the size of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 17, 1 << 16
#: Skippable frames have sixteen magic numbers; an empty one, in ASCII, stands after each frame of a file.
SKIPPABLE, EMPTY_FRAME = range(0x184D2A50, 0x184D2A60), "P*M\x18\0\0\0\0"
DATE = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(payload_digest, first) of payloads of least_bytes or more that more than one row has."""
    digest = F.sha2(F.coalesce(F.col(payload_col), F.lit("")), 256)
    return (
        pages.where(F.octet_length(F.col(payload_col)) >= least_bytes)
        .groupBy(digest.alias("payload_digest"))
        .agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> bytes:
    """A dictionary from a bounded, content-dealt sample of pages; empty if they are too few to train one."""
    import zstandard

    rows = pages.select(F.col(payload_col).alias("p"), F.xxhash64(id_col, url_col, payload_col).alias("h")).where(F.octet_length("p").between(1, SAMPLE_BYTES)).orderBy("h").limit(SAMPLE_PAGES).collect()
    samples = [http_head(len(b)) + b for r in rows for b in [r["p"].encode()]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A response record, or a revisit record that holds no payload but tells its digest and length."""
    block = http_head(len(payload)) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against the digest it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {h['WARC-Record-ID']}")

    def page(urn: str | None):
        x = urn and urn[len("<urn:page:") : -1]
        return None if x in (None, "null") else int(x)

    return {"page_id": page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": page(h.get("WARC-Refers-To"))}


def frames(records, dictionary: bytes, level: int = 3):
    """Frames of one archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    first = True
    for record in records:
        if first and dictionary:
            yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        first = False
        yield z.compress(record)


def read_archive(data: bytes):
    """The records of one archive, in order."""
    import zstandard

    at, view, z = 0, memoryview(data), zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] in SKIPPABLE:
            magic, n = struct.unpack_from("<II", data, at)
            if magic == DICTIONARY_MAGIC and not at:
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
            at += 8 + n
            continue
        frame, out = z.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + (1 << 15)]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> None:
    """Write a record for each row to archives in the folder `out` (on any file system of Spark's), one for each task.

    Of rows with equal payloads (UTF-8; null is empty) of least_bytes or more, those of the smallest id are responses
    and the others revisit it; every other row is a response. Spark's commit puts a task's file in place once, whatever
    tasks are lost or run twice.

    Repeated rows: each gets a record; all rows with the group's smallest id are responses. A null id is kept, and
    revisits a group that has another id; a group of null ids only is all response. A null url has no target header.
    An empty table gives no records. Extra columns are ignored.
    """
    firsts, _ = materialize(revisits(pages, id_col, payload_col, least_bytes), "warc-first")
    dictionary = train_dictionary(pages, id_col, url_col, payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    rows = keyed_join(rows, firsts, ["payload_digest"], "left", 160)
    rows = rows.select("id", "url", "payload", "payload_digest", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        whole = lambda x: None if pd.isna(x) else int(x)

        def records():
            for pdf in batches:
                for i, url, payload, digest, refers in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["payload_digest"], pdf["refers_to"]):
                    refers = whole(refers)
                    yield build_record(whole(i), url, payload.encode("utf-8", "surrogatepass"), digest, "response" if refers is None else "revisit", refers)

        held, size = [], 0
        for frame in frames(records(), dictionary):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pd.DataFrame({"frame": held})
                held, size = [], 0
        yield pd.DataFrame({"frame": held})

    write_blobs(rows.mapInPandas(run, "frame binary"), out, EMPTY_FRAME)


def read_warc(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, with `payload` if asked for."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    columns = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                held, size = [], 0
                for record in read_archive(data):
                    r = parse_record(record)
                    held.append(r if payloads else {c: r[c] for c in columns})
                    size += len(record) if payloads else 300
                    if size > 16 << 20:
                        yield frame(held)
                        held, size = [], 0
                yield frame(held)

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        for c in ("page_id", "refers_to"):
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        return out

    return read_blobs(spark, out).mapInPandas(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_warc(spark, out).drop("url")


SQL = """
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h)
"""
