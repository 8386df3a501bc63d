"""Token ids in binary files with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of, read_blobs, release, scratch_path, write_blobs
from quillspark.llm.tokens import BLOCK_CHARS, MEMO_WORDS, default_tokenizer, encoder

MAGIC = b"QTOK0002"
#: Ids of one part at most, unless a single document has more.
FILE_IDS = 4 << 20
#: Bytes of text of one file.
FILE_BYTES = 16 << 20
#: Documents of one table when files are read.
READ_DOCS = 4096
#: Words of high bits between two samples of select.
STRIDE = 16
_HEAD = "<8sIIQQQqQ"  # magic, bytes of an id, task, part, documents, token ids, smallest document id, documents without id
_CODED = "<QIIQ"  # values, low bits, 0, words of high bits


class EliasFano:
    """Rising integers: low bits stored plainly, high parts in unary. n * (2 + log2(top / n)) bits or so.

    Select needs a sample of 32 bits for each STRIDE words of high bits, which is an eighth of a bit for a value.
    """

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.low = n, low_bits, high, low
        ones = np.bitwise_count(high)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), STRIDE), dtype=np.uint32)
        self.before = np.cumsum(sums, dtype=np.uint32) - sums

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(ones[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        if bits:
            plain = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            plain = np.concatenate([plain, np.zeros(-len(plain) % 64, np.uint8)])
            low = np.packbits(plain, bitorder="little").view("<u8")
        else:
            low = np.zeros(0, "<u8")
        return cls(n, bits, high, low)

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th one gives the high part."""
        block = int(np.searchsorted(self.before, i, "right")) - 1
        r, w = i - int(self.before[block]), block * STRIDE
        while True:
            word = int(self.high[w])
            ones = word.bit_count()
            if r < ones:
                break
            r, w = r - ones, w + 1
        for _ in range(r):
            word &= word - 1
        place = w * 64 + (word & -word).bit_length() - 1
        high, k = place - i, self.low_bits
        if not k:
            return high
        bit = i * k
        pair = int(self.low[bit >> 6]) | (int(self.low[(bit >> 6) + 1]) << 64 if (bit >> 6) + 1 < len(self.low) else 0)
        return high << k | (pair >> (bit & 63)) & ((1 << k) - 1)

    def all(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            plain = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= plain.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def dump(self) -> bytes:
        return struct.pack(_CODED, self.n, self.low_bits, 0, len(self.high)) + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def load(cls, data, at: int) -> tuple[EliasFano, int]:
        """What dump() has put at `at`, and where it ends."""
        n, bits, _, h = struct.unpack_from(_CODED, data, at)
        at += struct.calcsize(_CODED)
        lo = -(-n * bits // 64)
        return cls(n, bits, np.frombuffer(data, "<u8", h, at), np.frombuffer(data, "<u8", lo, at + 8 * h)), at + 8 * (h + lo)


def pack_file(doc_ids: list, arrays: list[np.ndarray], dtype: np.dtype, task: int = 0, part: int = 0) -> bytes:
    """One part: head, Elias-Fano ends of the documents, Elias-Fano document ids (rising, nulls first), all token ids."""
    ends = np.cumsum([len(a) for a in arrays], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    gaps = np.array([d - least for d in known], np.uint64)
    head = struct.pack(_HEAD, MAGIC, dtype.itemsize, task, part, len(arrays), total, least, len(doc_ids) - len(known))
    names = EliasFano.encode(gaps, int(gaps[-1]) if known else 0)
    return b"".join([head, EliasFano.encode(ends, total).dump(), names.dump(), *(a.tobytes() for a in arrays)])


class TokenFile:
    """A part in memory; document(i) needs two selects and no table of offsets."""

    def __init__(self, data, at: int = 0):
        magic, width, self.task, self.part, self.n_docs, self.n_ids, self.least, self.unnamed = struct.unpack_from(_HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.load(data, at + struct.calcsize(_HEAD))
        self.names, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)
        self.stop = at + width * self.n_ids

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def name(self, i: int) -> int | None:
        return self.least + self.names.select(i - self.unnamed) if i >= self.unnamed else None


def _parts(data):
    """The parts of one file; a sign of the writer stands after each."""
    at = 0
    while at < len(data):
        f = TokenFile(data, at)
        yield f
        at = f.stop + 1


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, partitions: int | None = None) -> None:
    """Write the documents' ids, in ascending document id, to files in the folder `out` (on any file system of Spark's).

    Documents are dealt by ranges of id and of a hash of the text, so that rows without id or of one id spread too, into
    as many files as FILE_BYTES of text ask for. Spark's commit puts a task's file in place once, whatever tasks are
    lost or run twice. A file holds parts of FILE_IDS ids at most.

    Null text counts as empty and a null id sorts first; of equal ids the hash of the text decides the order. An empty
    table gives no documents. Extra columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    sorted_rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, 2 * MEMO_WORDS)
        end = np.array([end_id], enc.dtype)
        task, part = TaskContext.get().partitionId(), 0
        names, arrays, held = [], [], 0

        def full():
            nonlocal names, arrays, held, part
            data = pack_file(names, arrays, enc.dtype, task, part)
            names, arrays, held, part = [], [], 0, part + 1
            return pd.DataFrame({"blob": [data]})

        for pdf in batches:
            ids, texts = pdf["id"], pdf["text"].tolist()
            ids = [None if pd.isna(x) else int(x) for x in ids]
            for a, b in chunks_of(texts, 2 * BLOCK_CHARS):
                for d, t in zip(ids[a:b], enc.encode(texts[a:b])):
                    if held and held + len(t) + 1 > FILE_IDS:
                        yield full()
                    names.append(d)
                    arrays.append(np.concatenate([t, end]))
                    held += len(t) + 1
                release()
        if names:
            yield full()

    write_blobs(sorted_rows.mapInPandas(run, "blob binary"), out, "\n", 4000)


def _file_rows(data: bytes | TokenFile, start: int):
    """Tables (id, start, n_tokens, ids_crc32) of READ_DOCS documents at most, each found by select."""
    f = data if isinstance(data, TokenFile) else TokenFile(data)
    for i in range(0, f.n_docs, READ_DOCS):
        rows = []
        for j in range(i, min(i + READ_DOCS, f.n_docs)):
            x = f.document(j)
            rows.append((f.name(j), start, len(x), zlib.crc32(x.astype("<u4").tobytes())))
            start += len(x)
        out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])
        yield out.assign(id=pd.array([r[0] for r in rows], dtype="Int64"))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files in `out`."""
    files = read_blobs(spark, out)

    def heads(batches):
        for pdf in batches:
            found = [(f.task, f.part, f.n_ids) for data in pdf["content"] for f in _parts(data)]
            yield pd.DataFrame(found, columns=["task", "part", "n_ids"])

    start, bases = 0, {}
    for r in sorted(files.mapInPandas(heads, "task int, part long, n_ids long").collect()):  # a row for each part
        bases[r["task"], r["part"]] = start
        start += r["n_ids"]

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                for f in _parts(data):
                    yield from _file_rows(f, bases[f.task, f.part])

    return files.mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_tokens(spark, out).withColumnRenamed("id", "doc_id")
