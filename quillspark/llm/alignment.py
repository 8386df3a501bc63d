"""Alignment of two tokenizers' tokens by the byte offsets where both end."""

from __future__ import annotations

import itertools
import json
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize, release

#: Characters of texts whose words are tokenised together, and bytes of words that are encoded as one text.
BLOCK_CHARS, JOINED_BYTES = 4 << 20, 256 << 10
#: Tokens of a word among which ends are looked for one by one.
SHORT = 32
#: A text is parted before spaces that follow anything but white space, unless it ends with them. Neither tokenizer joins
#: what stands on both sides.
_PART = re.compile(r"(?<=\S)(?= +[^ ])")
#: White space next to white space, where parting at each space would be wrong.
_WIDE = re.compile(r"\s\s")
#: pre-tokens of byte-level vocabularies (fixed value of the file format)
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE of a tokenizers file; ids and the bytes of each id."""

    #: whether texts always come back: ranks over bytes leave nothing out
    lossless = property(lambda self: self.ranked)

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        added = {t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        # merges in the order of ids over the 256 bytes, the usual pre-tokens and nothing else: then ranks say the same
        self.ranked = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["model"].get("ignore_merges")
        self.ranked = self.ranked and [spec["model"]["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))) and len(self.bytes) == 256 + len(pairs)
        if self.ranked:
            ranks = {b: i for i, b in self.bytes.items()}
            self._encode = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self._encode = lambda t: tok.encode(t, add_special_tokens=False).ids
        #: whether words can be encoded by themselves
        self.parts = self.ranked

    def encode_words(self, words: list[str], size: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words and the number of each word's; many words go as one text."""
        ids, counts, over = [], np.zeros(len(words), np.int64), np.cumsum(size)
        cuts = np.unique(np.searchsorted(over, np.arange(0, int(size.sum()), JOINED_BYTES), "left")) if self.ranked else np.arange(len(words))
        for a, b in zip(cuts, [*cuts[1:], len(words)]):
            x = np.array(self._encode("".join(words[a:b])), np.int32)
            ids.append(x)
            counts[a:b] = np.bincount(np.searchsorted(over[a:b] - over[a] + size[a], np.cumsum(sizes[x])), minlength=b - a)[: b - a] if b - a > 1 else len(x)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


class Pieces:
    """A sentencepiece model that puts a space before the text; ids and the bytes of each id."""

    lossless = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, whole = {}, True
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[i] = bytes([int(p[3:-1], 16)])
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                self.bytes[i] = p.replace("▁", " ").encode()
                # a piece that goes on after a space would join words
                whole = whole and "▁" not in p.lstrip("▁")
        self.parts = whole

    def encode_words(self, words: list[str], size: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words and the number of each word's; the model itself adds the space that they begin with."""
        lists = self.model.encode([w[1:] for w in words], num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(counts.sum())), counts


def load(path: str):
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def _kept(path: str):
    """The worker's tokenizer for a file."""
    home = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    found = home.__dict__.setdefault("aligned", {})
    if path not in found:
        tok = load(path)
        sizes = np.zeros(max(tok.bytes) + 1, np.int32)
        for i, b in tok.bytes.items():
            sizes[i] = len(b)
        found[path] = tok, sizes
    return found[path]


def _encode_words(words: list[str], size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends within the word, tokens of each word, whether each word's bytes are those of its tokens); words begin with a space."""
    tok, sizes = _kept(path)
    ids, counts = tok.encode_words(words, size, sizes)
    good = np.ones(len(words), bool)
    if not tok.lossless and b"".join(map(tok.bytes.get, ids.tolist())) != "".join(words).encode():
        at = np.cumsum(counts) - counts
        good = np.array([b"".join([tok.bytes.get(i, b"") for i in ids[s : s + n].tolist()]) == w.encode() for s, n, w in zip(at, counts, words)])
        ids, counts, size = ids[np.repeat(good, counts)], np.where(good, counts, 0), np.where(good, size, 0)
    return ids, (np.cumsum(sizes[ids], dtype=np.int64) - np.repeat(np.cumsum(size) - size, counts)).astype(np.int32), counts, good


def _parted(texts: list[str], whole: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their bytes, the word at each place, words of each text, the texts' order) of texts that begin with a space."""
    if whole:
        return texts, np.array([len(t.encode()) for t in texts], np.int64), np.arange(len(texts), dtype=np.int32), np.ones(len(texts), np.int64), np.arange(len(texts))
    wide = np.fromiter((t[-1].isspace() or _WIDE.search(t) is not None for t in texts), bool, len(texts))
    order = np.argsort(wide, kind="stable")
    n_wide = int(wide.sum())
    lists = pc.split_pattern(pa.array([texts[i][1:] for i in order[: len(texts) - n_wide]], pa.large_string()), " ")
    # without the first space, as the others
    apart = pa.array([[w[1:] for w in _PART.split(texts[i])] for i in order[len(texts) - n_wide :]], pa.large_list(pa.large_string()))
    n = np.concatenate([np.diff(np.asarray(x.offsets)) for x in (lists, apart)])
    coded = pa.concat_arrays([lists.flatten(), apart.flatten()]).dictionary_encode()
    words = coded.dictionary
    # one text that is parted again: no object of Arrow's for each word
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\x00 ", pa.large_string()))[0].as_py() if len(words) else ""
    named = f" {joined}".split("\x00") if "\x00" not in joined.replace("\x00 ", "") and joined.count("\x00") == len(words) - 1 else [f" {w}" for w in words.to_pylist()]
    return named, np.asarray(pc.binary_length(words)).astype(np.int64) + 1, np.asarray(coded.indices).astype(np.int32), n, order


def _nested(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))


_BLOCK = pa.schema([
    ("words", pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("ae", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("be", pa.list_(pa.int32()))]))),
    ("docs", pa.list_(pa.struct([("id", pa.int64()), ("w", pa.list_(pa.int32()))]))),
])
_BLOCK_SQL = "words array<struct<a: array<int>, ae: array<int>, b: array<int>, be: array<int>>>, docs array<struct<id: bigint, w: array<int>>>"


def tokenize_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(words, docs) of blocks of texts: distinct words with both tokenizers' ids and byte ends, and each text as places of words.

    Texts get a space in front. A text that is null or empty, or whose tokens don't have its bytes, has no words. Where a
    tokenizer joins over spaces, a whole text is one word.
    """

    def block(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        some = np.flatnonzero([bool(t) for t in texts])
        words, size, at, n, order = _parted([f" {texts[i]}" for i in some], not (_kept(path_a)[0].parts and _kept(path_b)[0].parts))
        a, ae, na, good_a = _encode_words(words, size, path_a)
        b, be, nb, good_b = _encode_words(words, size, path_b)
        of = np.repeat(np.arange(len(n)), n)
        bad = np.zeros(len(n), bool)
        bad[of[~(good_a & good_b)[at]]] = True
        at, n = at[~bad[of]], np.where(bad, 0, n)
        # texts without tokens come last
        rest = np.setdiff1d(np.arange(len(texts)), some)
        counts, ids = np.concatenate([n, np.zeros(len(rest), np.int64)]), ids.take(pa.array(np.concatenate([some[order], rest])))
        columns = pa.StructArray.from_arrays([_nested(a, na), _nested(ae, na), _nested(b, nb), _nested(be, nb)], fields=list(_BLOCK.field("words").type.value_type))
        listed = pa.StructArray.from_arrays([ids, _nested(at, counts)], fields=list(_BLOCK.field("docs").type.value_type))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (columns, listed)], schema=_BLOCK)

    def run(batches):
        ids, texts, held = [], [], 0

        def full():
            nonlocal ids, texts, held
            out = block(pa.array(ids, pa.int64()), texts)
            ids, texts, held = [], [], 0
            release()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(t) if t else 0
                if held and held + n > block_chars:
                    yield full()
                ids.append(i)
                texts.append(t)
                held += n
        if ids:
            yield full()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _BLOCK_SQL)


#: Marks of a word longer than SHORT: a text with a 1 for each byte where both tokenizers end and 0 for the others.
_MARKS = "CAST(array_join(transform(x.c, (e, k) -> lpad('1', e - IF(k > 0, get(x.c, k - 1), 0), '0')), '') AS BINARY)"


def _places(ends: str) -> str:
    """SQL: numbers, from 1, of the tokens with these ends that end at common ends (x.c), in time proportional to the word."""
    marked = f"filter(sequence(1, size(x.{ends})), i -> substring(m, get(x.{ends}, i - 1), 1) = X'31')"
    return f"IF(size(x.ae) <= {SHORT} AND size(x.be) <= {SHORT}, transform(x.c, e -> CAST(array_position(x.{ends}, e) AS INT)), get(transform(array({_MARKS}), m -> {marked}), 0))"


def _piece(ids: str, at: str) -> str:
    past = f"IF(k > 0, get(y.{at}, k - 1), 0)"
    return f"array_join(CAST(slice(y.{ids}, {past} + 1, get(y.{at}, k) - {past}) AS ARRAY<STRING>), ',')"


#: From words to (groups, links, na, nb): what stands between common ends as text, and pairs of ids that end together.
#: Steps go over all words one after the other; a word that a tokenizer couldn't give back has no tokens.
ALIGN_WORDS = f"""
transform(
  transform(
    transform(words, w -> named_struct('a', w.a, 'b', w.b, 'ae', w.ae, 'be', w.be, 'c', array_intersect(w.ae, w.be))),
    x -> named_struct('a', x.a, 'b', x.b, 'i', {_places("ae")}, 'j', {_places("be")})),
  y -> named_struct(
    'groups', CASE WHEN size(y.i) = 0 THEN NULL
      WHEN size(y.i) = 1 THEN concat(array_join(CAST(y.a AS ARRAY<STRING>), ','), '|', array_join(CAST(y.b AS ARRAY<STRING>), ','))
      ELSE array_join(transform(y.i, (q, k) -> concat({_piece("a", "i")}, '|', {_piece("b", "j")})), ';') END,
    'links', zip_with(y.i, y.j, (m, n) -> shiftleft(CAST(get(y.a, m - 1) AS BIGINT), 32) + get(y.b, n - 1)),
    'na', size(y.a), 'nb', size(y.b)))
"""
#: From places of words to texts; `known` are the aligned words.
ALIGN_TEXTS = f"""
inline(get(transform(array({ALIGN_WORDS}), known -> transform(docs, d -> named_struct(
  'id', d.id,
  'n_a', aggregate(d.w, 0L, (s, i) -> s + get(known, i).na),
  'n_b', aggregate(d.w, 0L, (s, i) -> s + get(known, i).nb),
  'groups', array_join(transform(d.w, i -> get(known, i).groups), ';'),
  'links', flatten(transform(d.w, i -> get(known, i).links))))), 0))
"""


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_a, n_b, groups, links) of every row: tokens of both tokenizers, groups cut where both end, and linked ids.

    groups reads `a1,a2|b1;a3|b2,b3` in decimal ids; links are a * 2**32 + b, one for each common end. Python tokenises the
    distinct words of blocks of texts; after that, higher-order functions align each word once and put texts together.

    Null and empty texts, and such as a tokenizer doesn't give back byte for byte, have no tokens: zeros, '' and no links.
    Null ids and repeated rows stay as they are; an empty table gives an empty one. Extra columns are ignored.
    """
    return tokenize_blocks(docs, path_a, path_b, id_col, text_col, block_chars).select(F.expr(ALIGN_TEXTS))


def link_scores(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, n_best, count_sum) of the rows of `aligned` (uid, links) that have links, by the corpus counts in `pairs` (link, count, best)."""
    rows = aligned.select("uid", F.explode("links").alias("link"))
    met = keyed_join(rows, pairs, ["link"], "inner", 32)
    return met.groupBy("uid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(link, count, best): how often each pair of ids is linked, and whether no pair with the same second id is more often."""
    counts, _ = materialize(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count")), "link-counts")
    most = counts.groupBy((F.col("link") % (1 << 32)).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of the vocabulary
    out = counts.withColumn("b", F.col("link") % (1 << 32)).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))
    return materialize(out, "link-pairs")[0]


def cross_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, as align() says.

    A pair's count is how many links of the corpus hold it; n_best are the links whose count is the highest of their second
    id, ties included. Pairs are counted over all rows and looked up by a join that is broadcast only after a size check.
    """
    path_a, path_b = path_a or _public("byte_bpe_50k.json"), path_b or _public("piece_bpe_32k.model")
    aligned = align(docs, path_a, path_b, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows, _ = materialize(aligned.select(F.monotonically_increasing_id().alias("uid"), "id", "n_a", "n_b", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links"), "aligned")
    scores, _ = materialize(link_scores(rows, count_pairs(rows)), "link-scores")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # every common end closes a group and links the two tokens that end there
    return rows.drop("links").join(scores.hint("merge"), "uid", "left").select("id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cross_alignment of all documents with the public tokenizers."""
    return cross_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
