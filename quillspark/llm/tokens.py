"""Encoding of whole texts with the tokenizers library, each distinct word of a block once."""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.common import chunks_of, release

#: Words that a worker remembers in each of two generations unless told otherwise; the older one goes when the younger is full, which
#: changes no result.
MEMO_WORDS = 150_000
#: Characters of a block whose words are made distinct together.
BLOCK_CHARS = 4 << 20

# Letters of these blocks keep to themselves: lower case and composition go by single letters.
_FOREIGN = re.compile("[^\x00-įı-ɏ]")
# Fixed values of the file format that words can be encoded by themselves in.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# pre-tokens of printable ASCII in lower case, as the file's own pattern parts them
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits as the encoding by words takes for granted."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    steps, parts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    blank = any(x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    split = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": _SPLIT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    letters = split and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    return bool([x["type"] for x in steps] == _NORMALIZERS and blank and letters and model["type"] == "BPE" and not model.get("dropout"))


class Encoder:
    """ids of texts by the tokenizer file at `path`, add_special_tokens=False, as arrays of 16 or 32 bits.

    The file's pre-tokenizer never joins what white space parts, so a text's ids are those of its words in order. The
    words of a block of texts are made distinct first; those seen before come from a memo, the rest are encoded once.
    Texts where lower-casing or composing could look beyond a word, or that hold the strings of special tokens, are
    encoded whole, and so are all texts if the file normalises or splits in any other way.
    """

    def __init__(self, path: str, words: int | None = None):
        from tokenizers import Tokenizer

        self.most = words or MEMO_WORDS
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = _by_words(json.load(f))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # the alphabet of the byte-level model: letters beyond ASCII stand there as several signs
        self.letters = {i: "".join(x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(chr(i))) for i in range(0x80, 0x250) if chr(i).isalpha()} if self.by_words else {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of each of the distinct words."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, model, letters, width = self.young, self.old, self.tok.model.tokenize, self.letters, self.dtype.itemsize

        def piece(w: str) -> bytes:
            """ids of one pre-token."""
            b = young.get(w) or old.get(w)
            if b is None:
                b = b"".join([t.id.to_bytes(width, "little") for t in model(w if w.isascii() else w.translate(letters))])
            young[w] = b
            return b

        out = list(map(young.get, words))
        rest = []
        for i in [i for i, b in enumerate(out) if b is None]:
            w = words[i]
            if w.isalpha():
                out[i] = piece(w)
            elif w[-1:] in (",", ".") and w[:-1].isalpha():
                out[i] = piece(w[:-1]) + piece(w[-1])
            elif w.isascii() and w.isprintable():
                out[i] = b"".join([piece(x) for x in _PIECE.findall(w)])
            else:
                b = old.get(w)
                if b is None:
                    rest.append(i)
                else:
                    out[i] = young[w] = b
        if rest:
            for i, b in zip(rest, self._whole([words[i] for i in rest])):
                out[i] = young[words[i]] = b
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        # one string that is parted again: no object of Arrow's for each word
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        ids = self._words(distinct)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        # the ids of word after word: places in flat, each run moved to where the text has it
        n = size[at]
        stop = np.cumsum(n)
        kind = np.int32 if len(n) and stop[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
        where = np.repeat(((np.cumsum(size) - size)[at] - stop + n).astype(kind), n)
        where += np.arange(len(where), dtype=kind)
        cuts = np.concatenate([[0], stop])[ends]
        return np.split(flat[where], cuts[:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text; null counts as empty."""
        out: list = [np.zeros(0, self.dtype)] * len(texts)
        whole, apart = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_words or not t.isascii() and _FOREIGN.search(t) or any(s in t for s in self.special) or any(c in t for c in "\x1c\x1d\x1e\x1f"):
                whole.append(i)
            else:
                apart.append(i)
        low = [texts[i].lower() for i in apart]
        for a, b in chunks_of(low, 2 * BLOCK_CHARS):
            for i, x in zip(apart[a:b], self._block(low[a:b])):
                out[i] = x
        for a, b in chunks_of([texts[i] for i in whole], BLOCK_CHARS):
            for i, x in zip(whole[a:b], self._whole([texts[i] for i in whole[a:b]])):
                out[i] = np.frombuffer(x, self.dtype)
        return out


def encoder(path: str, words: int | None = None) -> Encoder:
    """The worker's encoder for a file; it outlives a task, as workers are used again."""
    release()
    home = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    found = home.__dict__.setdefault("encoders", {})
    if path not in found:
        found[path] = Encoder(path)
    found[path].most = words or MEMO_WORDS
    return found[path]
