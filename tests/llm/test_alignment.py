"""Cross-tokenizer alignment against a version written out over whole texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment as A

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Both libraries over whole texts, dictionaries of ends, counts over all links."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = A._byte_letters()
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, counts = [], Counter()
    for d, t in rows:
        x, y = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if any(b"".join(map(f, ids)) != f" {t}".encode() for f, ids in ((of_a, x), (of_b, y))):
            x, y = [], []
        ends = []
        for f, ids in ((of_a, x), (of_b, y)):
            at, n = {}, 0
            for k, i in enumerate(ids):
                n += len(f(i))
                at[n] = k
            ends.append(at)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, x[i : p + 1])) + "|" + ",".join(map(str, y[j : q + 1])))
            links.append((x[p], y[q]))
            i, j = p + 1, q + 1
        counts.update(links)
        made.append((d, len(x), len(y), groups, links))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (d, na, nb, len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for d, na, nb, g, links in made
    ]


def key(r):
    return tuple((x is None, x) for x in r)


ODD = [None, "", " ", "   ", "a", " a", "a  b", "a \n b", "tab\tand wide　space", "x\x00y", "line\n\nline\r\n", "<|endoftext|> <s> </s> <0x41>", "été ça Ünï 日本語 🙂👍🏽", "don't we'll 'S", "1234567890 3.14", "ends in space ", " sep", "﻿bom", "▁low", "ﬁ ligature ①", "z" * 400, "ab1-" * 500, "word " * 3000 + "!"]


def test_odd_texts(spark):
    """Nulls, empty and long texts, white space of all kinds, special strings, repeated rows, null ids, clashing names."""
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice("ab é\n .,'日7 ") for _ in range(rng.randrange(1, 60))) for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same"), (3, "same"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, links string, n_a int").repartition(3)
    got = [tuple(r) for r in A.cross_alignment(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_registered_query(spark):
    from quillspark.llm.registry import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = QUERIES["op11_cross_alignment"](spark, SF)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(brute(rows))


def test_blocks_and_empty(spark, docs, empty):
    """Any size of block gives the same; an empty table gives an empty one."""
    import public_tokenizers as P

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    some = docs.where(F.length("text") < 5000)
    one, many = (sorted(map(repr, A.align(some, *paths, block_chars=n).collect())) for n in (1 << 30, 500))
    assert one == many and len(one) == some.count()
    assert not A.cross_alignment(empty).collect()


def test_other_files(spark, tmp_path):
    """Two byte-level files, one of which isn't in the order of its ids: whole texts go through the library."""
    import json

    import public_tokenizers as P

    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][:300][::-1]
    path = f"{tmp_path}/other.json"
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert not A.load(path).ranked and A.load(P.path("byte_bpe_50k.json")).ranked
    df = spark.createDataFrame([(1, "the other one"), (2, "à la carte")], "doc_id long, text string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = {r["id"]: r["n_a"] for r in A.align(df, path, P.path("byte_bpe_50k.json")).collect()}
    assert got == {r["doc_id"]: len(tok.encode(f" {r['text']}", add_special_tokens=False).ids) for r in df.collect()}
