"""Every registered query of the subpackage: against its SQL, or against a second version on the same rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import registry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def rows(con):
    return con.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", list(registry.SQL))
def test_against_sql(spark, con, name):
    assert not differences(registry.QUERIES[name](spark, SF), con, registry.SQL[name])


def test_op1(spark, con, rows):
    """Perplexities and limits by a model written out with dictionaries, with the same quantile and slack."""
    from quillspark.llm import quality
    from tests.llm.test_scoring import brute_logp

    good = {r[0] for r in con.sql("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0").fetchall()}
    taught = [r[1] for r in rows if r[0] in good]
    logp = dict(zip((r[0] for r in rows), brute_logp([t for t in taught if t], [r[1] or "" for r in rows])))
    chars = {r[0]: len(r[1] or "") + 1 for r in rows}
    mean = {k: -sum(logp[r[0]] for r in rows if r[2] == k and r[0] in good and r[1]) / sum(chars[r[0]] for r in rows if r[2] == k and r[0] in good and r[1]) for k in {r[2] for r in rows if r[0] in good and r[1]}}
    every = -sum(logp[r[0]] for r in rows if r[0] in good and r[1]) / sum(chars[r[0]] for r in rows if r[0] in good and r[1])
    n = quality.PRIOR_CHARS
    surprise = {r[0]: (-logp[r[0]] + n * mean.get(r[2], every)) / (chars[r[0]] + n) for r in rows}
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_kneser_ney_quality"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, lang, _ in rows:
        assert got[i]["surprise"] == pytest.approx(surprise[i], rel=1e-6)
        assert got[i]["rejected"] == (bool(text) and surprise[i] > got[i]["limit"])
    for k in mean:
        taught = sorted(surprise[r[0]] for r in rows if r[2] == k and r[0] in good and r[1])
        limit = next(got[r[0]]["limit"] for r in rows if r[2] == k) - 0.06
        assert sum(x <= limit + 1e-9 for x in taught) >= 0.99 * len(taught) - 1 and any(abs(x - limit) < 1e-6 for x in taught)


def test_op3(spark, rows):
    from tests.llm.test_output import library

    want, start = set(), 0
    for r in sorted(rows):
        x = np.array([*library(r[1]), 1], "<u4")
        want.add((r[0], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert {tuple(r) for r in registry.QUERIES["op3_elias_fano_tokens"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op4(spark, rows):
    """Held-out rows against their languages; scores against the model applied gram by gram."""
    import re

    from pyspark.sql import functions as F

    from quillspark.llm import language_id as L

    got = {r["doc_id"]: r for r in registry.QUERIES["op4_subword_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taught = L.sample(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, "doc_id", "text", "lang")
    model = L.fit([t for t, _ in taught], [x for _, x in taught])
    assert set(got) == {r[0] for r in rows}
    held = []
    for i, text, lang, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not text or not re.search(r"[^\W\d_]", text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        if len(text) < 3000:
            z = slow_scores(model, text)
            assert got[i]["lang_pred"] == model.languages[int(np.argmax(z))]
            assert got[i]["score"] == pytest.approx(float(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum()), abs=1e-4)
        if got[i]["held_out"] and lang is not None:
            held.append(got[i]["lang_pred"] == lang)
    assert np.mean(held) > 0.9  # two hundred documents; 0.999 on ten thousand


def slow_scores(model, text):
    """The mean of the logits of all grams of two, three and four bytes, one gram at a time."""
    from quillspark.llm.language_id import HASH_BITS

    b = b" " + text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")) + b"   "
    total, n = np.zeros(len(model.languages)), 0
    for i in range(len(b) - 3):
        for j, k in enumerate((2, 3, 4)):
            g = (int.from_bytes(b[i : i + k], "big") + j * 0x3C6EF372) * 0x9E3779B1 & 0xFFFFFFFF
            total += model.logits[:, ((g ^ g >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - HASH_BITS]
            n += 1
    return (total / n + model.bias) * model.scale


def test_op5(spark, rows):
    from tests.llm.test_output import check_packing

    got = registry.QUERIES["op5_bin_completion_packing"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    assert check_packing(got, rows, 2048) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_op6(spark, rows):
    import re

    got = registry.QUERIES["op6_pivotal_mixing"](spark, SF).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by[source[r["doc_id"]]].append(r)
    for of in by.values():
        sizes = sorted(r["size"] for r in of)
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= sizes[min(16, len(sizes) - 1)]
    again = registry.QUERIES["op6_pivotal_mixing"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
