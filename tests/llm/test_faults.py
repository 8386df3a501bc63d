"""Faults that were found by review."""

import json

import pytest

from quillspark.llm import exact_dedup, packing
from quillspark.llm.tokens import Encoder, default_tokenizer


def test_a_lost_keeper_loses_no_text(spark, tmp_path):
    """Files that a kept state knows may go: of every text a row still stays."""
    path, state = f"{tmp_path}/t.parquet", f"file://{tmp_path}/state"
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "aa"), (2, "b"), (3, "b"), (4, "c")], schema).coalesce(1).write.parquet(path)
    exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()
    import os

    old = set(os.listdir(path))
    spark.createDataFrame([(9, "AA"), (8, "c")], schema).coalesce(1).write.mode("append").parquet(path)
    assert {r["id"]: r["keep_id"] for r in exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()} == {1: 9, 9: 9, 2: 3, 3: 3, 4: 8, 8: 8}
    for f in set(os.listdir(path)) - old:
        if f.startswith("part"):
            os.remove(f"{path}/{f}")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


@pytest.mark.parametrize("change", ["byte_level", "lower", "split"])
def test_other_tokenizer_files(tmp_path, change):
    """A file that splits or normalises in another way is encoded as the library does."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json") if change == "byte_level" else f"{tmp_path}/t.json"
    if change != "byte_level":
        spec = json.load(open(default_tokenizer(), encoding="utf-8"))
        if change == "lower":
            spec["normalizer"]["normalizers"].pop()
        else:
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"}
        json.dump(spec, open(path, "w", encoding="utf-8"))
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_words and Encoder(default_tokenizer()).by_words
    texts = ["Two Words, again 12ab", "É ça  va\n", None, ""]
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def test_work_is_a_parameter(spark):
    """However short the search, every piece finds its place."""
    df = spark.createDataFrame([(i, "word " * (3 + i % 40)) for i in range(200)], "doc_id long, text string")
    for work in (0, 10_000):
        rows = packing.pack_documents(df, cap=64, work=work).collect()
        ends: dict = {}
        for r in rows:
            ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(rows) == 200
        for v in ends.values():
            v.sort()
            assert sum(n for _, n in v) <= 64 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0
