"""The stages of corpus_pipeline on rows with nulls, empty and long texts, repeats, ties and columns that could clash."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_groups, brute_lines
from tests.llm.test_output import check_packing, library


@pytest.fixture(scope="module")
def sf(spark, docs_path):
    root = docs_path.removesuffix("/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{root}/labels.parquet")
    return root


def plain(rows):
    return Counter(str(tuple(r)) for r in rows)


def test_stages(spark, docs, sf, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near-copies", "mix", "pack"]
    good = stages["quality"](spark, docs, sf)
    good.write.parquet(f"{tmp_path}/good")
    good = spark.read.parquet(f"{tmp_path}/good")
    assert good.columns == docs.columns and not plain(good.collect()) - plain(docs.collect())
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in good.collect()} <= {61, 62, 64, 65, 66, 67, 68, 69, 70, None}

    lines = stages["lines"](spark, good, sf)
    assert lines.columns == docs.columns
    want = brute_lines([tuple(r) for r in good.collect()])
    assert Counter((r["doc_id"], r["text"]) for r in lines.collect()) == Counter({(k[0], k[3]): n for k, n in want.items()})
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    one = stages["near-copies"](spark, lines, sf)
    kept, before = one.collect(), [tuple(r) for r in lines.collect()]
    groups = brute_groups(before)
    assert one.columns == docs.columns and not plain(kept) - plain(lines.collect())
    ids = [r["doc_id"] for r in kept if r["text"].split()]
    # one row of every group that has an id, the smallest; rows without words all stay
    assert Counter(i for i in ids if i is not None) == Counter({c for (_, n, c) in groups if n and c is not None})
    assert sum(not r["text"].split() for r in kept) == sum(not (r[1] or "").split() for r in before)

    mixed = stages["mix"](spark, one, sf)
    assert mixed.columns == docs.columns
    most = plain(kept)
    assert all(n <= 3 * most[k] for k, n in plain(mixed.collect()).items())

    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    check_packing(stages["pack"](spark, mixed, sf).collect(), rows, 2048)


def test_run(spark, docs, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    again = corpus_pipeline.run(spark, sf).collect()
    content = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert out and content(out) == content(again)
    long = np.array([*library(next(r["text"] for r in docs.collect() if r["doc_id"] == 63)), 0], "<u4")
    assert content(out)[(63, 0, 2048, zlib.crc32(long[:2048].tobytes()))] <= 3


def test_run_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_of_each_group(spark):
    from quillspark.llm.jaccard_join import keep_one

    rows = [(None, "only null ids here at all"), (None, "only null ids here at all"), (3, "some text of its own"), (3, "some text of its own"), (None, "some text of its own"), (1, None), (1, None), (2, " ")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2], rows[5], rows[6], rows[7]])
