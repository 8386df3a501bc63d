"""One-bit search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import one_bit_search as O


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if asked(i):
            out[i] = sorted(((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in good if j != i and len(w) == len(v)))[:k]
    return out


def rows(width=24):
    """Vectors of all lengths, a third of them equal, ties, nulls, zeros, non-finite parts and another width."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, width)) * rng.uniform(0.5, 3, (900, 1))
    x[::3] = x[0]
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(1000, None), (1020, [0.0] * width), (1040, [float("nan")] * width), (1060, [None] * width), (1080, []), (None, x[1].tolist())]
    out += [(2000 + 10 * i, rng.normal(size=5).tolist()) for i in range(6)]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 26, 60 * 24 * 8])
def test_search(spark, block_bytes):
    df = spark.createDataFrame([(*r, 1, "a") for r in rows()], "vec_id long, embedding array<double>, rep int, v string").repartition(3)
    got: dict = {}
    for r in O.search(df, F.col("vec_id") % 20 == 0, k=20, block_bytes=block_bytes).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    want = brute(rows(), lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hit = total = 0
    for q, w in want.items():
        assert sorted(got[q]) == list(range(1, len(w) + 1))
        exact = {i: -s for s, i in w}
        hit += sum(i in exact for i, _ in got[q].values())
        total += len(w)
        have = [got[q][r] for r in sorted(got[q])]
        assert have == sorted(have, key=lambda p: (-p[1], p[0]))
        assert all(exact[i] == s for i, s in have if i in exact)
    assert hit >= 0.99 * total


def test_bounds_hold():
    """Nearly all inner products lie within the bounds, and these leave most vectors out."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    centre = x[:500].mean(0)
    coded, asked = O.Coded(*O.encode(x, centre), 1.0), O.Queries(x[:50], centre)
    out, over = 0, 0
    for i in range(50):
        est, high = asked.bounds(i, coded)
        true = x @ x[i]
        over += int((true > high).sum())
        assert abs(float((est - true).mean())) < 0.02
        out += int((high < np.sort(true)[-20]).sum())
    assert over <= 0.002 * 50 * 4000 and out > 0.7 * 50 * 4000


def test_turning_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(10, 33))
    r = O.rotate(x)
    assert r.shape == (10, 256) and np.allclose((r * r).sum(1), (x * x).sum(1)) and np.allclose(r @ r.T, x @ x.T)


def test_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert not O.search(empty, F.col("vec_id") % 20 == 0).collect()
