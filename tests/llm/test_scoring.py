import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language_id, mixing, quality


START, END = object(), object()


def brute_logp(texts: list[str], score: list[str]) -> list[float]:
    """The model written out with dictionaries."""
    seq = [[START, START, *t, END] for t in texts if t]
    c3 = Counter(tuple(s[i - 2 : i + 1]) for s in seq for i in range(2, len(s)))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [min(max((i + 1) - (i + 2) * y * n[i + 2] / n[i + 1] if n[i + 1] else 0.5, 0.1), i + 0.9) for i in range(3)]

    def parts(c):
        d = discounts(c)
        total, back = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            back[g[:-1]] += d[min(n, 3) - 1]
        return d, total, back

    ps = {3: parts(c3), 2: parts(c2), 1: parts(c1)}
    table = {3: c3, 2: c2, 1: c1}

    def p(g):
        d, total, back = ps[len(g)]
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(c1) + 1)
        if not total[g[:-1]]:
            return lower
        n = table[len(g)][g]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * lower

    return [sum(math.log(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) for s in ([START, START, *t, END] for t in score)]


def test_kneser_ney_equals_brute_force(spark, docs, doc_rows):
    trusted = spark.createDataFrame([(i,) for i in range(0, 50, 2)], "id long")
    taught = [r[1] for r in doc_rows if r[0] is not None and r[0] < 50 and r[0] % 2 == 0]
    got = {r["row_key"]: r["logp"] for r in quality.perplexities(docs, trusted).collect()}
    keyed = docs.select("doc_id", "text", quality._row_key("doc_id", "text").alias("k")).collect()
    want = brute_logp(taught, [r["text"] or "" for r in keyed])
    for r, w in zip(keyed, want):
        assert math.isclose(got[r["k"]], w, rel_tol=1e-6, abs_tol=1e-6), (r["doc_id"], got[r["k"]], w)


def test_quality_rejects_noise(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(["la", "ti", "mo", "ner"], int(rng.integers(1, 4))))
    rows = [(i, " ".join(word() for _ in range(60)), "en") for i in range(200)]
    rows += [(1000 + i, "".join(chr(int(c)) for c in rng.integers(33, 126, 300)), "en") for i in range(10)] + [(2000, None, "en"), (2001, "", None), (2002, "lati monerla", "xx"), (None, "lati", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.score_quality(docs, spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id long")).collect()
    assert len(got) == len(rows)
    assert {r["id"] for r in got if r["rejected"]} == set(range(1000, 1010))


def test_quality_without_trust(spark, docs, empty):
    none = spark.createDataFrame([], "id long")
    assert not any(r["rejected"] for r in quality.score_quality(docs, none).collect())
    assert quality.score_quality(empty, none).collect() == []


def test_language_id(spark, docs, empty):
    rng = np.random.default_rng(1)
    parts = {"aa": ["ka", "ro", "mi"], "bb": ["schu", "tz", "en"], "cc": ["é", "ouil", "ça"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(20)), k) for i in range(400) for k in [list(parts)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify_languages(table, F.col("doc_id") % 2 == 0).collect()
    held = [r for r in out if r["doc_id"] % 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect() if r["doc_id"] is not None}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (60, 61, 62, 70)) and odd[64]["lang_pred"] != "und"
    assert language_id.identify_languages(empty).collect() == []
    assert {r["lang_pred"] for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_targets_fill_up():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    out = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert out[0] == 30 and abs(sum(out) - 2010) < 1e-9 and abs(out[1] - 2 * out[2]) < 1e-9
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_pivot_keeps_mass():
    rng = np.random.default_rng(5)
    for last in (True, False):
        sizes, probs = np.sort(rng.integers(1, 50, 500))[::-1], np.full(500, rng.random())  # as in a source
        p = mixing.pivot(rng.integers(0, 2**60, 500), sizes, probs, 1, last, 4)
        live = np.flatnonzero((p > 0) & (p < 1))
        assert abs((p * sizes).sum() - (probs * sizes).sum()) < (1 if last else 1e-6)
        assert len(live) == 0 if last else len(live) <= 4 * 6


def test_pivot_keeps_expectations():
    sizes, probs = np.array([9, 5, 4, 2, 1, 1]), np.array([0.3, 0.3, 0.6, 0.5, 0.9, 0.5])
    mean = np.mean([mixing.pivot(np.arange(6), sizes, probs, seed, False) for seed in range(4000)], axis=0)
    assert np.abs(mean - probs).max() < 0.04


def test_mix_meets_targets(spark, monkeypatch):
    """Over several levels of the tree, with a hot source, long documents and one row a thousand times."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 300)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(min(3000, rng.lognormal(4, 1.3)) + 1), "a" if i % 3 else f"s{i % 7}") for i in range(3000)]
    rows += [(9000, "same row here " * 30, "b")] * 1000 + [(9001 + i, "x " * (i % 40 + 1), "b") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    by = defaultdict(list)
    for r in mixing.mix_sources(docs).collect():
        by[r["source"]].append(r)
    for name, of in by.items():
        words, target, sizes = sum(r["size"] * r["copies"] for r in of), of[0]["target"], sorted(r["size"] for r in of)
        assert abs(words - target) <= max(sizes[min(5, len(sizes) - 1)], 0.002 * target), (name, words, target)
        assert max(r["copies"] for r in of) <= 3
    same = Counter(r["copies"] for r in by["b"] if r["id"] == 9000)
    assert len(same) <= 2 and sum(same.values()) == 1000
    taken = Counter(r["doc_id"] for r in mixing.take_mix(docs).collect())
    assert taken == {i: n for i, n in Counter({k: sum(r["copies"] for rows in by.values() for r in rows if r["id"] == k) for k in {r[0] for r in rows}}).items() if n}


def test_take_mix_keeps_columns(docs):
    odd = docs.selectExpr("*", "1 AS __copies", "2 AS __mix_key", "3 AS mix_key", "4 AS copies", "5 AS `a.b`", "6 AS kept", "7 AS whole")
    out = mixing.take_mix(odd)
    assert out.columns == odd.columns and {tuple(r)[-7:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_mix(docs, empty):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    plain = lambda rows: sorted((str(r["id"]), r["mix_key"], r["copies"]) for r in rows)
    assert plain(got) == plain(again) and len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["copies"] <= 3
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["size"] * r["copies"] for r in rows) - rows[0]["target"]) <= 3 * max(r["size"] for r in rows)
    assert mixing.mix_sources(empty).collect() == [] and mixing.take_mix(docs).columns == docs.columns
