"""The trie of conversation prefixes against one written out, and by way of its parts."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quillspark.llm import prefix_trie as P


def brute(rows):
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
    built = {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    saved = {n: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n, m in nodes.items()}
    kids = {n: sum(k[:-1] == n for k in nodes if k) for n in nodes}
    below = lambda n: [k for k in nodes if k[: len(n)] == n]
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids[n], sum(not kids[k] for k in below(n)), sum(saved[k] for k in below(n)), hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def rows():
    """Shared beginnings, one very common conversation, a long one, turnless ones, nulls, ties and repeated rows."""
    rng = random.Random(6)
    out = []
    for c in [*range(90), -3, -40]:
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi there", "yes", "no  way\nback", ""])) for t in range(rng.randrange(1, 7))]
    for c in range(200, 260):
        out += [(c, t, "user", f"turn {t} of all") for t in range(5)]
    out += [(300, t, "user", f"long {t % 3}") for t in range(70)]
    out += [(301, None, None, None), (301, 1, None, "a b"), (301, 1, None, "a b"), (301, 1, "user", None), (None, 1, "user", "lost"), (400, 0, "x", "one")]
    return out


def test_trie(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows()], "conv_id long, turn long, role string, text string, pos int, k1 string").repartition(4)
    out = P.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in out.fillna(-1, ["parent_conv_id"]).collect()) == brute(rows())


def test_crowded_conversations(spark, monkeypatch):
    """Conversations that are dealt by ranges, and ids in many buckets, come out the same."""
    from quillspark.operators import ranges

    monkeypatch.setattr(P, "running", lambda *a: ranges.running(*a, crowded=20))
    monkeypatch.setattr(P, "BUCKET_BITS", 3)
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in P.prefix_trie(df).fillna(-1, ["parent_conv_id"]).collect()) == brute(rows())


def test_roll_up_of_a_chain(spark):
    """A path of 100 nodes takes seven rounds."""
    chain = spark.range(100).select(F.col("id").alias("k1"), F.col("id").alias("k2"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p1"), F.lit(1).cast("long").alias("n")).withColumn("p2", F.col("p1"))
    assert {r["k1"]: r["n"] for r in P.roll_up(chain, ["n"], 7).collect()} == {i: 100 - i for i in range(100)}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not P.prefix_trie(empty).collect()
