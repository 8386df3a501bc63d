"""The trie of shared conversation prefixes, rolled up to all ancestors by pointer jumping."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed_join, materialize, remove
from quillspark.operators.ranges import running

#: Conversations that lend their first turns, and the most turns that they lend.
FAMILY, MOST_BORROWED = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
#: Ids are joined to texts in buckets of so many consecutive ones before they meet at a node.
BUCKET_BITS = 16
_TOP = "CAST(9223372036854775808 AS DECIMAL(38,0))"
_EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text): turns in order, from 1; null turns first, ties by role and text, null role or text empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).where("conv IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(named, ["conv"], order, {"pos": F.lit(1)}).select("conv", "pos", "role", "text")


def borrow_heads(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv, pos, role, text): every conversation c with the first h turns of c - c % family in place of its own first h.

    h is the unsigned crc32 of the decimal c, modulo 4. Where the lender is shorter or absent, fewer turns are borrowed.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    base = F.col("conv") - F.col("conv") % family
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") <= MOST_BORROWED)).select(F.col("conv").alias("base"), "pos", "role", "text")
    members = turns.select("conv").distinct().select("conv", h.alias("h"), base.alias("base"))
    lent = members.join(heads, "base").where("pos <= h").select("conv", "pos", "role", "text")
    known = heads.groupBy("base").agg(F.count("*").alias("lent"))
    own = turns.withColumns({"h": h, "base": base}).where("pos > h").join(known.hint("merge"), "base", "left")
    return own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("lent", F.lit(0)))).alias("pos"), "role", "text").union(lent)


def _digest(pos: Column, role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", pos.cast("string"), F.octet_length(role).cast("string"), role, text), 256)


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, p1, p2, words): the digest of each turn's prefix and of the prefix before it.

    The terms of a prefix are digests of place, role and text; their sums modulo 2**63, twice, name the prefix. Sums can be
    run up in parts, so a conversation of any length is no work of one task. The empty prefix is (0, 0).
    """
    d = _digest(F.col("pos"), F.col("role"), F.col("text"))
    part = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)")
    terms = turns.select("conv", "pos", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), d.alias("d")).select("conv", "pos", "words", part(1).alias("t1"), part(17).alias("t2"))
    run = running(terms, ["conv"], [F.col("pos")], {"s1": F.col("t1"), "s2": F.col("t2")})
    key = lambda s: F.expr(f"CAST(pmod(CAST({s} AS DECIMAL(38,0)), {_TOP}) AS BIGINT)")
    return run.select("conv", "pos", key("s1").alias("k1"), key("s2").alias("k2"), key("s1 - t1").alias("p1"), key("s2 - t2").alias("p2"), "words")


def roll_up(nodes: DataFrame, sums: list[str], rounds: int) -> DataFrame:
    """nodes (k1, k2, p1, p2, each of `sums`) with every sum taken over the node's whole subtree.

    After round i a node holds what stands less than 2**i below it and points 2**i up (p1, p2), so the sums need about
    log2(depth) rounds. A parent of any number of children gets partial sums. Each round is written, which cuts the plan.
    """
    now, path = materialize(nodes.select("k1", "k2", "p1", "p2", *sums), "trie-round")
    for _ in range(rounds):
        given = now.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*(F.sum(s).alias(f"more_{s}") for s in sums))
        up = now.where("p1 IS NOT NULL").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
        nxt = now.join(given, ["k1", "k2"], "left").join(up, ["p1", "p2"], "left")
        nxt, made = materialize(nxt.select("k1", "k2", F.col("u1").alias("p1"), F.col("u2").alias("p2"), *((F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums)), "trie-round")
        remove(now.sparkSession, path)
        now, path = nxt, made
    return now.select("k1", "k2", *sums)


def id_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, sha): SHA-256 of the comma-joined, ascending decimal ids (conv) of each node, streamed in constant memory.

    Ids are joined to texts in buckets of 65536 consecutive ones first; the hash itself has to see a node's ids in order.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    bits = F.shiftright("conv", BUCKET_BITS)
    joined = ends.groupBy("k1", "k2", bits.alias("bucket")).agg(ids.alias("ids"))

    def run(batches):
        key = state = None
        for pdf in batches:
            out = []
            for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["ids"]):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "sha"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["k1", "k2", "sha"])

    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "bucket").select("k1", "k2", "ids").mapInPandas(run, "k1 long, k2 long, sha string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations: the trie's nodes, the root among them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member, number of
    turns, the parent's smallest member, members, children, childless nodes in the subtree, words saved in the subtree if
    each turn stands once for all members of its node, and the digest of the ids that end there.

    Prefixes are named by digests of 126 bits, so equal names count as equal prefixes. Rows without conversation id are in
    no conversation. Null turns come first; ties go by role and text, repeated rows are turns of their own; null role and
    text are empty. An empty table has no node. Extra columns are ignored.
    """
    turns, _ = materialize(number_turns(conversations, conv, turn, role, text), "trie-turns")
    steps, _ = materialize(prefix_nodes(borrow_heads(turns, family)), "trie-steps")
    nodes = steps.groupBy("k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("pos").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("words").alias("words"))
    none = F.lit(None).cast("long")
    root = turns.agg(F.min("conv").alias("conv"), F.count_distinct("conv").alias("n")).where("n > 0")
    root = root.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), "conv", "n", F.lit(0).cast("long").alias("words"))
    nodes, _ = materialize(nodes.unionByName(root), "trie-nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    nodes, _ = materialize(nodes.join(children, ["k1", "k2"], "left").fillna(0, ["children"]), "trie-nodes")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    below = roll_up(nodes.select("k1", "k2", "p1", "p2", F.expr("CAST(children = 0 AS BIGINT)").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")), ["leaves", "saved"], int(depth).bit_length())
    last = steps.groupBy("conv").agg(F.max_by(F.struct("k1", "k2"), "pos").alias("k"))
    zero = F.lit(0).cast("long")
    ends = turns.select("conv").distinct().join(last, "conv", "left").select("conv", F.coalesce("k.k1", zero).alias("k1"), F.coalesce("k.k2", zero).alias("k2"))
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("above"))
    out = nodes.join(below, ["k1", "k2"]).join(id_digests(ends), ["k1", "k2"], "left")
    out, _ = materialize(out, "trie-out")
    out = keyed_join(out, above, ["p1", "p2"], "left", 64)
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix_trie over all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH raw AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, (xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT c FROM raw)),
built AS (
  SELECT v.c, 0 AS mine, r.pos, r.role, r.text FROM convs v JOIN raw r ON r.c = v.c - v.c % 20 AND r.pos <= v.h
  UNION ALL
  SELECT v.c, 1, r.pos, r.role, r.text FROM convs v JOIN raw r ON r.c = v.c AND r.pos > v.h),
whole AS (
  SELECT v.c, coalesce(b.turns, []) AS turns FROM convs v
  LEFT JOIN (SELECT c, list({'r': role, 't': text} ORDER BY mine, pos) AS turns FROM built GROUP BY c) b ON b.c = v.c),
steps AS (SELECT c, d, turns[1:d] AS pre, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT pre, d, min(c) AS c, count(*) AS n,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].t, '[^\x20\x09-\x0D]+')) END AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS sha
  FROM steps GROUP BY pre, d),
kids AS (SELECT pre[1:d - 1] AS up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT a AS pre, sum(leaf) AS leaves, sum(saved) AS saved FROM (
    SELECT unnest(list_transform(range(0, n.d + 1), lambda e: n.pre[1:e])) AS a, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, n.saved
    FROM nodes n LEFT JOIN kids k ON k.up = n.pre) GROUP BY a)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.sha AS ends_sha256
FROM nodes n JOIN below b ON b.pre = n.pre LEFT JOIN kids k ON k.up = n.pre LEFT JOIN nodes p ON n.d > 0 AND p.pre = n.pre[1:n.d - 1]
"""
