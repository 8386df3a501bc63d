"""Jaccard similarity join of word-shingle sets by partitioning the universe of shingles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of, keyed_join, materialize, mix, release, remove, word_hashes
from quillspark.llm.components import components

#: Lists of up to this many sets are paired out; of longer ones the sets that can do without give the list up.
SHORT_LIST = 12
#: Signatures that one index task should hold.
TASK_ENTRIES = 2_000_000
#: Turns in which long lists are held against hubs before the rest is compared in blocks.
HUB_TURNS = 1
#: Members of a long list that make up a block.
BLOCK = 2048
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text (A-Z folded by bytes.lower); of fewer words, all of them as one."""
    h, n = word_hashes([t.lower() for t in texts])
    roll = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        roll = roll * _M + h[j : len(h) - width + 1 + j]
    roll = mix(roll)
    out, at = [], 0
    for k in n.tolist():
        if k >= width:
            out.append(np.unique(roll[at : at + k - width + 1]))
        elif k:
            x = np.array([k], np.uint64)
            for w in h[at : at + k]:
                x = x * _M + w
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def fingerprint(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    return int(mix(np.array([mix(s ^ _M).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in at least 2 len(s) buckets, as words; two sets differ in no fewer elements than parities."""
    bits = 64 << max(0, (2 * len(s) - 1).bit_length() - 6)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Parities as if for fewer buckets."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """How many elements sets of a and b elements with Jaccard >= num / den can differ in."""
    return (den - num) * (a + b) // (den + num)


def bands(top: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """Size ranges up to `top`; below the first, only equal sets are similar."""
    low = 1
    while most_apart(low, low, num, den) < 1 and most_apart(low, low + 1, num, den) < 1:
        low += 1
    out = []
    low += 1
    while low <= top:
        high = max(low, low * den // num)
        out.append((low, high))
        low = high + 1
    return tuple(out)


def allocation(low: int, high: int, num: int, den: int) -> tuple[int, int, int]:
    """(one, zero, apart) of a band: segments matched up to one deletion, segments matched exactly, and the bound on differences.

    With `one * 2 + zero` above `apart`, two similar sets agree in an exact segment or nearly in the other kind. The
    surplus lets a set give up empty and crowded segments. The choice is the cheapest in signatures, with a price on
    sets that have too many empty segments (binomial estimate for the smallest sets), which must meet in them.
    """
    apart = most_apart(high, high, num, den)
    small = max(1, -(-low * num // den))
    best = None
    for one in sorted({0, 1, 2, 3, apart // 8, apart // 4, apart // 2, (apart + 2) // 2}):
        for spare in sorted({0, 1, 2, 3, 4, 6, 8, *(math.ceil(apart * x) for x in (0.05, 0.08, 0.12, 0.16, 0.2, 0.3))}):
            zero = max(0, apart + 1 + spare - 2 * one)
            m = one + zero
            if not m:
                continue
            p0 = (1 - 1 / m) ** small
            p1 = p0 + small / m * (1 - 1 / m) ** (small - 1) if m > 1 else float(small <= 1)
            slack = 2 * one + zero - apart - 1
            mean, var = zero * p0 + 2 * one * p1, zero * p0 * (1 - p0) + 4 * one * p1 * (1 - p1)
            z = (slack + 0.5 - mean) / math.sqrt(var + 1e-12)
            unsafe = 0.5 * math.erfc(z / math.sqrt(2))
            crowded = max(0.0, 0.06 - (slack - mean) / (apart + 1))
            cost = zero + one * (1 + small / m) + 3000 * unsafe + 200 * crowded
            if best is None or cost < best[0]:
                best = (cost, one, zero)
    return best[1], best[2], apart


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, ...]:
    """Units (set, band, slack) and entries (signature, unit, weight) of sets.

    A set is a unit in its own band and in each higher band that can hold a similar set. Slack is the weight of
    segments that the unit can give up and still be sure to meet all similar sets.
    """
    size = np.array([len(s) for s in sets])
    units, entries, base = [], [], 0
    for no, (low, high) in enumerate(bands(int(size.max(initial=0)) * den // num + 1, num, den)):
        mine = np.flatnonzero((size <= high) & (size * den >= low * num))
        if not len(mine):
            continue
        one, zero, apart = allocation(low, high, num, den)
        m, n = one + zero, len(mine)
        x = np.concatenate([sets[i] for i in mine])
        unit = np.repeat(np.arange(n), size[mine])
        place = unit * m + (mix(x + np.array([no + 1], np.uint64) * _M) % np.uint64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, val = place[order], mix(x[order] ^ _M)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        total, count = np.add.reduceat(val, first), np.diff(first, append=len(place))
        place = place[first]
        seg = place % m
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((no + 1) << 32))
        near = seg < one
        # segments that a unit can't count on: empty ones, and for those with a deletion also single elements
        bad = np.full(n, 2 * one + zero, np.int64) - np.bincount(place // m, np.where(near, np.where(count > 1, 2, 0), 1), n).astype(np.int64)
        slack = 2 * one + zero - apart - 1 - bad
        sig = [mix(total + salt[seg])]
        of, weight = [place // m], [np.where(near, 2, 1)]
        drop = np.repeat(near & (count > 1), count)
        sig.append(mix(np.repeat(total, count)[drop] - val[drop] + np.repeat(salt[seg], count)[drop]))
        of.append(np.repeat(place // m, count)[drop])
        weight.append(np.full(int(drop.sum()), 2))
        weak = np.flatnonzero(slack < 0)
        if len(weak):
            # such units meet each other in what the rest leaves out
            held = np.zeros((n, m), np.int64)
            held[place // m, seg] = count
            u, s = np.nonzero((held[weak] == 0) | ((held[weak] == 1) & (np.arange(m) < one)))
            sig.append(mix(salt[s]))
            of.append(weak[u])
            weight.append(np.where(s < one, 2, 1))
        units.append((mine, np.full(n, no), slack))
        entries.append((np.concatenate(sig), np.concatenate(of) + base, np.concatenate(weight)))
        base += n
    if not units:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z, z
    return (*(np.concatenate(c) for c in zip(*units)), *(np.concatenate(c) for c in zip(*entries)))


def _deal(shards: int, num: int, den: int):
    def run(batches):
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in chunks_of(texts, 1 << 20):
                # equal sets of a block go in once
                sets = list({fingerprint(s): s for s in shingle_sets(texts[a:b]) if len(s)}.items())
                if not sets:
                    continue
                fp = np.array([f for f, _ in sets], np.int64)
                who, band, slack, sig, unit, weight = signatures([s for _, s in sets], num, den)
                size = np.array([len(s) for _, s in sets])[who]
                shard = (mix(sig) % np.uint64(shards)).astype(np.int64)
                rows = []
                for s in np.unique(shard).tolist():
                    m = shard == s
                    u, inv = np.unique(unit[m], return_inverse=True)
                    rows.append((s, fp[who[u]].tobytes(), size[u].astype("<i4").tobytes(), band[u].astype("<i2").tobytes(), slack[u].astype("<i4").tobytes(), sig[m].tobytes(), inv.astype("<u2" if len(u) <= 1 << 16 else "<u4").tobytes(), weight[m].astype(np.uint8).tobytes()))
                yield pd.DataFrame(rows, columns=["shard", "fp", "size", "band", "slack", "sig", "unit", "weight"])
            release()

    return run


_PAYLOAD = "shard int, fp binary, size binary, band binary, slack binary, sig binary, unit binary, weight binary"
_FOUND = "sig long, a long, b long, na int, band int, slack int, weight int, slack_b int"


def _index(num: int, den: int):
    """Of one shard: pairs that meet in short lists, by band with the number of meetings, and the entries of long lists (b null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        cols = []
        for r in pdf.itertuples():
            fp = np.frombuffer(r.fp, np.int64)
            unit = np.frombuffer(r.unit, "<u2" if len(fp) <= 1 << 16 else "<u4")
            rest = (np.frombuffer(x, t)[unit] for x, t in ((r.size, "<i4"), (r.band, "<i2"), (r.slack, "<i4")))
            cols.append((np.frombuffer(r.sig, np.uint64), fp[unit], *rest, np.frombuffer(r.weight, np.uint8)))
        sig, fp, size, band, slack, weight = (np.concatenate(c) for c in zip(*cols))
        order = np.lexsort((fp, sig))
        sig, fp, size, band, slack, weight = (c[order] for c in (sig, fp, size, band, slack, weight))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
        sig, fp, size, band, slack, weight = (c[new] for c in (sig, fp, size, band, slack, weight))
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(first, append=len(sig))
        pa, pb = [], []
        for k in range(2, SHORT_LIST + 1):
            at = first[count == k]
            for i in range(k):
                for j in range(i + 1, k):
                    pa.append(at + i)
                    pb.append(at + j)
        pa, pb = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pa, pb))
        both = size[pa].astype(np.int64) + size[pb]
        fits = np.minimum(size[pa], size[pb]).astype(np.int64) * den >= np.maximum(size[pa], size[pb]).astype(np.int64) * num
        pa, pb, both = pa[fits], pb[fits], both[fits]
        # meetings that a similar pair can't do without, besides its slack: the band's bound less the pair's own
        plan = [allocation(low, high, num, den) for low, high in bands(int(size.max(initial=1)) * den // num + 1, num, den)]
        bound = np.array([apart if not one else -(10**6) for one, _, apart in plan])
        more = bound[band[pa]] - (den - num) * both // (den + num)
        pairs = pd.DataFrame({"a": fp[pa], "b": fp[pb], "band": band[pa], "slack": slack[pa] + 1 + more, "slack_b": slack[pb] + 1 + more})
        pairs = pairs.groupby(["a", "b", "band"], as_index=False).agg(slack=("slack", "max"), slack_b=("slack_b", "max"), weight=("slack", "size"))
        long = np.repeat(count > SHORT_LIST, count)
        lists = pd.DataFrame({"sig": sig[long].view(np.int64), "a": fp[long], "na": size[long], "band": band[long], "slack": slack[long], "weight": weight[long]})
        # whole numbers all the way: a missing column must not turn them into floats
        names = ("sig", "a", "b", "na", "band", "slack", "weight", "slack_b")
        full = [pd.DataFrame({c: t[c].astype("Int64") if c in t else pd.array([pd.NA] * len(t), dtype="Int64") for c in names}) for t in (pairs, lists)]
        return pd.concat(full, ignore_index=True)

    return run


def _indexed_sets(docs: DataFrame) -> DataFrame:
    """(row_key, n_shingles, fp) of every row; fp is null for empty sets."""

    def run(batches):
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in chunks_of(texts, 1 << 20):
                sets = shingle_sets(texts[a:b])
                fp = pd.array([fingerprint(s) if len(s) else pd.NA for s in sets], dtype="Int64")
                yield pd.DataFrame({"row_key": pdf["row_key"].iloc[a:b].to_numpy(), "id": pdf["id"].iloc[a:b].to_numpy(), "n_shingles": [len(s) for s in sets], "fp": fp})
            release()

    return docs.mapInPandas(run, f"row_key long, id {dict(docs.dtypes)['id']}, n_shingles long, fp long")


def _candidate_sets(rows: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in chunks_of(texts, 1 << 20):
                sets = shingle_sets(texts[a:b])
                yield pd.DataFrame({"fp": [fingerprint(s) for s in sets], "n": [len(s) for s in sets], "parity": [parities(s) for s in sets], "items": [s.view(np.int64) for s in sets]})
            release()

    return rows.select("text").mapInPandas(run, "fp long, n int, parity array<long>, items array<long>")


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities let them be similar: whole sets are only sent for these."""
    side = lambda k: sets.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")).hint("merge")
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    def fold(c: str):
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    # sizes that are this near have as many words, or one has twice the other's
    pa = F.when(F.size("pa") > F.size("pb"), fold("pa")).otherwise(F.col("pa"))
    pb = F.when(F.size("pb") > F.size("pa"), fold("pb")).otherwise(F.col("pb"))
    apart = F.aggregate(F.zip_with(pa, pb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    return both.where(apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b")


def _in_blocks(num: int, den: int):
    """Of pairs of blocks of lists: the pairs of sets in different components whose sizes and parities let them be similar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, lo, hi), g in pdf.groupby(["sig", "lo", "hi"]):
            left = (g["block"] == lo).to_numpy()
            right = (g["block"] == hi).to_numpy()
            words = min(map(len, g["parity"]))
            # unsigned: numpy counts the bits of the absolute value otherwise
            par = np.stack([folded(np.asarray(x, np.int64), words) for x in g["parity"]]).view(np.uint64)
            fp, n, root = (g[c].to_numpy() for c in ("fp", "n", "root"))
            x, y = np.flatnonzero(left), np.flatnonzero(right)
            step = max(1, (1 << 20) // max(1, len(y) * words))
            for at in range(0, len(x), step):
                i = x[at : at + step]
                apart = np.bitwise_count(par[i][:, None] ^ par[y][None]).sum(2, dtype=np.int64)
                ok = (apart * (num + den) <= (n[i][:, None].astype(np.int64) + n[y]) * (den - num)) & (root[i][:, None] != root[y])
                u, v = np.nonzero(ok)
                found.append(np.stack([np.minimum(fp[i[u]], fp[y[v]]), np.maximum(fp[i[u]], fp[y[v]])], 1))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


def _block_pairs(now: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of lists, (sig, fp, n, length, root): each block of a list meets each other in a task of its own."""
    # lists that one component has taken over have nothing left to find
    mixed = now.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("sig")
    rows = now.join(mixed.hint("merge"), "sig", "left_semi").withColumn("blocks", F.ceil(F.col("length") / BLOCK).cast("int"))
    rows = rows.join(sets.select("fp", "parity").hint("merge"), "fp").withColumn("block", F.expr("pmod(xxhash64(fp), blocks)").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    # lists of one block share cells, so that a pair that meets in many of them comes out once or so; of longer ones each
    # pair of blocks is a cell, side by side: ranges of cells share the work out evenly
    n = max(1, -(-now.count() // BLOCK))
    shared = max(1, n // 8)
    cell = F.expr(f"CASE WHEN blocks = 1 THEN pmod(xxhash64(sig), {shared}) - {shared} ELSE pmod(xxhash64(sig), 1L << 31) * (1L << 31) + hi * (hi + 1L) DIV 2 + lo END")
    rows = rows.withColumn("cell", cell).select("sig", "fp", "n", "root", "parity", "block", "lo", "hi", "cell")
    return rows.repartitionByRange(n, "cell").groupBy("cell").applyInPandas(_in_blocks(num, den), "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) and whether they link, by their whole sets."""
    sets = sets.select("fp", "items")
    left = pairs.join(sets.toDF("a", "sa").hint("merge"), "a")
    both = left.join(sets.toDF("b", "sb").hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common * den >= (F.size("sa") + F.size("sb") - common) * num).alias("linked"))


def jaccard_links(docs: DataFrame, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows (row_key, id, n_shingles, fp), links (a, b) between fingerprints, and their components (node, root).

    docs: (row_key, id, text). The links join all sets that similarity joins, directly or over others; within a list of
    many sets, pairs that are already joined aren't looked at again.
    """
    spark = docs.sparkSession
    table, _ = materialize(_indexed_sets(docs), "jac-sets")
    shards = max(16, -(-table.count() * 300 // TASK_ENTRIES))
    payload = docs.select("text").mapInPandas(_deal(shards, num, den), _PAYLOAD)
    found, at_found = materialize(payload.groupBy("shard").applyInPandas(_index(num, den), _FOUND), "jac-found")
    # a unit gives up its longest lists, as far as its slack goes. All go by one order of lists: what either of two sets
    # gives up of the lists they meet in is then what one of them does
    lists = found.where("b is null")
    given, at_given = materialize(lists.groupBy("a", "band").agg(F.sum("weight").alias("given"), F.max("slack").alias("slack")), "jac-given")
    short, at_short = materialize(given.where("given > slack").select("a", "band"), "jac-short")
    lengths, at_lengths = materialize(lists.groupBy("sig").agg(F.count("*").alias("length")), "jac-lengths")
    kept = keyed_join(keyed_join(lists, short, ["a", "band"], "left_semi", 24), lengths, ["sig"], "inner", 24)
    order = Window.partitionBy("a", "band").orderBy(F.desc("length"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("sum", F.sum("weight").over(order)).where("sum > slack")
    open_, at_open = materialize(kept.select("sig", F.col("a").alias("fp"), F.col("na").alias("n"), "length").distinct(), "jac-lists")

    # similar sets agree in more segments than both can miss in empty ones and long lists
    met = found.where("b is not null").groupBy("a", "b", "band").agg(F.sum("weight").alias("met"), F.max("slack").alias("ra"), F.max("slack_b").alias("rb"))
    met = met.join(given.select("a", "band", F.col("given").alias("ga")), ["a", "band"], "left").join(given.select(F.col("a").alias("b"), "band", F.col("given").alias("gb")), ["b", "band"], "left")
    least = F.greatest(F.col("ra") - F.coalesce("ga", F.lit(0)), F.col("rb") - F.coalesce("gb", F.lit(0)))
    pairs, at_pairs = materialize(met.where(F.col("met") >= least).select("a", "b").distinct(), "jac-pairs")
    remove(spark, at_found, at_given, at_short, at_lengths)

    need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(open_.select("fp")).distinct()
    need, at_need = materialize(need, "jac-need")
    reps = table.where("fp is not null").groupBy("fp").agg(F.min("row_key").alias("row_key"))
    reps, at_reps = materialize(reps.join(need.hint("merge"), "fp", "left_semi").select("row_key"), "jac-reps")
    sets, at_sets = materialize(_candidate_sets(keyed_join(docs, reps, ["row_key"], "left_semi", 16)), "jac-items")
    if sets.count() > reps.count():  # the same row more than once
        old = at_sets
        sets, at_sets = materialize(sets.dropDuplicates(["fp"]), "jac-items")
        remove(spark, old)
    remove(spark, at_need, at_reps)

    near, at_near = materialize(_close(pairs, sets, num, den), "jac-near")
    # one pair of each set first; then those that aren't joined by these
    told, at_told = materialize(_verify(near.groupBy("a").agg(F.min("b").alias("b")), sets, num, den), "jac-told")

    def joined() -> tuple[DataFrame, str]:
        return materialize(components(told.where("linked").select("a", "b")), "jac-roots")

    def tell(fresh: DataFrame, *spent: str) -> None:
        nonlocal told, at_told
        old = at_told
        told, at_told = materialize(told.unionByName(_verify(fresh, sets, num, den)), "jac-told")
        remove(spark, old, *spent)

    roots, at_roots = joined()
    of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")).hint("merge")
    rest = near.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest, at_rest = materialize(rest.join(told.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "jac-rest")
    tell(rest, at_rest, at_near, at_pairs, at_roots)

    hubs_each, turn = 1, 0
    while True:
        roots, at_roots = joined()
        if turn > HUB_TURNS or not open_.take(1):
            break
        now = open_.join(roots.toDF("fp", "root").hint("merge"), "fp", "left").select("sig", "fp", "n", "length", F.coalesce("root", "fp").alias("root"))
        now, at_now = materialize(now, "jac-now")
        if turn == HUB_TURNS:
            fresh = _block_pairs(now, sets, num, den)
            fresh, at_fresh = materialize(fresh.join(told.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "jac-fresh")
            tell(fresh, at_fresh, at_now, at_roots)
            turn += 1
            continue
        # in each list that more than one component meets in, some sets by a common order, so that lists share them
        picks = [F.min(F.struct(F.xxhash64("fp", F.lit(turn * 1000 + i)).alias("o"), "fp", "n", "root")) for i in range(hubs_each)]
        hubs = now.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.array_distinct(F.array(*picks)).alias("hubs")).where("r1 < r2")
        hubs, at_hubs = materialize(hubs.select("sig", F.explode("hubs").alias("h")).select("sig", F.col("h.fp").alias("hub"), F.col("h.n").alias("hn"), F.col("h.root").alias("hroot")), "jac-hubs")
        if not hubs.take(1):
            remove(spark, at_now, at_hubs)
            break
        fits = (F.col("root") != F.col("hroot")) & (F.least("n", "hn") * den >= F.greatest("n", "hn") * num)
        fresh = now.join(hubs.hint("merge"), "sig").where(fits).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
        fresh, at_fresh = materialize(fresh.join(told.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "jac-fresh")
        close, at_close = materialize(_close(fresh, sets, num, den), "jac-close")
        # a list goes on without its hubs, which have now been held against all others of it
        still = now.join(hubs.select("sig").distinct().hint("merge"), "sig", "left_semi").select("sig", "fp", "n", "length")
        old = at_open
        open_, at_open = materialize(still.join(hubs.select("sig", F.col("hub").alias("fp")).hint("merge"), ["sig", "fp"], "left_anti"), "jac-lists")
        tell(close, at_close, at_fresh, at_hubs, at_now, old, at_roots)
        hubs_each, turn = hubs_each * 2, turn + 1
    remove(spark, at_open, at_sets)
    links = told.where("linked").select("a", "b")
    return table, links, roots


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """(row_key, id, n_shingles, component_id, keep_key) of every row: groups of rows whose 5-word shingle sets link directly or over others.

    Sets link when den * intersection >= num * union, exactly. Similar sets differ in few shingles; shingles are hashed
    to more segments than that, by band of set size, so that two similar sets agree in a whole segment, or in one but
    for a single deletion. Signatures of segments are indexed in shards. Sets give up their most crowded segments as far
    as they can do without; what is left of them is held against a few hubs and then compared in blocks. Candidates whose
    parities already differ in too much go; all others are verified on whole sets.

    Null texts and texts without words have empty sets, which link with nothing. Equal sets are one class. component_id
    is the smallest id reachable; null ids are ignored by it (null if there is no other), and repeated rows are members
    of one class. keep_key is the row_key of the group's first row by id (null last) and row_key. An empty table gives an
    empty one. Extra columns are ignored.
    """
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table, _, roots = jaccard_links(rows, num, den)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key"))
    least = table.where("fp is not null").groupBy("fp").agg(first.alias("first"), F.count("*").alias("n"))
    least, _ = materialize(least.join(roots.toDF("fp", "root").hint("merge"), "fp", "left").where("n > 1 or root is not null"), "jac-least")
    by_root = least.where("root is not null").groupBy("root").agg(F.min("first").alias("of_root"))
    named = least.join(by_root, "root", "left").select("fp", F.coalesce("of_root", "first").alias("first"))
    named, _ = materialize(named.select("fp", F.col("first.id").alias("component"), F.col("first.row_key").alias("keep_key")), "jac-named")
    out = keyed_join(table, named, ["fp"], "left", 32)
    return out.select("row_key", "id", "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce("keep_key", "row_key").alias("keep_key"))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs that similarity joins: the first by id (null last), then by a hash of id and text.

    Of repeated rows (same id and text) one stays, whichever its other columns. Rows with null text or without words are
    groups of their own and stay, all of them. Columns are those of docs, whatever their names; an empty table gives an
    empty one.
    """
    groups, _ = materialize(jaccard_groups(docs, id_col, text_col).where("n_shingles > 0").select("row_key", "keep_key"), "jac-groups")
    gone, _ = materialize(groups.where("row_key <> keep_key").select("row_key").distinct(), "jac-gone")
    again, _ = materialize(groups.where("row_key = keep_key").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "jac-again")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), row_key(id_col, text_col).alias("row_key"))
    out = keyed_join(rows, gone, ["row_key"], "left_anti", 16)
    if again.take(1):
        more = keyed_join(out, again, ["row_key"], "left_semi", 16).groupBy("row_key").agg(F.first("whole").alias("whole")).select("whole", "row_key")
        out = keyed_join(out, again, ["row_key"], "left_anti", 16).unionByName(more)
    return out.select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
