import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillspark.llm import exact_dedup, jaccard_join, line_dedup, vector_dedup
from quillspark.llm import components as comp
from quillspark.llm.components import components, contract

UP = {i: i + 32 for i in range(65, 91)}


def low(t):
    return (t or "").translate(UP)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, docs_path, doc_rows, bits):
    """With four bits of digest nearly all texts collide and only their bytes tell them apart."""
    groups = defaultdict(list)
    for r in doc_rows:
        groups[low(r[1])].append(r[0])
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((r[0], keep[low(r[1])], len(groups[low(r[1])]), r[0] == keep[low(r[1])], hashlib.sha256(low(r[1]).encode()).hexdigest()) for r in doc_rows)
    got = exact_dedup.exact_dedup(spark, docs_path, digest_bits=bits).collect()
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_goes_on(spark, tmp_path):
    path, state = str(tmp_path / "d"), f"file://{tmp_path}/state"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    one.write.parquet(path)
    exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()
    spark.createDataFrame([(3, "A"), (4, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_dedup_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "e"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e")).collect() == []


def brute_lines(rows, least=20, docs=3):
    white = " \t\n\r\x0b\x0c"
    keys = [[low(x.strip(white)) for x in (r[1] or "").split("\n")] for r in rows]
    held = defaultdict(list)
    for r, ks in zip(rows, keys):
        for k in set(ks):
            held[k].append(-1 if r[0] is None else r[0])
    out = []
    for r, ks in zip(rows, keys):
        gone = [len(k) >= least and len(held[k]) >= docs and (-1 if r[0] is None else r[0]) != max(held[k]) for k in ks]
        out.append((r[0], len(ks), sum(gone), "\n".join(x for x, g in zip((r[1] or "").split("\n"), gone) if not g)))
    return Counter(out)


def test_line_dedup(docs, doc_rows):
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(doc_rows)


def test_line_dedup_with_full_filters(docs, doc_rows, monkeypatch):
    """Filters too small to tell anything send every line to confirmation."""
    monkeypatch.setattr(line_dedup, "MAX_BITS", 8)
    got = line_dedup.line_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(doc_rows)


def test_line_dedup_by_a_tree_of_filters(docs, doc_rows, monkeypatch):
    """Filters filled in many parts and merged lose no repeated line."""
    monkeypatch.setattr(line_dedup, "PART_LINES", 1)
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    got = line_dedup.line_dedup(docs.repartition(8)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(doc_rows)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.line_dedup(empty).collect() == []


def brute_groups(rows, num=80, den=100):
    sets = []
    for r in rows:
        w = [x.lower() for x in (r[1] or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and n * den >= (len(sets[i]) + len(sets[j]) - n) * num:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            members[find(i)].append(r[0])
    return Counter((r[0], len(s), min(members[find(i)], default=None)) for i, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard_groups(docs, doc_rows):
    got = jaccard_join.jaccard_groups(docs).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(doc_rows)


@pytest.mark.parametrize("hub_turns", [0, 2])
def test_jaccard_long_lists(spark, monkeypatch, hub_turns):
    """Chains of near copies and a passage that many share, with lists so short that most go by hubs or blocks."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 3)
    monkeypatch.setattr(jaccard_join, "HUB_TURNS", hub_turns)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(30)]
    rows, text = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        text = list(text)
        text[rng.integers(120)] = f"z{i}"
        rows.append((100 + i, " ".join(text)))
    for i in range(40):
        own = [f"o{i}_{k}" for k in range(int(rng.integers(5, 40)))]
        rows.append((300 + i, " ".join(own + passage)))
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_groups(empty).collect() == []


def test_parities_differ_in_no_more():
    rng = np.random.default_rng(5)
    for n in (1, 5, 31, 32, 33, 64, 65, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for gone in {0, n // 10, n // 2, n}:
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)]))
            if len(b):
                x, y = jaccard_join.parities(a), jaccard_join.parities(b)
                words = min(len(x), len(y))
                both = jaccard_join.folded(x, words) ^ jaccard_join.folded(y, words)
                assert np.bitwise_count(both.view(np.uint64)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_find_all_pairs(blocks):
    """Blocks lose no pair of similar sets in different components, near the limit too."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 140).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in rng.integers(0, 20, 60)]
    block, root = np.arange(60) % blocks, np.arange(60) // 2
    rows = [(1, lo, hi, block[i], i, len(sets[i]), root[i], jaccard_join.parities(sets[i])) for lo in range(blocks) for hi in range(lo, blocks) for i in range(60) if block[i] in (lo, hi)]
    got = {tuple(r) for r in jaccard_join._in_blocks(80, 100)(pd.DataFrame(rows, columns=["sig", "lo", "hi", "block", "fp", "n", "root", "parity"])).to_numpy().tolist()}
    for j in range(60):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert ((i, j) in got) == (root[i] != root[j])


def test_signatures_meet():
    """Whatever similar sets differ in, they share a signature in some band."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(4, 400))).astype(np.uint64))
        k = int(rng.integers(0, len(a) // 4 + 2))
        gone = int(rng.integers(0, k + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, k - gone).astype(np.uint64)]))
        n = len(np.intersect1d(a, b))
        if 100 * n < 80 * (len(a) + len(b) - n) or np.array_equal(a, b):
            continue
        who, _, _, sig, unit, _ = jaccard_join.signatures([a, b], 80, 100)
        own = who[unit]
        assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_vector_dedup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        v = rng.normal(size=16)
        if i % 3 and i > 2:
            v = np.array(rows[i - 1][1]) + rng.normal(size=16) * 0.1
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 7 else None))
    rows += [(2000 + i, rows[1][1], rows[1][2]) for i in range(4)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1), (3004, [], 1), (3005, [float("inf")] * 16, 1), (3006, [1.0, 2.0], 1), (None, rows[1][1], rows[1][2])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("extra", "extra")
    got = {r["id"]: r for r in vector_dedup.vector_dedup(table).collect() if r["id"] is not None}
    good = [r for r in rows if r[0] is not None and r[2] is not None and (r[0] < 3000)]
    x = np.stack([np.array(r[1], np.float32).astype(float) for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.93) & (same[:, None] == same)
    np.fill_diagonal(link, False)
    true, found = link.sum(), sum(r["n_links"] for r in got.values())
    assert true and 0.9 * true <= found <= true
    for r, n in zip(good, link.sum(1)):
        assert got[r[0]]["n_links"] <= n
    for i in range(3000, 3007):
        assert tuple(got[i]) == (i, 0, i, True)
    assert len({got[i]["component_id"] for i in (1, 2000, 2001, 2002, 2003)}) == 1 and got[2000]["n_links"] >= 4


@pytest.mark.parametrize("block", [1024, 50])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Every link of a group far larger than a leaf is counted, in one block or many, and columns may clash."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "TOP_ROWS", 100)
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    x = np.concatenate([base + rng.normal(size=(500, 24)) * rng.uniform(0.02, 0.3, (500, 1)), rng.normal(size=(300, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), 1, 5, 6, 7, 8) for i, v in enumerate(x)]
    got = {r["id"]: r for r in vector_dedup.vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, rep int, n int, root int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    true, found = link.sum(1), np.array([got[i]["n_links"] for i in range(800)])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()


def test_vector_dedup_of_nothing(spark):
    assert vector_dedup.vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and all(got[600 + i] == 500 for i in range(50))


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_components_of_random_graphs(spark, monkeypatch, most):
    """Stars and contraction agree with a search from node to node, in one task and where edges are dealt to many chunks."""
    monkeypatch.setattr("quillspark.llm.components.TASK_EDGES", most)
    rng = np.random.default_rng(most)
    links = [tuple(int(x) for x in p) for p in rng.integers(-300, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(None, 5), (6, None)]
    near = defaultdict(set)
    for x, y in links:
        if x is not None and y is not None and x != y:
            near[x].add(y)
            near[y].add(x)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_contract():
    """A path whose middle is its greatest node, and two paths apart, become stars around their least nodes."""
    u, v = (np.array(x) for x in ([9, 9, 5, 30], [1, 5, 2, 31]))
    x, y = contract(u, v)
    assert dict(zip(x.tolist(), y.tolist())) == {9: 1, 5: 1, 2: 1, 31: 30}


def test_contract_in_chunks(monkeypatch):
    """A task with more edges than it contracts at a time gives stars of each chunk, which keep what was joined."""
    monkeypatch.setattr(comp, "TASK_EDGES", 4)
    batch = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    parts = [batch([2, 3], [1, 2]), batch([], []), batch([5, 6, 7], [3, 5, 6]), batch([9], [7])]
    got = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in comp._contract_batches(iter(parts))]
    assert got == [([2, 3, 5, 6, 7], [1] * 5), ([9], [7])]
    assert list(comp._contract_batches(iter([]))) == []
