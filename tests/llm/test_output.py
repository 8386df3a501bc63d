import hashlib
import zlib
from collections import Counter

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillspark.llm import packing, token_store, warc
from quillspark.llm.tokens import Encoder, default_tokenizer


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "tok"):
        library.tok = Tokenizer.from_file(default_tokenizer())
    return library.tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzé.,'!? \n\tAÉ0½²_-\x1ćΣİßК<|>", max_size=60))
def test_encoder_equals_library(text):
    if not hasattr(test_encoder_equals_library, "enc"):
        test_encoder_equals_library.enc = Encoder(default_tokenizer())
    for t in (text, text + "<|endoftext|> don't. we're,", "Abc. Def, ghi.\nJkl " + text):
        assert test_encoder_equals_library.enc.encode([t])[0].tolist() == library(t)


def test_encoder_forgets_and_learns_again(monkeypatch):
    """Many distinct words over several blocks and generations of the memo."""
    from quillspark.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 400)
    enc = Encoder(default_tokenizer())
    texts = [None, "", " ", *(f" word{i % 97}. Été{i % 31}, {'x' * (i % 7)}a&&& don't\xa0b{i}  " for i in range(600))]
    assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]
    assert len(enc.young) < 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=80))
def test_elias_fano(gaps):
    values = np.cumsum(gaps, dtype=np.int64)
    ef = token_store.EliasFano.encode(values, int(values[-1]) if len(values) else 0)
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_token_store(spark, docs, doc_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_IDS", 3000)
    out = f"file://{tmp_path}/t"
    token_store.write_tokens(docs, out, partitions=3)
    got = sorted(token_store.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == [r["id"] for r in sorted(got, key=lambda r: (r["id"] is not None, r["id"] or 0))]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [(r[0], np.array([*library(r[1]), 1], "<u4")) for r in doc_rows]
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    f = token_store.TokenFile(next(x for x in (tmp_path / "t").glob("part-*") if x.stat().st_size).read_bytes())
    assert np.concatenate([f.document(i) for i in range(f.n_docs)]).tolist() == f.ids.tolist()


def test_token_store_of_nothing(spark, empty, tmp_path):
    token_store.write_tokens(empty, f"file://{tmp_path}/t")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/t").collect() == []


def check_packing(rows, doc_rows, cap):
    want = Counter()
    for r in doc_rows:
        x = np.array([*library(r[1]), 0], "<u4")
        for p, s in enumerate(range(0, len(x), cap)):
            want[(r[0], p, s, len(x[s : s + cap]), zlib.crc32(x[s : s + cap].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    at: dict[int, list] = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= cap
    return len(at)


def test_long_elias_fano():
    """Several samples of select; ids over the whole range of a long."""
    values = np.cumsum(np.random.default_rng(0).integers(0, 40, 5000), dtype=np.int64)
    ef = token_store.EliasFano.encode(values, int(values[-1]))
    again, _ = token_store.EliasFano.load(b"xx" + ef.dump(), 2)
    assert len(ef.before) > 1 and [again.select(i) for i in range(5000)] == values.tolist()
    names = [None, None, -(1 << 63), -5, 0, 0, 7, (1 << 63) - 1]
    f = token_store.TokenFile(token_store.pack_file(names, [np.arange(3, dtype="<u2")] * 8, np.dtype("<u2")))
    assert [f.name(i) for i in range(8)] == names


def test_packing(docs, doc_rows, empty):
    rows = packing.pack_documents(docs, cap=128).collect()
    n = check_packing(rows, doc_rows, 128)
    assert n <= -(-sum(r["length"] for r in rows) // 128) + 1
    assert packing.pack_documents(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_histogram_is_packed_whole(counts):
    out = packing.pack_histogram(counts, 40)
    got: Counter = Counter()
    for k, lengths in out:
        assert sum(lengths) <= 40
        for s in lengths:
            got[s] += k
    assert got == Counter(counts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_packing_is_optimal_when_small(sizes):
    """Against every way to put the pieces into bins."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, 20 - sizes[i]])

    sizes.sort(reverse=True)
    go(0, [])
    counts = Counter(sizes)
    assert sum(k for k, _ in packing.pack_histogram(counts, 20)) == best[0]
    assert packing.lower_bound(counts, 20) <= best[0] <= sum(k for k, _ in packing.best_fit(counts, 20))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.one_of(st.integers(1, 12), st.integers(1, 2048)), st.integers(1, 6000), max_size=12))
@example({1: 5000})
@example({8: 1000})
@example({9: 3000})
@example({10: 1000, 3: 50})
def test_histogram_at_the_real_cap(counts):
    """Any number of short pieces: packed whole, near the bound."""
    out = packing.pack_histogram(counts, 2048, work=20_000)
    got: Counter = Counter()
    for k, lengths in out:
        assert sum(lengths) <= 2048
        for s, n in Counter(lengths).items():
            got[s] += k * n
    assert got == Counter(counts)
    assert packing.lower_bound(counts, 2048) <= sum(k for k, _ in out) <= packing.lower_bound(counts, 2048) * 11 / 9 + 1


def test_dominated_fillings_stay_out():
    fills = dict((f, w) for w, f in packing.completions({6: 1, 5: 2, 4: 1, 3: 1, 2: 1, 1: 1}, 10, 10, [10_000]))
    assert ((6, 1), (4, 1)) in fills
    # five and five do what no other filling does; three, two and five give way to five and five
    assert ((5, 2),) in fills and ((5, 1), (3, 1), (2, 1)) not in fills
    assert all(w == 10 - sum(s * n for s, n in f) for f, w in fills.items())


def test_many_empty_documents(spark):
    rows = [(i, None if i % 2 else "") for i in range(5000)] + [(5000 + i, "a b c") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert check_packing(packing.pack_documents(table).collect(), rows, 2048) == -(-(5000 + 300 * 4) // 2048)


def test_bin_completion_finds_perfect_bins():
    assert sum(k for k, _ in packing.pack_histogram({6: 10, 4: 10, 5: 4, 3: 6, 2: 6}, 10)) == 15


PAGES = [(i, f"http://x/{i}", f"<p>{i % 7} {'body ' * (i % 7 * 10)}</p>") for i in range(60)] + [(60, None, None), (61, "u\r\nX: y", ""), (62, "ü", "é" * 60), (63, "z", "é" * 60), (None, "n", "é" * 60), (64, "l", "long " * 60_000), (5, "again", "<p>5 " + "body " * 50 + "</p>")]


def test_warc(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    out = f"file://{tmp_path}/w"
    warc.write_warc(table, out)
    got = warc.read_warc(spark, out, payloads=True).collect()
    first: dict = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        back = len(b) >= 100 and i != first[h or ""]
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if back else "response", first[h or ""] if back else None, b"" if back else b)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == want
    assert not any("\r" in (r["url"] or "") for r in got)


def test_warc_dictionary_leads(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><head><title>Page {i}</title></head><body class='main'>{'word%d ' % (i % 13) * 40}{hashlib.md5(str(i).encode()).hexdigest()}</body></html>") for i in range(600)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    warc.write_warc(table, out)
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert sum(1 for _ in warc.read_archive(data)) and warc.read_warc(spark, out).count() == 600


def test_warc_of_nothing(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").collect() == []
