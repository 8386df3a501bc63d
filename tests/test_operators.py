import io
import math
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import concepts as C
from quillspark.operators import graph as G
from quillspark.operators import layout as L
from quillspark.operators import passages as P
from quillspark.operators import retrieval as R
from quillspark.operators import segment as S
from quillspark.operators import verify as V
from quillspark.plans import concept_map, ingest, locks, qa
from quillspark.sources import parsers, stores
from quillspark.streaming import logs


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.content_tokens(c), t="The quick, quick Fox and a cat's 42nd toy") == ["quick", "quick", "fox", "cat", "42nd", "toy"]
    assert one(spark, T.normalize(c), t=" “A” –  B’s\n") == "\"a\" - b's"
    assert [one(spark, T.normalize_key(c), t=x) for x in ("The Neural Networks!", "a  Glass", "Été", "bus")] == ["neural network", "glass", "été", "bus"]
    assert [one(spark, T.light_stem(c), t=x) for x in ("running", "studies", "boxes", "played", "ring", "cats", "sadly")] == ["runn", "study", "box", "play", "ring", "cat", "sad"]
    assert one(spark, T.sanitize_answer(c), t="<think>x\ny</think>Answer: ```py\nHi <b>you</b>```\n\n\n\nEnd") == "Hi you\n\nEnd"
    assert one(spark, T.sanitize_markdown(c), t="* **a** [b](http://c) ![d](e) https://f.g") == "- a b"
    assert one(spark, T.strip_citations(c), t="One [1.2]  two [a_b].") == "One two."
    assert one(spark, T.sentences_chunker(c), t="Short. This one is long enough! And so is this?") == ["This one is long enough!", "And so is this?"]
    assert one(spark, T.sentences_qa(c), t="Heading\nlow x\nA whole sentence here. Then (another) one follows.") == ["Heading", "A whole sentence here.", "Then (another) one follows."]
    assert one(spark, T.truncate_at_boundary(c, 30, 5), t="One two. Three four. Five six seven") == "One two. Three four."
    assert one(spark, T.script_safe(c), t="<a>&\u2028") == "\\u003ca\\u003e\\u0026\\u2028"
    assert one(spark, T.source_type(c), t="a.b.Pdf") == "PDF" and one(spark, T.source_type(c), t="none") == "DOC"
    assert one(spark, T.is_grounded(c, F.col("x")), t="Neural Network", x="a neural net and network") and not one(spark, T.is_grounded(c, F.col("x")), t="model", x="model")
    assert one(spark, T.evidence_sentence(F.col("x"), c, F.lit("pear")), t="apple", x="No. An apple. An apple and a pear. Pear.") == "An apple and a pear."
    assert one(spark, T.ordered_distinct(c, 5, 2), t=["Abc", "abc", "", "de", "f"]) == ["Abc", "de"]
    assert one(spark, T.coverage(c, F.col("w")), t=["a", "b"], w=["b", "c", "c"]) == 0.5


def test_markdown_and_text_sections(spark):
    files = spark.createDataFrame([("a.md", "# One\nbody\n## Empty\n### Two words\nmore\n"), ("b.md", "intro\n# X\ny")], "name string, content string")
    got = sorted((r["source_file"], r["page_or_slide"], r["heading"], r["content"]) for r in S.sections_markdown(files).collect())
    assert got == [("a.md", 2, "One", "body"), ("a.md", 4, "Two words", "more"), ("b.md", 1, "Section 1", "intro"), ("b.md", 2, "X", "y")]
    txt = spark.createDataFrame([("c.txt", "a\n\n\n \n\nb\nc")], "name string, content string")
    assert [(r["heading"], r["content"]) for r in S.sections_txt(txt).collect()] == [("Section 1", "a"), ("Section 2", "b\nc")]


def mirror_chunks(ds, n):
    if n <= 2:
        return []
    m = sum(ds) / len(ds)
    limit, cuts, at = m + math.sqrt(sum((d - m) ** 2 for d in ds) / len(ds)), [], 0
    for i, d in enumerate(ds):
        if (d > limit and i + 1 - at >= 2) or i + 1 - at >= 15:
            cuts.append(i + 1)
            at = i + 1
    return cuts


@pytest.mark.parametrize("n", [1, 2, 3, 16, 31, 60])
def test_cut_points(spark, n):
    rng = random.Random(n)
    ds = [round(rng.random(), 3) for _ in range(n - 1)]
    row = spark.createDataFrame([(ds, n)], "ds array<double>, n int").select(S.cut_points(F.col("ds"), F.col("n")).alias("c")).first()
    assert row["c"] == mirror_chunks(ds, n)


def test_chunks_cover_all(spark):
    text = " ".join(f"Sentence {i} speaks of topic{i // 4} and thing{i // 4}." for i in range(40))
    out = S.semantic_chunks(spark.createDataFrame([(1, text), (2, ""), (3, "Only one sentence here.")], "k int, content string"), ["k"]).collect()
    spans = sorted((r["start"], r["end"]) for r in out if r["k"] == 1)
    assert spans[0][0] == 0 and spans[-1][1] == 40 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and all(b - a <= 15 for a, b in spans)
    assert [r["text"] for r in out if r["k"] == 3] == ["Only one sentence here."] and not [r for r in out if r["k"] == 2]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, ""), (4, "the and")], "id long, t string")
    asked = spark.createDataFrame([(1, "apple pear pear unknown")], "query_id long, query string")
    got = {r["id"]: r["score"] for r in R.bm25(docs, asked, "id", F.col("t")).collect()}
    mean = 5 / 4
    w = lambda tf, dl, df: math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert got.keys() == {1, 2} and math.isclose(got[1], w(2, 3, 1) + 2 * w(1, 3, 2)) and math.isclose(got[2], 2 * w(1, 2, 2))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(20, 120))
def test_best_span(lens, most):
    s = ["x" * n for n in lens]
    score = [round(1 - 0.5 * i / len(s), 4) for i in range(len(s))]
    fits = [(round(sum(score[a:b]), 6), -a, -b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if sum(lens[a:b]) <= most]
    want = (0, 1) if not fits else (-max(fits)[1], -max(fits)[2])
    assert P.best_span(s, most)[:2] == want


def test_context_and_budget(spark):
    assert one(spark, P.context_block(F.lit("f.pdf"), F.lit(3), F.col("h"), F.lit("b")), h="Page 3") == "[Source: f.pdf | Page 3]\nb"
    assert one(spark, P.context_block(F.lit("f.pdf"), F.lit(3), F.col("h"), F.lit("b")), h="Intro") == "[Source: f.pdf | Page 3 | Section: Intro]\nb"
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([9000, 10, 10])] + [(2, i, n) for i, n in enumerate([3000, 3000, 3000, 1])], "question_id int, pid int, n int")
    assert sorted((r[0], r[1]) for r in P.within_budget(rows, 7000, "pid", F.col("n")).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_claims(spark):
    rows = spark.createDataFrame([([("alpha beta gamma", ["1.1"]), ("delta epsilon", ["1.2"]), ("Alphas beta gamma", ["2.1"])],)], "c array<struct<text:string,support:array<string>>>")
    got = rows.select(V.dedupe_claims(F.col("c")).alias("x")).first()["x"]
    assert [(r["text"], r["support"]) for r in got] == [("alpha beta gamma", ["1.1", "2.1"]), ("delta epsilon", ["1.2"])]
    assert V.blocks("## A title that has far too many words\ntext\nmore\n\n- point\n1. other") == [("heading", "### A title that has far too"), ("paragraph", "text more"), ("bullet", "point"), ("bullet", "other")]
    text = "## A title that has far too many words\ntext\r\nmore\n\n- point\n1. other\n* third\nend.\n# One:\n## Two\n### Three!\n#### Four\n#nospace\n##  \n\n\n2. \nlast"
    for t in (text, "", None, "plain", "- a\n- b", "# only"):
        got = spark.createDataFrame([(t,)], "t string").select(V.answer_blocks(F.col("t")).alias("b")).first()["b"]
        assert [(r["kind"], r["text"]) for r in got] == V.blocks(t), t
    assert [k for k, _ in V.blocks(text)].count("heading") == 3 and ("heading", "### Two") in V.blocks(text)
    assert V.drop_bare_headings([("heading", "a"), ("heading", "b"), ("paragraph", "c"), ("heading", "d")]) == [("paragraph", "c")]
    long = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
    assert V.polish(long + " Not so.", lambda s: "Not" not in s, 70, "fb") == (long, ["Not so."])
    assert V.polish("Too short.", lambda s: True, 70, "fb")[0] == "fb"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("x", "y", 1.0)], "u string, v string, w double")
    rank = {r["node"]: r["rank"] for r in G.pagerank(e, rounds=40).collect()}
    assert math.isclose(sum(rank.values()), 1, rel_tol=1e-9) and rank["b"] > rank["a"] > rank["c"]
    assert {r["node"]: r["component"] for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r["node"] for r in G.k_hop(e, "a", 1).collect()} == {"a", "b"} and not G.k_hop(e, "zz").collect()
    assert G.density(e).first()["density"] == pytest.approx(0.3)
    cliques = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "pqr" for i in range(4) for j in range(i)] + [("p0", "q0", 0.1), ("q1", "r1", 0.1), ("p0", "z", 0.2)]
    found = G.communities(spark.createDataFrame(cliques, "u string, v string, w double")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["community"], set()).add(r["node"][0])
    assert sorted(map(sorted, groups.values())) == [["p", "z"], ["q"], ["r"]]
    assert G.break_cycles([("a", "b", 2), ("b", "c", 1), ("c", "a", 3)]) == [("a", "b", 2), ("c", "a", 3)]
    forest = G.spanning_forest([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 0.5)])
    assert [x[:2] for x in forest if x[3]] == [(0, 1), (1, 2), (3, 4)]


def test_layout():
    assert L.cap_members([10, 3, 8], 12) == [4, 3, 5] or sum(L.cap_members([10, 3, 8], 12)) == 12
    for n in (0, 1, 5, 40):
        assert len(L.ring_slots(n)) == n
    halos = [120.0, 200.0, 150.0, 90.0]
    xy = L.place_clusters(halos, [(0, 1, 3.0), (1, 2, 1.0)])
    for halos, links in ((halos, [(0, 1, 3.0), (1, 2, 1.0)]), (halos * 6, []), (halos * 6, [(i, i + 1, 1.0 + i) for i in range(23)]), ([100.0] * 40, [(0, i, 5.0) for i in range(1, 40)])):
        xy = L.place_clusters(halos, links)
        for i in range(len(halos)):
            for j in range(i):
                assert math.hypot(*(xy[i] - xy[j])) >= halos[i] + halos[j] + L.HALO_GAP - 1e-6


def test_concepts(spark):
    keys = spark.createDataFrame([(k,) for k in ("event bus", "event buss", "order", "order system", "core order", "event")], "key string")
    pairs = C.fuzzy_pairs(keys).select("a", "b").union(C.affix_pairs(keys))
    canon = {r["key"]: r["canon"] for r in C.canonical(keys, pairs).collect()}
    assert canon["event buss"] == canon["event bus"] == "event bus" and canon["order system"] == canon["core order"] == canon["order"] and canon["event"] == "event"
    rels = spark.createDataFrame([("a", "type_of", "b", 3), ("b", "part_of", "a", 2), ("c", "type_of", "d", 1), ("d", "type_of", "c", 1), ("a", "uses", "b", 1)], "source_key string, relation string, target_key string, support long")
    assert {(r[0], r[1]) for r in C.settle_directions(rels).collect()} == {("a", "type_of"), ("a", "uses")}


def test_aliases_join_concepts(spark):
    kind = lambda *names: [(n, "component") for n in names]
    rows = [
        ("c0", 0, "f", kind("Ordinary Least Squares", "Residual"), [("Ordinary Least Squares", "uses", "Residual", "e")]),
        ("c1", 1, "f", kind("OLS", "Variance"), [("OLS", "uses", "Variance", "e"), ("PCA", "uses", "Variance", "e")]),
        ("c2", 2, "f", kind("Principal Component Analysis", "Zebra"), []),
    ]
    ext = spark.createDataFrame(rows, "chunk_id string, seq long, source_file string, concepts array<struct<name:string,kind:string>>, relations array<struct<source:string,relation:string,target:string,evidence:string>>")
    texts = spark.createDataFrame([(0, "Ordinary Least Squares (OLS) and Principal Component Analysis (PCA)."), (1, None), (2, "Not Known Here (NKH)")], "seq long, text string")
    aliases = S.acronym_aliases(texts, "text", "seq")
    cs, rels = concept_map.consolidate(ext, aliases=aliases)
    # keys lose one last s beyond three letters
    pca = "principal component analysi"
    assert {r["canon"]: r["support"] for r in cs.collect()} == {"ols": 2, "residual": 1, "variance": 1, pca: 1, "zebra": 1}
    ends = {(r["source_key"], r["target_key"]) for r in rels.collect()}
    assert ends == {("ols", "residual"), ("ols", "variance"), (pca, "variance")}
    plain, _ = concept_map.consolidate(ext)
    assert plain.count() == 6 and concept_map.consolidate(ext, aliases=aliases.limit(0))[0].count() == 6
    pairs = spark.createDataFrame([("ols", "ordinary least square", 0.9), ("x", "y", 0.9), ("pca", pca, 0.8), ("x", "z", 0.8)], "a string, b string, cosine double")
    got = {(r["a"], r["decision"]) for r in C.vector_pairs(pairs, aliases=aliases).collect()}
    assert got == {("ols", "merged"), ("pca", "kept_separate")}


def pptx() -> bytes:
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda t, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    ns = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    rel = lambda i, t: f'<Relationships><Relationship Id="{i}" Target="{t}"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="x"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rel("x", "slides/slide1.xml"))
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {ns}>{shape("Title", "<p:ph type=\'title\'/>")}{shape("Body")}</p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rel("y", "../notesSlides/n1.xml"))
        z.writestr("ppt/notesSlides/n1.xml", f'<p:notes {ns}>{shape("Say this", "<p:ph type=\'body\'/>")}</p:notes>')
    return out.getvalue()


def test_files_to_answers(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "deck.pptx").write_bytes(pptx())
    (up / "bees.txt").write_text("Bees make honey in the hive. Honey is stored in wax cells. Wax is made by worker bees.\n\nForests hold carbon for many years.")
    (up / "n.md").write_text("# Rivers\nRivers carry water to the sea. Water flows downhill.")
    chunks = ingest.ingest(spark, str(up), str(tmp_path / "chunks"), "s1")
    assert {r["source_type"] for r in chunks.collect()} == {"PPTX", "TXT", "MD"}
    asked = spark.createDataFrame([(1, "Where is honey stored?"), (2, "zzz qqq")], "question_id long, question string")
    got = {r["question_id"]: r for r in qa.ask(chunks, asked).collect()}
    assert got[1]["status"] == "answered" and "wax cells" in got[1]["answer"] and "[Source: bees.txt" in got[1]["context"]
    assert got[2]["status"] == "not_found" and got[2]["answer"] is None
    with pytest.raises(Exception, match="Unsupported file type"):
        parsers.parse_files(spark.createDataFrame([("a.xyz", bytearray(b""))], "name string, content binary")).collect()


def test_sessions_and_logs(spark, tmp_path):
    s = stores.Sessions(spark, str(tmp_path))
    a, b = s.create("one"), s.create("two")
    s.update(a, chunk_count=5, is_processed=True)
    s.delete(b)
    assert [(r["session_id"], r["chunk_count"], r["is_processed"]) for r in s.list().collect()] == [(a, 5, True)]
    path = tmp_path / "answers.jsonl"
    path.write_text('{"id": "r1", "status": "ok", "claims": [{"text": "x", "support": ["1.1"]}]}\n\n{broken\n{"id": "r2"}\n')
    assert [r["id"] for r in stores.read_answers(spark, str(path)).collect()] == ["r1", "r2"]
    src, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    take = lambda rows: rows.select("id", F.upper("t").alias("t"))
    (src / "a.json").write_text('{"id": 1, "t": "x"}\n')
    logs.resume_extraction(spark, str(src), "id int, t string", out, at, take)
    (src / "b.json").write_text('{"id": 2, "t": "y"}\n')
    logs.resume_extraction(spark, str(src), "id int, t string", out, at, take)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "X"), (2, "Y")]


def test_lock(tmp_path):
    path = str(tmp_path / "l")
    with locks.lock(path):
        with pytest.raises(FileExistsError), locks.lock(path):
            pass
    (tmp_path / "l").write_text('{"pid": 999999999, "ts": 0}')
    with locks.lock(path):
        pass


def test_concept_map(spark):
    names = [f"{g} part {i}" for g in ("engine", "river", "market") for i in range(4)]
    rows = []
    for i in range(60):
        g = i % 3 * 4
        a, b = names[g + i % 4], names[g + (i + 1) % 4]
        rows.append((f"c{i}", i, f"f{i % 2}", [(a, "component"), (b, "component")], [(a, "part_of" if i % 2 else "uses", b, "e")]))
    ext = spark.createDataFrame(rows, "chunk_id string, seq long, source_file string, concepts array<struct<name:string,kind:string>>, relations array<struct<source:string,relation:string,target:string,evidence:string>>")
    # numbered parts are alike to the letter, so likeness would join them
    canon, rels = C.canonical, None
    try:
        C.canonical = lambda keys, pairs, key="key": keys.select(key).distinct().withColumn("canon", F.col(key))
        cs, rels = concept_map.consolidate(ext)
    finally:
        C.canonical = canon
    members, links, metrics = concept_map.clusters(cs, rels)
    m = metrics.first()
    assert m["n_clusters"] == 3 and m["n_concepts"] == 12 and concept_map.is_sufficient(cs, rels)
    kinds = {r["kind"] for r in concept_map.build_map(members, links).collect()}
    assert {"cluster", "member", "view"} <= kinds


def test_entities_keep_accented_words(spark):
    """Accented letters belong to words: nothing is torn, and no phrase begins or ends within a word."""
    text = "La función es Präsentation und Élément. Das Haus Überall Big Data. Größe Neue Welt; NASAé ESA identité moción"
    got = spark.createDataFrame([(text,)], "t string").select(S.entities(F.col("t")).alias("e")).first().e
    assert set(got) == {"Big Data", "Neue Welt", "Das Haus", "ESA", "präsentation", "élément"}
