"""Queries over whole tables: small tables where a cut of texts, rows or weights would show."""

import hashlib
import itertools
from collections import Counter

import pytest

from quillspark import catalog
from tests.compare import differences

FILL = "filler " * 40


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    texts = ["Alpha Beta heating x", "fiction of consolidation", "fiction NATO heating", "consolidation by Alpha Beta", "NATO. Ratio 42 holds here.", "consolidating"]
    rows = [(i, f"{FILL}{t} heavy weight", "en" if i % 3 else "fr", f"src{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def bags():
    """Entities of each text by hand: words with typical endings, phrases of capitals and acronyms, past any prefix."""
    return [{"Alpha Beta", "heating"}, {"fiction", "consolidation"}, {"fiction", "NATO", "heating"}, {"consolidation", "Alpha Beta"}, {"NATO"}, {"consolidating"}]


@pytest.fixture(scope="module")
def small_con(small):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", "cooccurrence node_statistics graph_density k_hop pagerank modularity global_topics sparsified_affinity bridge_concepts".split())
def test_graph_queries_take_whole_texts(spark, small, small_con, name):
    assert not differences(catalog.QUERIES[name](spark, small), small_con, catalog.SQL[name])


def test_rare_pairs_by_hand(spark, small):
    want = Counter(p for b in bags() for p in itertools.combinations(sorted(b), 2))
    got = {(r["e1"], r["e2"]): r["weight"] for r in catalog.QUERIES["cooccurrence"](spark, small).collect()}
    assert got == dict(want)


def test_communities_and_names_take_whole_texts(spark, small):
    nodes = set().union(*(b for b in bags() if len(b) > 1))
    assert {r["node"] for r in catalog.QUERIES["louvain"](spark, small).collect()} == nodes
    assert catalog.QUERIES["map_layout"](spark, small).count() > 0
    pairs = {(r["a"], r["b"]) for r in catalog.QUERIES["fuzzy_merge"](spark, small).collect()}
    assert pairs == {("consolidating unit", "consolidation unit")}


@pytest.mark.parametrize("name", ["parents", "context_blocks"])
def test_passages_take_whole_texts(spark, small, small_con, name):
    assert not differences(catalog.QUERIES[name](spark, small), small_con, catalog.SQL[name])


def test_parents_are_cut_once_joined(spark, tmp_path):
    texts = ["x" * 1500, "y" * 1500]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    row = catalog.QUERIES["parents"](spark, str(tmp_path)).first()
    assert row["text_md5"] == hashlib.md5("\n".join(texts)[:1800].encode()).hexdigest()


def test_components_take_all_orders(spark, tmp_path):
    orders = [(1, 8), (2, 9), (3, 15), (4, 20), (5, 14), (6, 33), (7, 28), (8, None), (9, 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    edges = [(c, c - c % 7) for _, c in orders if c is not None]
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = {r["node"]: r["component"] for r in catalog.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == label


def test_sentence_support_takes_all_documents_and_references(spark, tmp_path):
    import duckdb

    d = str(tmp_path)
    docs = [
        (0, "The copper kettle boils water quickly. Purple owls negotiate treaties."),
        (1, "The copper kettle boils 7 litres quickly. The copper kettle boils 9 litres quickly."),
        (2, "Copper lanterns guard northern rivers tonight. Kettle boiled quickly."),
        (3, "It is not known. The lanterns guard northern valleys beyond mountains."),
    ]
    items = [(0, "nothing alike"), (1, "other words"), (2, "still others"), (3, "A copper kettle boils water quickly, 7 litres at once"), (4, "lanterns guard rivers"), (5, "northern skies tonight")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df = catalog.QUERIES["sentence_support"](spark, d)
    assert {r["doc_id"]: (r["n"], r["supported"]) for r in df.collect()} == {0: (2, 1), 1: (2, 1), 2: (2, 2), 3: (2, 0)}
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    assert not differences(df, c, catalog.SQL["sentence_support"])


ACRONYMS = ["Gradient Boosted Trees (GBT) rule.", "We use Support Vector Machines (SVM) and Principal-Component Analysis (PCA).", "Not Matching Words (XYZ).", "Later, Generic Boosting Tool (GBT)."]


def test_acronyms_come_from_documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ACRONYMS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["acronym"]: r["expansion"] for r in catalog.QUERIES["acronym_aliases"](spark, str(tmp_path)).collect()}
    assert got == {"gbt": "generic boosting tool", "pca": "principal-component analysi", "svm": "we use support vector machine"}
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not differences(catalog.QUERIES["acronym_aliases"](spark, str(tmp_path)), c, catalog.SQL["acronym_aliases"])
    spark.createDataFrame([(0, "Ordinary Least Squares (OLS)")], "doc_id long, text string").write.parquet(f"{tmp_path}/o/documents.parquet")
    assert [tuple(r) for r in catalog.QUERIES["acronym_aliases"](spark, f"{tmp_path}/o").collect()] == [("ols", "ordinary least square")]
