"""Named queries over the fixture tables and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import concepts as C
from quillspark.operators import graph as G
from quillspark.operators import layout as L
from quillspark.operators import passages as P
from quillspark.operators import retrieval as R
from quillspark.operators import segment as S
from quillspark.operators import verify as VF
from quillspark.plans.lineage import cut, fresh_folder
from quillspark.sources.lexical_index import LexicalIndex
from quillspark.sources.vector_store import VectorStore
from quillspark.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Text tables up to that many bytes are dealt to all cores: they are often one row group, which one task reads.
SPREAD_BYTES = 256 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in ("documents", "pages", "conversations") and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


# --- SQL pieces ---------------------------------------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(T.STOPWORDS)}, w))"


def _stem(w: str) -> str:
    out = w
    for e in reversed(T.STEM_ENDINGS):
        cut = f"left({w}, length({w}) - {len(e)})" + (" || 'y'" if e == "ies" else "")
        out = f"CASE WHEN ends_with({w}, '{e}') AND length({w}) >= {len(e) + 3} THEN {cut} ELSE {out} END"
    return out


def _sentences(x: str) -> str:
    return f"string_split(regexp_replace({_strip(x)}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))"


def _chunker(x: str) -> str:
    return f"list_filter(list_transform({_sentences(x)}, lambda s: {_strip('s')}), lambda s: length(s) >= 10)"


def _qa(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({_strip(x)}, '\\n+'), lambda s: {_strip('s')}), lambda s: s <> '')"
    parts = f"flatten(list_transform({lines}, lambda s: string_split(regexp_replace(s, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(30) || '\\2', 'g'), chr(30))))"
    return f"list_filter(list_transform({parts}, lambda s: {_strip('s')}), lambda s: s <> '' AND (length(s) >= 12 OR (regexp_matches(s, '^\\p{{Lu}}') AND NOT ends_with(s, '.'))))"


def _key(x: str) -> str:
    plain = _strip(f"lower({x})")
    bare = _collapse(f"regexp_replace({plain}, '[^\\w\\s-]', '', 'g')")
    bare = _strip(f"regexp_replace({bare}, '^(the|a|an) ', '')")
    cut = _strip("left(k, length(k) - 1)")
    return f"(SELECT CASE WHEN length(k) > 3 AND ends_with(k, 's') AND NOT ends_with(k, 'ss') THEN {cut} ELSE k END FROM (SELECT {bare} AS k))"


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, md5(array_to_string({_tokens('text')}, ' ')) AS tokens_md5 FROM documents")
def content_tokens(spark, d):
    t = T.content_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY token")
def token_counts(spark, d):
    per = read(spark, d, "documents").select("doc_id", F.explode(T.content_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return per.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query(
    f"""SELECT token, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf
FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS token FROM documents), (SELECT count(*) AS n FROM documents) GROUP BY token, n"""
)
def term_stats(spark, d):
    _, terms, _ = R.build_index(read(spark, d, "documents"), "doc_id", F.col("text"))
    return terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, md5({_collapse('translate(lower(text), ' + chr(39) + '‘’“”–—' + chr(39) + ', ' + chr(39) * 4 + '||' + chr(39) * 4 + '||' + chr(39) + chr(34) * 2 + '--' + chr(39) + ')')}) AS norm_md5 FROM documents")
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


@query(f"SELECT p_partkey, {_key('p_name')} AS name_key FROM part")
def normalize_key(spark, d):
    return read(spark, d, "part").select("p_partkey", T.normalize_key(F.col("p_name")).alias("name_key"))


@query(f"SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT unnest({_tokens('text')}) AS token FROM documents)")
def light_stem(spark, d):
    t = read(spark, d, "documents").select(F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("token")).distinct()
    return t.select("token", T.light_stem(F.col("token")).alias("stem"))


_SAN = "html"
for _p, _r in (("(?is)<think>.*?</think>|<thought>.*?</thought>|<reasoning>.*?</reasoning>", ""), ("```[a-zA-Z0-9_-]*\\n?", ""), ("```", ""), ("(?im)^\\s*(?:Final\\s+)?Answer:\\s*", ""), ("<[^>]+>", ""), ("\\n{3,}", "' || chr(10) || chr(10) || '")):
    _SAN = f"regexp_replace({_SAN}, '{_p}', '{_r}', 'g')"


@query(f"SELECT page_id, md5({_strip(_SAN)}) AS clean_md5 FROM pages")
def sanitize_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.sanitize_answer(F.col("html"))).alias("clean_md5"))


@query("SELECT conv_id, turn, md5(" + _collapse("regexp_replace(text, '\\s*\\[[a-zA-Z0-9_.]+\\]', '', 'g')") + ") AS text_md5 FROM conversations")
def strip_citations(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_citations(F.col("text"))).alias("text_md5"))


@query(f"SELECT doc_id, len({_chunker('text')}) AS n, md5(array_to_string({_chunker('text')}, '|')) AS sentences_md5 FROM documents")
def sentences_chunker(spark, d):
    s = T.sentences_chunker(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


@query(f"SELECT doc_id, len({_qa('text')}) AS n, md5(array_to_string({_qa('text')}, '|')) AS sentences_md5 FROM documents")
def sentences_qa(spark, d):
    s = T.sentences_qa(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


_DIGITS = "length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')"
_REFS = f"len(list_filter({_LINES}, lambda s: regexp_matches(s, '{T.REFERENCE_LINE}'))) / len({_LINES})"
_BOILER = f"(length(text) < 200 OR coalesce({_DIGITS}, 0) > 0.35 OR coalesce({_REFS}, 0) > 0.30)"


@query(f"SELECT doc_id, round(coalesce({_DIGITS}, 0), 6) AS digit_ratio, round(coalesce({_REFS}, 0), 6) AS reference_ratio, {_BOILER} AS boilerplate FROM documents")
def boilerplate_filter(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.round(T.digit_ratio(t), 6).alias("digit_ratio"), F.round(T.reference_ratio(t), 6).alias("reference_ratio"), T.is_boilerplate(t).alias("boilerplate"))


@query(f"SELECT min(doc_id) AS doc_id, md5({_collapse('lower(text)')}) AS text_key FROM documents WHERE NOT {_BOILER} GROUP BY 2")
def exact_dedupe(spark, d):
    rows = read(spark, d, "documents").where(~T.is_boilerplate(F.col("text")))
    return S.drop_repeats(rows, "text", ["doc_id"]).select("doc_id", T.dedupe_key(F.col("text")).alias("text_key"))


_HEAD = "left(text, 1200)"
_CUT_S, _CUT_W = f"regexp_extract({_HEAD}, '(?s)^(.*[.!?](?:\\s+|$))', 1)", f"regexp_extract({_HEAD}, '(?s)^(.*) ', 1)"


@query(f"SELECT doc_id, md5(CASE WHEN length(text) <= 1200 THEN text WHEN length({_CUT_S}) >= 200 THEN {_strip(_CUT_S)} WHEN length({_CUT_W}) >= 200 THEN {_strip(_CUT_W)} ELSE {_strip(_HEAD)} END) AS cut_md5 FROM documents")
def truncate_boundary(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.truncate_at_boundary(F.col("text"))).alias("cut_md5"))


@query("SELECT p_partkey, upper(p_brand) || '::' || p_type || '::' || p_size AS parent_id, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS words FROM part")
def parent_ids(spark, d):
    return read(spark, d, "part").select("p_partkey", T.parent_id(F.upper("p_brand"), F.col("p_type"), F.col("p_size")).alias("parent_id"), T.word_count(F.col("p_name")).cast("long").alias("words"))


@query(
    f"""WITH b AS (SELECT item_id, list_distinct({_tokens('text')}) AS bt FROM benchmark), c AS (SELECT conv_id, turn, list_distinct({_tokens('text')}) AS ct FROM conversations)
SELECT item_id, conv_id, turn, round(len(list_intersect(bt, ct)) / len(bt), 6) AS coverage,
  round(len(list_intersect(bt, ct)) / len(list_distinct(list_concat(bt, ct))), 6) AS jaccard
FROM b, c WHERE len(list_intersect(bt, ct)) > 0"""
)
def benchmark_overlap(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.array_distinct(T.content_tokens(F.col("text"))).alias("bt"))
    c = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.content_tokens(F.col("text"))).alias("ct"))
    # the benchmark is a stated set of questions
    both = c.crossJoin(F.broadcast(b)).where(F.arrays_overlap("bt", "ct"))
    return both.select("item_id", "conv_id", "turn", F.round(T.coverage(F.col("ct"), F.col("bt")), 6).alias("coverage"), F.round(T.jaccard(F.col("bt"), F.col("ct")), 6).alias("jaccard"))


# --- segmentation ---------------------------------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, CAST(i AS INTEGER) AS page_or_slide, md5(ps[i]) AS content_md5 FROM
(SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '') AS ps FROM documents))"""
)
def sections_txt(spark, d):
    out = S.sections_txt(read(spark, d, "documents"), "doc_id", "text", "\n")
    return out.select(F.col("source_file").alias("doc_id"), "page_or_slide", F.md5("content").alias("content_md5"))


@query("SELECT source, min(doc_id) AS first_seq, count(*) AS n, md5(left(string_agg(text, chr(10) ORDER BY doc_id), 1800)) AS text_md5 FROM documents GROUP BY source")
def parents(spark, d):
    return S.parents(read(spark, d, "documents"), "source", "doc_id", "text", "\n", 1800).select("source", "first_seq", "n", F.md5("text").alias("text_md5"))


@query("SELECT source, min(doc_id) AS first_seq, arg_min(lang, doc_id) AS first_lang, arg_min(n_chars, doc_id) AS first_n_chars FROM documents GROUP BY source")
def first_attributes(spark, d):
    return S.first_in_group(read(spark, d, "documents"), "source", "doc_id", ["lang", "n_chars"])


_CHUNKS = f"""
WITH RECURSIVE ss AS (
  SELECT doc_id, s, len(s) AS n FROM (SELECT doc_id, {_chunker('text')} AS s FROM documents ) WHERE len(s) > 0
), st AS (SELECT doc_id, n, i, s[i + 1] AS sent FROM (SELECT *, unnest(range(0, n)) AS i FROM ss)),
tk AS (SELECT doc_id, i, token, count(*) AS c FROM (SELECT doc_id, i, unnest({_tokens('sent')}) AS token FROM st) GROUP BY ALL),
nm AS (SELECT doc_id, i, sqrt(sum(c * c)) AS nn FROM tk GROUP BY ALL),
dt AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS x FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.token = b.token GROUP BY ALL),
ds AS (SELECT st.doc_id, st.i, CASE WHEN a.nn IS NULL OR b.nn IS NULL THEN 1.0 ELSE 1.0 - coalesce(dt.x, 0) / (a.nn * b.nn) END AS d
  FROM st LEFT JOIN nm a ON a.doc_id = st.doc_id AND a.i = st.i LEFT JOIN nm b ON b.doc_id = st.doc_id AND b.i = st.i + 1
  LEFT JOIN dt ON dt.doc_id = st.doc_id AND dt.i = st.i WHERE st.i < st.n - 1),
th AS (SELECT doc_id, avg(d) + stddev_pop(d) AS t FROM ds GROUP BY doc_id),
walk(doc_id, i, first_at) AS (
  SELECT doc_id, 0, 0 FROM ss
  UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN ss.n > 2 AND ((ds.d > th.t AND w.i + 1 - w.first_at >= 2) OR w.i + 1 - w.first_at >= 15) THEN w.i + 1 ELSE w.first_at END
  FROM walk w JOIN ss ON ss.doc_id = w.doc_id JOIN ds ON ds.doc_id = w.doc_id AND ds.i = w.i JOIN th ON th.doc_id = w.doc_id
)
SELECT walk.doc_id, first_at AS first_sentence, count(*) AS n_sentences, md5(string_agg(sent, ' ' ORDER BY walk.i)) AS text_md5
FROM walk JOIN st ON st.doc_id = walk.doc_id AND st.i = walk.i GROUP BY walk.doc_id, first_at
"""


@query(_CHUNKS)
def semantic_chunks(spark, d):
    out = S.semantic_chunks(read(spark, d, "documents"), ["doc_id"], "text")
    return out.select("doc_id", F.col("start").alias("first_sentence"), (F.col("end") - F.col("start")).cast("long").alias("n_sentences"), F.md5("text").alias("text_md5"))


# --- retrieval ----------------------------------------------------------------------------------------------------------

ASKED = [(1, "thing tion erly thing heat"), (2, "keit und lich einung"), (3, "para las mente ción que")]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
_BM25 = f"""
docs AS (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
post AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM docs) GROUP BY ALL),
term AS (SELECT token, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), stats),
asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_tokens('query')}) AS token FROM q) GROUP BY ALL),
bm AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM asked JOIN post USING (token) JOIN term USING (token), stats GROUP BY ALL)
"""


def _asked(spark) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id long, query string")


@query(f"WITH q(query_id, query) AS (VALUES {_VALUES}), {_BM25} SELECT query_id, id AS doc_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 30")
def bm25_topk(spark, d):
    found = R.bm25(read(spark, d, "documents"), _asked(spark), "doc_id", F.col("text"))
    return R.top(found, 30).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"""WITH q(query_id, query) AS (VALUES {_VALUES}), {_BM25}, best AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 30)
SELECT CASE WHEN query_id <= 2 THEN 1 ELSE 2 END AS question_id, id AS doc_id, round(max(score), 6) AS bm25 FROM best GROUP BY ALL"""
)
def bm25_multi(spark, d):
    q = spark.createDataFrame([(1, [ASKED[0][1], ASKED[1][1]]), (2, [ASKED[2][1]])], "question_id int, queries array<string>")
    return R.multi_query(read(spark, d, "documents"), q, "doc_id", F.col("text")).select("question_id", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


TERMS = [(1, ["thing", "tion er"], ["heat of the"], "src1"), (2, ["keit", "und die"], [], "src2"), (3, ["que", "para la"], [], "src0")]


#: Phrases that headings hold.
HEADED = [(1, ["src1", "tion er"], ["heat of the"], "src1"), (2, ["src", "und die"], [], "src2"), (3, ["que", "src3"], [], "src0")]


def _questions(spark, asked=TERMS) -> DataFrame:
    rows = [(i, [ASKED[i - 1][1]], terms, subs, "", "", [file]) for i, terms, subs, file in asked]
    return spark.createDataFrame(rows, "question_id long, queries array<string>, key_terms array<string>, sub_questions array<string>, hypothetical_answer string, focus string, hinted_files array<string>")


def _composite_sql(asked=TERMS, heading: str = "''") -> str:
    bm25 = _BM25.replace(_tokens("text"), _tokens(f"CASE WHEN {heading} = '' THEN text ELSE {heading} || ' ' || text END")) if heading != "''" else _BM25
    fan = ", ".join(f"({i * 10 + j}, '{q}')" for i, terms, subs, _ in asked for j, q in enumerate([ASKED[i - 1][1], " ".join(terms), *subs]))
    said = ", ".join(f"({i}, '{' '.join([ASKED[i - 1][1], *terms, *subs])}', {_list(terms)}, '{file}')" for i, terms, subs, file in asked)
    return f"""WITH q(query_id, query) AS (VALUES {fan}), {bm25}, best AS (
  SELECT query_id // 10 AS question_id, id, max(score) AS bm25 FROM (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 30) GROUP BY ALL
), a(question_id, said, terms, file) AS (VALUES {said}), a2 AS (SELECT *, list_distinct({_tokens('said')}) AS want FROM a),
each AS (
  SELECT question_id, doc_id AS id, 3.0 * len(list_filter(terms, lambda p: contains(lower(text), p))) + 2.0 * len(list_filter(terms, lambda p: contains(lower({heading}), p))) + len(list_intersect(want, {_tokens('text')})) / len(want) AS extra, source = file AS hinted
  FROM documents, a2
), total AS (SELECT question_id, id, (coalesce(bm25, 0) + extra) * CASE WHEN hinted THEN 1.15 ELSE 1 END AS raw FROM each LEFT JOIN best USING (question_id, id))
SELECT question_id, id AS doc_id, round(raw, 6) AS retrieval_score, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 9) DESC, id) AS rank
FROM total WHERE raw > 0 QUALIFY rank <= 30"""


def _ranked(spark, d) -> DataFrame:
    return R.composite_rank(read(spark, d, "documents"), _questions(spark), "doc_id", "text", F.lit(""), F.col("source"))


@query(_composite_sql())
def composite_rank(spark, d):
    return _ranked(spark, d).select("question_id", F.col("id").alias("doc_id"), "retrieval_score", F.col("rank").cast("long").alias("rank"))


@query(_composite_sql(HEADED, "source"))
def composite_rank_headings(spark, d):
    out = R.composite_rank(read(spark, d, "documents"), _questions(spark, HEADED), "doc_id", "text", F.col("source"), F.col("source"))
    return out.select("question_id", F.col("id").alias("doc_id"), "retrieval_score", F.col("rank").cast("long").alias("rank"))


_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _vector_queries(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) <= 10")
def vector_topk(spark, d):
    return V.top_k_join(read(spark, d, "embeddings"), _vector_queries(spark, d), 10).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_TRIGRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr('^' || {0} || '$', i, 3)))"


@query(
    f"""WITH q(query_id, query) AS (VALUES {_VALUES}), {_BM25},
best AS (SELECT query_id, id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 30),
qt AS (SELECT DISTINCT query_id, token AS asked, {_TRIGRAMS.format("token")} AS ga FROM asked),
dt AS (SELECT id, h AS held, {_TRIGRAMS.format("h")} AS gh FROM (SELECT DISTINCT doc_id AS id, unnest({_tokens("text")}) AS h FROM documents WHERE doc_id IN (SELECT id FROM best))),
sim AS (SELECT b.query_id, b.id, asked, max(len(list_intersect(ga, gh)) / sqrt(len(ga) * len(gh)::DOUBLE)) AS s FROM best b JOIN qt USING (query_id) JOIN dt USING (id) GROUP BY ALL),
total AS (SELECT b.query_id, b.id, coalesce(sum(s), 0.0) AS s FROM best b LEFT JOIN sim USING (query_id, id) GROUP BY ALL)
SELECT query_id AS question_id, id AS doc_id, round(s, 6) AS maxsim, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM total"""
)
def late_interaction(spark, d):
    docs, asked = read(spark, d, "documents"), _asked(spark)
    first = R.top(R.bm25(docs, asked, "doc_id", F.col("text")), 30).withColumnRenamed("query_id", "question_id")
    out = R.late_interaction(first, asked.withColumnRenamed("query_id", "question_id"), docs, "doc_id", F.col("text"))
    return out.select("question_id", F.col("id").alias("doc_id"), F.round("maxsim", 6).alias("maxsim"), F.col("rank").cast("long").alias("rank"))


_COSINE = f"{_DOT} / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def _store(spark, d) -> VectorStore:
    """A vector store of all embeddings, added in three batches."""
    rows = read(spark, d, "embeddings")
    store = VectorStore.create(rows, fresh_folder(spark, "vector-store"))
    for i in range(3):
        store.append(rows.where(F.coalesce(F.pmod("vec_id", F.lit(3)), F.lit(0)) == i), f"batch-{i}")
    return store


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({_COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) <= 10")
def vector_store_topk(spark, d):
    store = _store(spark, d)
    asked = _vector_queries(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return store.search(asked, 10, len(store.centres())).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT q.vec_id AS asked_id, q.label AS parent, e.vec_id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0")
def vector_store_siblings(spark, d):
    """Parents and siblings from the store; labels stand for parents."""
    store = _store(spark, d)
    asked = _vector_queries(spark, d).select(F.col("vec_id").alias("id"))
    return store.siblings(asked, "label").join(store.parents_of(asked, "label"), "asked_id").select("asked_id", "parent", F.col("id").alias("vec_id"))


@query(f"WITH q(query_id, query) AS (VALUES {_VALUES}), {_BM25} SELECT query_id, id AS doc_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 30")
def bm25_index_topk(spark, d):
    """bm25_topk from a persisted index to which the documents were added in two batches."""
    index, rows = LexicalIndex(spark, fresh_folder(spark, "bm25-index")), read(spark, d, "documents")
    for i in range(2):
        index.append(rows.where(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)) == i), f"batch-{i}", "doc_id", "text")
    return R.top(index.search(_asked(spark)), 30).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"""WITH q(query_id, query) AS (VALUES {_VALUES}), {_BM25},
r1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 30),
r2 AS (SELECT q.vec_id // 100 + 1 AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY r <= 30)
SELECT query_id, id, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL"""
)
def rrf_fusion(spark, d):
    lexical = R.top(R.bm25(read(spark, d, "documents"), _asked(spark), "doc_id", F.col("text")), 30)
    asked = _vector_queries(spark, d).select((F.floor(F.col("vec_id") / 100) + 1).cast("long").alias("query_id"), "embedding")
    dense = V.top_k_join(read(spark, d, "embeddings"), asked, 30)
    return R.fuse_ranks([lexical, dense]).select("query_id", "id", F.round("rrf", 8).alias("rrf"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.5")
def cosine_pairs(spark, d):
    return V.cosine_pairs(read(spark, d, "embeddings"), 0.5).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS l1_of_unit FROM embeddings")
def l2_normalise(spark, d):
    u = V.l2_normalize(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1_of_unit"))


_SQD = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) + list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) - 2 * list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"""WITH p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum({_SQD}) AS s, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
x AS (SELECT vec_id, la, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM p GROUP BY ALL)
SELECT vec_id, la AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM x"""
)
def silhouette(spark, d):
    return V.silhouette(read(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), "label", F.round("silhouette", 5).alias("silhouette"))


# --- passages -------------------------------------------------------------------------------------------------------------


def _ranked_docs(spark, d) -> DataFrame:
    return _ranked(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"), F.col("lang").alias("source_file"), "text"), "id")


_RANKED = f"r AS (SELECT c.*, source AS parent_id, lang AS source_file, text FROM ({_composite_sql()}) c JOIN documents USING (doc_id))"
_FIRST = "f AS (SELECT * FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY question_id, parent_id ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) <= 5)"


@query(f"WITH {_RANKED}, {_FIRST} SELECT question_id, doc_id, parent_id FROM f")
def parent_dedupe(spark, d):
    return P.dedupe_parents(_ranked_docs(spark, d), 5).select("question_id", F.col("id").alias("doc_id"), "parent_id")


@query(
    f"""WITH {_RANKED}, {_FIRST}, e AS (SELECT * FROM r WHERE (question_id, source_file) NOT IN (SELECT (question_id, source_file) FROM f) AND (question_id, parent_id) NOT IN (SELECT (question_id, parent_id) FROM f)
QUALIFY row_number() OVER (PARTITION BY question_id, source_file ORDER BY rank) = 1)
SELECT question_id, doc_id, source_file FROM (SELECT *, 0 AS late FROM f UNION ALL SELECT *, 1 FROM e) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY late, rank) <= 8"""
)
def file_coverage(spark, d):
    ranked = _ranked_docs(spark, d)
    return P.cover_files(ranked, P.dedupe_parents(ranked, 5)).select("question_id", F.col("id").alias("doc_id"), "source_file")


@query(
    f"""WITH s AS (SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE [text] END AS x FROM (SELECT doc_id, text, {_qa('text')} AS x FROM documents WHERE text <> '')),
w AS (SELECT doc_id, x, len(x) AS n, a, unnest(range(1, len(x) - a + 1)) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x))) AS a FROM s)),
v AS (SELECT doc_id, x, a, k, list_sum(list_transform(range(a, a + k), lambda i: round(1.0 - 0.5 * i / n, 4))) AS score, list_sum(list_transform(x[a + 1:a + k], lambda z: length(z))) AS chars FROM w),
best AS (SELECT * FROM v WHERE chars <= 900 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, a, k) = 1)
SELECT s.doc_id, CAST(coalesce(a, 0) AS INTEGER) AS start, CAST(coalesce(a + k, 1) AS INTEGER) AS "end", md5(coalesce(array_to_string(best.x[a + 1:a + k], ' '), s.x[1])) AS text_md5 FROM s LEFT JOIN best USING (doc_id)"""
)
def window_best(spark, d):
    rows = read(spark, d, "documents").where("text <> ''").select("doc_id", P.evidence_sentences(F.col("text")).alias("s"))
    w = rows.select("doc_id", P.best_window(F.col("s")).alias("w"))
    return w.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.md5("w.text").alias("text_md5"))


@query(
    """SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER w AS s, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE s <= 7000 OR n = 1"""
)
def budget_blocks(spark, d):
    return P.within_budget(read(spark, d, "documents"), 7000, "doc_id", F.length("text"), "source").select("source", "doc_id")


@query(
    """SELECT doc_id, md5('[Source: ' || source || ' | Page ' || (doc_id % 7) || CASE WHEN lang <> 'en' THEN ' | Section: ' || lang ELSE '' END || ']' || chr(10) || text) AS block_md5 FROM documents"""
)
def context_blocks(spark, d):
    page = F.col("doc_id") % 7
    heading = F.when(F.col("lang") == "en", F.concat(F.lit("Page "), page.cast("string"))).otherwise(F.col("lang"))
    return read(spark, d, "documents").select("doc_id", F.md5(P.context_block(F.col("source"), page, heading, F.col("text"))).alias("block_md5"))


@query(
    f"""WITH {_RANKED}, g AS (SELECT question_id, bool_or(length(text) > 20000) AS found FROM r GROUP BY 1)
SELECT g.question_id, CASE WHEN found THEN 'ok' ELSE 'not_found' END AS status, CASE WHEN found THEN 0 ELSE 3 END AS shown FROM g"""
)
def answerability_gate(spark, d):
    out = P.not_found_gate(_ranked_docs(spark, d), F.length("text") > 20000)
    return out.select("question_id", "status", F.coalesce(F.size("closest"), F.lit(0)).alias("shown"))


# --- concepts and graphs --------------------------------------------------------------------------------------------------

#: Letters beyond ASCII become `_` for the SQL's boundaries, which know ASCII alone: part of a word, in no class of letters.
_ENTITIES = """list_distinct(list_concat(regexp_extract_all(a, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1), regexp_extract_all(a, '\\b([A-Z]{2,}[a-z]*(?:\\s*[A-Z]{2,}[a-z]*)*)\\b', 1),
  list_transform(list_filter(regexp_extract_all(whole, '[\\p{L}\\p{M}\\p{Nd}_]+'), lambda x: length(x) >= 5 AND regexp_matches(x, '(?i)[\\p{L}\\p{M}\\p{Nd}_](ing|tion|ment|ity|ness|ance|ence|ism|ist|ics|ology|graphy)$')), lambda x: lower(x))))"""


def _unaccented(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\x00-\\x7F]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


@query(
    f"""SELECT page_id, len(list_distinct(regexp_extract_all(url, '[a-z]{{4,}}'))) AS n_words, md5(array_to_string(list_sort({_ENTITIES}), '|')) AS entities_md5
FROM (SELECT page_id, url, html AS whole, {_unaccented('html')} AS a FROM pages)"""
)
def entities(spark, d):
    words = F.array_distinct(F.regexp_extract_all("url", F.lit("[a-z]{4,}"), F.lit(0)))
    found = F.array_sort(S.entities(F.col("html")))
    return read(spark, d, "pages").select("page_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(found, "|")).alias("entities_md5"))


_ACRONYM = "'\\b([A-Z][A-Za-z0-9\\s\\-]{2,40}?)\\s*\\(([A-Z0-9]{2,8})\\)'"


@query(
    f"""WITH m AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l, s FROM (SELECT doc_id, regexp_extract_all(text, {_ACRONYM}, 1) AS l, regexp_extract_all(text, {_ACRONYM}, 2) AS s FROM documents)),
k AS (SELECT doc_id, i, {_key('s[i]')} AS acronym, {_key('l[i]')} AS expansion FROM m
  WHERE contains(upper(list_reduce(list_concat([''], list_transform(list_filter(string_split_regex(l[i], '[\\s\\-]+'), lambda w: w <> ''), lambda w: left(w, 1))), lambda x, y: x || y)), upper(s[i])))
SELECT acronym, arg_max(expansion, doc_id * 1000000 + i) AS expansion FROM k WHERE acronym <> '' AND expansion <> '' AND acronym <> expansion GROUP BY acronym"""
)
def acronym_aliases(spark, d):
    return S.acronym_aliases(read(spark, d, "documents"), "text", "doc_id")


def _tagged(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source", F.explode(S.entities(F.col("text"))).alias("entity"))


_TAGGED = f"t AS (SELECT doc_id, source, unnest({_ENTITIES}) AS entity FROM (SELECT doc_id, source, text AS whole, {_unaccented('text')} AS a FROM documents))"


@query(f"WITH {_TAGGED} SELECT a.entity AS e1, b.entity AS e2, count(*) AS weight FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL")
def cooccurrence(spark, d):
    return C.cooccurrence(_tagged(spark, d), "doc_id", "entity")


@query(f"WITH {_TAGGED} SELECT entity, count(*) AS frequency, count(DISTINCT source) AS n_sources FROM t GROUP BY entity")
def node_statistics(spark, d):
    return C.node_stats(_tagged(spark, d), "entity", "source").select("entity", "frequency", F.size("source_files").cast("long").alias("n_sources"))


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Names (id, entity) and edges (u, v, w) by id; ids have the order of the names."""
    return C.cooccurrence_graph(_tagged(spark, d), "doc_id", "entity")


def _letters(names: DataFrame) -> DataFrame:
    """First letters as communities."""
    return names.select(F.col("id").alias("node"), F.ascii(F.left("entity", F.lit(1))).alias("community"))


def _named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.join(names.toDF(c, "__name"), c).withColumn(c, F.col("__name")).drop("__name")
    return rows


_EDGES = f"{_TAGGED}, e AS (SELECT a.entity AS u, b.entity AS v, CAST(count(*) AS DOUBLE) AS w FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL)"
_WAYS = "way AS (SELECT u AS x, v AS y, w FROM e UNION ALL SELECT v, u, w FROM e)"


@query(f"WITH {_EDGES}, n AS (SELECT count(DISTINCT x) AS nodes FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e)), m AS (SELECT count(*) AS edges FROM e) SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 8) AS density FROM n, m")
def graph_density(spark, d):
    return G.density(_graph(spark, d)[1]).withColumn("density", F.round("density", 8))


@query(f"WITH {_EDGES}, {_WAYS}, r0 AS (SELECT 'thing' AS x WHERE 'thing' IN (SELECT x FROM way)), r1 AS (SELECT x FROM r0 UNION SELECT y FROM way JOIN r0 USING (x)), r2 AS (SELECT x FROM r1 UNION SELECT y FROM way JOIN r1 USING (x)) SELECT x AS node FROM r2")
def k_hop(spark, d):
    names, edges = _graph(spark, d)
    start = names.where("entity = 'thing'").first()
    return _named(G.k_hop(edges, start["id"] if start else -1, 2), names, "node")


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f", r{i + 1} AS (SELECT ns.x, 0.15 / n + 0.85 * coalesce(g, 0) AS r FROM ns CROSS JOIN nn LEFT JOIN (SELECT y AS x, sum(p * r) AS g FROM flow JOIN r{i} USING (x) GROUP BY y) q ON q.x = ns.x)" for i in range(rounds)
    )
    return f"""WITH {_EDGES}, {_WAYS}, s AS (SELECT x, sum(w) AS s FROM way GROUP BY x), flow AS MATERIALIZED (SELECT x, y, w / s AS p FROM way JOIN s USING (x)),
ns AS (SELECT x FROM s), nn AS (SELECT count(*) AS n FROM ns), r0 AS (SELECT x, 1.0 / n AS r FROM ns, nn){steps} SELECT x AS node, round(r, 8) AS rank FROM r{rounds}"""


@query(_pagerank_sql(6))
def pagerank(spark, d):
    names, edges = _graph(spark, d)
    return _named(G.pagerank(edges, rounds=6), names, "node").select("node", F.round("rank", 8).alias("rank"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, o_custkey - o_custkey % 7 AS v FROM orders), way AS (SELECT u AS x, v AS y FROM e UNION SELECT v, u FROM e),
r(x, y) AS (SELECT x, x FROM way UNION SELECT r.x, way.y FROM r JOIN way ON r.y = way.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x"""
)
def components(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("v")).distinct()
    return G.components(o)


@query(
    f"""WITH {_EDGES}, {_WAYS}, m AS (SELECT sum(w) AS m FROM e), c AS (SELECT left(u, 1) AS c, sum(w) AS i FROM e WHERE left(u, 1) = left(v, 1) GROUP BY 1), k AS (SELECT left(x, 1) AS c, sum(w) AS k FROM way GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN c USING (c), m"""
)
def modularity(spark, d):
    names, e = _graph(spark, d)
    return G.modularity(e, _letters(names)).select(F.round("modularity", 6).alias("modularity"))


@query()
def louvain(spark, d):
    names, edges = _graph(spark, d)
    return _named(G.communities(edges), names, "node")


@query()
def fuzzy_merge(spark, d):
    keys = _tagged(spark, d).select(F.concat_ws(" ", F.col("entity"), F.lit("unit")).alias("key")).distinct()
    return C.fuzzy_pairs(keys)


@query()
def map_layout(spark, d):
    names, edges = _graph(spark, d)
    found = cut(G.communities(edges).where("community is not null"))
    deg = G.degrees(edges)
    members = _named(found.join(deg, "node"), names, "node").select("session", F.col("community").alias("cluster"), F.col("node").alias("name"), F.col("degree").alias("support"), F.col("strength").alias("weight"))
    label = G.light(found.select("node", "community"))
    e = edges.join(label.toDF("u", "ca"), "u").join(label.toDF("v", "cb"), "v").where("ca <> cb")
    links = e.groupBy(F.lit("").alias("session"), F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
    return L.map_layout(L.scaled_members(members).select("session", "cluster", "name", "imp", "rank"), links)


_RELS = "x AS (SELECT 'k' || (l_partkey % 40) AS source_key, CASE l_linenumber % 5 WHEN 0 THEN 'type_of' WHEN 1 THEN 'part_of' WHEN 2 THEN 'uses' WHEN 3 THEN 'example_of' ELSE 'related_to' END AS relation, 'k' || (l_suppkey % 40) AS target_key, l_orderkey AS chunk_id, l_shipdate || '/' || l_linenumber AS evidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"
_AGG = "g AS (SELECT source_key, relation, target_key, count(DISTINCT chunk_id) AS support, arg_min(evidence, seq) AS evidence FROM x WHERE source_key <> target_key GROUP BY ALL)"
_WEIGHT = "round(CASE WHEN relation IN ('type_of', 'part_of', 'example_of') THEN 3.0 WHEN relation = 'uses' THEN 1.5 ELSE 1.0 END * (1 + ln(support)), 3)"


def _relations(spark, d) -> DataFrame:
    n = F.col("l_linenumber") % 5
    kind = F.when(n == 0, "type_of").when(n == 1, "part_of").when(n == 2, "uses").when(n == 3, "example_of").otherwise("related_to")
    k = lambda c: F.concat(F.lit("k"), (F.col(c) % 40).cast("string"))
    rows = read(spark, d, "lineitem").select(k("l_partkey").alias("source_key"), kind.alias("relation"), k("l_suppkey").alias("target_key"), F.col("l_orderkey").alias("chunk_id"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.aggregate_relations(rows)


@query(f"WITH {_RELS}, {_AGG} SELECT source_key, relation, target_key, support, {_WEIGHT} AS weight FROM g")
def relation_weights(spark, d):
    return _relations(spark, d).select("source_key", "relation", "target_key", "support", "weight")


@query(
    f"""WITH {_RELS}, {_AGG}, p AS (SELECT *, least(source_key, target_key) AS pa, relation IN ('type_of', 'part_of', 'example_of') AS h FROM g),
m AS (SELECT pa, greatest(source_key, target_key) AS pb, max(CASE WHEN source_key = pa THEN support END) AS fa, max(CASE WHEN source_key <> pa THEN support END) AS fb FROM p WHERE h GROUP BY ALL)
SELECT source_key, relation, target_key, support FROM p LEFT JOIN m ON p.pa = m.pa AND greatest(source_key, target_key) = m.pb
WHERE NOT h OR fa IS NULL OR fb IS NULL OR (fa > fb AND source_key = p.pa) OR (fb > fa AND source_key <> p.pa)"""
)
def hierarchy_conflicts(spark, d):
    return C.settle_directions(_relations(spark, d)).select("source_key", "relation", "target_key", "support")


@query()
def hierarchy_without_cycles(spark, d):
    return C.without_cycles(C.settle_directions(_relations(spark, d))).select("source_key", "relation", "target_key", "support")


_PRI = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.KINDS)) + " END"
_KINDS = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(C.KINDS)) + " END"


@query(f"SELECT key, kind FROM (SELECT l_suppkey AS key, {_KINDS} AS kind, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, {_PRI}) = 1")
def majority_kind(spark, d):
    n = F.col("l_linenumber") % 5
    kind = F.array(*(F.lit(k) for k in C.KINDS))[n]
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), kind.alias("kind"))
    return C.majority(rows, "key", "kind", C.kind_priority(F.col("kind")))


@query(f"WITH {_TAGGED}, n AS (SELECT count(*) AS n FROM documents) SELECT entity AS canon, count(*) AS chunks, count(*) / max(n) > 0.5 AS global FROM t, n GROUP BY entity")
def global_topics(spark, d):
    s = _tagged(spark, d).groupBy(F.col("entity").alias("canon")).agg(F.count("*").alias("chunks"))
    n = read(spark, d, "documents").agg(F.count("*").alias("n"))
    return C.global_topics(s.crossJoin(F.broadcast(n)), F.col("n")).drop("n")


@query(
    f"""WITH {_EDGES}, {_WAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS n FROM way WHERE w >= 2)
SELECT DISTINCT least(x, y) AS u, greatest(x, y) AS v, w FROM k WHERE n <= 5"""
)
def sparsified_affinity(spark, d):
    names, edges = _graph(spark, d)
    return _named(C.sparsify(edges, 5, 2.0), names, "u", "v")


@query(
    f"""WITH {_EDGES}, {_WAYS}, p AS (SELECT x, left(x, 1) AS c, left(y, 1) AS o, sum(w) AS w FROM way GROUP BY ALL),
g AS (SELECT x, c, coalesce(sum(w) FILTER (o = c), 0) AS own, coalesce(max(w) FILTER (o <> c), 0) AS other_weight FROM p GROUP BY ALL)
SELECT x AS node, c AS community, own, other_weight, other_weight > 0 AND other_weight >= 0.5 * own AS bridge FROM g"""
)
def bridge_concepts(spark, d):
    names, e = _graph(spark, d)
    out = _named(C.soft_membership(e, _letters(names)), names, "node")
    letter = F.decode(F.unhex(F.lpad(F.hex("community"), 8, "0")), "UTF-32")
    return out.select("node", letter.alias("community"), "own", "other_weight", "bridge")


@query(
    f"""WITH s AS (SELECT doc_id, unnest({_qa('text')}) AS s FROM documents), b AS (SELECT list(text ORDER BY item_id) AS refs FROM benchmark),
r AS (SELECT doc_id, s, list_distinct(list_transform({_tokens('s')}, lambda w: {_stem('w')})) AS st, list_transform(refs, lambda t: list_distinct(list_transform({_tokens('t')}, lambda w: {_stem('w')}))) AS rs, array_to_string(refs, ' ') AS whole FROM s, b)
SELECT doc_id, count(*) AS n, count(*) FILTER (len(st) > 0 AND len(list_intersect(st, flatten(rs))) / len(st) >= 0.7 AND list_max(list_transform(rs, lambda x: len(list_intersect(st, x)))) / len(st) >= 0.3
  AND len(list_filter(regexp_extract_all(s, '\\b\\d+(?:\\.\\d+)?%?\\b'), lambda x: NOT list_contains(regexp_extract_all(whole, '\\b\\d+(?:\\.\\d+)?%?\\b'), x))) = 0) AS supported FROM r GROUP BY doc_id"""
)
def sentence_support(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(T.sentences_qa(F.col("text"))).alias("s"))
    return VF.count_supported(s, read(spark, d, "benchmark"), "doc_id")


@query()
def claim_dedupe(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    claims = F.transform("ts", lambda t: F.struct(t["text"].alias("text"), F.array(t["turn"].cast("string")).alias("support")))
    out = c.select("conv_id", F.explode(VF.dedupe_claims(claims)).alias("c"))
    return out.select("conv_id", F.md5("c.text").alias("text_md5"), F.array_join("c.support", ",").alias("support"))


_NONE = "The documents do not appear to contain an answer to this question."


@query(
    f"""SELECT conv_id, turn, md5(CASE WHEN turn % 5 = 4 THEN '{_NONE}' WHEN role = 'assistant' THEN {_strip('text')} WHEN role = 'user' THEN {_strip('text')} ELSE {_collapse("regexp_replace(" + _strip('text') + ", '\\s*\\[[a-zA-Z0-9_.]+\\]', '', 'g')")} END) AS shown_md5 FROM conversations"""
)
def display_text(spark, d):
    when = lambda r: F.when(F.col("role") == r, F.col("text"))
    status = F.when(F.col("turn") % 5 == 4, "not_found").otherwise("answered")
    shown = T.display_text(status, when("assistant"), when("user"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.array("text"), F.lit(False))
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(shown).alias("shown_md5"))


# --- relational categories ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_default(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nationkey, coalesce(ns, 0) AS suppliers, coalesce(nc, 0) AS customers FROM (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey")
def full_join(spark, d):
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    return s.join(c, "nationkey", "full").fillna(0)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_counts(spark, d):
    return read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rnk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("run3"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("long").alias("rnk"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return s.intersect(read(spark, d, "customer").select("c_nationkey")).subtract(read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def local_suppliers(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(read(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return logs.windowed_counts(read(spark, d, "events"), "ts", "1 hour", by=("event_type",))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, s")
def events_sessions(spark, d):
    return logs.session_counts(read(spark, d, "events"), "ts", "30 minutes", "user_id")


# --- more text --------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({_sentences('text')}) AS n, md5(array_to_string({_sentences('text')}, '|')) AS sentences_md5 FROM documents")
def sentences_plain(spark, d):
    s = T.sentences_plain(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


@query("SELECT page_id, coalesce(nullif(upper(regexp_extract(url, '\\.([^.]+)$', 1)), ''), 'DOC') AS source_type FROM pages")
def source_types(spark, d):
    return read(spark, d, "pages").select("page_id", T.source_type(F.col("url")).alias("source_type"))


@query("SELECT conv_id, turn, md5(regexp_replace(text || '_*`', '([*_`])', '\\\\\\1', 'g')) AS escaped_md5 FROM conversations")
def escaped_markdown(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.escape_markdown(F.concat("text", F.lit("_*`")))).alias("escaped_md5"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')) AS safe_md5 FROM pages")
def script_safe(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.script_safe(F.col("html"))).alias("safe_md5"))


@query(f"SELECT conv_id, turn, {_strip('left(coalesce(text, chr(32)), 60)')} AS head FROM conversations")
def capped_text(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.cap(F.col("text"), 60).alias("head"))


_CAPPED = f"list_filter(list_transform(string_split(text, ' '), lambda x: {_strip('left(x, 4)')}), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, array_to_string(list_slice(list_filter({_CAPPED}, lambda x, i: list_position(list_transform({_CAPPED}, lambda y: lower(y)), lower(x)) = i), 1, 6), '|') AS terms FROM conversations")
def ordered_terms(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.ordered_distinct(F.split("text", " "), 4, 6), "|").alias("terms"))


_FILE = "'File' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.pptx' WHEN 1 THEN '.pdf' ELSE '.md' END"
_HINT = "CASE s_suppkey % 5 WHEN 0 THEN ' Slides ' WHEN 1 THEN 'my notes' WHEN 2 THEN 'file' || (s_suppkey % 10) WHEN 3 THEN 'the paper' ELSE '' END"


@query(
    f"""SELECT s_suppkey, h <> '' AND CASE WHEN regexp_matches(h, 'slides?|presentation|ppt') THEN ends_with(f, '.pptx') WHEN regexp_matches(h, 'notes?|pdf|paper') THEN ends_with(f, '.pdf') ELSE contains(f, h) END AS hinted
FROM (SELECT s_suppkey, lower({_FILE}) AS f, trim(lower({_HINT})) AS h FROM supplier)"""
)
def hinted_files(spark, d):
    yes = F.lit(True)
    return read(spark, d, "supplier").select("s_suppkey", T.hinted(F.expr(_FILE), F.expr(_HINT), yes, yes).alias("hinted"))


_SAID = "p_brand || ' with ' || left(p_name, p_partkey % 14) || ' and ' || p_type"
_CT = f"list_filter(regexp_extract_all(norm, '[a-z0-9_]+'), lambda w: NOT list_contains({_list(T.CONCEPT_STOPWORDS)}, w))"


@query(
    f"""SELECT p_partkey, norm <> '' AND NOT list_contains({_list(T.GENERIC_NAMES)}, norm) AND len({_CT}) > 0 AND (len(list_filter({_CT}, lambda w: contains(low, w))) / len({_CT}) >= 0.6
  OR (regexp_matches(norm, '^[a-z0-9]{{2,6}}$') AND regexp_matches(low, '\\b' || norm || '\\b'))) AS grounded
FROM (SELECT p_partkey, lower({_SAID}) AS low, {_strip('lower(CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, chr(32), 1) ELSE chr(109) || chr(101) || chr(116) || chr(104) || chr(111) || chr(100) END)')} AS norm FROM part)"""
)
def grounded_names(spark, d):
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.col("p_type")).when(n == 1, F.col("p_name")).when(n == 2, F.split("p_name", " ")[0]).otherwise("method")
    return read(spark, d, "part").select("p_partkey", T.is_grounded(name, F.expr(_SAID.replace("left(p_name, p_partkey % 14)", "left(p_name, cast(p_partkey % 14 as int))"))).alias("grounded"))


@query(
    """SELECT source_file, heading, CAST(page AS INTEGER) AS page_or_slide, content FROM (
  SELECT n_name AS source_file, unnest(['Section 1', n_name, 'Last one']) AS heading, unnest([1, 2, 4]) AS page, unnest(['intro ' || n_nationkey, 'body ' || n_regionkey || chr(10) || 'more', 'tail']) AS content FROM nation)"""
)
def sections_markdown(spark, d):
    text = F.concat(F.lit("intro "), F.col("n_nationkey"), F.lit("\n# "), F.col("n_name"), F.lit(" \n\nbody "), F.col("n_regionkey"), F.lit("\nmore\n## Empty\n\n### Last one\ntail\n"))
    return S.sections_markdown(read(spark, d, "nation").select(F.col("n_name").alias("name"), text.alias("content")))


@query("SELECT role || '_chunk_' || printf('%04d', row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) AS id, conv_id, turn FROM conversations")
def numbered_chunks(spark, d):
    return S.number_chunks(read(spark, d, "conversations"), "role", ["conv_id", "turn"]).select("id", "conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 600")
def strict_budget(spark, d):
    return P.within_budget(read(spark, d, "conversations"), 600, "turn", F.length("text"), "conv_id", keep_first=False).select("conv_id", "turn")


# --- claims -----------------------------------------------------------------------------------------------------------------

_CLAIMS = "c AS (SELECT conv_id AS answer_id, turn AS claim_no, text, ['quote', 'paraphrase', 'weak', 'other'][1 + (turn + conv_id) % 4] AS kind, (turn * 37 + conv_id * 11) % 100 / 100.0 AS support_score, turn % 2 = 1 AS verified FROM conversations)"


def _claims(spark, d) -> DataFrame:
    kind = F.array(*(F.lit(k) for k in ("quote", "paraphrase", "weak", "other")))[((F.col("turn") + F.col("conv_id")) % 4).cast("int")]
    return read(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_no"), "text", kind.alias("kind"), ((F.col("turn") * 37 + F.col("conv_id") * 11) % 100 / 100).alias("support_score"), (F.col("turn") % 2 == 1).alias("verified"))


@query(f"WITH {_CLAIMS}, g AS (SELECT *, kind = 'quote' OR (kind = 'paraphrase' AND verified) OR support_score >= 0.7 AS good FROM c) SELECT answer_id, claim_no FROM g QUALIFY good OR count(*) FILTER (good) OVER (PARTITION BY answer_id) = 0")
def kept_claims(spark, d):
    return VF.keep_claims(_claims(spark, d)).select("answer_id", "claim_no")


@query(f"WITH {_CLAIMS} SELECT answer_id, claim_no, kind FROM c WHERE kind IN ('weak', 'paraphrase') QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY kind <> 'weak', claim_no) <= 3")
def claims_to_verify(spark, d):
    return VF.to_verify(_claims(spark, d)).select("answer_id", "claim_no", "kind")


@query(
    f"""WITH {_CLAIMS}, v AS (SELECT answer_id, claim_no, claim_no % 2 = 0 AS holds FROM c WHERE claim_no % 3 <> 0)
SELECT answer_id, claim_no, CASE WHEN coalesce(holds, true) THEN 'kept' ELSE 'dropped' END AS state, kind = 'quote' OR coalesce(holds, false) AS verified FROM c LEFT JOIN v USING (answer_id, claim_no)"""
)
def claim_verdicts(spark, d):
    c = _claims(spark, d)
    told = c.where("claim_no % 3 <> 0").select("answer_id", "claim_no", (F.col("claim_no") % 2 == 0).alias("holds"))
    kept, dropped = VF.apply_verdicts(c, told)
    both = kept.withColumn("state", F.lit("kept")).unionByName(dropped.withColumn("state", F.lit("dropped")))
    return both.select("answer_id", "claim_no", "state", "verified")


@query(f"WITH {_CLAIMS} SELECT answer_id, claim_no AS sid, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY answer_id ORDER BY support_score DESC, claim_no) QUALIFY place <= 2")
def fallback_claims(spark, d):
    windows = _claims(spark, d).select("answer_id", F.col("claim_no").alias("sid"), "text", F.col("support_score").alias("score"))
    out = VF.extractive_fallback(windows)
    return out.select("answer_id", F.col("support")[0].alias("sid"), F.col("claim_no").cast("long").alias("place"))


_INTENTS = list(VF.TARGET_WORDS)


@query(
    f"""SELECT event_id, words, CASE WHEN words <= 100 THEN 'short paragraphs' WHEN words <= 160 THEN 'paragraphs or one list' ELSE 'up to three subheadings' END AS shape FROM (
  SELECT event_id, CASE {_list(_INTENTS + ['unheard'])}[1 + event_id % {len(_INTENTS) + 1}] {' '.join(f"WHEN '{k}' THEN {v}" for k, v in VF.TARGET_WORDS.items())} ELSE {VF.TARGET_WORDS['other']} END AS words FROM events)"""
)
def answer_shapes(spark, d):
    intent = F.array(*(F.lit(k) for k in [*_INTENTS, "unheard"]))[(F.col("event_id") % (len(_INTENTS) + 1)).cast("int")]
    return read(spark, d, "events").select("event_id", VF.target_words(intent).alias("words"), VF.structure_line(VF.target_words(intent)).alias("shape"))


# --- more concepts, graphs and vectors ----------------------------------------------------------------------------------------


@query("SELECT a.vec_id, round(CASE WHEN sqrt(list_dot_product(x, x)) < 1e-10 OR sqrt(list_dot_product(y, y)) < 1e-10 THEN 1.0 ELSE 1.0 - list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)) END, 6) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b ON a.vec_id = b.vec_id")
def cosine_distances(spark, d):
    e = read(spark, d, "embeddings")
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(near, "vec_id").select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("y")), 6).alias("distance"))


_MESH = "x AS (SELECT l_partkey % 60 AS a, l_suppkey % 60 AS b, l_quantity AS q FROM lineitem), u AS (SELECT least(a, b) AS u, greatest(a, b) AS v, sum(q) AS w FROM x WHERE a <> b GROUP BY ALL)"


def _mesh(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b"), "l_quantity")
    return G.undirected(rows, "a", "b", "l_quantity")


@query(f"WITH {_MESH} SELECT u, v, round(w, 4) AS w FROM u")
def undirected_edges(spark, d):
    return _mesh(spark, d).select("u", "v", F.round("w", 4).alias("w"))


@query(f"WITH {_MESH} SELECT node, count(*) AS degree, round(sum(w), 4) AS strength FROM (SELECT u AS node, w FROM u UNION ALL SELECT v, w FROM u) GROUP BY node")
def node_degrees(spark, d):
    return G.degrees(_mesh(spark, d)).select("node", "degree", F.round("strength", 4).alias("strength"))


@query(
    """WITH h AS (SELECT DISTINCT l_suppkey AS c, l_orderkey AS k FROM lineitem), n AS (SELECT c, count(*) AS n FROM h GROUP BY c),
co AS (SELECT a.c AS u, b.c AS v, count(*) AS m FROM h a JOIN h b ON a.k = b.k AND a.c < b.c GROUP BY ALL),
cc AS (SELECT u, v, m / sqrt(a.n::DOUBLE * b.n) AS cooccur FROM co JOIN n a ON a.c = u JOIN n b ON b.c = v),
r0 AS (SELECT least(a.l_suppkey, b.l_suppkey) AS u, greatest(a.l_suppkey, b.l_suppkey) AS v, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY ALL),
r AS (SELECT u, v, w / (SELECT max(w) FROM r0)::DOUBLE AS relation FROM r0),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)),
s AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(a.e, b.e) AS semantic FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.1)
SELECT u, v, round(relation, 6) AS relation, round(cooccur, 6) AS cooccur, round(semantic, 6) AS semantic,
  round(0.5 * coalesce(relation, 0) + 0.3 * coalesce(cooccur, 0) + 0.2 * coalesce(semantic, 0), 6) AS w
FROM r FULL JOIN cc USING (u, v) FULL JOIN s USING (u, v)"""
)
def measured_signals(spark, d):
    """Suppliers as concepts: what follows in an order is a relation, orders are chunks, embeddings are the concepts' vectors."""
    lines = read(spark, d, "lineitem")
    places = lines.select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("concept"))
    follows = C.followers(places).withColumn("weight", F.lit(1))
    known = read(spark, d, "supplier").select(F.col("s_suppkey").alias("vec_id"))
    vectors = read(spark, d, "embeddings").join(known, "vec_id", "left_semi").select("vec_id", "embedding")
    out = C.measured_affinity(follows, lines.select(F.col("l_suppkey").alias("concept"), F.col("l_orderkey").alias("chunk")), vectors, 0.1)
    return out.select("u", "v", *(F.round(c, 6).alias(c) for c in ("relation", "cooccur", "semantic", "w")))


@query("SELECT least(user_id, event_id % 40) AS u, greatest(user_id, event_id % 40) AS v, count(*) AS w FROM events GROUP BY ALL")
def running_edges(spark, d):
    return logs.edge_weights(read(spark, d, "events").select(F.col("user_id").alias("e1"), (F.col("event_id") % 40).alias("e2")))


@query("SELECT least(user_id, event_id % 40) AS u, greatest(user_id, event_id % 40) AS v, count(*) AS w FROM events GROUP BY ALL")
def streamed_edges(spark, d):
    """running_edges from a stream with state; events that come again count once."""
    path, out = f"{d}/events.parquet", fresh_folder(spark, "edges")
    pairs = lambda rows: rows.select(F.col("user_id").alias("e1"), (F.col("event_id") % 40).alias("e2"))
    logs.grow_edges(logs.stream_files(spark, path, spark.read.parquet(path).schema), f"{out}/weights", f"{out}/state", pairs, "event_id")
    return logs.read_edges(spark, f"{out}/weights")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_orderkey IS NOT NULL)")
def unprocessed_orders(spark, d):
    done = read(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.unprocessed(read(spark, d, "orders"), done, "o_orderkey").select("o_orderkey")


_NAMES = "n AS (SELECT DISTINCT unnest([p_name, p_name || ' ' || lower(p_type), 'core ' || p_name, p_name || ' system', 'general ' || p_name || ' framework']) AS a FROM part)"


@query(
    f"""WITH {_NAMES}, p AS (SELECT a, unnest([regexp_replace(a, ' (?:{'|'.join(C.SUFFIXES)})$', ''), regexp_replace(a, '^(?:{'|'.join(C.MODIFIERS)}) ', '')]) AS b FROM n)
SELECT DISTINCT a, b FROM p WHERE a <> b AND b <> '' AND b IN (SELECT a FROM n)"""
)
def affix_merge(spark, d):
    names = F.array("p_name", F.concat("p_name", F.lit(" "), F.lower("p_type")), F.concat(F.lit("core "), "p_name"), F.concat("p_name", F.lit(" system")), F.concat(F.lit("general "), "p_name", F.lit(" framework")))
    return C.affix_pairs(read(spark, d, "part").select(F.explode(names).alias("key")))


_NEAR = "p AS (SELECT p_name || ' ' || p_partkey AS a, CASE p_partkey % 2 WHEN 0 THEN p_name || ' of x' ELSE 'other of thing' END AS b, p_partkey * 7919 % 1000 / 1000.0 AS cosine FROM part)"


@query(
    f"""WITH {_NEAR}, auto AS (SELECT * FROM p WHERE cosine >= 0.88 AND (cosine >= 0.93 OR len(list_filter(list_intersect(string_split(a, ' '), string_split(b, ' ')), lambda w: NOT list_contains({_list(T.CONCEPT_STOPWORDS)}, w))) > 0)),
band AS (SELECT * FROM p WHERE cosine >= 0.78 AND cosine < 0.88 AND len(list_filter(list_intersect(string_split(a, ' '), string_split(b, ' ')), lambda w: NOT list_contains({_list(T.CONCEPT_STOPWORDS)}, w))) > 0 ORDER BY cosine DESC, a, b LIMIT 30)
SELECT a, b, round(cosine, 6) AS cosine, 'merged' AS decision, 'embedding' AS "by" FROM auto UNION ALL SELECT a, b, round(cosine, 6), 'kept_separate', 'judge' FROM band"""
)
def vector_merge(spark, d):
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" of x"))).otherwise("other of thing")
    pairs = read(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_partkey").alias("a"), b.alias("b"), (F.col("p_partkey") * 7919 % 1000 / 1000).alias("cosine"))
    return C.vector_pairs(pairs).select("a", "b", F.round("cosine", 6).alias("cosine"), "decision", "by")


@query("SELECT l_orderkey, l_linenumber, round(0.5 * coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END, 0) + 0.3 * coalesce(l_quantity / 50, 0) + 0.2 * coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 2 END, 0), 6) AS affinity FROM lineitem")
def three_signals(spark, d):
    n = F.col("l_linenumber")
    a = C.affinity(F.when(n % 3 != 0, F.col("l_discount")), F.col("l_quantity") / 50, F.when(n % 2 == 0, F.col("l_discount") * 2))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(a, 6).alias("affinity"))
