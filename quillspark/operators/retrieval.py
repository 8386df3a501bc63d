"""Lexical retrieval: BM25, the composite score and rank fusion, for a given set of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.lineage import cut

# Fixed values of the ranking.
K1, B, TOP_K, HINT_BOOST, PHRASE_BONUS, HEADING_BONUS = 1.5, 0.75, 30, 1.15, 3.0, 2.0


def index_text(heading: Column, text: Column) -> Column:
    """What is indexed of a chunk: heading and text, or the text alone."""
    return F.when(F.coalesce(heading, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(heading, F.lit(" "), F.coalesce(text, F.lit(""))))


def build_index(chunks: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (id, token, tf), terms (token, df, idf) and documents (id, dl) for a table that many questions ask.

    Documents without tokens count towards the mean length, so lengths come from the token arrays, not the postings.
    """
    rows = chunks.select(F.col(id_col).alias("id"), T.content_tokens(text).alias("tokens"))
    docs = rows.select("id", F.size("tokens").alias("dl"))
    postings = rows.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    return postings, terms.select("token", "df", idf(F.col("n"), F.col("df")).alias("idf")), docs


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def bm25(chunks: DataFrame, questions: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(query_id, id, score) of all chunks with a token of the question; questions: (query_id, query).

    Query tokens count as often as they stand in the question. Each text is read once, for its length and the asked tokens
    that it holds; that is written for frequencies and scores.
    """
    asked = _asked(questions)
    rows = chunks.select(F.col(id_col).alias("id"), T.content_tokens(text).alias("tokens")).crossJoin(F.broadcast(_wanted(asked, "wanted")))
    return _scores(cut(rows.select("id", F.size("tokens").alias("dl"), _hits("tokens", "wanted").alias("hits"))), asked)


def _asked(questions: DataFrame) -> DataFrame:
    """(query_id, token, times) of questions (query_id, query)."""
    return questions.select("query_id", F.explode(T.content_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def _wanted(tokens: DataFrame, name: str, token: str = "token") -> DataFrame:
    """One row with the distinct tokens, bounded by the questions asked."""
    return tokens.agg(F.collect_set(token).alias(name))


def _hits(tokens: str, wanted: str) -> Column:
    """(token, tf) of the tokens that are wanted."""
    return F.transform(F.array_intersect(tokens, wanted), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).cast("long").alias("tf")))


def _scores(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score) from rows (id, dl, hits) of all chunks and asked (query_id, token, times)."""
    # documents without tokens count towards the mean length
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    postings = rows.select("id", "dl", F.explode("hits").alias("h")).groupBy("id", "dl", "h.token").agg(F.sum("h.tf").alias("tf"))
    terms = postings.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    terms = terms.select("token", "mean", idf(F.col("n"), F.col("df")).alias("idf"))
    scored = postings.join(terms.join(asked, "token"), "token")
    return scored.groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("mean"))).alias("score"))


def top(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", ties: str = "id") -> DataFrame:
    """The k best rows for each question, with their rank; scores equal to nine places go by the smaller id."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_query(chunks: DataFrame, questions: DataFrame, id_col: str, text: Column, k: int = TOP_K) -> DataFrame:
    """(question_id, id, bm25): several queries of a question, each cut to its k best, and the best score of each chunk.

    questions: (question_id, queries array).
    """
    return _best_of(bm25(chunks, _fan(questions), id_col, text), k)


def _fan(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.posexplode("queries").alias("i", "query")).withColumn("query_id", F.struct("question_id", "i"))


def _best_of(scores: DataFrame, k: int) -> DataFrame:
    best = top(scores.where("score > 0"), k)
    return best.groupBy(F.col("query_id.question_id").alias("question_id"), "id").agg(F.max("score").alias("bm25"))


def composite_rank(chunks: DataFrame, questions: DataFrame, id_col: str, text_col: str, heading: Column, file: Column, k: int = TOP_K) -> DataFrame:
    """(question_id, id, retrieval_score, rank): BM25, phrases in text and heading, and the share of the question's tokens.

    questions: (question_id, queries, key_terms, sub_questions, hypothetical_answer, focus, hinted_files). Chunks of a
    hinted file weigh HINT_BOOST. Ties go to the smaller id.
    """
    fanned = questions.select("question_id", F.concat(F.slice("queries", 1, 1), F.array(F.array_join("key_terms", " ")), "sub_questions").alias("queries"))
    fan = _asked(_fan(fanned))
    said = F.concat_ws(" ", F.array_join("queries", " "), F.array_join("key_terms", " "), F.array_join("sub_questions", " "), "hypothetical_answer", "focus")
    asked = questions.select("question_id", F.array_distinct(T.content_tokens(said)).alias("asked"), F.transform("key_terms", F.lower).alias("phrases"), "hinted_files")
    tokens = asked.select("question_id", F.size("asked").alias("n"), F.explode("asked").alias("token"))
    phrases = asked.select("question_id", F.explode("phrases").alias("phrase"))
    rows = chunks.select(F.col(id_col).alias("id"), file.alias("file"), F.lower(text_col).alias("low"), F.lower(F.coalesce(heading, F.lit(""))).alias("head"), T.content_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("own"), T.content_tokens(F.coalesce(heading, F.lit(""))).alias("above"))
    for one in (_wanted(fan, "wanted"), _wanted(tokens, "share"), _wanted(phrases, "phrases", "phrase")):
        rows = rows.crossJoin(F.broadcast(one))
    # phrases may stand within words, so each one is looked for; what finds none leaves no row
    bonus = F.transform("phrases", lambda p: F.struct(p.alias("phrase"), (PHRASE_BONUS * F.contains("low", p).cast("int") + HEADING_BONUS * F.contains("head", p).cast("int")).alias("extra")))
    # a text is read once; a heading's tokens come before its own, which no token joins over the space between them
    rows = rows.withColumn("indexed", F.concat("above", "own")).select("id", "file", F.size("indexed").alias("dl"), _hits("indexed", "wanted").alias("hits"), F.array_intersect("own", "share").alias("own"), F.filter(bonus, lambda x: x["extra"] > 0).alias("said"))
    rows = cut(rows)
    best = _best_of(_scores(rows, fan), TOP_K)
    # the share of a question's tokens, by token
    shared = rows.select("id", F.explode("own").alias("token")).join(tokens, "token").groupBy("question_id", "id").agg((F.count("*") / F.first("n")).alias("extra"))
    said_in = rows.select("id", F.explode("said").alias("x")).select("id", F.col("x.phrase").alias("phrase"), F.col("x.extra").alias("extra")).join(phrases, "phrase")
    parts = shared.select("question_id", "id", "extra").unionByName(said_in.select("question_id", "id", "extra")).unionByName(best.select("question_id", "id", F.col("bm25").alias("extra")))
    each = parts.groupBy("question_id", "id").agg(F.sum("extra").alias("raw")).join(rows.select("id", "file"), "id")
    each = each.join(asked.select("question_id", "hinted_files"), "question_id")
    boost = F.when(F.array_contains("hinted_files", F.col("file")), HINT_BOOST).otherwise(1.0)
    scored = each.select("question_id", "id", (F.col("raw") * boost).alias("raw")).where("raw > 0")
    ranked = top(scored, k, "question_id", "raw")
    return ranked.select("question_id", "id", F.round("raw", 6).alias("retrieval_score"), "rank")


def fuse_ranks(rankings: list[DataFrame], k: int = 60, by: str = "query_id") -> DataFrame:
    """(by, id, rrf): sum of 1 / (k + rank) over rankings (by, id, rank)."""
    rows = rankings[0].select(by, "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(by, "id", "rank"))
    return rows.groupBy(by, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def _grams(token: Column) -> Column:
    """Distinct runs of three characters of a token between two marks."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def late_interaction(ranked: DataFrame, questions: DataFrame, texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(question_id, id, maxsim, rank): a second ranking of the best rows (question_id, id) of a first one.

    Each token of the question (question_id, query) takes the token of the text that is most like it, by the cosine of their
    character trigrams; a row's score is the sum over the question's distinct tokens, so that other forms of a word count
    where BM25 wants the same one. Tokens meet by a trigram that they share. Rows without any such token score 0. Ties go to
    the smaller id. The work follows the rows of the first ranking, whose number for a question is its k.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(T.content_tokens(F.col("query")))).alias("asked"))
    best = ranked.select("question_id", "id")
    told = texts.select(F.col(id_col).alias("id"), text.alias("text")).join(best.select("id").distinct(), "id", "left_semi")
    held = told.select("id", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("held"))
    split = lambda df, c, n: df.withColumn("grams", _grams(F.col(c))).withColumn(n, F.size("grams")).withColumn("gram", F.explode("grams")).drop("grams")
    rows = best.join(split(held, "held", "nh"), "id")
    met = rows.join(split(asked, "asked", "na"), ["question_id", "gram"]).groupBy("question_id", "id", "asked", "held", "na", "nh").agg(F.count("*").alias("both"))
    like = met.groupBy("question_id", "id", "asked").agg(F.max(F.col("both") / F.sqrt(F.col("na") * F.col("nh").cast("double"))).alias("like"))
    sums = like.groupBy("question_id", "id").agg(F.sum("like").alias("maxsim"))
    scored = best.join(sums, ["question_id", "id"], "left").select("question_id", "id", F.coalesce("maxsim", F.lit(0.0)).alias("maxsim"))
    w = Window.partitionBy("question_id").orderBy(F.round("maxsim", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w))
