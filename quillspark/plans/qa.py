"""Questions to answers in one lazily planned job for all questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import passages as P
from quillspark.operators.retrieval import composite_rank

# Passages for each kind of question, and characters of parents, windows and prompts.
PASSAGES, PASSAGES_COMPARED, MOST_PASSAGES, PARENT_CHARS, WINDOW_CHARS, PROMPT_CHARS, QUESTION_CHARS = 5, 6, 8, 1800, 900, 7000, 500
EMPTY = "array<string>"


def understand(questions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What retrieval needs to know of each question (question_id, question); columns that a model has filled in are kept.

    Without a model the intent is other and the key terms are the first six content tokens. The question itself leads
    the queries. `files` (source_file) resolves a document hint.
    """
    q = T.cap(F.col("question"), QUESTION_CHARS)
    have = set(questions.columns)
    col = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    none = F.array().cast(EMPTY)
    tokens = F.slice(T.content_tokens(q), 1, 6)
    fallback = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.left(q, F.lit(60))))
    terms = T.ordered_distinct(col("key_terms", none), 60, 6)
    out = questions.select(
        "question_id",
        q.alias("question"),
        col("intent", F.lit("other")).alias("intent"),
        col("answer_type", F.lit("paragraph")).alias("answer_type"),
        T.cap(col("focus", F.lit("")), 50).alias("focus"),
        F.when(F.size(terms) > 0, terms).otherwise(fallback).alias("key_terms"),
        F.concat(F.array(q), T.ordered_distinct(col("queries", none), 160, 3)).alias("queries"),
        T.cap(col("hypothetical_answer", F.lit("")), 300).alias("hypothetical_answer"),
        F.slice(col("sub_questions", none), 1, 3).alias("sub_questions"),
        col("doc_hint", F.lit(None).cast("string")).alias("doc_hint"),
    )
    if files is None:
        return out.withColumn("hinted_files", none)
    names = files.select("source_file").distinct()
    any_of = names.agg(F.coalesce(F.max(F.lower("source_file").endswith(".pptx")), F.lit(False)).alias("s"), F.coalesce(F.max(F.lower("source_file").endswith(".pdf")), F.lit(False)).alias("n"))
    hints = out.where("doc_hint is not null").select("question_id", "doc_hint").join(names.crossJoin(F.broadcast(any_of)), T.hinted(F.col("source_file"), F.col("doc_hint"), F.col("s"), F.col("n")))
    return out.join(hints.groupBy("question_id").agg(F.collect_set("source_file").alias("hinted_files")), "question_id", "left").withColumn("hinted_files", F.coalesce("hinted_files", none))


def ask(chunks: DataFrame, questions: DataFrame, relevant: Column | None = None, generate: Column | None = None) -> DataFrame:
    """(question_id, question, status, answer, partial, context, passages) of all questions over one session's chunks.

    chunks: (id, chunk_seq, parent_id, source_file, page_or_slide, heading, text); questions as for understand().
    `relevant` is a model's verdict on a passage (missing verdicts count as yes) and `generate` a model's answer from
    `question` and `context`; without one the best evidence windows are the answer.
    """
    known = understand(questions, chunks)
    ranked = composite_rank(chunks, known, "id", "text", F.col("heading"), F.col("source_file"))
    rows = ranked.join(chunks, "id").join(known.select("question_id", "intent", "question"), "question_id")
    rows = rows.where(F.coalesce(relevant, F.lit(True))) if relevant is not None else rows
    wanted = F.when(F.col("intent") == "comparison", PASSAGES_COMPARED).otherwise(PASSAGES)
    first = P.dedupe_parents(rows, PASSAGES_COMPARED)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    first = first.withColumn("__n", place).where(F.col("__n") <= wanted).drop("__n")
    chosen = P.cover_files(rows, first, MOST_PASSAGES)
    whole = chunks.groupBy("parent_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "text"))), lambda x: x["text"]), "\n"), F.lit(PARENT_CHARS)).alias("parent_text"))
    told = chosen.join(whole, "parent_id").withColumn("pid", place)
    told = told.withColumn("window", P.best_window(P.evidence_sentences(F.col("parent_text"), WINDOW_CHARS), WINDOW_CHARS))
    told = told.withColumn("block", P.context_block(F.col("source_file"), F.col("page_or_slide"), F.col("heading"), F.col("window.text")))
    fits = P.within_budget(told, PROMPT_CHARS, "pid", F.length("block"), few=True)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pid", c))), lambda x: x[c])
    found = fits.withColumn("window_text", F.col("window.text")).groupBy("question_id").agg(F.array_join(in_order("block"), "\n\n").alias("context"), F.array_join(F.slice(in_order("window_text"), 1, 2), " ").alias("extract"), in_order("id").alias("passages"))
    out = known.select("question_id", "question", "intent").join(found, "question_id", "left")
    text = T.sanitize_answer(generate if generate is not None else F.col("extract"))
    out = out.withColumn("__a", F.when(F.col("context").isNotNull(), text))
    missing = F.col("__a").isNull() | (F.col("__a") == "") | (F.col("__a") == "NO_ANSWER")
    return out.select("question_id", "question", F.when(missing, "not_found").otherwise("answered").alias("status"), F.when(~missing, F.col("__a")).alias("answer"), (F.col("intent") == "summary").alias("partial"), "context", "passages")
