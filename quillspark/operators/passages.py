"""From ranked chunks to evidence: parents, windows, budgets and context blocks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.ranges import running


def dedupe_parents(ranked: DataFrame, k: int, question: str = "question_id", parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """The best row of each parent, then the first k."""
    best = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(question, parent).orderBy(rank))).where("__n = 1")
    return best.withColumn("__n", F.row_number().over(Window.partitionBy(question).orderBy(rank))).where(F.col("__n") <= k).drop("__n")


def cover_files(ranked: DataFrame, chosen: DataFrame, most: int = 8, question: str = "question_id", parent: str = "parent_id", file: str = "source_file", rank: str = "rank") -> DataFrame:
    """The chosen rows and, for each file that they leave out, its best row of another parent; `most` rows in all."""
    left = ranked.join(chosen.select(question, file).distinct(), [question, file], "left_anti").join(chosen.select(question, parent).distinct(), [question, parent], "left_anti")
    extra = left.withColumn("__n", F.row_number().over(Window.partitionBy(question, file).orderBy(rank))).where("__n = 1").drop("__n")
    both = chosen.withColumn("__late", F.lit(0)).unionByName(extra.select(chosen.columns).withColumn("__late", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(question).orderBy("__late", rank))).where(F.col("__n") <= most).drop("__n", "__late")


def _rounded(x: float) -> int:
    whole = math.floor(x)
    return whole + (x - whole >= 0.5)


def best_span(sentences: list[str], most: int = 900) -> tuple[int, int, float]:
    """(start, end, score) of the neighbours with the largest sum of 1 - i / 2n within `most` characters; (0, 1) if none fits.

    Scores are positive, so for each start the longest span that fits is best; the first of equal spans wins.
    """
    n = len(sentences)
    # in whole ten-thousandths, halves up, so that equal sums are equal
    score = [_rounded((1.0 - 0.5 * i / n) * 10_000) for i in range(n)]
    best, end, chars, held = None, 0, 0, 0
    for a in range(n):
        if end < a:
            end, chars, held = a, 0, 0
        while end < n and chars + len(sentences[end]) <= most:
            chars, held, end = chars + len(sentences[end]), held + score[end], end + 1
        if end > a:
            if best is None or held > best[2]:
                best = (a, end, held)
            chars, held = chars - len(sentences[a]), held - score[a]
    a, end, held = best or (0, 1, score[0])
    return a, end, held / 10_000


def best_window(sentences: Column, most: int = 900) -> Column:
    """(start, end, score, text) of the best span of each array of sentences; null for an empty one."""

    @F.pandas_udf("start int, end int, score double, text string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            if x is None or not len(x):
                rows.append((None, None, None, None))
                continue
            a, b, v = best_span(list(x), most)
            rows.append((a, b, round(v, 4), " ".join(x[a:b])))
        out = pd.DataFrame(rows, columns=["start", "end", "score", "text"])
        return out.astype({"start": "Int32", "end": "Int32", "score": "Float64"})

    return run(sentences)


def evidence_sentences(text: Column, most: int | None = None) -> Column:
    """Sentences of a text; if none is left, the text is one, its first `most` characters if given."""
    found = T.sentences_qa(text)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text if most is None else F.left(text, F.lit(most))))


def within_budget(blocks: DataFrame, most: int, order: str, length: Column, by: str = "question_id", keep_first: bool = True, few: bool = False) -> DataFrame:
    """Rows up to the first whose running length exceeds `most`; the first row stays in any case if asked.

    Groups of any size are summed up by ranges. `few` says that each has but a few rows, which saves counting them.
    """
    sums = {"__sum": length, "__n": F.lit(1)}
    if few:
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        run = blocks.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    else:
        run = running(blocks, [by], [F.col(order)], sums)
    fits = F.col("__sum") <= most
    return run.where(fits | (F.col("__n") == 1) if keep_first else fits).drop("__sum", "__n")


def context_block(file: Column, page: Column, heading: Column, body: Column) -> Column:
    """[Source: f | Page n | Section: h] and the body; a heading that only repeats the page is left out."""
    plain = F.concat(F.lit("Page "), page.cast("string"))
    section = F.when((F.coalesce(heading, F.lit("")) != "") & (heading != plain), F.concat(F.lit("Section: "), heading))
    return F.concat(F.lit("["), F.concat_ws(" | ", F.concat(F.lit("Source: "), file), plain, section), F.lit("]\n"), body)


def not_found_gate(ranked: DataFrame, relevant: Column, closest: int = 3, question: str = "question_id", text: str = "text") -> DataFrame:
    """(question, status, closest): questions without a relevant row are not found and show the closest texts."""
    w = Window.partitionBy(question).orderBy("rank")
    rows = ranked.withColumn("__rel", F.coalesce(relevant, F.lit(True)).cast("int")).withColumn("__n", F.row_number().over(w))
    near = F.collect_list(F.when(F.col("__n") <= closest, F.struct("__n", F.left(text, F.lit(300)).alias("t"))))
    g = rows.groupBy(question).agg(F.max("__rel").alias("any"), F.array_sort(near).alias("near"))
    return g.select(question, F.when(F.col("any") == 1, "ok").otherwise("not_found").alias("status"), F.when(F.col("any") == 0, F.transform("near", lambda x: x["t"])).alias("closest"))
