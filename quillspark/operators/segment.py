"""From sections to sentences, chunks and parents."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.ranges import running


def sections_txt(files: DataFrame, name_col: str = "name", content_col: str = "content", separator: str = r"\n{2,}") -> DataFrame:
    """(source_file, heading, page_or_slide, content): paragraphs between blank lines, numbered after empty ones are gone."""
    parts = F.filter(F.transform(F.split(content_col, separator), T.strip), lambda x: x != "")
    rows = files.select(F.col(name_col).alias("source_file"), F.posexplode(parts).alias("i", "content"))
    return rows.select("source_file", F.concat(F.lit("Section "), F.col("i") + 1).alias("heading"), (F.col("i") + 1).cast("int").alias("page_or_slide"), "content")


def sections_markdown(files: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """(source_file, heading, page_or_slide, content): one section for each heading line that has a body.

    Sections are numbered with those that have no body, and with the empty start of a text that begins with a heading.
    """
    parts = F.split(content_col, r"(?m)(?=^#{1,6}\s)")
    rows = files.select(F.col(name_col).alias("source_file"), F.col(content_col).rlike(r"^#{1,6}\s").cast("int").alias("lead"), F.posexplode(parts).alias("i", "part"))
    part = T.strip(F.col("part"))
    has = part.rlike(r"^#{1,6}\s")
    heading = F.when(has, T.strip(F.regexp_extract(part, r"^#{1,6}\s+([^\n]*)", 1))).otherwise(F.concat(F.lit("Section "), F.col("i") + 1 + F.col("lead")))
    body = F.when(has, T.strip(F.regexp_replace(part, r"^#{1,6}\s[^\n]*", ""))).otherwise(part)
    out = rows.select("source_file", heading.alias("heading"), (F.col("i") + 1 + F.col("lead")).cast("int").alias("page_or_slide"), body.alias("content"))
    return out.where("content <> ''")


def cut_points(distances: Column, n: Column, deviations: float = 1.0, least: int = 2, most: int = 15) -> Column:
    """Where chunks of n sentences begin after the first, from the distances of neighbours.

    A cut falls before sentence i + 1 where distance i exceeds mean + deviations * population deviation and the chunk has
    `least` sentences, or where it has `most`. Mean and limit ride in the folds' states, so each is computed once.
    """
    size = F.size(distances)
    mean = F.aggregate(distances, F.lit(0.0), lambda s, x: s + x) / size
    spread = F.aggregate(distances, F.struct(mean.alias("m"), F.lit(0.0).alias("v")), lambda s, x: F.struct(s["m"].alias("m"), (s["v"] + (x - s["m"]) * (x - s["m"])).alias("v")), lambda s: s["m"] + deviations * F.sqrt(s["v"] / size))
    start = F.struct(spread.alias("limit"), F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        held = s["i"] + 1 - s["at"]
        cut = ((x > s["limit"]) & (held >= least)) | (held >= most)
        return F.struct(s["limit"].alias("limit"), (s["i"] + 1).alias("i"), F.when(cut, s["i"] + 1).otherwise(s["at"]).alias("at"), F.when(cut, F.concat(s["cuts"], F.array(s["i"] + 1))).otherwise(s["cuts"]).alias("cuts"))

    return F.when(n > 2, F.aggregate(distances, start, step)["cuts"]).otherwise(F.array().cast("array<int>"))


def bag_distances(sentences: Column) -> Column:
    """1 - cosine of the token counts of neighbouring sentences; 1 where one has no tokens."""

    @F.pandas_udf("array<double>")
    def run(tokens: pd.Series) -> pd.Series:
        out = []
        for sents in tokens:
            bags = [Counter(s) for s in sents]
            norms = [math.sqrt(sum(c * c for c in b.values())) for b in bags]
            out.append([1.0 - sum(c * b[t] for t, c in a.items()) / (na * nb) if na and nb else 1.0 for a, b, na, nb in zip(bags, bags[1:], norms, norms[1:])])
        return pd.Series(out)

    return run(F.transform(sentences, T.content_tokens))


def semantic_chunks(sections: DataFrame, keys: list[str], content_col: str = "content", distances=bag_distances) -> DataFrame:
    """(keys, cut, start, end, text): sentences grouped where neighbours are alike.

    `distances` maps an array of sentences to the distances of neighbours, as an embedding model would; the default
    compares counts of content tokens. Sections of one or two sentences are one chunk; without sentences they give none.
    """
    rows = sections.select(*keys, T.sentences_chunker(F.col(content_col)).alias("ss")).withColumn("n", F.size("ss")).where("n > 0")
    rows = rows.withColumn("ds", distances(F.col("ss")))
    edges = F.concat(F.array(F.lit(0)), cut_points(F.col("ds"), F.col("n")), F.array(F.col("n")))
    # the sentences pass the fold as they are; spans come from the cuts alone
    rows = rows.select(*keys, "ss", edges.alias("edges")).select(*keys, "ss", "edges", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("cut", "start"))
    end = F.get("edges", F.col("cut") + 1)
    return rows.select(*keys, "cut", "start", end.alias("end"), F.array_join(F.slice("ss", F.col("start") + 1, end - F.col("start")), " ").alias("text"))


def number_chunks(chunks: DataFrame, session_col: str, order: list[str]) -> DataFrame:
    """Chunk ids that run on through a session: {session}_chunk_0000 and so on; a session of any size is numbered by ranges."""
    numbered = running(chunks, [session_col], [F.col(c) for c in order], {"chunk_seq": F.lit(1)}).withColumn("chunk_seq", F.col("chunk_seq") - 1)
    return numbered.withColumn("id", F.concat(F.col(session_col), F.lit("_chunk_"), F.format_string("%04d", "chunk_seq")))


def parents(chunks: DataFrame, key: str = "parent_id", seq: str = "chunk_seq", text: str = "text", separator: str = "\n", most: int | None = None) -> DataFrame:
    """(key, first_seq, n, text): the texts of a parent's chunks in order, cut at `most` characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator)
    return chunks.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"), (F.left(joined, F.lit(most)) if most else joined).alias("text"))


def first_in_group(chunks: DataFrame, key: str, seq: str, attributes: list[str]) -> DataFrame:
    """(key, first_seq, first_...): attributes of the first row of each group; first_seq orders the groups."""
    return chunks.groupBy(key).agg(F.min(seq).alias("first_seq"), *(F.min_by(a, seq).alias(f"first_{a}") for a in attributes))


def drop_repeats(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row by `order` (which identifies rows) of those with equal text but for case and white space.

    Keys and order columns alone are compared, so no text moves and a text that many rows share is summed up in parts.
    """
    first = rows.select(T.dedupe_key(F.col(text)).alias("__key"), F.struct(*order).alias("__first")).groupBy("__key").agg(F.min("__first").alias("__first"))
    return rows.join(first.select("__first.*"), order, "left_semi")


def entities(c: Column) -> Column:
    """Capitalised phrases, acronym runs and words with typical endings (lower case), each once.

    Letters of all scripts make up words, so an accented one ends no phrase and tears no word; phrases and runs are of
    plain letters.
    """
    phrases = F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), F.lit(1))
    codes = F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z]{2,}[a-z]*(?:\s*[A-Z]{2,}[a-z]*)*)\b"), F.lit(1))
    ends = F.regexp_extract_all(c, F.lit(r"(?iU)\b(\w++(?<=\w(?:ing|tion|ment|ity|ness|ance|ence|ism|ist|ics|ology|graphy)))\b"), F.lit(1))
    return F.array_distinct(F.concat(F.transform(phrases, T.strip), F.transform(codes, T.strip), F.transform(F.filter(ends, lambda x: F.length(x) >= 5), F.lower)))


def acronyms(c: Column) -> Column:
    """[(acronym, expansion)] from `Long Form (ABC)`, as keys, where the initials are or contain the acronym."""
    pattern = F.lit(r"\b([A-Z][A-Za-z0-9\s\-]{2,40}?)\s*\(([A-Z0-9]{2,8})\)")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("long"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("short"))

    def fits(p: Column) -> Column:
        words = F.filter(F.split(p["long"], r"[\s\-]+"), lambda w: w != "")
        initials = F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
        return F.contains(initials, F.upper(p["short"]))

    named = F.transform(F.filter(pairs, fits), lambda p: F.struct(T.normalize_key(p["short"]).alias("acronym"), T.normalize_key(p["long"]).alias("expansion")))
    return F.filter(named, lambda p: (p["acronym"] != "") & (p["expansion"] != "") & (p["acronym"] != p["expansion"]))


def acronym_aliases(rows: DataFrame, text: str, seq: str) -> DataFrame:
    """(acronym, expansion): the last definition of each acronym by `seq`."""
    found = rows.select(F.col(seq).alias("s"), F.posexplode(acronyms(F.col(text))).alias("i", "p"))
    return found.groupBy(F.col("p.acronym").alias("acronym")).agg(F.max_by("p.expansion", F.struct("s", "i")).alias("expansion"))
