"""Checking and polishing answers against their evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# What a sentence needs to stand, when claims are the same, and lengths by intent.
SUPPORT, ANCHOR, SAME, LEAST_WORDS, MOST_HEADINGS, MOST_POINTS = 0.70, 0.30, 0.8, 15, 3, 5
TARGET_WORDS = {"fact": 70, "definition": 100, "numeric": 50, "yes_no": 60, "list": 140, "comparison": 200, "procedure": 160, "explanation": 200, "summary": 220, "other": 120}


def supported(sentence: Column, references: Column) -> Column:
    """A sentence's stems are covered by the references, well by a single one, and its numbers occur there."""
    stems = T.stemmed_tokens(sentence)
    each = F.transform(references, T.stemmed_tokens)
    n = F.size(stems)
    covered = F.size(F.array_intersect(stems, F.flatten(each))) / n
    anchor = F.coalesce(F.array_max(F.transform(each, lambda r: F.size(F.array_intersect(stems, r)) / n)), F.lit(0.0))
    known = T.numbers(F.array_join(references, " "))
    return (n > 0) & (covered >= SUPPORT) & (anchor >= ANCHOR) & (F.size(F.array_except(T.numbers(sentence), known)) == 0)


def count_supported(sentences: DataFrame, references: DataFrame, by: str, sentence: str = "s", text: str = "text") -> DataFrame:
    """(by, n, supported): sentences and those that all references support as `supported` says, by the references' inverted terms.

    Stems and numbers meet references in joins, so no sentence is held against every reference.
    """
    refs = references.select(F.monotonically_increasing_id().alias("__ref"), T.stemmed_tokens(F.col(text)).alias("__st"), F.array_distinct(T.numbers(F.col(text))).alias("__nu"))
    stems = refs.select("__ref", F.explode("__st").alias("__term"))
    numbers = refs.select(F.explode("__nu").alias("__term")).distinct()
    # a stem has no mark, so that numbers are told from it
    known = stems.select("__term").distinct().union(numbers.select(F.concat(F.lit("#"), "__term"))).withColumn("__known", F.lit(1))

    rows = sentences.select(F.monotonically_increasing_id().alias("__row"), by, T.stemmed_tokens(F.col(sentence)).alias("__st"), F.array_distinct(T.numbers(F.col(sentence))).alias("__nu"))
    terms = rows.withColumn("__term", F.explode_outer(F.concat("__st", F.transform("__nu", lambda x: F.concat(F.lit("#"), x)))))
    is_stem = ~F.startswith("__term", F.lit("#"))
    met = terms.join(known, "__term", "left").groupBy("__row", by, "__st", F.size("__nu").alias("__m"))
    met = met.agg(F.count_if(is_stem & F.col("__known").isNotNull()).alias("__c"), F.count_if(~is_stem & F.col("__known").isNotNull()).alias("__k"))
    n = F.size("__st")
    met = met.withColumn("__ok", (n > 0) & (F.col("__c") / n >= SUPPORT) & (F.col("__k") == F.col("__m")))

    # only what passes so far looks for its best single reference
    near = met.select("__row", by, n.alias("__n"), F.explode_outer(F.when(F.col("__ok"), F.col("__st"))).alias("__term")).join(stems, "__term", "left")
    best = near.groupBy("__row", by, "__n", "__ref").agg(F.count_if(F.col("__ref").isNotNull()).alias("__h")).groupBy("__row", by, "__n").agg(F.max("__h").alias("__h"))
    return best.groupBy(by).agg(F.count("*").alias("n"), F.count_if((F.col("__h") > 0) & (F.col("__h") / F.col("__n") >= ANCHOR)).alias("supported"))


def keep_claims(claims: DataFrame, by: str = "answer_id") -> DataFrame:
    """Quotes, verified paraphrases and well supported claims; all of them where none is such."""
    good = (F.col("kind") == "quote") | ((F.col("kind") == "paraphrase") & F.coalesce("verified", F.lit(False))) | (F.coalesce("support_score", F.lit(0.0)) >= SUPPORT)
    w = Window.partitionBy(by)
    return claims.withColumn("__g", good).withColumn("__n", F.sum(F.col("__g").cast("int")).over(w)).where("__g or __n = 0").drop("__g", "__n")


def dedupe_claims(claims: Column, least: float = SAME) -> Column:
    """Claims [{text, support}] in order, each joined to the first kept one that it resembles; their supports are united."""
    kind = "array<struct<text:string,support:array<string>,stems:array<string>>>"
    start = F.array().cast(kind)

    def step(kept: Column, c: Column) -> Column:
        stems = T.stemmed_tokens(c["text"])
        at = F.array_position(F.transform(kept, lambda k: T.jaccard(stems, k["stems"]) >= least), True)
        merged = F.transform(kept, lambda k, i: F.struct(k["text"].alias("text"), F.when(i + 1 == at, F.array_union(k["support"], c["support"])).otherwise(k["support"]).alias("support"), k["stems"].alias("stems")))
        return F.when(at > 0, merged).otherwise(F.concat(kept, F.array(F.struct(c["text"].alias("text"), c["support"].alias("support"), stems.alias("stems")))).cast(kind))

    kept = F.aggregate(claims, start, step)
    return F.transform(kept, lambda k: F.struct(k["text"].alias("text"), k["support"].alias("support")))


def to_verify(claims: DataFrame, by: str = "answer_id", most: int = 3) -> DataFrame:
    """The claims that a judge should see: weak ones first, then paraphrases, `most` for each answer."""
    w = Window.partitionBy(by).orderBy((F.col("kind") != "weak").cast("int"), "claim_no")
    return claims.where(F.col("kind").isin("weak", "paraphrase")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def apply_verdicts(claims: DataFrame, verdicts: DataFrame, by: str = "answer_id") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) claims by verdicts (answer, claim_no, holds); without a verdict a claim stays. Quotes are verified."""
    told = claims.join(verdicts, [by, "claim_no"], "left").withColumn("verified", (F.col("kind") == "quote") | F.coalesce("holds", F.lit(False)))
    out = F.coalesce("holds", F.lit(True))
    return told.where(out).drop("holds"), told.where(~out).drop("holds")


def extractive_fallback(windows: DataFrame, by: str = "answer_id", most: int = 2) -> DataFrame:
    """Claims from the best evidence sentences (answer, sid, text, score)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "sid")
    best = windows.withColumn("claim_no", F.row_number().over(w)).where(F.col("claim_no") <= most)
    return best.select(by, "claim_no", "text", F.array("sid").alias("support"), F.lit("extractive_fallback").alias("kind"), F.lit(1.0).alias("support_score"), F.lit(True).alias("verified"))


def structure_line(target: Column) -> Column:
    return F.when(target <= 100, "short paragraphs").when(target <= 160, "paragraphs or one list").otherwise("up to three subheadings")


def target_words(intent: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in TARGET_WORDS.items() for x in (k, v)))
    return F.coalesce(table[intent], F.lit(TARGET_WORDS["other"]))


# Signs that part blocks, and lead headings and bullets, while an answer is taken apart.
_END, _HEAD, _POINT = "\x1e", "\x1d", "\x1f"


def answer_blocks(markdown: Column) -> Column:
    """[(kind, text)] of an answer: paragraphs, headings of up to six words (three at most) and bullets.

    Every line is marked by what it is; joined by spaces and parted at the marks, text lines that follow each other are
    one paragraph.
    """
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(markdown, F.lit("")), r"\r\n?", "\n"), "\n"), T.strip)

    def marked(x: Column) -> Column:
        head, point = F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1), F.regexp_extract(x, r"^(?:[-*]|\d+\.)\s+(.+)$", 1)
        title = F.array_join(F.slice(F.split(T.strip(F.regexp_replace(T.strip(head), r"[.:;,!?]+$", "")), r"\s+"), 1, 6), " ")
        return F.when(head != "", F.concat(F.lit(_END + _HEAD), title, F.lit(_END))).when(point != "", F.concat(F.lit(_END + _POINT), T.strip(point), F.lit(_END))).when(x == "", _END).otherwise(x)

    parts = F.filter(F.transform(F.split(F.array_join(F.transform(lines, marked), " "), _END), T.strip), lambda x: ~x.isin("", _HEAD, _POINT))
    parts = F.filter(parts, lambda x, i: ~F.startswith(x, F.lit(_HEAD)) | (F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: F.startswith(y, F.lit(_HEAD)))) <= MOST_HEADINGS))
    kind = lambda x: F.when(F.startswith(x, F.lit(_HEAD)), "heading").when(F.startswith(x, F.lit(_POINT)), "bullet").otherwise("paragraph")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), F.when(F.startswith(x, F.lit(_HEAD)), F.concat(F.lit("### "), F.substr(x, F.lit(2)))).when(F.startswith(x, F.lit(_POINT)), F.substr(x, F.lit(2))).otherwise(x).alias("text")))


def blocks(markdown: str) -> list[tuple[str, str]]:
    """answer_blocks of one text, without a session."""
    text = "\n".join(map(str.strip, (markdown or "").splitlines()))
    short = lambda m: " ".join(m[1].strip().rstrip(".:;,!?").split()[:6])
    text = re.sub(r"(?m)^#{1,6}[ \t]+(.+)$", lambda m: f"{_END}{_HEAD}{short(m)}{_END}", text)
    text = re.sub(r"(?m)^(?:[-*]|\d+\.)[ \t]+(.+)$", lambda m: f"{_END}{_POINT}{m[1].strip()}{_END}", text)
    parts = [x for x in (p.strip(" \n") for p in re.split(rf"{_END}|\n\n+", text)) if x not in ("", _HEAD, _POINT)]
    late = [p for p in parts if p[0] == _HEAD][MOST_HEADINGS:]
    names = {_HEAD: ("heading", "### "), _POINT: ("bullet", "")}
    told = [(*names.get(p[0], ("paragraph", p[0])), p[1:].replace("\n", " ")) for p in parts if not late or not any(p is x for x in late)]
    return [(kind, lead + rest) for kind, lead, rest in told]


def drop_bare_headings(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without headings that nothing follows, and without those before any text."""
    out: list[tuple[str, str]] = []
    for kind, text in reversed(parts):
        if kind != "heading" or (out and out[0][0] != "heading"):
            out.insert(0, (kind, text))
    while out and out[0][0] == "heading":
        out.pop(0)
    return out


def render(parts: list[tuple[str, str]]) -> str:
    """Markdown of blocks: blank lines between them, none between bullets of a list."""
    out = ""
    for i, (kind, text) in enumerate(parts):
        gap = "" if not i else "\n" if kind == "bullet" == parts[i - 1][0] else "\n\n"
        out += gap + (f"- {text}" if kind == "bullet" else text)
    return out


def polish(markdown: str, holds, target: int, fallback: str) -> tuple[str, list[str]]:
    """(text, dropped): blocks whose sentences hold, within 1.6 times the target; the fallback if too little is left."""
    dropped, kept = [], []
    for kind, text in blocks(markdown):
        if kind == "heading":
            kept.append((kind, text))
            continue
        units = [text] if kind == "bullet" else re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", text)
        good = [u for u in units if holds(u)]
        dropped += [u for u in units if not holds(u)]
        if good:
            kept.append((kind, " ".join(good)))
    kept = drop_bare_headings(kept)
    while kept and len(render(kept).split()) > int(target * 1.6):
        kept = drop_bare_headings(kept[:-1])
    text = render(kept)
    if not any(k == "paragraph" for k, _ in kept) or len(text.split()) < LEAST_WORDS:
        return fallback or "No answer could be determined from the documents.", dropped
    return text, dropped
