"""Text functions as column expressions; all stay on the JVM and inside code generation where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that content tokens leave out.
STOPWORDS = (
    "the and for are but not you all can had her was one our out has have been from this that with they will each make "
    "like into some then than them very when what your how its also more these about which would there their other"
).split()
# Words that concept tokens leave out, and names too general for a concept.
CONCEPT_STOPWORDS = "a an the and or in on at to for of with by from as is are was were be been that this it its into their such".split()
GENERIC_NAMES = "paper method approach model results figure table section data system work".split()
# Endings that the light stemmer takes off, in order of trial.
STEM_ENDINGS = ("ing", "ies", "es", "ed", "ly", "s")

WHITE = " \t\n\r\f\u000b"


def words_in(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def content_tokens(c: Column) -> Column:
    """Lower-case runs of letters a-z and digits, longer than two, without stop words; repeats and order stay."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))


def normalize(c: Column) -> Column:
    """Lower case, straight quotes, plain hyphens, single spaces."""
    return collapse(F.translate(F.lower(c), "‘’“”–—", "''\"\"--"))


def normalize_key(c: Column) -> Column:
    """Key of a concept's name: no punctuation but hyphens, no leading article, no plural s."""
    bare = collapse(F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s\-]", ""))
    bare = strip(F.regexp_replace(bare, "^(?:the|a|an) ", ""))
    return F.when((F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss"), strip(F.left(bare, F.length(bare) - 1))).otherwise(bare)


def light_stem(w: Column) -> Column:
    """Take off the first of the endings that leaves three letters."""
    out = w
    for ending in reversed(STEM_ENDINGS):
        cut = F.left(w, F.length(w) - len(ending))
        out = F.when(w.endswith(ending) & (F.length(w) >= len(ending) + 3), F.concat(cut, F.lit("y")) if ending == "ies" else cut).otherwise(out)
    return out


def stemmed_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(content_tokens(c), light_stem))


def _without_thoughts_and_fences(c: Column, label: str) -> Column:
    c = F.regexp_replace(c, r"(?is)<(think|thought|reasoning)>.*?</\1>", "")
    c = F.regexp_replace(c, r"```[a-zA-Z0-9_-]*\n?", "")
    c = F.regexp_replace(c, "```", "")
    return F.regexp_replace(c, rf"(?im)^\s*{label}\s*", "")


def sanitize_answer(c: Column) -> Column:
    """A model's answer without hidden reasoning, code fences, answer labels, tags and runs of blank lines."""
    c = _without_thoughts_and_fences(F.coalesce(c, F.lit("")), "(?:Final\\s+)?Answer:")
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\n{3,}", "\n\n"))


def sanitize_markdown(c: Column) -> Column:
    """As sanitize_answer, and without images, links, addresses and emphasis; bullets become hyphens."""
    c = _without_thoughts_and_fences(F.coalesce(c, F.lit("")), "Answer:")
    for pattern, by in ((r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", ""), (r"<[^>]+>", ""), (r"(?m)^[+*]\s+", "- "), (r"[*_]", "")):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def strip_citations(c: Column) -> Column:
    """Without citation marks such as [2.3]."""
    return collapse(F.regexp_replace(c, r"\s*\[[a-zA-Z0-9_.]+\]", ""))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([*_`])", r"\\$1")


def script_safe(c: Column) -> Column:
    """JSON text that may stand within a script element."""
    for ch in ("&", "<", ">", "\u2028", "\u2029"):
        c = F.replace(c, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return c


def cap(c: Column, n: int) -> Column:
    return strip(F.left(F.coalesce(c, F.lit("")), F.lit(n)))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b\d+(?:\.\d+)?%?\b"), F.lit(0))


def word_count(c: Column) -> Column:
    """Number of runs without white space."""
    return F.size(F.filter(F.split(strip(c), r"\s+"), lambda x: x != ""))


def phrase_hits(text: Column, phrases: Column) -> Column:
    """How many of the phrases occur within the text."""
    return F.size(F.filter(phrases, lambda p: F.contains(text, p)))


def coverage(items: Column, wanted: Column) -> Column:
    """Share of `wanted` (distinct) found in `items`; 0 if either is empty."""
    w = F.array_distinct(wanted)
    hit = F.size(F.array_intersect(w, items))
    return F.when((F.size(w) > 0) & (F.size(items) > 0), hit / F.size(w)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def sentences_plain(c: Column) -> Column:
    """Split after . ! ? and white space; nothing is dropped."""
    return F.split(strip(c), r"(?<=[.!?])\s+")


def sentences_chunker(c: Column, least: int = 10) -> Column:
    """Sentences for chunking: stripped, of ten characters or more."""
    return F.filter(F.transform(sentences_plain(c), strip), lambda x: F.length(x) >= least)


def sentences_qa(c: Column, least: int = 12) -> Column:
    """Sentences for evidence: lines first, then sentence ends before a capital, digit, quote or bracket.

    Fragments under twelve characters stay only if they look like headings: a capital first and no stop last.
    """
    lines = F.filter(F.transform(F.split(strip(c), "\n+"), strip), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.filter(parts, lambda x: (F.length(x) >= least) | (x.rlike(r"^\p{Lu}") & ~x.endswith(".")))


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"\P{Nd}", "")) / F.length(c)).otherwise(F.lit(0.0))


# Fixed value: what marks a line of a reference list.
REFERENCE_LINE = r"(?i)et al\.|arXiv|pp\.|\b(19|20)\d{2}\b.*\.$|doi"


def reference_ratio(c: Column) -> Column:
    """Share of lines that aren't blank and look like references."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(REFERENCE_LINE))) / F.size(lines)).otherwise(F.lit(0.0))


def is_boilerplate(c: Column, least: int = 200, digits: float = 0.35, references: float = 0.30) -> Column:
    """Too short, mostly digits, or a reference list."""
    return (F.length(c) < least) | (digit_ratio(c) > digits) | (reference_ratio(c) > references)


def dedupe_key(c: Column) -> Column:
    return F.md5(collapse(F.lower(strip(c))))


def truncate_at_boundary(c: Column, most: int = 1200, least: int = 200) -> Column:
    """At most `most` characters, cut after a sentence end or else at a space, where that leaves `least`."""
    head = F.left(c, F.lit(most))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?](?:\s+|$))", 1)
    space = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(sentence) >= least, strip(sentence)).when(F.length(space) >= least, strip(space)).otherwise(strip(head))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def concept_tokens(c: Column) -> Column:
    stop = words_in(CONCEPT_STOPWORDS)
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), lambda x: ~F.array_contains(stop, x))


def is_grounded(name: Column, text: Column, share: float = 0.60) -> Column:
    """A concept's name stands on the text: most of its tokens occur there, or it is a short code found as a word."""
    norm, low = strip(F.lower(name)), F.lower(text)
    tokens = concept_tokens(norm)
    found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    # a code has letters and digits alone, so it needs no quoting in a pattern
    code = strip(name).rlike("^[A-Za-z0-9]{2,6}$") & F.regexp_like(low, F.concat(F.lit("\\b"), norm, F.lit("\\b")))
    return (norm != "") & ~F.array_contains(words_in(GENERIC_NAMES), norm) & (F.size(tokens) > 0) & ((found / F.size(tokens) >= share) | code)


def evidence_sentence(text: Column, source: Column, target: Column, most: int = 200) -> Column:
    """The first sentence with most tokens of both ends, both touched if any sentence does; cut at a word."""
    s, t = F.array_distinct(concept_tokens(source)), F.array_distinct(concept_tokens(target))
    both = F.array_union(s, t)

    def rank(x: Column, i: Column) -> Column:
        own = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0)))
        touched = F.arrays_overlap(s, own) & F.arrays_overlap(t, own)
        return F.struct(touched.alias("both"), F.size(F.array_intersect(both, own)).alias("n"), (-i).alias("i"), x.alias("x"))

    best = F.array_max(F.transform(sentences_plain(text), rank))["x"]
    head = F.left(best, F.lit(most))
    word = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return strip(F.when(F.length(best) > most, F.concat(word, F.lit("…"))).otherwise(best))


def source_type(file: Column) -> Column:
    """Upper-case extension of a file name, or DOC."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(file, r"\.([^.]+)$", 1)), F.lit("")), F.lit("DOC"))


def parent_id(file: Column, heading: Column, page: Column) -> Column:
    return F.concat(file, F.lit("::"), heading, F.lit("::"), page.cast("string"))


def ordered_distinct(items: Column, most_chars: int, most: int) -> Column:
    """Capped items, first spelling of each regardless of case, at most `most`."""

    def add(kept: Column, x: Column) -> Column:
        # an item is held against those kept alone, and no more once they are enough
        c = cap(x, most_chars)
        return F.when(F.size(kept) >= most, kept).when((c == "") | F.exists(kept, lambda k: F.lower(k) == F.lower(c)), kept).otherwise(F.concat(kept, F.array(c)))

    return F.aggregate(items, F.array().cast("array<string>"), add)


def hinted(file: Column, hint: Column, any_slides: Column, any_notes: Column) -> Column:
    """Whether a hint names a file; any_slides and any_notes tell whether a .pptx or .pdf file exists at all."""
    h, f = strip(F.lower(hint)), F.lower(file)
    slides, notes = h.rlike("slides?|presentation|ppt"), h.rlike("notes?|pdf|paper")
    part = F.contains(f, h)
    out = F.when(slides & any_slides, f.endswith(".pptx")).when(~slides & notes & any_notes, f.endswith(".pdf")).otherwise(part)
    return F.coalesce((h != "") & out, F.lit(False))


def display_text(status: Column, polished: Column, answer: Column, lead: Column, points: Column, claims: Column, consolidated: Column) -> Column:
    """What to show for an answer record: not found, polished text, answer, joined points or joined claims."""
    none = F.lit("The documents do not appear to contain an answer to this question.")
    full = lambda a: F.filter(F.transform(a, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    joined = F.array_join(F.concat(full(F.array(lead)), full(F.coalesce(points, F.array().cast("array<string>")))), " ")
    claimed = F.filter(F.coalesce(claims, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return (
        F.when(status == "not_found", none)
        .when(F.coalesce(polished, F.lit("")) != "", strip(polished))
        .when(strip(F.coalesce(answer, F.lit(""))) != "", strip(answer))
        .when(consolidated, strip_citations(joined))
        .when(F.size(claimed) > 0, strip_citations(F.array_join(F.transform(claimed, strip), " ")))
        .otherwise(none)
    )
