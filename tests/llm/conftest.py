import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, n int, p double, row int, size int, fp long"
CLASH = ("x", 1, 2, 0.5, 3, 4, 5)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "en", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, ties, repeated rows and columns whose names could clash."""
    rng = random.Random(4)
    out: list[tuple] = []
    base = words(rng, 200)
    for i in range(30):  # near copies: a word or two apart
        w = base.split()
        w[rng.randrange(200)] = f"v{i}"
        out.append((i, " ".join(w), "en", "a"))
    shared = "This very line stands in several documents."
    for i in range(30, 60):
        out.append((i, f"{words(rng, rng.randint(1, 80))}\n{shared if i % 3 else shared.upper()}\n{words(rng, 5)}", "fr", "b"))
    out += [(60, None, "en", "a"), (61, "", "en", None), (62, "  \n\t ", None, "c"), (63, words(rng, 40_000), "en", "a"), (64, "Equal TEXT here", "de", "b"), (65, "equal text here", "de", "b"), (66, "equal text here", None, None)]
    out += [(67, "same row", "en", "a")] * 3 + [(None, "no id at all", "en", "a"), (None, None, None, None), (68, "été ça naïve Ünï \x1c odd", "fr", "c"), (69, "<|endoftext|> in a text", "en", "c"), (70, "1234 !!", "en", "c")]
    return [(*r, None if r[1] is None else len(r[1]), *CLASH) for r in out]


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def docs_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return path


@pytest.fixture(scope="session")
def docs(spark, docs_path):
    return spark.read.parquet(docs_path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
