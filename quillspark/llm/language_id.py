"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of

#: Labelled rows of a language that training uses at most; their whole texts.
ROWS_PER_LANGUAGE = 500
#: Languages beyond this many are an error: the model keeps a column for each.
MAX_LANGUAGES = 1_000
HASH_BITS, DIM, EPOCHS, RATE = 17, 16, 6, 0.5
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all byte 2-, 3- and 4-grams of the texts, A-Z folded, and the number of them for each text.

    Each text stands between two spaces, so that word ends count; grams never reach into the next text.
    """
    buf = _FOLD[np.frombuffer(b"".join(b" " + t + b"   " for t in texts), np.uint8)].astype(np.uint32)
    lens = np.array([len(t) + 4 for t in texts])
    w = np.zeros((len(buf), 3), np.uint32)
    two = buf[:-1] << np.uint32(8) | buf[1:]
    three = two[:-1] << np.uint32(8) | buf[2:]
    four = three[:-1] << np.uint32(8) | buf[3:]
    shift = np.uint32(32 - HASH_BITS)
    for j, g in enumerate((two, three, four)):
        g = (g + np.uint32(j * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        w[: len(g), j] = (g ^ g >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> shift
    # the last three places of each text would look past its end
    keep = np.ones(len(buf), bool)
    ends = np.cumsum(lens)
    for k in (1, 2, 3):
        keep[ends - k] = False
    return w[keep].ravel(), (lens - 3) * 3


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket: embedding times the linear layer
    bias: np.ndarray
    scale: float = 1.0  # of all logits, fitted on rows kept out of training
    least: float = 0.0  # scores below are rejected

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)))
        for a, b in chunks_of(texts, 1 << 20):
            grams, n = subwords(texts[a:b])
            first = np.cumsum(n) - n
            for c in range(len(self.languages)):
                out[a:b, c] = np.add.reduceat(self.logits[c][grams], first) / n
        return out + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        z = self.scores(texts) * self.scale
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def fit(texts: list[bytes], langs: list[str], seed: int = 3) -> Model:
    """Stochastic gradient descent over single texts; every fifth text is kept out and sets scale and rejection."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept = order[::5] if len(texts) >= 50 else order[:0]
    train = order[np.isin(order, kept, invert=True)]
    emb = rng.normal(0, 0.1, (1 << HASH_BITS, DIM))
    lin, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    bags = []
    for t in texts:
        grams, _ = subwords([t])
        u, c = np.unique(grams, return_counts=True)
        bags.append((u, c / c.sum()))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            u, c = bags[i]
            mean = c @ emb[u]
            z = mean @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = lin @ p
            lin -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # the mean over thousands of grams would hardly move a bucket: steps follow the root of the share instead
            emb[u] -= rate * np.sqrt(c)[:, None] * back
    model = Model(names, np.ascontiguousarray((emb @ lin).T.astype(np.float32)), bias)
    if len(kept):
        z, t = model.scores([texts[i] for i in kept]), y[kept]

        def loss(s: float) -> float:
            q = z * s - (z * s).max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(t)), t]))

        model.scale = min((float(s) for s in np.geomspace(0.05, 20, 60)), key=loss)
        best, score = model.predict([texts[i] for i in kept])
        right = score[best == t]
        model.least = float(np.quantile(right, 0.005)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, eligible: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """A bounded sample for each language, dealt by a hash of the row, so that it is the same whatever the layout."""
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.abs(F.xxhash64(id_col, text_col) % (1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    below = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, ROWS_PER_LANGUAGE / n) * (1 << 40)))))
    got = rows.where(F.col("h") <= below[F.col("lang")]).orderBy("h").limit(ROWS_PER_LANGUAGE * len(counts)).collect()
    return [(r["text"].encode("utf-8", "surrogatepass"), r["lang"]) for r in got]


def identify_languages(docs: DataFrame, eligible: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs with lang_pred, score and rejected; trained on a bounded sample of eligible rows with a language.

    Whole texts are scored. `und` with score 0 if the text is null or has no letter, or if there was nothing to learn
    from. `rejected` marks scores below the level that 99.5 % of correctly named texts outside the training reach; `und`
    is rejected. Neither language nor id of a row is an input of its prediction. Repeated rows get equal results; an
    empty table gives an empty one. The three result columns replace columns of those names.
    """
    taught = sample(docs, F.lit(True) if eligible is None else eligible, id_col, text_col, lang_col)
    model = fit([t for t, _ in taught], [x for _, x in taught]) if taught else None
    sent = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)  # 2**HASH_BITS numbers for each language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        m = sent.value and Model(**sent.value)
        named, score, rejected = ["und"] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
        at = [i for i, t in enumerate(text) if t and _LETTER.search(t)] if m else []
        if at:
            best, s = m.predict([text.iloc[i].encode("utf-8", "surrogatepass") for i in at])
            for i, b in zip(at, best):
                named[i] = m.languages[b]
            score[at], rejected[at] = s, s < m.least
        return pd.DataFrame({"lang_pred": named, "score": score, "rejected": rejected})

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("whole"), predict(F.col(text_col)).alias("pred"))
    return out.select("whole.*", "pred.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    held_out = F.coalesce(held_out, F.lit(False))  # a null id has no remainder
    out = identify_languages(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
