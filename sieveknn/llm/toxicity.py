"""Toxicity: boosted trees over dense features of a whole text, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon, the nearness of second-person words to lexicon
words, rates of capitals, punctuation, digits and of obfuscated spellings. Model and learned lexicon
are fitted on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of the id; rows whose
crc32(doc_id) mod 5 is 0 are held out); scoring reads every text whole.

* A null or empty text has features of zero and is scored like any other.
* Unlabelled rows, null labels and rows without an id are not learned from; an id labelled more than once counts as
  toxic if any of its labels does. Without labels of both kinds every score is the share of toxic labels, or 0.
* Repeated rows get equal scores. Further columns are ignored by ``score_toxicity`` and kept by
  ``drop_toxic``. No rows give no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.boosting import Trees, boost, isotonic, sigmoid
from sieveknn.llm.common import hash_sample, remainder, whole_text
from sieveknn.session import ship_package

SAMPLE_ROWS = 20_000
LEXICON_WORDS = 200
FOLDS = 4
# Insults and second-person words of the four languages.
INSULTS = frozenset(
    "idiot moron clown scum loser pathetic worthless stupid trash garbage dumb filth vermin disgusting "
    "dummkopf abschaum trottel widerlich imbécile crétin ordure débile imbécil escoria estúpido basura".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein ihr euch tu te toi ton vous votre usted tú ti vosotros".split())
NEAR = 6  # words
FEATURES = (
    "fixed_density", "learned_density", "fixed_count", "learned_count", "distinct_hits", "second_density", "near_second",
    "capitals", "capital_words", "exclamations", "punctuation", "digits", "masked", "repeats", "log_words",
)

_WORDS = re.compile(r"[^\W_]+")
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 punctuation, 5 exclamation
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_CLASS[[33, 63]] = 5


def features(text: str, lexicon: frozenset[str]) -> list[float]:
    words = _WORDS.findall(text.lower())
    n = max(1, len(words))
    fixed = [w for w in words if w in INSULTS]
    hits = [i for i, w in enumerate(words) if w in lexicon or w in INSULTS]
    learned = sum(words[i] in lexicon for i in hits)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0.0
    if hits and second:
        places = np.array(second)
        at = np.searchsorted(places, hits)
        gap = np.minimum(np.abs(places[np.minimum(at, len(places) - 1)] - hits), np.abs(places[np.maximum(at - 1, 0)] - hits))
        near = float((1.0 / (1.0 + gap[gap <= NEAR])).sum())
    kinds = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    counts = np.bincount(kinds, minlength=6)
    size = max(1, len(kinds))
    letters = max(1, counts[1] + counts[2])
    is_letter = (kinds == 1) | (kinds == 2)
    # A digit or mark between two letters, and letters written three times or more.
    masked = float((is_letter[:-2] & ((kinds[1:-1] == 3) | (kinds[1:-1] == 4)) & is_letter[2:]).sum()) if size > 2 else 0.0
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    repeats = float(((raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & is_letter[2:]).sum()) if size > 2 else 0.0
    return [
        len(fixed) / n,
        learned / n,
        min(50, len(fixed)),
        min(50, learned),
        len({words[i] for i in hits}),
        len(second) / n,
        near,
        counts[2] / letters,
        sum(len(w) > 1 and w.isupper() for w in text.split()) / n if counts[2] else 0.0,
        counts[5] / size,
        counts[4] / size,
        counts[3] / size,
        masked / size,
        repeats / size,
        math.log1p(len(words)),
    ]


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray
    constant: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), self.at, self.value), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Ids are chosen first, so that no more than the sample's texts move; at most sample_rows ids are broadcast.
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = hash_sample(present, sample_rows)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def _learn_lexicon(rows: DataFrame, most: int) -> frozenset[str]:
    """Words that labelled toxic rows have far more often than others: large and certain log odds."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = totals["n"], totals["t"] or 0
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("length(word) > 2")
    counts = words.groupBy("word").agg(F.count("*").alias("a"), F.sum("toxic").alias("k")).where("k >= 4")
    odds = F.log((F.col("k") + 0.5) / (F.lit(toxic + 0.5) - F.col("k") + 0.5)) - F.log(
        (F.col("a") - F.col("k") + 0.5) / (F.lit(n - toxic + 0.5) - F.col("a") + F.col("k") + 0.5)
    )
    sure = odds / F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("a") - F.col("k") + 0.5))
    found = counts.withColumn("odds", odds).withColumn("sure", sure).where("sure > 4 and odds > 1.2")
    return frozenset(r["word"] for r in found.orderBy(F.desc("sure"), "word").limit(most).collect())


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_words: int = LEXICON_WORDS) -> ToxicityModel:
    """Fits lexicon, trees and calibration; features are made by tasks, the driver holds ``sample_rows`` of them."""
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, sample_rows).persist()
    lexicon = _learn_lexicon(rows, lexicon_words)

    def run(frames):
        for frame in frames:
            table = pd.DataFrame([features(t, lexicon) for t in frame["text"]], columns=list(FEATURES), dtype=float)
            table["toxic"], table["doc_id"] = frame["toxic"].to_numpy(), frame["doc_id"].astype(str).to_numpy()
            yield table

    schema = ", ".join(f"{name} double" for name in FEATURES) + ", toxic int, doc_id string"
    table = rows.mapInPandas(run, schema).toPandas().sort_values("doc_id")
    rows.unpersist()
    x, y = table[list(FEATURES)].to_numpy(float), table["toxic"].to_numpy(float)
    if len(y) < 2 * FOLDS or y.min() == y.max():
        return ToxicityModel(lexicon, None, np.zeros(1), np.zeros(1), float(y.mean()) if len(y) else 0.0)
    fold = np.arange(len(y)) % FOLDS
    raw = np.empty(len(y))
    for k in range(FOLDS):
        raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    at, value = isotonic(raw, y)
    return ToxicityModel(lexicon, boost(x, y), at, value)


def with_score(docs: DataFrame, model: ToxicityModel, column: str = "score", text: str = "text") -> DataFrame:
    """The documents with the score of the whole text as ``column``, which replaces one of that name."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(column, score(whole_text(text)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train_toxicity(docs, labels, sample_rows)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False)).alias("held_out")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    model = train_toxicity(docs, labels, sample_rows)
    rows = docs.select(F.struct("*").alias("__row"))  # so that no name of theirs can clash
    return with_score(rows, model, "__score", "__row.text").where(F.col("__score") < threshold).select("__row.*")
