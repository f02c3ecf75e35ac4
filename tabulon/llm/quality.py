"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import linear
from tabulon.llm.linear import Features, Ftrl

TRAIN_ROWS = 8_000  # labelled documents that are learnt from at most
THRESHOLD = 0.3
SEED = "quality-1"
SETTINGS = Ftrl(alpha=0.3, l1=0.02, l2=0.01, passes=5)
SCALE = 10.0


def features(texts: Sequence[bytes]) -> Features:
    """Shares of hashed n-grams: of words (1 and 2), of their shapes (1 to 3), and of repeats.

    A shape is a word's sequence of upper case, other letters, digits and each punctuation mark; whether the run of
    three words at a word came before in the text, and whether a word equals the one before, are tokens too. A text without words has the bias alone.
    """
    n = len(texts)
    of, index = [], []
    for words, number in linear.word_runs(texts):
        plain, shape = words.hashes(), words.shapes()
        three, three_of = linear.ngrams(plain, number, 3)
        first = np.zeros(len(three), bool)
        first[np.unique(three + three_of.astype(np.uint64) * linear.C1, return_index=True)[1]] = True
        same = number[1:] == number[:-1]
        families = [
            *((*linear.ngrams(plain, number, k), k) for k in (1, 2)),
            *((*linear.ngrams(shape, number, k), 10 + k) for k in (1, 2, 3)),
            (first.astype(np.uint64), three_of, 20),
            ((plain[1:] == plain[:-1])[same].astype(np.uint64), number[1:][same], 21),
        ]
        for hashes, owner, family in families:
            of.append(owner)
            index.append(linear.index_of(hashes, family))
    of.append(np.arange(n))
    index.append(np.zeros(n, np.int64))
    of, index = np.concatenate(of), np.concatenate(index)
    size = np.maximum(np.bincount(of, minlength=n) - 1, 1)
    value = np.where(index == 0, 1.0, SCALE / size[of])
    return linear.summed(of, index, value)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, settings: Ftrl = SETTINGS) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents whose id is not held out (``linear.remainder`` not 0).

    ``labels`` has ``doc_id`` and ``quality``; null labels are not used, of several for one id the smallest counts.
    """
    known = labels.where(F.col("quality").isNotNull() & (linear.remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def train(got):
        return [settings.fit(linear.unpacked(got), got.get("quality", [])).astype("<f4").tobytes()]

    return linear.fitted(linear.sample(docs, known, rows, features, SEED), train, ["quality"])["quality"]


def score(text: Column, weights: np.ndarray) -> Column:
    """The probability of label 1: a sparse dot product of features and weights; no words or null: the bias alone."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for part in linear.in_parts(texts):
            of, index, value = features(part)
            out.append(np.bincount(of, weights[index] * value, len(part)))
        return pd.Series(linear.sigmoid(np.concatenate(out)) if out else np.zeros(0))

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document.

    Without labels all scores are 0.5; repeated rows get equal scores; an empty table gives no rows.
    """
    weights = fit(docs, labels, rows)
    scored = docs.select("doc_id", (linear.remainder(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
