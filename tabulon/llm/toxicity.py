"""Toxicity by a classifier chain: later linear models see the probabilities of earlier categories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import linear
from tabulon.llm.linear import DIMS, Features, Ftrl

TRAIN_ROWS = 8_000  # labelled documents that are learnt from at most
FOLDS = 4
THRESHOLD = 0.4
SEED = "toxicity-1"
SETTINGS = Ftrl(alpha=1.0, l1=4.0, l2=0.0, passes=8)
PREFIXES = (4, 5, 6, 7)
CHAIN = 16  # the last indices are kept for the probabilities of earlier categories
#: Toxic in a text of good quality, toxic in one of low quality, toxic at all: the last one is the verdict.
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")


def features(texts: Sequence[bytes]) -> Features:
    """How often a text holds hashed words and beginnings of words (4 to 7 bytes), A-Z lower-cased: log2(1 + count).

    Index 0 is the bias, the only feature of a text without words.
    """
    n = len(texts)
    keys = [np.arange(n, dtype=np.int64) * DIMS]
    for words, number in linear.word_runs([t.lower() for t in texts]):
        for family, hashes in enumerate([words.hashes(), *(words.hashes(p) for p in PREFIXES)]):
            long_enough = hashes != 0
            index = (hashes[long_enough] + np.uint64(family)) % np.uint64(DIMS - CHAIN - 1)
            keys.append(number[long_enough].astype(np.int64) * DIMS + index.astype(np.int64) + 1)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // DIMS, key % DIMS, np.log2(1.0 + count)


def fit_chain(got: dict, categories: Sequence[str], settings: Ftrl = SETTINGS, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector per category, in order.

    What a later model learns from are out-of-fold probabilities: each row's come from a model of the category
    that has not seen the row, as it will be for new documents. The kept model of a category learns from all rows.
    """
    rows = linear.unpacked(got)
    fold = np.arange(len(rows)) % folds
    earlier = np.zeros((len(rows), 0), np.float32)
    models = []
    for place, name in enumerate(categories):
        labels = got.get(name, [])
        more = (DIMS - CHAIN + np.arange(place), earlier)
        models.append(settings.fit(rows, labels, more=more))
        if place + 1 < len(categories):
            unseen = np.zeros(len(rows), np.float32)
            for f in range(folds):
                own = settings.fit(rows, labels, more=more, skip=fold == f)
                for i in np.flatnonzero(fold == f):
                    index, value = rows[i]
                    unseen[i] = linear.sigmoid(own[index] @ value + own[more[0]] @ earlier[i])
            earlier = np.c_[earlier, unseen]
    return models


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, rows: int = TRAIN_ROWS) -> list[np.ndarray]:
    """Weights of the chain from at most ``rows`` labelled documents.

    ``labels`` has ``doc_id`` and a 0/1 column per category; rows with a null among them are not used, of several for one
    id the largest values count.
    """
    known = labels.select("doc_id", *categories).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in categories))

    def train(got):
        return [m.astype("<f4").tobytes() for m in fit_chain(got, categories)]

    found = linear.fitted(linear.sample(docs, known, rows, features, SEED), train, list(categories))
    return [found[c] for c in categories]


def probabilities(text: Column, models: Sequence[np.ndarray], categories: Sequence[str] = CATEGORIES) -> Column:
    """A struct with the probability of each category, predicted in the order of the chain."""
    kind = ", ".join(f"{c} double" for c in categories)

    @F.pandas_udf(kind)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for part in linear.in_parts(texts):
            of, index, value = features(part)
            earlier: list[np.ndarray] = []
            for weights in models:
                total = np.bincount(of, weights[index] * value, len(part))
                for place, p in enumerate(earlier):
                    total = total + weights[DIMS - CHAIN + place] * p
                earlier.append(linear.sigmoid(total))
            parts.append(np.stack(earlier, axis=1))
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(categories))), columns=list(categories))

    return predicted(text)


def categories_of(labels: DataFrame) -> DataFrame:
    """``doc_id`` and the categories from the table of labels (``doc_id``, ``quality``, ``toxic``)."""
    toxic, good = F.col("toxic"), F.col("quality")
    return labels.select("doc_id", (toxic * good).alias("toxic_prose"), (toxic * (1 - good)).alias("toxic_junk"), toxic)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``p_toxic_prose``, ``p_toxic_junk``, ``p_toxic`` and ``toxic`` (at ``threshold`` or more) for every document.

    A text without words (null or empty) gets the prior. Without labels all probabilities are 0.5 and nothing
    is toxic. Repeated rows get equal scores; an empty table gives no rows.
    """
    models = fit(docs, categories_of(labels), rows=rows)
    found = probabilities(F.col("text"), models)
    scored = docs.select("doc_id", found.alias("p")).select(
        "doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES)
    )
    return scored.withColumn("toxic", toxic(F.col("p_toxic"), models, threshold))


def toxic(probability: Column, models: Sequence[np.ndarray], threshold: float = THRESHOLD) -> Column:
    return (probability >= threshold) & F.lit(bool(any(m.any() for m in models)))


def clean_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with their columns as they are."""
    models = fit(docs, categories_of(labels), rows=rows)
    return docs.where(~toxic(probabilities(F.col("text"), models)["toxic"], models, threshold))
