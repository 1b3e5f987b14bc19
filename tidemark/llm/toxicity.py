"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents taken without regard to labels the unlabelled set. A linear
numpy classifier over word presence minimises prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss: the
second part estimates the risk on clean documents from unlabelled ones, corrected by the share of toxic documents among
them, and is kept from going negative, which would be overfitting. Where it does, a step goes back up that part.

Fitting uses a bounded sample: at most POSITIVES positives and UNLABELLED unlabelled documents, the first by a hash of
their ids, of an id that repeats the first text, equal texts once; the class prior and everything else is over all rows. Words become features if LEAST_DF documents of
the sample have them and their frequencies in the two sets differ by Z standard errors, in either direction: words that
toxic documents have and words that they lack, FEATURES at most, the clearest first. Which of them tell toxic documents
from clean ones, and not only from unlabelled ones, is left to the risk.

Nulls and empty texts are scored by the intercept alone. Null labels are no labels. Repeated ids in labels count once
each for the prior and once for the sample. Without any positive every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fold, forget, map_batches, spread, texts_of, with_fields, written

POSITIVES, UNLABELLED = 4_000, 12_000
FEATURES, Z, LEAST_DF = 2_048, 4.0, 20
#: Fold 0 of FOLDS is held out: its labels are never learned from.
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, L2 = 400, 0.05, 5e-5

#: Beside whole words, their beginnings of these lengths are features: insults are inflected.
STEMS = (4, 5, 6)

words_of = re.compile(r"[^\W\d_]+").findall


def present(text: str) -> set[str]:
    """The words of a text, and the beginnings of longer words marked with a hyphen."""
    words = set(words_of(text.lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def margin(self, text: str) -> float:
        get = self.weights.get
        return self.bias + sum(map(get, present(text), repeat(0.0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -40, 40))))


class Rows:
    """Sparse 0/1 rows: the features of all rows in one array, and where each row begins."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.index = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, g[self.row], self.width)


def risk(positive: Rows, unlabelled: Rows, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """(risk on toxic documents, corrected risk on clean ones, derivatives by w and b of the step to take).

    Their sum is what is minimised while the second is not negative. Where it is, the step is that of its negative: it goes
    back up.
    """
    gp, gu = positive.dot(w) + b, unlabelled.dot(w) + b
    sp, su = sigmoid(gp), sigmoid(gu)
    toxic = prior * np.logaddexp(0, -gp).mean()
    clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    # derivatives of log(1 + e^-g) on positives, and of log(1 + e^g) on both sets
    up, down_u, down_p = -prior * (1 - sp) / positive.n, su / unlabelled.n, -prior * sp / positive.n
    on_p, on_u = (up + down_p, down_u) if clean >= 0 else (-down_p, -down_u)
    return float(toxic), float(clean), np.append(positive.back(on_p) + unlabelled.back(on_u), on_p.sum() + on_u.sum())


def train(positive: Rows, unlabelled: Rows, prior: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam over the full sets."""
    width = positive.width
    x = np.append(np.zeros(width) if start is None else start, np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        g = risk(positive, unlabelled, prior, x[:-1], x[-1])[2]
        g[:-1] += L2 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


#: What is learned without a toxic example: every text scores 0.
NOTHING = Model({}, float("-inf"), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labels of the learning folds; text is the only input of the model.

    Toxic labels whose documents are not in docs are no examples. A document that is labelled both 1 and 0 is a positive
    example: one confirmation confirms it.
    """
    known = labels.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
    share = known.agg(F.avg("toxic").alias("prior")).first()["prior"]
    if not share:
        return NOTHING
    prior = min(max(float(share), 1e-3), 0.999)

    def ids(df: DataFrame, n: int, kind: int) -> DataFrame:
        """The first n by hash; hashes far beyond the n-th go before the sort, which then is small at any size."""
        share = min(1.0, 2 * (n + 100) / max(1, df.count()))
        near = df.select("doc_id", F.xxhash64("doc_id").alias("draw")).filter(F.col("draw") <= int(-(2**63) + share * (2**64 - 2**11)))
        return near.orderBy("draw", "doc_id").limit(n).select("doc_id", F.lit(kind).alias("positive"))

    chosen = ids(known.filter("toxic = 1").select("doc_id").distinct(), POSITIVES, 1).unionByName(ids(docs.filter(fold("doc_id", FOLDS) != HELD_OUT), UNLABELLED, 0).distinct())
    # POSITIVES + UNLABELLED rows of two numbers at most: safe to broadcast at any size of the input
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text"))
    sample = written(rows.select("positive", "text").distinct(), "toxicity")

    def word_rows() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = [sorted(present(t)) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(seen, pa.list_(pa.string()))], names=["positive", "words"])

        return work

    rows = map_batches(sample, "positive int, words array<string>", word_rows)
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p:
        return NOTHING
    if not n_u:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    df = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    p, u, both = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (p - u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    features = df.filter(F.col("p") + F.col("u") >= LEAST_DF).withColumn("z", F.abs(z)).filter(F.col("z") >= Z).orderBy(F.col("z").desc(), "word").limit(FEATURES)
    words = [r["word"] for r in features.select("word").collect()]
    place = {w: k for k, w in enumerate(words)}

    def feature_rows() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(place[w] for w in present(t) if w in place) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"])

        return work

    # order by content, so that sums of doubles do not depend on the order of arrival
    got = map_batches(sample, "positive int, found array<int>", feature_rows).collect()
    got = sorted((r["positive"], r["found"]) for r in got)
    forget(sample)
    sets = [Rows([np.asarray(f, np.int64) for kind, f in got if kind == k], len(words)) for k in (1, 0)]
    w, b = train(*sets, prior)
    return Model({x: float(y) for x, y in zip(words, w, strict=True)}, b, prior)


def score(docs: DataFrame, model: Model, score_column: str = "score", predicted_column: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on) added, in place of columns of those names; a row for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_column, predicted_column)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = sigmoid(np.array([own.margin(t) for t in texts_of(batch)]))
            extra = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, score_column, predicted_column])

        return work

    return map_batches(spread(docs), with_fields(docs.schema.fields, f"`{score_column}` double, `{predicted_column}` int"), make)
