"""Language identification by word-first backoff.

A known word adds its log frequency in every language. A word that is not known adds the mean log frequency of its
character n-grams, of the longest order of which it has known ones, from ORDERS down. The language with the largest sum
wins; the score is its probability when the sums are tempered by the square root of the number of words, since words of
one text are not independent.

The tables are fitted on a bounded sample of labelled texts, about PER_LANGUAGE of each language, chosen by a hash of
their ids and texts. They keep the WORDS_PER_LANGUAGE most frequent words of each language, or an equal part of MOST_WORDS where
languages are so many that this is less; words of more than LONGEST letters are cut into pieces of so many. They keep all
n-grams of those words. Languages are the LANGUAGES most frequent values of lang at
most. Tables are sparse: a word or n-gram holds the languages that have it, what the others share is one number each.

`und` with score 0: null texts, texts without a letter, and every text if nothing could be learned. Ties go to the first
language by name. A row for every row of the input, whatever repeats; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fold, map_batches, spread, with_fields

PER_LANGUAGE = 4_000
WORDS_PER_LANGUAGE, MOST_WORDS = 30_000, 400_000
LONGEST = 64
LANGUAGES = 1_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Cells of a table that is kept as rows too.
MOST_CELLS = 1 << 20
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

words_of = re.compile(r"[^\W\d_]+").findall


@dataclass
class Table:
    """Smoothed log frequencies of keys in languages: what a language without the key has, and what each other has above it.

    The entries of key k are those from begins[k] to begins[k + 1].
    """

    keys: dict[str, int]
    begins: np.ndarray
    language: np.ndarray
    above: np.ndarray
    base: np.ndarray

    def __post_init__(self) -> None:
        # few languages: the same numbers as rows, which are quicker to add up
        self.rows = None
        if len(self.keys) * len(self.base) <= MOST_CELLS:
            self.rows = np.zeros((len(self.keys), len(self.base)))
            self.rows[np.repeat(np.arange(len(self.keys)), np.diff(self.begins)), self.language] = self.above

    def total(self, found: list[int], weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the log frequencies of these keys, for each language."""
        if self.rows is not None:
            return self.base * weights.sum() + weights @ self.rows[found]
        k = np.asarray(found, np.int64)
        counts = self.begins[k + 1] - self.begins[k]
        place = np.repeat(self.begins[k] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        own = np.bincount(self.language[place], self.above[place] * np.repeat(weights, counts), len(self.base))
        return self.base * weights.sum() + own


def tabled(counts: dict[str, dict[int, float]], n_languages: int) -> Table:
    """counts: key -> language -> frequency."""
    keys = sorted(counts)
    entries = [(lang, n) for k in keys for lang, n in sorted(counts[k].items())]
    language = np.array([x for x, _ in entries], np.int32)
    n = np.array([x for _, x in entries], np.float64)
    totals = np.bincount(language, n, n_languages) + SMOOTH * max(1, len(keys))
    begins = np.concatenate([[0], np.cumsum([len(counts[k]) for k in keys], dtype=np.int64)])
    return Table({k: i for i, k in enumerate(keys)}, begins, language, np.log1p(n / SMOOTH), np.log(SMOOTH / totals))


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: Table

    def sums(self, text: str) -> tuple[np.ndarray, int]:
        """Log score of each language, and the number of words."""
        found = words_of(text.lower())
        known, get = [], self.words.keys.get
        grams, weights, table = [], [], self.grams.keys.get
        for word in found:
            k = get(word)
            if k is not None:
                known.append(k)
                continue
            padded = f"^{word}$"
            for order in ORDERS:
                own = [g for i in range(len(padded) - order + 1) if (g := table(padded[i : i + order])) is not None]
                if own:
                    grams += own
                    weights += [1 / len(own)] * len(own)
                    break
        total = np.zeros(len(self.languages))
        if known:
            total = total + self.words.total(known, np.ones(len(known)))
        if grams:
            total = total + self.grams.total(grams, np.asarray(weights))
        return total, len(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = self.sums(text)
        x = (total - total.max()) / math.sqrt(max(n, 1))
        odds = np.exp(x)
        return self.languages[int(total.argmax())], float(odds.max() / odds.sum())


def model_of(rows: list[tuple[str, str, int]], languages: list[str]) -> Model:
    """From (lang, word, count) rows."""
    at = {x: k for k, x in enumerate(languages)}
    words: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    grams: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for lang, word, n in sorted(rows):
        words[word][at[lang]] += n
        padded = f"^{word}$"
        # a word type counts by the root of its frequency: unseen words are like rare ones
        weight = math.sqrt(n)
        for order in ORDERS:
            for i in range(len(padded) - order + 1):
                grams[padded[i : i + order]][at[lang]] += weight
    return Model(languages, tabled(words, len(languages)), tabled(grams, len(languages)))


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of the learning folds."""
    known = docs.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], tabled({}, 0), tabled({}, 0))
    # LANGUAGES rows at most
    shares = docs.sparkSession.createDataFrame([(r["lang"], PER_LANGUAGE / r["n"]) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.select("lang", "text", draw.alias("draw")).join(F.broadcast(shares), "lang").filter("draw < share").select("lang", "text")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word in words_of(text.lower()):
                    for at in range(0, len(word), LONGEST):
                        counts[lang, word[at : at + LONGEST]] += 1
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

        return work

    counts = map_batches(spread(sample), "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    # MOST_WORDS rows at most, whatever the input
    best = counts.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= min(WORDS_PER_LANGUAGE, MOST_WORDS // len(languages)))
    return model_of([(r["lang"], r["word"], r["n"]) for r in best.collect()], languages)


def identify(docs: DataFrame, model: Model, language_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """docs with the language and its score added, in place of columns of those names; a row for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(language_column, score_column)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = zip(*map(own.predict, batch.column("text").to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, language_column, score_column])

        return work

    return map_batches(spread(docs), with_fields(docs.schema.fields, f"`{language_column}` string, `{score_column}` double"), make)
