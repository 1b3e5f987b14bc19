"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import language, toxicity
from tidemark.llm.bpe import codec_of, token_digests
from tidemark.llm.mixing import mixture
from tidemark.llm.ngram_join import row_classes
from tidemark.llm.registry import tokenizer_path
from tidemark.llm.shared import WORD, forget, named, table, written

#: A document whose language has less than this probability is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of one stage that docs, which may have any, do not have."""
    longest = max(map(len, docs.columns))
    return [f"{n}_{'_' * longest}" for n in names]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input and the labels, does not call toxic.

    Each row is judged by its text alone: rows that repeat stay or go together, a null or empty text is judged by the
    intercept, which is that of a clean one. Ties: a score of exactly one half goes. Without a toxic label all stay. Columns
    of any names stay as they are; no rows give no rows.
    """
    score, predicted = free(docs, "score", "predicted")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score, predicted).filter(F.col(predicted) == 0).select(*map(named, docs.columns))


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without a letter or without a clear language go.

    Each row is judged by its text alone: null and empty texts go, rows that repeat stay or go together, a score of exactly
    LEAST_LANGUAGE_SCORE stays. Null values of lang teach nothing; without any value all documents go. Columns of any names
    stay as they are; no rows give no rows.
    """
    lang, score = free(docs, "lang", "score")
    found = language.identify(docs, language.fit(docs), lang, score)
    return found.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*map(named, docs.columns))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest id, one without an id only if none has one.

    Ids may repeat or be null: a row is known by its id and text. Of rows that are equal in those, one stays: the first by
    all of its other columns, so that reruns agree. Rows without n-grams (null and empty texts, white space) are in no class;
    they stay, but once for each id and text if they have an id. Columns of any names stay as they are; no rows give no rows.
    """
    (row,) = free(docs, "row")
    stated = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    keyed = docs.withColumn(row, F.md5(F.concat(stated("doc_id"), F.lit("\0"), stated("text"))))
    classes = written(row_classes(keyed.select("doc_id", F.col(row).alias("row"), "text")), "classes")
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select("best.row")
    gone = classes.join(best, "row", "left_anti").select(F.col("row").alias(row)).distinct()
    has_name = F.col("doc_id").isNotNull() | F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    left = keyed.filter(has_name).join(gone, row, "left_anti")
    # rows of one digest are alike in id and text; the others decide which stays
    rest = F.struct(*(F.to_json(F.struct(named(c).alias("v"))).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    (place,) = free(left, "place")
    kept = left.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(rest))).filter(F.col(place) == 1)
    return kept.select(*map(named, docs.columns)).unionByName(keyed.filter(~has_name).select(*map(named, docs.columns)))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them.

    A null source is a source of its own. Null and empty texts have no words and are taken as the draw has it. Rows that
    repeat draw the same key and are taken together; ties are ordered by id and size. Columns of any names stay as they are;
    no rows give no rows.
    """
    return mixture(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A row for every row, repeats too; a null text counts as empty; other columns are dropped; no rows give no rows.
    """
    return token_digests(docs, codec_of(tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", in_known_language),
    ("ngram_join", one_of_each_class),
    ("mixing", mixed_to_targets),
    ("bpe", tokenized),
]

#: The classifiers have no form in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
