"""The corpus pipeline: five operators of ringside.llm, each over what the one before it kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes
and reads again as the next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from ringside.llm import decontaminate, frames, jaccard_join, language_id, mixing, quality


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told; those rejected go."""
    return language_id.known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes; those rejected go."""
    return quality.good(docs, frames.table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return jaccard_join.representatives(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, frames.table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("jaccard_join", one_of_each_class),
    ("decontamination", no_benchmark),
    ("mixing", to_weights),
]

#: Trained models have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frames.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
