"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import attention, decontaminate, mixing, ngram_join, token_files
from factloom.llm.files import free_name
from factloom.llm.queries import MAX_REPEATS, held_out, table, tokenizer_path
from factloom.operators.stages import written

#: The result has no SQL: a classifier and a tokenizer stand in it. A test holds it against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = attention.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score, predicted = free_name("score", docs.columns), free_name("predicted", docs.columns)
    judged = attention.score(docs, model, threshold=0.3, name=score, predicted=predicted)
    return judged.where(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return ngram_join.one_of_each(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them."""
    return mixing.mixed(docs, max_repeats=MAX_REPEATS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: place, number and CRC of each document's ids."""
    return token_files.tokenized(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
