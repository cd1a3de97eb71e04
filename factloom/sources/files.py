"""CSV, JSON-lines and dictionary files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions.text import strip

# Accepted texts of the catalogue enums.
LINKER_TYPES = ("cleavable", "non-cleavable", "unknown")
DEVELOPMENT_STATUSES = ("approved", "investigational", "discontinued", "unknown")
REVIEW_STATUSES = ("needs_review", "reviewed")


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark before the header is dropped, blanks become NULL."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    first = df.columns[0].lstrip("﻿").strip('"')
    return _blank_to_null(df.withColumnRenamed(df.columns[0], first))


def catalogue_violations() -> Column:
    """Names of the rules a catalogue row breaks."""
    enum = lambda c, allowed: F.when(~F.coalesce(F.col(c), F.lit("unknown" if "unknown" in allowed else allowed[0])).isin(*allowed), c)
    return F.array_compact(F.array(
        F.when(F.col("adc_id").isNull(), "adc_id"), F.when(F.col("adc_name").isNull(), "adc_name"), F.when(F.col("target").isNull(), "target"),
        enum("linker_type", LINKER_TYPES), enum("development_status", DEVELOPMENT_STATUSES), enum("data_review_status", REVIEW_STATUSES),
        F.when(F.col("dar").isNotNull() & (F.col("dar").try_cast("double").isNull() | ~F.col("dar").try_cast("double").between(0, 20)), "dar")))


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Validated catalogue rows, and the rejected rows with the broken rules."""
    raw = read_csv(spark, path)
    names = [c.split()[0] for c in schemas.CATALOGUE.split(", ")]
    for c in names:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    checked = raw.withColumn("violations", catalogue_violations())
    good = checked.filter(F.size("violations") == 0).select(*names).withColumns({
        "dar": F.col("dar").try_cast("double"), "linker_type": F.coalesce("linker_type", F.lit("unknown")),
        "development_status": F.coalesce("development_status", F.lit("unknown")),
        "data_review_status": F.coalesce("data_review_status", F.lit("needs_review"))})
    return good, checked.filter(F.size("violations") > 0)


def read_unique_catalogue(spark: SparkSession, path: str, key: str = "adc_id") -> DataFrame:
    """Public catalogue; blank or repeated ids and an empty file are errors."""
    df = read_csv(spark, path)
    state = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k"), F.countDistinct(key).alias("d")).first()
    if not state.n or state.k != state.n or state.d != state.n:
        raise ValueError(f"{key} must be present and unique in a non-empty catalogue")
    return df


def alias_rows(catalogue: DataFrame, key: str = "adc_id") -> DataFrame:
    """Pipe-separated aliases as rows."""
    items = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), strip), lambda a: a != "")
    return catalogue.select(F.col(key).alias("entity_id"), F.explode(items).alias("alias"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped and broken lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_questions(spark: SparkSession, path: str, split: str = "dev", evaluation_use: str = "development_exposed") -> DataFrame:
    """Question file with the defaults of missing fields."""
    q = read_json_lines(spark, path, schemas.QUESTION)
    return q.withColumns({"split": F.coalesce("split", F.lit(split)), "evaluation_use": F.coalesce("evaluation_use", F.lit(evaluation_use))})


def read_reference_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``{"targets": {name: [alias, ...]}, "payloads": {...}}`` as ``(entity_type, canonical_name, aliases)``; a small file."""
    payload = json.loads(spark.read.text(path, wholetext=True).first()[0])
    rows = [(kind, name, list(aliases)) for key, kind in (("targets", "target"), ("payloads", "payload"))
            for name, aliases in payload.get(key, {}).items()]
    return spark.createDataFrame(rows, "entity_type string, canonical_name string, aliases array<string>")


def read_locators(spark: SparkSession, path: str) -> DataFrame:
    """Candidate source locators; only HTTPS locators are accepted."""
    df = read_json_lines(spark, path, "adc_id string, field string, url string, value string")
    if not df.filter(~F.coalesce(F.col("url").startswith("https://"), F.lit(False))).isEmpty():
        raise ValueError("candidate locators must use HTTPS")
    return df
