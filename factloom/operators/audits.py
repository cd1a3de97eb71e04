"""Audits of stored data: links, URLs, dates, catalogue, scope, hygiene and file hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx, urls
from factloom.functions.dates import partial_date
from factloom.operators.relational import orphans, ratio

# Catalogue fields behind the public core facts.
STRUCTURAL_FIELDS = ("target", "antibody", "linker_name", "linker_type", "payload_name", "payload_class", "dar")
CORE_FACT_FIELDS = (*STRUCTURAL_FIELDS, "indication")


def url_quality(df: DataFrame, column: str) -> DataFrame:
    """Missing, non-HTTPS and distinct URLs, one row."""
    url = tx.strip(F.coalesce(F.col(column), F.lit("")))
    bad = (url == "") | ~url.startswith("https://")
    return df.agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(url == "").alias("missing_url_count"),
        F.count_if((url != "") & ~url.startswith("https://")).alias("non_https_url_count"),
        F.countDistinct(F.nullif(url, F.lit(""))).alias("distinct_url_count"), F.count_if(urls.is_generic_url(url)).alias("generic_url_count"),
        F.when(F.count_if(bad) > 0, "needs_review").otherwise("pass").alias("status"))


def link_coverage(links: DataFrame) -> DataFrame:
    """Links, distinct entities and distinct records per entity and record type."""
    return links.groupBy("entity_type", "source_record_type").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("source_record_id").alias("records"))


def entity_coverage(catalogue: DataFrame, links: DataFrame, key: str = "entity_id") -> DataFrame:
    """Linked trials and documents per catalogue entity, entities without links included."""
    own = links.filter(F.col("entity_type") == "adc").select(F.col("entity_id").alias(key), "source_record_type", "source_record_id")
    per = own.groupBy(key).agg(
        F.countDistinct(F.when(F.col("source_record_type") == "trial", F.col("source_record_id"))).alias("trials"),
        F.countDistinct(F.when(F.col("source_record_type") == "document", F.col("source_record_id"))).alias("documents"))
    return catalogue.select(key).join(per, key, "left").select(
        key, F.coalesce("trials", F.lit(0)).alias("trials"), F.coalesce("documents", F.lit(0)).alias("documents"))


def link_faults(links: DataFrame, catalogue: DataFrame, trials: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counts of links to unknown trials, documents and entities, and of matched aliases the dictionary does not have."""
    adc = links.filter("entity_type = 'adc'")
    checks = {
        "orphan_trial_links": orphans(links.filter("source_record_type = 'trial'"), trials, ["source_record_id"], ["nct_id"]),
        "orphan_document_links": orphans(links.filter("source_record_type = 'document'"), documents, ["source_record_id"], ["document_id"]),
        "unknown_entities": orphans(adc, catalogue, ["entity_id"], ["entity_id"]),
        "unmatched_aliases": orphans(links, aliases, ["entity_type", "entity_id", "matched_alias"], ["entity_type", "entity_id", "alias"]),
    }
    counted = [df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


def late_dates(df: DataFrame, column: str, as_of: Column, *keys: str) -> DataFrame:
    """Records whose (partial) date lies after the cut-off."""
    return df.withColumn("parsed_date", partial_date(F.col(column))).filter(F.col("parsed_date") > as_of).select(*keys, column, "parsed_date")


def late_publication_review(late: DataFrame, histories: DataFrame, as_of: Column) -> DataFrame:
    """Chronology of publications dated after the cut-off.

    ``histories(source_record_id, event, event_date, raw_hash, expected_hash)`` comes from the raw article files.
    """
    known = F.col("event_date") <= as_of
    per = histories.groupBy("source_record_id").agg(
        F.bool_and(F.col("raw_hash") == F.col("expected_hash")).alias("hash_bound"),
        F.bool_or((F.col("event") == "entrez") & known).alias("indexed_before"), F.bool_or((F.col("event") == "accepted") & known).alias("accepted_before"),
        F.min("event_date").alias("first_event"))
    j = late.join(per, "source_record_id", "left")
    state = (F.when(F.col("hash_bound").isNull(), "raw_record_missing").when(~F.col("hash_bound"), "raw_hash_mismatch")
             .when(F.coalesce("indexed_before", F.lit(False)), "advance_issue_date").otherwise("needs_review"))
    return j.withColumn("review", state)


# ---------------------------------------------------------------- catalogue


def catalogue_problems(catalogue: DataFrame, statuses: Sequence[str], key: str = "adc_id", name: str = "adc_name",
                       status: str = "catalog_status") -> DataFrame:
    """Blank or repeated ids and names and unknown statuses as ``(problem, value)``."""
    blank = lambda c: catalogue.filter(tx.strip(F.coalesce(F.col(c), F.lit(""))) == "").select(
        F.lit(f"blank_{c}").alias("problem"), F.col(key).alias("value"))
    twice = lambda c: catalogue.groupBy(F.lower(tx.strip(F.col(c))).alias("value")).count().filter("count > 1 AND value <> ''").select(
        F.lit(f"duplicate_{c}").alias("problem"), "value")
    unknown = catalogue.filter(~F.coalesce(F.col(status).isin(*statuses), F.lit(False))).select(F.lit("unknown_status").alias("problem"), F.col(key).alias("value"))
    return reduce(lambda a, b: a.unionByName(b), [blank(key), blank(name), twice(key), twice(name), unknown])


def catalogue_hosts(catalogue: DataFrame, url: str) -> DataFrame:
    """Records per source host, class of host and specificity of the URL."""
    u = F.col(url)
    return catalogue.groupBy(urls.url_host(u).alias("host"), urls.source_class(u).alias("source_class")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(urls.is_generic_url(u)).alias("generic"))


def locator_coverage(catalogue: DataFrame, candidates: DataFrame, fields: Sequence[str], key: str = "adc_id") -> DataFrame:
    """Coverage of catalogue values by candidate source locators, per field.

    ``candidates(<key>, field, url, value)``. Expected cells are the non-blank catalogue values; a cell is covered by any HTTPS
    candidate and matched when a candidate gives the same text.
    """
    cells = catalogue.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.strip(F.col(f).cast("string")).alias("expected"))
                                                      for f in fields])).alias("c")).select(key, "c.*").filter("coalesce(expected, '') <> ''")
    usable = candidates.filter(F.col("url").startswith("https://"))
    pairs = cells.join(usable, [key, "field"], "left")
    per_cell = pairs.groupBy(key, "field").agg(
        F.count("url").alias("n"), F.coalesce(F.bool_or(F.lower(tx.strip(F.col("value"))) == F.lower("expected")), F.lit(False)).alias("match"),
        F.coalesce(F.bool_or(urls.source_class(F.col("url")).startswith("regulator")), F.lit(False)).alias("regulator"))
    total, covered = F.count(F.lit(1)), F.count_if(F.col("n") > 0)
    return per_cell.groupBy("field").agg(
        total.alias("expected"), covered.alias("covered"), (total - covered).alias("missing"), ratio(covered, total).alias("coverage"),
        ratio(F.count_if("match"), covered).alias("value_match_rate"), F.count_if("regulator").alias("regulator_covered"))


def scope_problems(catalogue: DataFrame, classes: dict[str, bool], records: DataFrame, key: str = "adc_id") -> DataFrame:
    """Differences between catalogue ids and the scope policy, and records of unknown class.

    ``records(<key>, scope_class)``.
    """
    ids, listed = catalogue.select(key).distinct(), records.select(key).distinct()
    say = lambda df, problem: df.select(F.lit(problem).alias("problem"), key)
    unknown = records.filter(~F.col("scope_class").isin(*classes))
    return say(ids.join(listed, key, "left_anti"), "missing_in_policy").unionByName(
        say(listed.join(ids, key, "left_anti"), "unknown_in_policy")).unionByName(say(unknown, "unknown_class"))


def scope_counts(catalogue: DataFrame, classes: dict[str, bool], records: DataFrame, key: str = "adc_id", status: str = "catalog_status") -> DataFrame:
    """Records per ``core:<status>`` and ``extended:<status>``."""
    core = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[F.col("scope_class")]
    j = catalogue.join(records, key)
    return j.groupBy(F.concat_ws(":", F.when(core, "core").otherwise("extended"), status).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- files


def hygiene_findings(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """``(path, kind)`` of sensitive text classes; never the text."""
    return files.select(path, F.explode(tx.sensitive_categories(F.col(content))).alias("kind"))


def read_texts(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.text(location, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")


def artifact_manifest(spark: SparkSession, location: str) -> DataFrame:
    """Path, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot_integrity(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """``valid``, ``missing`` or ``hash_mismatch`` per snapshot; ``files(path, sha256)``, ``snapshots(..., raw_path, content_hash)``."""
    f = files.select(F.col("path").alias("raw_path"), F.col("sha256").alias("actual_hash"))
    j = snapshots.join(f, "raw_path", "left")
    return j.withColumn("integrity", F.when(F.col("actual_hash").isNull(), "missing")
                        .when(F.col("actual_hash") == F.col("content_hash"), "valid").otherwise("hash_mismatch"))


def absolute_paths(df: DataFrame) -> DataFrame:
    """Values that look like local absolute paths, per text column, from one scan."""
    columns = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    local = r"^(?:[A-Za-z]:[\\/]|/(?:home|Users|root|tmp|var|mnt)/)"
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").rlike(local)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in columns])).alias("x")).select("x.*")
