"""Trial registry pages (nested JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions.ids import digest
from factloom.operators.relational import latest_per_key


def read_pages(spark: SparkSession, location: str) -> DataFrame:
    """Saved pages as ``(path, body, page)``; the page number is the last number of the file name."""
    raw = spark.read.text(location, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return raw.withColumn("page", F.coalesce(F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("int"), F.lit(0)))


def parse_studies(pages: DataFrame) -> DataFrame:
    """Flat trial rows; studies without id or title are skipped, the last page wins for a repeated id.

    The checksum covers the record, so a change elsewhere on the page does not renew its snapshot.
    """
    p = pages.select("path", "page", F.explode(F.from_json("body", schemas.STUDY_PAGE)["studies"]["protocolSection"]).alias("s"))
    strings = F.array().cast("array<string>")
    names = F.transform(F.coalesce("s.armsInterventionsModule.interventions", F.array().cast("array<struct<name:string,otherNames:array<string>>>")),
                        lambda i: F.concat(F.array_compact(F.array(F.nullif(i["name"], F.lit("")))), F.coalesce(i["otherNames"], strings)))
    outcomes = F.filter(F.coalesce("s.outcomesModule.primaryOutcomes.measure", strings), lambda m: F.coalesce(m, F.lit("")) != "")
    flat = p.select(
        F.col("s.identificationModule.nctId").alias("nct_id"), F.col("s.identificationModule.briefTitle").alias("brief_title"),
        F.col("s.identificationModule.officialTitle").alias("official_title"), F.col("s.statusModule.overallStatus").alias("overall_status"),
        F.coalesce("s.designModule.phases", strings).alias("phases"), F.coalesce("s.conditionsModule.conditions", strings).alias("conditions"),
        F.array_sort(F.array_distinct(F.flatten(names))).alias("interventions"), F.col("s.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        F.col("s.designModule.enrollmentInfo.count").alias("enrollment"), F.col("s.statusModule.startDateStruct.date").alias("start_date"),
        F.col("s.statusModule.completionDateStruct.date").alias("completion_date"),
        F.col("s.statusModule.lastUpdatePostDateStruct.date").alias("last_update_date"), outcomes.alias("primary_outcomes"),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), F.col("s.identificationModule.nctId")).alias("source_url"),
        F.col("path").alias("raw_path"), digest(F.to_json("s")).alias("checksum"), "page")
    known = flat.filter((F.coalesce("nct_id", F.lit("")) != "") & (F.coalesce("brief_title", F.lit("")) != ""))
    return latest_per_key(known, ["nct_id"], ["page", "checksum"]).drop("page")


def capture_state(pages: DataFrame) -> DataFrame:
    """Reported total and whether the last page still names a next one (truncated), one row."""
    p = pages.select("page", F.from_json("body", "nextPageToken string, totalCount bigint").alias("h"))
    return p.agg(F.max("h.totalCount").alias("expected_count"),
                 F.max_by(F.coalesce("h.nextPageToken", F.lit("")), "page").alias("t")).select("expected_count", (F.col("t") != "").alias("truncated"))
