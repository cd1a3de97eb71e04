"""Partial dates and ISO timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

# English month abbreviations.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def partial_date(text: Column) -> Column:
    """Date of ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``, ``YYYY-Mon``, ``YYYY-Mon-DD`` or ``YYYY Mon-Mon DD``.

    Missing parts count as 1; other forms and impossible dates give NULL.
    """
    text = strip(text)
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])

    def month(pattern: str) -> Column:
        return F.try_element_at(months, F.initcap(F.regexp_extract(text, pattern, 2)))

    def date(year: Column, month_: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, month_, day), "yyyy-MM-dd")

    named_day, named, span = (r"^(\d{4})-([A-Za-z]{3})-(\d{2})$", r"^(\d{4})-([A-Za-z]{3})$",
                              r"^(\d{4}) ([A-Za-z]{3})-[A-Za-z]{3} (\d{2})$")
    year, one = F.substring(text, 1, 4), F.lit("01")

    def when_month(pattern: str, day: Column) -> Column:
        found = month(pattern)
        return F.when(found.isNotNull(), date(year, found, day))

    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
        .when(text.rlike(r"^\d{4}-\d{2}$"), date(year, F.substring(text, 6, 2), one))
        .when(text.rlike(named_day), when_month(named_day, F.regexp_extract(text, named_day, 3)))
        .when(text.rlike(named), when_month(named, one))
        .when(text.rlike(r"^\d{4}$"), date(year, one, one))
        .when(text.rlike(span), when_month(span, F.regexp_extract(text, span, 3)))
    )


def parse_timestamp(text: Column) -> Column:
    """ISO timestamp with ``Z`` or an offset; no zone means UTC; anything else gives NULL."""
    return F.try_to_timestamp(strip(text))


def date_quality(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """One row: observed, missing, invalid and future counts, extremes and the first five bad values in text order."""
    text = strip(F.coalesce(F.col(column).cast("string"), F.lit("")))
    d = df.select(text.alias("v"), partial_date(text).alias("d"))
    invalid = (F.col("v") != "") & F.col("d").isNull()
    future = F.coalesce(F.col("d") > as_of, F.lit(False))

    counts = d.agg(
        F.count(F.lit(1)).alias("observed_count"), F.count_if(F.col("v") == "").alias("missing_count"),
        F.count_if(invalid).alias("invalid_count"), F.min("d").cast("string").alias("min_date"),
        F.max("d").cast("string").alias("max_date"), F.count_if(future).alias("after_as_of_count"),
    )

    def examples(condition: Column) -> Column:
        first = d.filter(condition).select("v").distinct().orderBy("v").limit(5)
        return F.coalesce(first.agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("x")).scalar(), F.lit(""))

    bad = (F.col("invalid_count") > 0) | (F.col("after_as_of_count") > 0)
    return counts.select(
        "*", F.when(bad, "needs_review").otherwise("pass").alias("status"), examples(invalid).alias("invalid_examples"),
        examples(future).alias("after_as_of_examples"),
    )
