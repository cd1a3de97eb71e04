"""Third-party catalogue pages (HTML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.ids import digest

# Labels of the detail page and the columns they fill.
DETAIL_FIELDS = (
    ("ADC ID", "adcdb_id"),
    ("ADC Name", "adc_name"),
    ("Brand Name", "brand_name"),
    ("Organization", "organization"),
    ("Drug Status", "drug_status"),
    ("Antibody Name", "antibody_name"),
    ("Antigen Name", "antigen_name"),
    ("Payload Name", "payload_name"),
    ("Linker Name", "linker_name"),
    ("Representative Indication", "representative_indication"),
)
RATIO_LABEL = "Drug-to-Antibody Ratio"
# Marks of a search result.
RESULT_MARK, NAME_MARK, DETAIL_PATH = "ADC ID:", "ADC Name:", "/data/adc/details/"


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def search_results(pages: DataFrame, html: str = "body") -> DataFrame:
    """Results of search pages: ``(…, adcdb_id, found_name, detail_path)``."""
    parts = F.split(html, f"(?i){RESULT_MARK}")
    found = lambda part: F.struct(
        F.upper(F.regexp_extract(part, r"^\s*(\w+)", 1)).alias("adcdb_id"), F.regexp_extract(part, f"(?is){NAME_MARK}(.*?)</span>", 1).alias("raw"),
        F.regexp_extract(part, f"(?i)=\\s*[\"']({DETAIL_PATH}\\w+)", 1).alias("detail_path"))
    rows = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(0))), found), lambda r: (r["adcdb_id"] != "") & (r["detail_path"] != ""))
    r = pages.select(*[c for c in pages.columns if c != html], F.explode(rows).alias("r"))
    return r.select(*[c for c in pages.columns if c != html], "r.adcdb_id", tx.clean_html(F.col("r.raw")).alias("found_name"), "r.detail_path")


def pick_exact(wanted: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result with the wanted name for each entity, and the entities without one.

    ``wanted(entity_id, name)``; ``results(entity_id, adcdb_id, found_name, detail_path)``. Of several hits the smallest id counts.
    """
    hits = results.join(wanted, "entity_id").filter(name_key(F.col("found_name")) == name_key(F.col("name")))
    best = hits.groupBy("entity_id").agg(F.min(F.struct("adcdb_id", "detail_path")).alias("b")).select("entity_id", "b.*")
    return best, wanted.join(best, "entity_id", "left_anti").withColumn("error", F.lit("no_exact_name"))


def with_detail_fields(pages: DataFrame, html: str = "body", out: str = "f") -> DataFrame:
    """Add the label to value map of a detail page; the first non-empty value of a label counts."""
    pairs = tx.html_table_fields(F.col(html))
    # One unescape call per page: labels and values travel through it as one text.
    packed = F.array_join(F.transform(pairs, lambda p: F.concat(_light(p["label"]), F.lit("\u0002"), _light(p["value"]))), "\u0001")
    df = pages.withColumn("__p", packed)
    df = df.withColumn("__p", F.coalesce(tx._unescape(F.when(F.contains("__p", F.lit("&")), F.col("__p"))), "__p"))
    rows = F.transform(F.split("__p", "\u0001"), lambda row: F.struct(
        tx.squeeze(F.split_part(row, F.lit("\u0002"), F.lit(1))).alias("k"), tx.squeeze(F.split_part(row, F.lit("\u0002"), F.lit(2))).alias("v")))
    df = df.withColumn("__p", F.filter(rows, lambda r: (r["k"] != "") & (r["v"] != "")))
    labels = F.array_distinct(F.transform("__p", lambda r: r["k"]))
    firsts = F.transform(labels, lambda k: F.try_element_at(F.filter("__p", lambda r: r["k"] == k), F.lit(1))["v"])
    return df.withColumn(out, F.map_from_arrays(labels, firsts)).drop("__p")


def _light(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "; "), r"<[^>]+>", " ")


def parse_details(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of detail pages ``(entity_id, detail_url, body)`` and the pages that lack id or name."""
    f = with_detail_fields(pages)
    get = lambda label: F.try_element_at("f", F.lit(label))
    synonyms = F.filter(F.transform(F.split(F.coalesce(get("Synonyms"), F.lit("")), ";"), tx.strip), lambda s: s != "")
    rows = f.select("entity_id", *[get(label).alias(c) for label, c in DETAIL_FIELDS], synonyms.alias("synonyms"),
                    tx.first_number(get(RATIO_LABEL)).alias("dar"), "detail_url", digest("body").alias("checksum"))
    ok = F.col("adcdb_id").isNotNull() & F.col("adc_name").isNotNull()
    return rows.filter(ok), rows.filter(~ok).select("entity_id", "detail_url", F.lit("detail_page_incomplete").alias("error"))
