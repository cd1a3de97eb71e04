"""Publication XML.

Files are read with the article end tag as record separator, so a large file is split between tasks at article borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.ids import digest
from factloom.operators.relational import latest_per_key


def read_articles(spark: SparkSession, location: str) -> DataFrame:
    raw = spark.read.text(location, lineSep="</PubmedArticle>").select(F.input_file_name().alias("path"), F.col("value"))
    return raw.filter(F.contains("value", F.lit("<PubmedArticle"))).select(
        "path", F.regexp_replace("value", r"(?s)^.*?(?=<PubmedArticle[ >])", "").alias("xml"))


def _plain(inner: Column) -> Column:
    """Text of an element with nested mark-up; NULL when blank."""
    text = F.regexp_replace(inner, r"(?s)<[^>]+>", "")
    text = F.coalesce(tx._unescape(F.when(F.contains(text, F.lit("&")), text)), text)
    return F.nullif(tx.strip(text), F.lit(""))


def _inner(xml: Column, tag: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1)


def parse_articles(articles: DataFrame) -> DataFrame:
    """Publication rows: title, labelled abstract parts, authors, journal, partial date, first DOI; last one wins per id."""
    x = F.col("xml")
    a = articles.withColumn("cite", _inner(x, "MedlineCitation")).withColumn("article", _inner(F.col("cite"), "Article"))
    date = F.regexp_extract(_inner(F.col("article"), "Journal"), r"(?s)<PubDate>(.*?)</PubDate>", 1)
    part = r"(?s)<AbstractText(?: [^>]*?)?>.*?</AbstractText>"
    authors = F.transform(F.regexp_extract_all("article", F.lit(r"(?s)<Author(?: [^>]*)?>.*?</Author>"), F.lit(0)), lambda n: F.coalesce(
        F.nullif(tx.strip(_inner(n, "CollectiveName")), F.lit("")),
        F.concat_ws(" ", F.nullif(tx.strip(_inner(n, "LastName")), F.lit("")), F.nullif(tx.strip(_inner(n, "Initials")), F.lit("")))))
    a = a.select(
        "path", "xml", _plain(F.regexp_extract("cite", r"(?s)<PMID(?: [^>]*)?>(.*?)</PMID>", 1)).alias("pmid"),
        _plain(_inner(F.col("article"), "ArticleTitle")).alias("title"), F.regexp_extract_all("article", F.lit(part), F.lit(0)).alias("parts"),
        _plain(F.regexp_extract(_inner(F.col("article"), "Journal"), r"(?s)<Title>(.*?)</Title>", 1)).alias("journal"),
        F.nullif(tx.strip(_inner(date, "Year")), F.lit("")).alias("y"), F.nullif(tx.strip(_inner(date, "Month")), F.lit("")).alias("m"),
        F.nullif(tx.strip(_inner(date, "Day")), F.lit("")).alias("d"), F.nullif(tx.strip(_inner(date, "MedlineDate")), F.lit("")).alias("md"),
        F.filter(authors, lambda n: n != "").alias("authors"),
        _plain(F.regexp_extract("xml", r'(?s)<ArticleId [^>]*IdType="doi"[^>]*>(.*?)</ArticleId>', 1)).alias("doi"))
    # Abstract parts are cleaned as one text, with a separator that the mark-up removal leaves alone.
    mark = "\u0001"
    joined = F.array_join(F.transform("parts", lambda p: F.concat(
        F.when(p.rlike(r'^<AbstractText[^>]*\bLabel="'), F.concat(F.regexp_extract(p, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1), F.lit(": "))).otherwise(""),
        tx.strip(F.regexp_replace(p, r"(?s)<[^>]+>", "")))), mark)
    text = F.coalesce(tx._unescape(F.when(F.contains(joined, F.lit("&")), joined)), joined)
    abstract = F.array_join(F.filter(F.split(text, mark), lambda s: ~s.rlike(r"^[^:]*: ?$") & (s != "")), "\n")
    flat = a.filter("pmid IS NOT NULL AND title IS NOT NULL").select(
        F.concat(F.lit("pubmed:"), "pmid").alias("document_id"), F.lit("pubmed").alias("source"), F.col("pmid").alias("source_record_id"), "title",
        F.nullif(abstract, F.lit("")).alias("abstract"), "authors", "journal",
        F.when(F.col("y").isNotNull(), F.concat_ws("-", "y", "m", "d")).otherwise(F.col("md")).alias("publication_date"), "doi",
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("source_url"), F.col("path").alias("raw_path"),
        digest("xml").alias("checksum"))
    return latest_per_key(flat, ["document_id"], ["raw_path", "checksum"])


def article_histories(articles: DataFrame) -> DataFrame:
    """``(source_record_id, event, event_date)`` of the publication history."""
    h = articles.select(_inner(F.col("xml"), "PMID").alias("source_record_id"), F.explode(F.regexp_extract_all(
        "xml", F.lit(r'(?s)<PubMedPubDate PubStatus="[^"]*">.*?</PubMedPubDate>'), F.lit(0))).alias("e"))
    return h.select("source_record_id", F.regexp_extract("e", r'PubStatus="([^"]*)"', 1).alias("event"), F.try_to_date(F.concat_ws(
        "-", _inner(F.col("e"), "Year"), F.lpad(_inner(F.col("e"), "Month"), 2, "0"), F.lpad(_inner(F.col("e"), "Day"), 2, "0")), "yyyy-MM-dd").alias("event_date"))


def uncovered_names(names: DataFrame, publications: DataFrame, name: str = "name") -> DataFrame:
    """Entity names that occur in no title or abstract: what a supplementary search has to ask for."""
    from factloom.operators.entities import resolve_in_questions

    texts = publications.select(F.col("document_id").alias("k"), F.concat_ws(" ", "title", "abstract").alias("q"))
    forms = names.select(F.col(name).alias("entity_id"), F.col(name).alias("entity_name"), F.col(name).alias("form"))
    found = resolve_in_questions(texts, forms, key="k", question="q").select(F.col("entity_id").alias(name)).distinct()
    return names.join(found, name, "left_anti")
