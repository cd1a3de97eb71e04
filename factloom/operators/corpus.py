"""Retrieval documents, chunks, content hashes and incremental rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.ids import digest, table_digest

METADATA_LISTS = ("adc_ids", "adc_names", "targets", "payloads", "aliases", "literature_topics")

# Labelled lines of an entity profile, with the column and whether a blank is written out.
PROFILE_LINES = (
    ("ADC 名称 / ADC name", "name", False),
    ("别名 / aliases", "__aliases", True),
    ("靶点 / target", "target", False),
    ("抗体 / antibody", "antibody", True),
    ("连接子 / linker", "linker_name", True),
    ("连接子类型 / linker type", "linker_type", False),
    ("载荷 / payload", "payload_name", True),
    ("载荷类型 / payload class", "payload_class", True),
    ("药物抗体比 / DAR", "dar", True),
    ("适应证 / indication", "indication", True),
    ("研发状态 / development status", "development_status", False),
    ("企业 / company", "company", True),
)
NOT_RECORDED = "not recorded"


def _strings() -> Column:
    return F.array().cast("array<string>")


def _metadata(**lists: Column) -> Column:
    return F.struct(*[F.coalesce(lists.get(n, _strings()), _strings()).alias(n) for n in METADATA_LISTS]).alias("metadata")


def profile_documents(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """One document of twelve labelled lines per entity; ``aliases(entity_id, alias)``."""
    names = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("__list"))
    df = catalogue.join(names, "entity_id", "left").withColumn("__list", F.coalesce("__list", _strings()))
    df = df.withColumn("__aliases", F.array_join("__list", ", "))
    lines = []
    for label, column, blank_is_named in PROFILE_LINES:
        value = tx.squeeze(F.coalesce(F.col(column).cast("string"), F.lit("")))
        if blank_is_named:
            value = F.when(value == "", NOT_RECORDED).otherwise(value)
        lines.append(F.concat(F.lit(f"{label}: "), value))
    payloads = F.when(F.coalesce("payload_name", F.lit("")) != "", F.array("payload_name"))
    return df.select(
        F.concat(F.lit("adc_profile:"), F.col("entity_id")).alias("retrieval_document_id"),
        F.lit("adc_profile").alias("source_type"), F.col("entity_id").alias("source_record_id"),
        F.concat(F.lit("ADC profile: "), "name").alias("title"), F.concat_ws("\n", *lines).alias("content"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        _metadata(adc_ids=F.array("entity_id"), adc_names=F.array("name"), targets=F.array("target"),
                  payloads=payloads, aliases=F.col("__list")),
    )


def linked_entities(links: DataFrame, catalogue: DataFrame, record_type: str) -> DataFrame:
    """Linked entity ids and names per record, as sorted arrays, in one pass over the links."""
    named = links.filter(F.col("source_record_type") == record_type).join(
        catalogue.select(F.col("entity_id"), F.col("name").alias("__name")), "entity_id", "left")
    of = lambda kind, col: F.sort_array(F.collect_set(F.when(F.col("entity_type") == kind, F.col(col))))
    return named.groupBy("source_record_id").agg(
        of("adc", "entity_id").alias("adc_ids"), of("adc", "__name").alias("adc_names"),
        of("target", "entity_id").alias("targets"), of("payload", "entity_id").alias("payloads"))


def _line(label: str, column: str | Column) -> Column:
    value = tx.squeeze((F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def publication_documents(publications: DataFrame, links: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """``publications(document_id, source_record_id, title, abstract, journal, publication_date, source_url)`` with
    the output of :func:`linked_entities` and ``topics(document_id, topic)``."""
    df = publications.join(links.withColumnRenamed("source_record_id", "document_id"), "document_id", "left")
    listed = _strings()
    if topics is not None:
        per = topics.groupBy("document_id").agg(F.sort_array(F.collect_set("topic")).alias("__topics"))
        df, listed = df.join(per, "document_id", "left"), F.col("__topics")
    title = tx.squeeze(F.coalesce("title", F.lit("")))
    content = F.concat_ws("\n", F.concat(F.lit("Title: "), title), _line("Abstract", "abstract"),
                          _line("Journal", "journal"), _line("Publication date", "publication_date"))
    return df.select(
        F.col("document_id").alias("retrieval_document_id"), F.lit("pubmed").alias("source_type"), "source_record_id",
        title.alias("title"), content.alias("content"), "source_url",
        _metadata(adc_ids=F.col("adc_ids"), adc_names=F.col("adc_names"), targets=F.col("targets"),
                  payloads=F.col("payloads"), literature_topics=listed))


def trial_documents(trials: DataFrame, links: DataFrame) -> DataFrame:
    df = trials.join(links.withColumnRenamed("source_record_id", "nct_id"), "nct_id", "left")
    listed = lambda c, sep=", ": F.array_join(F.coalesce(c, _strings()), sep)
    title = tx.squeeze("brief_title")
    content = F.concat_ws(
        "\n", F.concat(F.lit("Clinical trial: "), "nct_id"), F.concat(F.lit("Brief title: "), title),
        _line("Official title", "official_title"), _line("Recruitment status", "overall_status"),
        _line("Phase", listed("phases")), _line("Conditions", listed("conditions")),
        _line("Interventions", listed("interventions")), _line("Sponsor", "sponsor"),
        _line("Enrollment", "enrollment"), _line("Primary outcomes", listed("primary_outcomes", "; ")),
        _line("Start date", "start_date"), _line("Completion date", "completion_date"))
    return df.select(
        F.concat(F.lit("trial:"), "nct_id").alias("retrieval_document_id"),
        F.lit("clinical_trial").alias("source_type"), F.col("nct_id").alias("source_record_id"),
        title.alias("title"), content.alias("content"), "source_url",
        _metadata(adc_ids=F.col("adc_ids"), adc_names=F.col("adc_names"), targets=F.col("targets"),
                  payloads=F.col("payloads")))


# ---------------------------------------------------------------- chunks


def chunk_array(text: Column, max_chars: int = 1200, overlap_chars: int = 160) -> Column:
    """Chunks of one text.

    Units end at a sentence end or line break; a unit over ``max_chars`` is cut into windows that overlap; units are
    packed greedily, and a chunk that follows another starts with the end of it.
    """
    if max_chars <= overlap_chars:
        raise ValueError("max_chars must be greater than overlap_chars")
    step = max_chars - overlap_chars
    raw = F.filter(F.transform(F.split(tx.strip(text), tx.SENTENCE_OR_LINE_BREAK), tx.strip), lambda u: u != "")
    units = F.flatten(F.transform(raw, lambda u: F.when(F.length(u) <= max_chars, F.array(u)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(u), F.lit(step)), lambda s: F.substring(u, s, F.lit(max_chars))))))

    def add(acc: Column, unit: Column) -> Column:
        current = acc["current"]
        joined = F.when(current == "", unit).otherwise(tx.strip(F.concat(current, F.lit("\n"), unit)))
        room = F.lit(max_chars) - F.length(unit) - 1
        tail = F.ltrim(F.right(current, F.least(F.lit(overlap_chars), room)), F.lit(tx.WHITESPACE))
        restarted = F.when((current != "") & (room > 0), tx.strip(F.concat(tail, F.lit("\n"), unit))).otherwise(unit)
        fits = F.length(joined) <= max_chars
        return F.struct(
            F.when(fits | (current == ""), acc["chunks"]).otherwise(F.array_append(acc["chunks"], current)).alias("chunks"),
            F.when(fits, joined).otherwise(restarted).alias("current"))

    start = F.struct(_strings().alias("chunks"), F.lit("").alias("current"))
    return F.aggregate(units, start, add, lambda acc: F.when(acc["current"] == "", acc["chunks"]).otherwise(
        F.array_append(acc["chunks"], acc["current"])))


def chunk_documents(documents: DataFrame, max_chars: int = 1200, overlap_chars: int = 160) -> DataFrame:
    """Chunk rows with ids ``<document>#chunk-000``; other document columns are inherited."""
    exploded = documents.select(
        *[c for c in documents.columns if c != "content"],
        F.posexplode(chunk_array(F.col("content"), max_chars, overlap_chars)).alias("chunk_index", "content"))
    return exploded.select(
        F.concat("retrieval_document_id", F.lit("#chunk-"), F.lpad(
            F.col("chunk_index").cast("string"), F.greatest(F.lit(3), F.length(F.col("chunk_index").cast("string"))),
            F.lit("0"))).alias("chunk_id"), "*", F.length("content").alias("char_count"))


def _metadata_text() -> Column:
    return F.to_json("metadata")


def with_content_hash(documents: DataFrame) -> DataFrame:
    """Hash of everything that decides whether a document changed."""
    return documents.withColumn("content_hash", digest(
        "source_type", "source_record_id", "title", "content", "source_url", _metadata_text()))


def classify_changes(old: DataFrame, new: DataFrame, key: str = "retrieval_document_id",
                     content_hash: str = "content_hash") -> DataFrame:
    """One row per document with ``added``, ``updated``, ``deleted`` or ``unchanged``."""
    o = old.select(key, F.col(content_hash).alias("__old"))
    n = new.select(key, F.col(content_hash).alias("__new"))
    state = (F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted")
             .when(F.col("__old") != F.col("__new"), "updated").otherwise("unchanged"))
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def merge_chunks(old_chunks: DataFrame, new_documents: DataFrame, changes: DataFrame, max_chars: int = 1200,
                 overlap_chars: int = 160) -> DataFrame:
    """New chunk table: chunks of unchanged documents are kept, only changed documents are cut again."""
    key = "retrieval_document_id"
    kept = old_chunks.join(changes.filter("state = 'unchanged'").select(key), key, "left_semi")
    rewritten = new_documents.join(changes.filter("state IN ('added', 'updated')").select(key), key, "left_semi")
    return kept.unionByName(chunk_documents(rewritten, max_chars, overlap_chars).select(*kept.columns))


def corpus_version(chunks: DataFrame) -> DataFrame:
    """Version over chunk ids and content, independent of row order."""
    hashed = chunks.select("chunk_id", digest("title", "content", _metadata_text()).alias("content_hash"))
    return table_digest(hashed, ["chunk_id", "content_hash"], "corpus_")
