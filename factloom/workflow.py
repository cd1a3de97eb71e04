"""Refresh of a published version from saved raw files.

Raw folder: ``seed.csv``, ``entities.json``, ``trials/*.json``, ``articles/*.xml``, ``pages/<entity id>.html``. Every step is a
DataFrame job; the driver only orders them and decides on publication.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ids, text as tx
from factloom.operators import cards, corpus, entities, fact_batch, facts, merge, relational, retrieval, runs
from factloom.operators.service import Store
from factloom.operators.stages import written
from factloom.policy import Policy, load_policy
from factloom.sources import articles, files, pages, studies

SOURCE_ORDER = ("curated_seed", "adcdb", "clinicaltrials", "pubmed")
RECORD_BITS = 36


@dataclass(frozen=True)
class Refreshed:
    tables: dict[str, DataFrame]
    gates: DataFrame
    passed: bool
    #: Counters of the fact batch; none for a first version.
    counters: DataFrame | None = None


def _catalogue(spark: SparkSession, raw: str) -> tuple[DataFrame, DataFrame]:
    good, bad = files.read_catalogue(spark, f"{raw}/seed.csv")
    first = bad.select("adc_id", "violations").limit(3).collect()
    if first:
        raise ValueError(f"invalid catalogue rows: {[(r.adc_id, r.violations) for r in first]}")
    return good.withColumnRenamed("adc_id", "entity_id").withColumnRenamed("adc_name", "name"), files.alias_rows(good)


def _registry(spark: SparkSession, raw: str, dictionary: DataFrame) -> DataFrame | None:
    """Third-party records with the canonical target; pages are named after their entity."""
    fs, folder = merge._fs(spark, f"{raw}/pages")
    if not fs.exists(folder):
        return None
    body = spark.read.text(f"{raw}/pages", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("entity_id"), F.input_file_name().alias("detail_url"), F.col("value").alias("body"))
    records = written(pages.parse_details(body)[0])
    hit = entities.match_dictionary(records.select(F.col("entity_id").alias("record_key"), "antigen_name"), dictionary.filter("entity_type = 'target'"),
                                    key="record_key", text="antigen_name")
    first = hit.groupBy(F.col("record_key").alias("entity_id")).agg(F.min("canonical_name").alias("target"))
    return records.join(first, "entity_id", "left")


def _snapshots(df: DataFrame, source: str, record: str, checksum: str, url: str, path: str, at: str, version: str) -> DataFrame:
    return df.select(
        ids.snapshot_id(F.lit(source), record, checksum).alias("snapshot_id"), F.lit(source).alias("source"), F.col(record).alias("source_record_id"),
        F.lit(at).alias("fetched_at"), F.lit(None).cast("string").alias("source_updated_at"), F.col(url).alias("source_url"), F.col(path).alias("raw_path"),
        F.col(checksum).alias("content_hash"), F.lit(None).cast("string").alias("dataset_version"), F.lit(version).alias("parser_version"))


def refresh(spark: SparkSession, raw: str, run_id: str, run_number: int, observed_at: str, *, previous: str | None = None, policy: Policy | None = None,
            required: tuple[str, ...] = ("clinicaltrials", "pubmed"), max_drop: float = 0.25, max_missing: int = 0) -> Refreshed:
    """Build all tables of a new version from raw files and the previous version under ``previous``."""
    policy = policy or load_policy()
    old = (lambda name: merge.read_current(spark, previous, name)) if previous else None
    at = F.lit(observed_at)

    catalogue, aliases = _catalogue(spark, raw)
    reference = files.read_reference_aliases(spark, f"{raw}/entities.json")
    dictionary = written(entities.alias_dictionary(catalogue, reference))
    trials = written(studies.parse_studies(studies.read_pages(spark, f"{raw}/trials")))
    papers = written(articles.parse_articles(articles.read_articles(spark, f"{raw}/articles")))
    registry = _registry(spark, raw, dictionary)
    registry = None if registry is None else written(registry)

    snapshots = _snapshots(trials, "clinicaltrials", "nct_id", "checksum", "source_url", "raw_path", observed_at, "studies_v1").unionByName(
        _snapshots(papers, "pubmed", "source_record_id", "checksum", "source_url", "raw_path", observed_at, "articles_v1"))
    # Runs and sources are ordered by the upper bits; the lower ones tell the records of one source apart.
    seq = lambda source: F.lit((run_number * 10 + SOURCE_ORDER.index(source)) << RECORD_BITS).cast("bigint")
    batch = [
        facts.catalogue_observations(catalogue.withColumn("seq", seq("curated_seed")), at),
        facts.trial_observations(trials.withColumn("seq", seq("clinicaltrials")), at, ids.snapshot_id(F.lit("clinicaltrials"), "nct_id", "checksum")),
        facts.publication_observations(papers.withColumn("seq", seq("pubmed")), at, ids.snapshot_id(F.lit("pubmed"), "source_record_id", "checksum"))]
    if registry is not None:
        snapshots = snapshots.unionByName(_snapshots(registry, "adcdb", "adcdb_id", "checksum", "detail_url", "detail_url", observed_at, "pages_v1"))
        batch.append(facts.registry_observations(registry.withColumn("seq", seq("adcdb")), at, ids.snapshot_id(F.lit("adcdb"), "adcdb_id", "checksum")))
    snapshots = written(merge.append_snapshots(old("snapshots"), snapshots) if old else snapshots)
    observed = relational.union_all(batch)
    observed = written(observed.withColumn("seq", F.col("seq") + F.pmod(F.xxhash64(*facts.RECORD), F.lit(1 << RECORD_BITS))))
    facts.require_valid(observed, policy, snapshots)
    history = old("observations").unionByName(observed) if old else observed
    if old:
        applied = fact_batch.apply_batch(old("facts"), old("evidence"), observed, policy)
        known, proof = fact_batch.merged(old("facts"), old("evidence"), applied)
        known, proof, told, counters = written(known), written(proof), old("events").unionByName(applied.events), applied.counters
    else:
        store = facts.reconcile(observed, policy)
        known, proof, told = store.facts, store.evidence, store.events
        counters = None

    links = entities.mention_links(
        papers.withColumn("full_text", F.concat_ws("\n", "title", "abstract")), dictionary, record_type="document", source="pubmed", key="document_id",
        record_id="document_id", text="full_text", url="source_url", confidence=0.9)
    named = F.concat_ws("\n", "brief_title", "official_title", F.array_join("interventions", "\n"))
    quote = F.concat("brief_title", F.lit("; interventions: "), F.array_join("interventions", ", "), F.lit("; status: "), F.coalesce("overall_status", F.lit("UNKNOWN")))
    trial_links = entities.mention_links(
        trials.withColumns({"full_text": named, "quote": quote, "shown_status": F.coalesce("overall_status", F.lit("UNKNOWN"))}), dictionary.filter("entity_type <> 'payload'"),
        record_type="trial", source="clinicaltrials", key="nct_id", record_id="nct_id", text="full_text", url="source_url", confidence=0.98,
        predicate="trial_status", value="shown_status", evidence_text="quote")
    links = written(links.unionByName(trial_links))

    topics = papers.select("document_id", F.explode(tx.topics(F.concat_ws(" ", "title", "abstract"))).alias("t")).select("document_id", "t.topic", "t.matched_terms")
    topics = written(topics)
    linked = lambda kind: corpus.linked_entities(links, catalogue, kind)
    documents = corpus.with_content_hash(relational.union_all([
        corpus.profile_documents(catalogue, aliases), corpus.publication_documents(papers, linked("document"), topics),
        corpus.trial_documents(trials, linked("trial"))]))
    documents = written(documents)
    chunk_columns = lambda df: df.withColumn("entities", F.concat_ws(" ", *[F.array_join(f"metadata.{c}", " ") for c in ("adc_names", "targets", "payloads", "aliases")]))
    if old:
        changes = written(corpus.classify_changes(old("documents"), documents))
        chunks = chunk_columns(corpus.merge_chunks(old("chunks").drop("entities"), documents, changes))
    else:
        chunks = chunk_columns(corpus.chunk_documents(documents))
    chunks = written(chunks)

    members = trials.select(F.lit(run_id).alias("run_id"), F.lit("clinicaltrials").alias("source"), F.col("nct_id").alias("source_record_id")).unionByName(
        papers.select(F.lit(run_id).alias("run_id"), F.lit("pubmed").alias("source"), "source_record_id"))
    state = studies.capture_state(studies.read_pages(spark, f"{raw}/trials"))
    counts = members.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("collected_count"))
    when = F.to_timestamp(at)
    cut = F.coalesce(state.select("truncated").scalar(), F.lit(False)) & (F.col("source") == "clinicaltrials")
    log = counts.select(
        "run_id", "source", when.alias("started_at"), when.alias("finished_at"), F.lit("complete").alias("status"), F.lit(1).alias("attempts"),
        F.when(F.col("source") == "clinicaltrials", state.select("expected_count").scalar()).alias("expected_count"), "collected_count",
        (~cut).alias("is_complete"), F.lit(None).cast("string").alias("error_text"), cut.alias("planned_truncation"))
    log = written(old("runs").unionByName(log) if old else log)
    members = written(old("members").unionByName(members) if old else members)
    run_events = runs.source_events(log, members)

    faults = [("duplicate_trials", trials.groupBy("nct_id").count().filter("count > 1")),
              ("orphan_evidence", relational.orphans(proof, known, ["fact_id"], ["fact_id"]))]
    gates = written(runs.refresh_gates(log, members, run_id, required, max_drop=max_drop, max_missing=max_missing, integrity=faults))
    tables = {"catalogue": catalogue, "aliases": aliases, "dictionary": dictionary, "trials": trials, "publications": papers, "snapshots": snapshots,
              "observations": history, "facts": known, "evidence": proof, "events": told, "run_events": run_events, "links": links,
              "topics": topics, "documents": documents, "chunks": chunks, "index": retrieval.build_vector_index(chunks), "runs": log, "members": members}
    return Refreshed(tables, gates, bool(runs.gates_passed(gates).first()[0]), counters)


def publish(spark: SparkSession, root: str, run_id: str, result: Refreshed, policy: Policy | None = None) -> str:
    """Write the version and point ``CURRENT`` at it; a version whose gates fail is not written."""
    if not result.passed:
        failed = [r.name for r in result.gates.filter("NOT passed AND blocking").collect()]
        raise RuntimeError(f"publication gates failed: {failed}")
    policy = policy or load_policy()
    chunks, f = result.tables["chunks"], result.tables["facts"]
    manifest = {
        "policy_version": policy.version, "retrieval_corpus_version": corpus.corpus_version(chunks).first().version,
        "data_version": cards.data_version({"facts": (f, ["fact_id", "content_hash", "status", "valid_to"]),
                                            "trials": (result.tables["trials"], ["nct_id", "checksum"])}, policy.version).first()[0]}
    return merge.publish_version(spark, root, run_id, result.tables, manifest)


def open_store(spark: SparkSession, root: str) -> Store:
    read = lambda name: merge.read_current(spark, root, name)
    return Store(read("catalogue"), read("aliases"), read("dictionary"), read("facts"), read("evidence"), read("events"), read("trials"), read("links"),
                 read("documents"), read("chunks"))
