"""End-to-end answering of a question table over one published version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import answers, cards, questions as qs, relational, retrieval
from factloom.operators.stages import written
from factloom.policy import Policy

RESULT = ("question_id", "status", "refusal_reason", "route", "answer", "claim_count", "citations")


@dataclass(frozen=True)
class Store:
    """Tables of one version."""
    catalogue: DataFrame
    aliases: DataFrame
    dictionary: DataFrame
    facts: DataFrame
    evidence: DataFrame
    events: DataFrame
    trials: DataFrame
    links: DataFrame
    documents: DataFrame
    chunks: DataFrame


def forms(store: Store) -> DataFrame:
    names = store.catalogue.select("entity_id", F.col("name").alias("entity_name"), F.col("name").alias("form"))
    more = store.aliases.join(store.catalogue.select("entity_id", F.col("name").alias("entity_name")), "entity_id").select(
        "entity_id", "entity_name", F.col("alias").alias("form"))
    return names.unionByName(more).distinct()


def field_citations(store: Store) -> DataFrame:
    """Evidence ids of the shown facts per entity field, in value and source order."""
    shown = cards.fact_rows(store.facts, store.evidence, None).filter("fact_evidence_id IS NOT NULL")
    ordered = F.array_sort(F.collect_set(F.struct("display_value", "source", "observed_at", "fact_evidence_id")))
    return shown.groupBy("subject_id", "predicate").agg(F.transform(ordered, lambda s: s["fact_evidence_id"]).alias("citation_keys"))


def resolved_events(store: Store) -> DataFrame:
    """Change events with the entities and targets they concern."""
    e = store.events.withColumn("subject_type", F.when(F.col("subject_type") == "adc", "entity").otherwise(F.col("subject_type")))
    bridge = store.links.select(
        F.when(F.col("source_record_type") == "document", "publication").otherwise(F.col("source_record_type")).alias("subject_type"),
        F.regexp_replace("source_record_id", "^pubmed:", "").alias("subject_id"),
        F.when(F.col("entity_type") == "adc", "entity").otherwise(F.col("entity_type")).alias("entity_type"), "entity_id").filter("entity_type <> 'payload'")
    catalogue = store.catalogue.select("entity_id", F.col("name").alias("entity_name"), "target")
    r = relational.resolve_subjects(e.select("event_id", "subject_type", "subject_id"), bridge.distinct(), catalogue)
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    text = lambda c: F.replace(F.regexp_replace(c, r'^\[|\]$', ""), F.lit('"'), F.lit(""))
    return r.select("event_id", split("entity_ids").alias("entity_ids"), split("entity_names").alias("entity_names"), split("targets").alias("targets")).join(
        e.select("event_id", "event_type", "subject_type", "subject_id", "predicate", "detected_at", text(F.col("old_value_json")).alias("old_text"),
                 text(F.col("new_value_json")).alias("new_text")), "event_id")


def answer_questions(questions: DataFrame, store: Store, policy: Policy, now: Column, *, mode: str = "sparse", top_k: int = 5,
                     index: DataFrame | None = None) -> DataFrame:
    """One row per question: guard, route, then the structured template or the retrieval path of the route.

    Structured questions never fall back to retrieval.
    """
    guarded = written(qs.guard_questions(questions, store.dictionary))
    plans = written(qs.route_questions(guarded.filter("refusal_reason IS NULL").select(*questions.columns), forms(store)))
    none, zero = F.array().cast("array<string>"), F.lit(0)
    refused = guarded.filter("refusal_reason IS NOT NULL").select(
        "question_id", F.lit("refused").alias("status"), "refusal_reason", F.lit("refusal").alias("route"), F.lit(None).cast("string").alias("answer"),
        zero.alias("claim_count"), none.alias("citations")).unionByName(plans.filter("route = 'refusal'").select(
            "question_id", F.lit("refused").alias("status"), F.col("reason").alias("refusal_reason"), "route", F.lit(None).cast("string").alias("answer"),
            zero.alias("claim_count"), none.alias("citations")))

    subjects = store.catalogue.select(F.col("entity_id").alias("subject_id"))
    fields = cards.card_fields(subjects, store.facts.filter("subject_type = 'adc'"), store.evidence, None, policy, cards.ENTITY_FIELDS, now)
    cited = field_citations(store)
    of = lambda route: plans.filter(F.col("route") == route)
    trial_links = store.links.filter("entity_type = 'adc' AND source_record_type = 'trial'").select("entity_id", F.col("source_record_id").alias("nct_id"))
    items = relational.union_all([
        answers.field_items(of("structured_fact"), fields, cited), answers.field_items(of("comparison"), fields, cited, fields_first=True),
        answers.trial_items(of("trial_lookup"), store.trials, trial_links), answers.change_items(of("change_query"), resolved_events(store), now)])
    structured = answers.assemble(items).join(plans.select("question_id", "route"), "question_id").select(
        "question_id", "status", "refusal_reason", "route", "answer", "claim_count", F.col("citation_keys").alias("citations"))
    return refused.unionByName(structured).unionByName(_literature(of("literature_evidence"), store, mode, top_k, index)).select(*RESULT)


def _literature(plans: DataFrame, store: Store, mode: str, top_k: int, index: DataFrame | None) -> DataFrame:
    """Identifier search first, then one ranked search for all other questions.

    A single named entity and a topic narrow the search of their question; chunks of any named entity come first.
    """
    asked = plans.select("question_id", "question")
    exact = written(retrieval.identifier_search(store.chunks, asked, source_type="pubmed", top_k=top_k))
    rest = plans.join(exact.select("question_id").distinct(), "question_id", "left_anti")
    rest = written(rest.select("question_id", "question", "topic", "entity_ids"))
    hits = retrieval.search(
        mode, store.chunks, rest.select("question_id", "question"), index=index, top_k=top_k, source_type="pubmed",
        question_topics=rest.select("question_id", "topic"), question_entities=rest.select("question_id", F.explode("entity_ids").alias("entity_id")),
        required_entities=rest.filter("size(entity_ids) = 1").select("question_id", F.element_at("entity_ids", 1).alias("entity_id")))
    columns = ["question_id", "rank", "score", "chunk_id"]
    found = exact.select(*columns).unionByName(retrieval.with_chunk(hits, store.chunks).select(*columns))
    rows = found.join(store.chunks.select("chunk_id", "retrieval_document_id", "source_type", "source_record_id", "title", "content"), "chunk_id")
    rows = retrieval.expand_context(rows, store.documents)
    out = answers.literature_answers(asked, rows, mode, top_k)
    return out.select("question_id", "status", "refusal_reason", F.lit("literature_evidence").alias("route"), "answer",
                      F.col("supported_claims").cast("int").alias("claim_count"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
