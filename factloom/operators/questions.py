"""Guarding and routing of questions, as columns over a question table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx, vocabulary as v
from factloom.operators import entities

MAX_QUESTION = 500
MINIMUM_SCORE = {"sparse": 0.5, "dense": 0.20, "hybrid": 0.05}


def _tokens_regex_nct(column: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(r"(?i)\b(NCT\d{8})\b"), F.lit(1)), F.upper))


def question_refusal(question: Column, has_entity: Column) -> Column:
    """Reason why a question is not answered at all, else NULL. The first matching rule wins."""
    stripped = tx.strip(F.coalesce(question, F.lit("")))
    lowered = tx.squeeze(tx.fold(stripped))
    personal = (tx.any_of(lowered, v.PERSONAL_CONTEXT) | lowered.rlike(v.PERSONAL_CONTEXT_REGEX)) & (
        tx.any_of(lowered, v.PERSONAL_ACTION) | lowered.rlike(v.PERSONAL_ACTION_REGEX))
    fill_in = tx.any_of(lowered, v.NO_SOURCE_PATTERNS) & tx.any_of(lowered, v.FILL_IN_ACTIONS)
    in_scope = has_entity | tx.any_of(lowered, v.DOMAIN_TERMS) | stripped.rlike(r"(?i)\b(?:NCT\d{8}|PMID\s*:?\s*\d+)\b")
    return (F.when(stripped == "", "empty_question").when(F.length(stripped) > MAX_QUESTION, "question_too_long")
            .when(tx.any_of(lowered, v.UNSAFE_PATTERNS) | personal, "personalized_medical_advice")
            .when(fill_in, "unsupported_fact_completion").when(tx.any_of(lowered, v.FUTURE_PATTERNS), "future_or_unpublished_claim")
            .when(~in_scope, "out_of_scope"))


def guard_questions(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``refusal_reason``; any dictionary phrase in the question counts as an entity."""
    named = entities.match_dictionary(questions.select("question_id", "question"), dictionary, key="question_id", text="question")
    flags = named.select("question_id").distinct().withColumn("__named", F.lit(True))
    j = questions.join(flags, "question_id", "left")
    return j.withColumn("refusal_reason", question_refusal(F.col("question"), F.coalesce("__named", F.lit(False)))).drop("__named")


def requested_fields(lowered: Column) -> Column:
    """Entity fields a question asks for; a specific field replaces the general one it would also match."""
    asked = dict(v.FIELD_MARKERS) | dict(v.UNSUPPORTED_FIELD_MARKERS)
    picks = []
    for field, markers in v.FIELD_MARKERS:
        wanted = tx.any_of(lowered, markers)
        for general, specific, exceptions in v.FIELD_OVERRIDES:
            if general == field:
                wanted = wanted & (~tx.any_of(lowered, asked[specific]) | tx.any_of(lowered, exceptions))
        picks.append(F.when(wanted, F.lit(field)))
    picks += [F.when(tx.any_of(lowered, markers), F.lit(field)) for field, markers in v.UNSUPPORTED_FIELD_MARKERS]
    return F.array_compact(F.array(*picks))


def requested_trial_fields(lowered: Column) -> Column:
    return F.array_compact(F.array(*[F.when(tx.any_of(lowered, m), F.lit(p)) for p, m in v.TRIAL_FIELD_MARKERS]))


def window_days(lowered: Column) -> Column:
    return F.when(tx.any_of(lowered, v.MONTH_MARKERS), 30).when(tx.any_of(lowered, v.DAY_MARKERS), 1).otherwise(7)


def source_type(lowered: Column) -> Column:
    result = F.lit(None).cast("string")
    for kind, markers in reversed(v.SOURCE_TYPE_MARKERS):
        result = F.when(tx.any_of(lowered, markers), kind).otherwise(result)
    return result


def literature_topic(lowered: Column) -> Column:
    result = F.lit(None).cast("string")
    for topic, markers in reversed(v.TOPIC_MARKERS):
        result = F.when(tx.any_of(lowered, markers), topic).otherwise(result)
    return result


def phase_filter(lowered: Column) -> Column:
    result = F.lit(None).cast("string")
    for marker, phase in reversed(v.PHASE_MARKERS):
        result = F.when(F.contains(lowered, F.lit(marker)), phase).otherwise(result)
    return result


def route_questions(questions: DataFrame, forms: DataFrame) -> DataFrame:
    """Plan of every question: route, reason, confidence, entities, fields, trial ids, targets and days.

    ``forms(entity_id, entity_name, form)`` are the names and aliases of the catalogue. Precedence: comparison unless a
    trial is meant, change, trial, literature, entity fields, refusal.
    """
    hits = entities.resolve_in_questions(questions, forms, key="question_id", question="question")
    listed = F.array_sort(F.collect_list(F.struct("position", "entity_id", "entity_name")))
    per = hits.groupBy("question_id").agg(listed.alias("__e"))
    none = F.array().cast("array<string>")
    j = questions.join(per, "question_id", "left").withColumn("lowered", tx.fold(F.col("question")))
    j = j.withColumn("entity_ids", F.coalesce(F.transform("__e", lambda e: e["entity_id"]), none)).withColumn(
        "entity_names", F.coalesce(F.transform("__e", lambda e: e["entity_name"]), none)).drop("__e")
    low, known = F.col("lowered"), F.size("entity_ids")
    j = j.withColumn("trial_ids", _tokens_regex_nct(F.col("question")))
    targets = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.casefold())), F.lit(t)) for t in v.TARGETS]))
    comparison, change = tx.any_of(low, v.COMPARISON_MARKERS), tx.any_of(low, v.CHANGE_MARKERS)
    trial = (F.size("trial_ids") > 0) | tx.any_of(low, v.TRIAL_MARKERS) | low.rlike(r"(?iU)\b(?:phase\s*)?(?:i{1,3}|iv|v)\s*期")
    literature = tx.any_of(low, v.LITERATURE_MARKERS) | low.rlike(r"(?U)\b(?:orr|mtd)\b")
    reason = (
        F.when(comparison & ~trial, F.when(known >= 2, "comparison_intent_with_multiple_known_adcs")
               .when(literature, "literature_intent_overrides_incomplete_comparison_entities")
               .otherwise("comparison_requires_two_known_adcs"))
        .when(change, "recent_change_intent").when(trial, "trial_identifier_or_registry_field_intent")
        .when(literature, "literature_or_unstructured_research_claim_intent")
        .when(known > 0, "known_adc_with_structured_field_intent").otherwise("no_supported_entity_or_route"))
    routes = {
        "comparison_intent_with_multiple_known_adcs": "comparison",
        "literature_intent_overrides_incomplete_comparison_entities": "literature_evidence",
        "comparison_requires_two_known_adcs": "refusal", "recent_change_intent": "change_query",
        "trial_identifier_or_registry_field_intent": "trial_lookup",
        "literature_or_unstructured_research_claim_intent": "literature_evidence",
        "known_adc_with_structured_field_intent": "structured_fact", "no_supported_entity_or_route": "refusal"}
    j = j.withColumn("reason", reason).withColumn(
        "route", F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])[F.col("reason")])
    fields, trial_fields = requested_fields(low), requested_trial_fields(low)
    default = lambda items, names: F.when(F.size(items) > 0, items).otherwise(F.array(*[F.lit(n) for n in names]))
    route = F.col("route")
    predicates = (F.when(route.isin("comparison", "structured_fact"), default(fields, v.PROFILE_DEFAULTS))
                  .when(route == "trial_lookup", default(trial_fields, v.TRIAL_DEFAULTS)).otherwise(none))
    confidence = (F.when(route == "change_query", 0.98).when(route == "trial_lookup", F.when(F.size("trial_ids") > 0, 1.0).otherwise(0.92))
                  .when(route == "literature_evidence", 0.9).when(route == "structured_fact", F.when(F.size(fields) > 0, 1.0).otherwise(0.85))
                  .when(F.col("reason") == "no_supported_entity_or_route", 0.95).otherwise(1.0))
    return j.select(
        *questions.columns, "route", "reason", confidence.alias("confidence"), "entity_ids", "entity_names", predicates.alias("predicates"),
        "trial_ids", targets.alias("targets"), F.when(route == "change_query", window_days(low)).alias("days"),
        source_type(low).alias("source_type"), literature_topic(low).alias("topic"), phase_filter(low).alias("phase"))


def evidence_refusal(questions: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """Reason why the retrieved rows do not carry an answer: ``(question_id, refusal_reason)``, NULL when they do.

    ``results(question_id, rank, score, retrieval_document_id, source_record_id, title, content)`` holds the few rows per
    question that search returned.
    """
    text = F.concat_ws(" ", "retrieval_document_id", "source_record_id", "title", "content")
    combined = results.groupBy("question_id").agg(
        F.max_by("score", -F.col("rank")).alias("top_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), " ").alias("all_text"))
    j = questions.select("question_id", "question").join(combined, "question_id", "left")
    evidence = tx.normalize_text(F.coalesce("all_text", F.lit("")))
    generic = r"(?i)\b(?!PMID\b)(?!NCT\d{8}\b)[A-Za-z]{2,}[- ]?\d{2,}[A-Za-z0-9-]*\b"
    named = F.concat(F.regexp_extract_all("question", F.lit(r"(?i)\bPMID\s*:?[ \t]*(\d+)\b"), F.lit(1)),
                     F.regexp_extract_all("question", F.lit(r"(?i)\b(NCT\d{8})\b"), F.lit(1)),
                     F.regexp_extract_all("question", F.lit(generic), F.lit(0)))
    j = j.withColumn("__ev", evidence).withColumn("__ids", F.transform(named, lambda i: tx.keep_alphanumeric(F.lower(i))))
    absent = F.exists("__ids", lambda i: (i != "") & ~F.contains(F.col("__ev"), i))
    low = tx.fold(F.col("question"))
    off_topic = F.lit(False)
    for group in v.TOPIC_ANCHORS:
        off_topic = off_topic | (tx.any_of(low, group) & ~tx.any_of(F.col("__ev"), group))
    reason = (F.when(F.col("top_score").isNull(), "no_retrieval_results")
              .when(F.col("top_score") < MINIMUM_SCORE.get(mode, 0.0), "low_retrieval_relevance")
              .when(absent, "specific_identifier_not_found").when(off_topic, "topic_not_supported"))
    return j.select("question_id", reason.alias("refusal_reason"))
