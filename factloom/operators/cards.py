"""Evidence cards, comparisons and briefs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators.facts import freshness
from factloom.policy import Policy

# The ten fields of an entity card and their labels.
ENTITY_FIELDS = (
    ("adc.target", "靶点"),
    ("adc.antibody", "抗体"),
    ("adc.linker_name", "连接子"),
    ("adc.linker_type", "连接子类型"),
    ("adc.payload_name", "载荷"),
    ("adc.payload_class", "载荷类型"),
    ("adc.dar", "药物抗体比"),
    ("adc.indication", "适应证"),
    ("adc.development_status", "研发状态"),
    ("adc.company", "企业"),
)
NOT_RECORDED = "未记录"
MAX_COMPARED = 10


def fact_rows(facts: DataFrame, evidence: DataFrame, snapshots: DataFrame | None, active: bool = True) -> DataFrame:
    """Facts with their evidence and the snapshot it came from: open ones, or the history."""
    if active:
        f = facts.filter("valid_to IS NULL AND status IN ('current', 'conflicted')")
        e = evidence.filter("is_current")
    else:
        f, e = facts.filter("valid_to IS NOT NULL OR status = 'superseded'"), evidence
    e = e.select("fact_id", "fact_evidence_id", "source", "source_record_id", "source_url", "source_locator", "evidence_text",
                 "snapshot_id", F.col("observed_at"), F.col("review_status").alias("evidence_review_status"))
    rows = f.join(e, "fact_id", "left")
    if snapshots is None:
        return rows.withColumn("fetched_at", F.lit(None).cast("string"))
    return rows.join(snapshots.select("snapshot_id", "fetched_at"), "snapshot_id", "left")


def review_status(statuses: Column) -> Column:
    """Collapse a set of review statuses."""
    return (F.when(F.size(statuses) == 0, "not_applicable").when(F.size(statuses) == 1, F.try_element_at(statuses, F.lit(1)))
            .when(F.array_contains(statuses, "needs_review"), "needs_review").otherwise("mixed"))


def card_fields(subjects: DataFrame, facts: DataFrame, evidence: DataFrame, snapshots: DataFrame | None, policy: Policy,
                fields: Sequence[tuple[str, str]], now: Column) -> DataFrame:
    """One row per subject and card field, missing fields included.

    The sets gathered per field are bounded by the sources of the policy and the open values of the field.
    """
    rows = freshness(fact_rows(facts, evidence, snapshots), policy, now)
    has = F.col("fact_evidence_id").isNotNull()
    external = has & (F.col("source") != "curated_seed")
    full = F.lit(True)
    for c in ("source_record_id", "source_url", "observed_at", "evidence_review_status"):
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    per_field = rows.groupBy("subject_id", "predicate").agg(
        F.bool_or(F.col("status") == "conflicted").alias("is_conflicted"),
        F.coalesce(F.bool_or(F.col("is_stale")), F.lit(False)).alias("is_stale"),
        F.bool_or(external).alias("__external"),
        F.bool_or(external & (F.col("freshness_status") == "unknown")).alias("__undated"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count_if(has).alias("evidence_count"),
        F.max("observed_at").alias("latest_observed_at"), F.bool_and(~has | full).alias("__traceable"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("display_value", "fact_id"))), lambda s: s["display_value"]),
                     "；").alias("display_value"),
        F.array_sort(F.array_union(F.collect_set("review_status"), F.collect_set("evidence_review_status"))).alias("__reviews"),
    )
    spec = F.explode(F.array(*[F.struct(F.lit(p).alias("predicate"), F.lit(label).alias("label"), F.lit(i).alias("field_order"))
                               for i, (p, label) in enumerate(fields)]))
    wanted = subjects.select("subject_id", spec.alias("s")).select("subject_id", "s.*")
    j = wanted.join(per_field, ["subject_id", "predicate"], "left")
    missing = F.col("display_value").isNull()
    stale = F.coalesce("is_stale", F.lit(False))
    return j.select(
        "subject_id", "predicate", "label", "field_order",
        F.when(missing, "missing").when(F.col("is_conflicted"), "conflicted").otherwise("current").alias("status"),
        F.when(missing, "unknown").when(F.col("is_conflicted"), F.when(stale, "stale").otherwise("mixed"))
        .when(stale, "stale").when(~F.col("__external"), "demo_source").when(F.col("__undated"), "unknown")
        .otherwise("current").alias("freshness_status"),
        stale.alias("is_stale"), F.coalesce("display_value", F.lit(NOT_RECORDED)).alias("display_value"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        "latest_observed_at",
        F.coalesce((F.col("evidence_count") > 0) & F.col("__traceable"), F.lit(False)).alias("traceability_complete"),
        F.when(missing, "not_applicable").otherwise(review_status(F.col("__reviews"))).alias("review_status"))


def _page(key: Column, size: Column, limit: int) -> Column:
    """The page of an item: items are dealt by a hash of their key to as many pages as ``limit`` items for each ask for."""
    number = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, F.ceil(size / F.lit(limit))).cast("int")


def nested_facts(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Facts with their evidence as an array: rows of one fact and page; ``rows`` as :func:`fact_rows` with freshness.

    A fact with more than about ``limit`` pieces of evidence has them on several pages, each an own row, so no array grows with the evidence of a fact.
    Evidence is ordered by source and time inside its page. ``evidence_count`` counts all pages.
    """
    has = F.col("fact_evidence_id").isNotNull()
    size = rows.groupBy("fact_id").agg(F.greatest(F.count_if(has), F.lit(1)).alias("__size"), F.count_if(has).alias("evidence_count"))
    item = F.struct("source", "observed_at", "fact_evidence_id", "source_record_id", "source_locator", "evidence_text", "source_url", "freshness_status", "is_stale",
                    F.col("evidence_review_status").alias("review_status"))
    paged = rows.join(size, "fact_id").withColumn("evidence_page", _page(F.coalesce("fact_evidence_id", "fact_id"), F.col("__size"), limit))
    fact = ["fact_id", "subject_id", "predicate", "normalized_value_json", "display_value", "status", "valid_from", "valid_to", "review_status"]
    return paged.groupBy("fact_id", "evidence_page").agg(
        *[F.first(c).alias(c) for c in fact[1:]], F.first("evidence_count").alias("evidence_count"), F.array_sort(F.collect_list(F.when(has, item))).alias("evidence"))


def nested_cards(facts: DataFrame, evidence: DataFrame, snapshots: DataFrame | None, policy: Policy, now: Column, *, active: bool = True,
                 fact_limit: int = 50, evidence_limit: int = 50) -> DataFrame:
    """Fields with their facts, each with its evidence, nested: one row for each subject, field and page of facts.

    Further evidence pages of a fact are further items of the field. ``fact_count``, ``evidence_count`` and the collapsed ``review_status`` are those of the whole field.
    """
    held = freshness(fact_rows(facts, evidence, snapshots, active), policy, now)
    items = nested_facts(held, evidence_limit)
    field = ["subject_id", "predicate"]
    whole = items.groupBy(*field).agg(
        F.count(F.lit(1)).alias("__size"), F.countDistinct("fact_id").alias("fact_count"), F.sum(F.size("evidence")).alias("field_evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.array_append(F.transform("evidence", lambda e: e["review_status"]), F.col("review_status"))))))).alias("__reviews"))
    item = F.struct("display_value", "fact_id", "evidence_page", "normalized_value_json", "status", "valid_from", "valid_to", "review_status", "evidence_count", "evidence")
    paged = items.join(whole, field).withColumn("page", _page(F.concat_ws(":", "fact_id", F.col("evidence_page").cast("string")), F.col("__size"), fact_limit))
    return paged.groupBy(*field, "page").agg(
        F.first("fact_count").alias("fact_count"), F.first("field_evidence").alias("evidence_count"), F.first(review_status(F.col("__reviews"))).alias("review_status"),
        F.array_sort(F.collect_list(item)).alias("facts"))


def brief_json(nested: DataFrame) -> DataFrame:
    """The nested rows as canonical JSON: (subject_id, predicate, page, body)."""
    body = ids.canonical_json(F.to_json(F.struct("predicate", "page", "fact_count", "evidence_count", "review_status", "facts"), {"ignoreNullFields": "false"}))
    return nested.select("subject_id", "predicate", "page", body.alias("body"))


def brief_lines(nested: DataFrame, policy: Policy) -> DataFrame:
    """Markdown lines of the evidence of each field: (subject_id, predicate, page, line, text)."""
    names = F.create_map(*[F.lit(x) for s, p in policy.sources.items() for x in (s, p["display_name"])])
    fact = F.posexplode("facts").alias("f_pos", "f")
    rows = nested.select("subject_id", "predicate", "page", fact).select("subject_id", "predicate", "page", "f_pos", "f.display_value", F.posexplode_outer("f.evidence").alias("e_pos", "e"))
    head = F.concat(F.lit("#### "), "predicate", F.lit("："), "display_value")
    proof = F.concat(F.lit("- **"), F.coalesce(names[F.col("e.source")], F.col("e.source")), F.lit("** / `"), F.col("e.source_record_id"), F.lit("`；观测时间："), F.col("e.observed_at"),
                     F.lit("；审核："), F.col("e.review_status"), F.lit("；[打开来源]("), F.col("e.source_url"), F.lit(")"))
    quote = F.concat(F.lit("  - 证据："), F.col("e.evidence_text"))
    lines = F.array_compact(F.concat(F.when(F.coalesce("e_pos", F.lit(0)) == 0, F.array(head)).otherwise(F.array().cast("array<string>")), F.array(proof, quote)))
    return rows.select("subject_id", "predicate", "page", "f_pos", "e_pos", F.posexplode(lines).alias("l_pos", "text")).select(
        "subject_id", "predicate", "page", F.struct("f_pos", F.coalesce("e_pos", F.lit(0)).alias("e_pos"), "l_pos").alias("line"), "text")


def field_history(facts: DataFrame) -> DataFrame:
    """Closed and outranked values per field with their validity."""
    past = facts.filter("valid_to IS NOT NULL OR status = 'superseded'")
    return past.select("subject_id", "predicate", "display_value", "valid_from", "valid_to", "status")


def card_summary(fields: DataFrame) -> DataFrame:
    return fields.groupBy("subject_id").agg(
        F.sum("evidence_count").alias("evidence_count"), F.count_if(F.col("status") == "missing").alias("missing_fields"),
        F.count_if(F.col("status") == "conflicted").alias("conflicted_fields"), F.count_if("is_stale").alias("stale_fields"),
        F.bool_and((F.col("status") == "missing") | F.col("traceability_complete")).alias("traceability_complete"))


def selected_ids(subject_ids: Sequence[str], low: int) -> list[str]:
    chosen = list(dict.fromkeys(str(s) for s in subject_ids))
    if not low <= len(chosen) <= MAX_COMPARED:
        raise ValueError(f"between {low} and {MAX_COMPARED} different ids are needed")
    return chosen


def compare(fields: DataFrame, subject_ids: Sequence[str]) -> DataFrame:
    """Field by subject matrix of two to ten subjects; cells read ``status:value``."""
    chosen = selected_ids(subject_ids, 2)
    cells = fields.filter(F.col("subject_id").isin(chosen)).select(
        "predicate", "subject_id", F.concat_ws(":", "status", "display_value").alias("cell"))
    return cells.groupBy("predicate").pivot("subject_id", chosen).agg(F.first("cell"))


def comparison_table(fields: DataFrame, names: DataFrame, subject_ids: Sequence[str], version: dict[str, str]) -> DataFrame:
    """Wide comparison with seven columns per subject, as written to CSV. ``names(subject_id, name)``."""
    chosen = selected_ids(subject_ids, 2)
    f = fields.filter(F.col("subject_id").isin(chosen)).join(names, "subject_id")
    cells = {"name": "name", "value": "display_value", "status": "status", "freshness": "freshness_status",
             "review_status": "review_status", "sources": "sources", "observed_at": "latest_observed_at"}
    wide = f.groupBy("predicate", F.col("label").alias("field_label"), "field_order").pivot("subject_id", chosen).agg(
        *[F.first(F.replace(F.col(c), F.lit(","), F.lit(" | ")) if out == "sources" else F.coalesce(F.col(c), F.lit("")))
          .alias(out) for out, c in cells.items()])
    return wide.orderBy("field_order").select(
        *[F.lit(v).alias(k) for k, v in version.items()], "predicate", "field_label",
        *[F.col(f"`{s}_{out}`") for s in chosen for out in cells])


def brief_id(data_version: str, subject_ids: Sequence[str], generated_at: str) -> Column:
    payload = json.dumps({"adc_ids": selected_ids(subject_ids, 1), "data_version": data_version, "generated_at": generated_at},
                         ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return F.concat(F.lit("brief_"), F.substring(F.sha2(F.lit(payload), 256), 1, 24))


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def comparison_markdown(fields: DataFrame, names: DataFrame, subject_ids: Sequence[str]) -> DataFrame:
    """Markdown table lines of a comparison, numbered; conflicts are marked in the cell."""
    chosen = selected_ids(subject_ids, 2)
    shown = F.concat("display_value", F.when(F.col("status") == "conflicted", "（冲突）").otherwise(""))
    cells = fields.filter(F.col("subject_id").isin(chosen)).withColumn("cell", markdown_cell(shown))
    wide = cells.groupBy("field_order", "label").pivot("subject_id", chosen).agg(F.first("cell"))
    body = wide.select((F.col("field_order") + 2).alias("line"), F.concat(
        F.lit("| "), markdown_cell(F.col("label")), F.lit(" | "), F.concat_ws(" | ", *[F.col(f"`{s}`") for s in chosen]), F.lit(" |"))
        .alias("text"))
    order = F.create_map(*[x for i, s in enumerate(chosen) for x in (F.lit(s), F.lit(i))])
    head = names.filter(F.col("subject_id").isin(chosen)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct(order[F.col("subject_id")].alias("i"), markdown_cell(F.col("name")).alias("n")))), lambda s: s["n"]), " | ").alias("n"))
    head = head.select(F.explode(F.array(
        F.struct(F.lit(0).alias("line"), F.concat(F.lit("| 字段 | "), "n", F.lit(" |")).alias("text")),
        F.struct(F.lit(1).alias("line"), F.lit("|---|" + "---|" * len(chosen)).alias("text")))).alias("h")).select("h.*")
    return head.unionByName(body).orderBy("line")


def data_version(parts: dict[str, tuple[DataFrame, Sequence[str]]], policy_version: str) -> DataFrame:
    """One version over several tables; each contributes its order-independent digest."""
    rows = None
    for name, (df, columns) in sorted(parts.items()):
        one = ids.table_digest(df, columns).select(F.lit(name).alias("name"), "version")
        rows = one if rows is None else rows.unionByName(one)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "version"))),
                                      lambda s: F.concat_ws("=", s["name"], s["version"])), "\n")
    return rows.agg(F.concat(F.lit("data_"), ids.digest(F.lit(policy_version), listed)).alias("data_version"))
