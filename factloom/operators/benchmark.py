"""Benchmark questions generated from the stored data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import first_per_group, union_all
from factloom.operators.scan import pair_with_next

TEXT_FIELDS = (("target", "靶点"), ("payload_name", "载荷"))
TOPIC_LABELS = (("mechanism", "机制"), ("efficacy", "疗效"), ("safety", "安全性"))
COLUMNS = ("question_id", "split", "category", "question", "expected_route", "expected_status", "kind", "expected_cells", "allowed",
           "accepted_documents", "allow_partial", "should_refuse")
CELL = "array<struct<subject_id:string,field:string,values:array<string>,is_list:boolean>>"


def _cell(subject: Column, field: str, value: Column, is_list: bool = False) -> Column:
    return F.struct(subject.alias("subject_id"), F.lit(field).alias("field"), (value if is_list else F.array(value)).alias("values"),
                    F.lit(is_list).alias("is_list"))


def _rows(df: DataFrame, *, question_id: Column, split: str, category: str, question: Column, status: Column, kind: Column,
          cells: Column | None = None, allowed: Column | None = None, documents: Column | None = None, partial: Column, refuse: bool = False) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        question_id.alias("question_id"), F.lit(split).alias("split"), F.lit(category).alias("category"), question.alias("question"),
        F.lit("refusal" if refuse else category).alias("expected_route"), status.alias("expected_status"), kind.alias("kind"),
        (F.array().cast(CELL) if cells is None else cells.cast(CELL)).alias("expected_cells"), (none if allowed is None else allowed).alias("allowed"),
        (none if documents is None else documents).alias("accepted_documents"), partial.alias("allow_partial"), F.lit(refuse).alias("should_refuse"))



def _either() -> Column:
    return F.array(F.lit("answered"), F.lit("partial"))


def fact_questions(catalogue: DataFrame) -> DataFrame:
    """Two field questions per entity; a missing value becomes an explicit gap."""
    frames = []
    for field, label in TEXT_FIELDS:
        value = F.col(field)
        empty = F.trim(F.coalesce(value, F.lit(""))) == ""
        frames.append(_rows(
            catalogue, question_id=F.concat(F.lit("fact_"), "entity_id", F.lit(f"_{field}")), split="dev", category="structured_fact",
            question=F.concat("name", F.lit(f" 的{label}是什么？")), status=F.when(empty, F.array(F.lit("refused"), F.lit("partial"))).otherwise(_either()),
            kind=F.when(empty, "gap").otherwise("structured"),
            cells=F.when(empty, F.array().cast(CELL)).otherwise(F.array(_cell(F.lit(None).cast("string"), field, value)).cast(CELL)),
            allowed=F.when(empty, F.array().cast("array<string>")).otherwise(F.array(value)), partial=empty))
    return union_all(frames)


def comparison_questions(catalogue: DataFrame, limit: int = 10, field: str = "payload_name", label: str = "载荷") -> DataFrame:
    """Each of the first entities against the next one; the last entity is followed by the first."""
    numbered = catalogue.withColumn("__n", F.col("entity_number"))
    pairs = pair_with_next(numbered.select(F.col("__n").alias("entity_number")), "entity_number")
    left = numbered.select("__n", *[F.col(c).alias(f"l_{c}") for c in ("entity_id", "name", field)])
    right = numbered.select("__n", *[F.col(c).alias(f"r_{c}") for c in ("entity_id", "name", field)])
    j = pairs.orderBy("left_key").limit(limit).join(left, F.col("left_key") == left["__n"]).drop("__n").join(
        right, F.col("right_key") == right["__n"]).drop("__n")
    return _rows(j, question_id=F.concat(F.lit("compare_"), F.col("left_key").cast("string")), split="dev", category="comparison",
                 question=F.concat(F.lit("比较 "), "l_name", F.lit(" 和 "), "r_name", F.lit(f" 的{label}。")), status=_either(), kind=F.lit("comparison"),
                 cells=F.array(_cell(F.col("l_entity_id"), field, F.col(f"l_{field}")), _cell(F.col("r_entity_id"), field, F.col(f"r_{field}"))),
                 partial=F.lit(True))


def trial_questions(trials: DataFrame, links: DataFrame, limit: int = 12) -> DataFrame:
    """One representative trial, the first by id, for each of the first ``limit`` linked entities."""
    first = links.groupBy("entity_id").agg(F.min("nct_id").alias("nct_id")).orderBy("entity_id").limit(limit)
    j = first.join(trials.select("nct_id", "overall_status", "phases"), "nct_id")
    key = F.col("nct_id")
    return _rows(j, question_id=F.concat(F.lit("trial_"), "entity_id"), split="public_smoke", category="trial_lookup",
                 question=F.concat(F.lit("试验 "), key, F.lit(" 当前登记状态和阶段是什么？")), status=_either(), kind=F.lit("trial_record"),
                 cells=F.array(_cell(key, "nct_id", key), _cell(key, "overall_status", F.col("overall_status")), _cell(key, "phases", F.col("phases"), True)),
                 partial=F.lit(True))


def literature_questions(publications: DataFrame, links: DataFrame, names: DataFrame, limit: int = 12, accepted: int = 50) -> DataFrame:
    """One question per entity; accepted are its first ``accepted`` papers, those that name it in the title first.

    ``links(entity_id, document_id)``, ``names(entity_id, name)``; ``publications(document_id, title, abstract)``. The cut
    at ``accepted`` papers belongs to the question format.
    """
    wanted = links.select("entity_id").distinct().orderBy("entity_id").limit(limit)
    j = links.join(wanted, "entity_id", "left_semi").join(publications, "document_id").join(names, "entity_id")
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower("name"))
    ranked = first_per_group(j, ["entity_id"], [F.desc(has("title")), F.desc(has("abstract")), F.col("document_id")], accepted)
    per = ranked.groupBy("entity_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "document_id"))), lambda s: s["document_id"]).alias("docs"))
    return _rows(per, question_id=F.concat(F.lit("literature_"), "entity_id"), split="public_smoke", category="literature_evidence",
                 question=F.concat(F.lit("请给出一篇与 "), "name", F.lit(" 直接相关的文献证据。")), status=_either(), kind=F.lit("evidence_document"),
                 documents=F.col("docs"), partial=F.lit(True))


def topic_questions(topics: DataFrame, links: DataFrame, names: DataFrame, limit: int = 12, accepted: int = 50) -> DataFrame:
    """Questions per entity and topic, the first ``limit`` in (entity, topic) order; ``topics(document_id, topic)``."""
    labels = F.create_map(*[F.lit(x) for pair in TOPIC_LABELS for x in pair])
    j = links.join(topics.filter(F.col("topic").isin(*[k for k, _ in TOPIC_LABELS])), "document_id").join(names, "entity_id")
    groups = j.select("entity_id", "topic").distinct().orderBy("entity_id", "topic").limit(limit)
    ranked = first_per_group(j.join(groups, ["entity_id", "topic"], "left_semi"), ["entity_id", "topic"], [F.col("document_id")], accepted)
    per = ranked.groupBy("entity_id", "topic", "name").agg(F.array_sort(F.collect_list("document_id")).alias("docs"))
    return _rows(per, question_id=F.concat_ws("_", F.lit("topic"), "topic", "entity_id"), split="public_smoke", category="literature_evidence",
                 question=F.concat(F.lit("请给出一篇与 "), "name", F.lit(" 的"), labels[F.col("topic")], F.lit("相关的文献证据。")), status=_either(),
                 kind=F.lit("evidence_document"), documents=F.col("docs"), partial=F.lit(True))


def refusal_questions(df: DataFrame) -> DataFrame:
    """``df(question_id, question)`` of questions that must be refused."""
    return _rows(df, question_id=F.col("question_id"), split="public_smoke", category="safety_refusal", question=F.col("question"),
                 status=F.array(F.lit("refused")), kind=F.lit("refusal"), partial=F.lit(False), refuse=True)
