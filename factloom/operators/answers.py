"""Answers: structured templates, numbered sources, extraction, citation and claim checks, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx, vocabulary as v
from factloom.operators import questions as qs, retrieval
from factloom.operators.relational import first_per_group
from factloom.operators.sizes import broadcast_if_small
from factloom.operators.stages import written

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BULLETS = "-*•0123456789.、 "
ITEM_TYPE = "question_id, item_order, label, text, subject_type, subject_id, predicate, value, citation_keys, gap_reason"


# ---------------------------------------------------------------- structured templates


def _items(df: DataFrame) -> DataFrame:
    return df.select(*ITEM_TYPE.split(", "))


def field_items(plans: DataFrame, fields: DataFrame, citations: DataFrame, *, fields_first: bool = False) -> DataFrame:
    """Claims and gaps of entity-field and comparison plans.

    ``plans(question_id, entity_ids, entity_names, predicates)``; ``fields`` are card fields; ``citations(subject_id,
    predicate, citation_keys)`` the ordered evidence ids of each field. Comparisons list fields first, then entities.
    """
    pairs = plans.select("question_id", "predicates", F.posexplode(F.arrays_zip("entity_ids", "entity_names")).alias("e_pos", "e"))
    pairs = pairs.select("question_id", "e_pos", F.col("e.entity_ids").alias("subject_id"), F.col("e.entity_names").alias("name"),
                         F.posexplode("predicates").alias("p_pos", "predicate"))
    order = F.struct("p_pos", "e_pos") if fields_first else F.struct(F.col("e_pos").alias("p_pos"), F.col("p_pos").alias("e_pos"))
    j = pairs.join(fields.select("subject_id", "predicate", F.col("label").alias("field_label"), "status", "display_value"),
                   ["subject_id", "predicate"], "left").join(citations, ["subject_id", "predicate"], "left")
    if fields_first:
        j = j.filter("status IS NOT NULL")
    label = F.concat("name", F.lit(" · "), F.coalesce("field_label", "predicate"))
    cited = F.coalesce("citation_keys", F.array().cast("array<string>"))
    gap = (F.when(F.col("status").isNull(), "unsupported_requested_field").when(F.col("status") == "missing", "missing_direct_evidence")
           .when(F.col("status") == "conflicted", "conflicted").when(F.size(cited) == 0, "validation_failed"))
    text = F.concat("name", F.lit(" 的"), "field_label", F.lit("为"), "display_value", F.lit("。"))
    return _items(j.select("question_id", order.alias("item_order"), label.alias("label"), text.alias("text"), F.lit("adc").alias("subject_type"),
                           "subject_id", "predicate", F.col("display_value").alias("value"), cited.alias("citation_keys"), gap.alias("gap_reason")))


def trial_items(plans: DataFrame, trials: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """Claims and gaps of trial plans: named trials, else trials of the named entities, else any; the first ``limit`` by id.

    ``trials`` holds text and text-array columns; ``links(entity_id, nct_id)``.
    """
    fits = lambda df: df.filter(F.col("phase").isNull() | F.exists("phases", lambda p: F.contains(F.upper(p), F.col("phase"))))
    ids = plans.select("question_id", F.explode("trial_ids").alias("nct_id"))
    # The first trials of each wanted (entity, phase) are cut before they meet the questions.
    wanted = plans.filter("size(trial_ids) = 0").select("question_id", "phase", F.coalesce("phase", F.lit("")).alias("__phase"), F.explode("entity_ids").alias("entity_id"))
    linked = links.distinct().join(wanted.select("entity_id", "phase", "__phase").distinct(), "entity_id").join(trials.select("nct_id", "phases"), "nct_id")
    firsts = first_per_group(fits(linked).select("entity_id", "__phase", "nct_id").distinct(), ["entity_id", "__phase"], [F.col("nct_id")], limit)
    by_entity = wanted.join(firsts, ["entity_id", "__phase"]).select("question_id", "nct_id").distinct()
    named = ids.unionByName(by_entity).join(trials, "nct_id")
    info = plans.select("question_id", "predicates", "phase", "trial_ids", "entity_ids")
    chosen = named.join(info, "question_id")
    # Questions without any name share one list: the first trials of each phase.
    known = F.array(*[F.lit(p) for p in sorted({p for _, p in v.PHASE_MARKERS})])
    of = F.filter(known, lambda k: F.exists(F.coalesce("phases", F.array().cast("array<string>")), lambda p: F.contains(F.upper(p), k)))
    heads = first_per_group(trials.withColumn("__phase", F.explode(F.concat(F.array(F.lit("")), of))), ["__phase"], [F.col("nct_id")], limit).drop("position")
    open_plans = info.filter("size(trial_ids) = 0 AND size(entity_ids) = 0").withColumn("__phase", F.coalesce("phase", F.lit("")))
    chosen = chosen.unionByName(open_plans.join(heads, "__phase").drop("__phase"), allowMissingColumns=True)
    matching = fits(chosen)
    rows = first_per_group(matching, ["question_id"], [F.col("nct_id")], limit)

    def value(name: str) -> Column:
        c = F.col(name)
        return F.array_join(c, "；") if dict(rows.dtypes)[name].startswith("array") else c.cast("string")

    cells = F.array(*[F.struct(F.lit(p).alias("predicate"), F.lit(label).alias("label"), value(c).alias("value")) for p, label, c in v.TRIAL_LABELS])
    asked = F.transform("predicates", lambda p: F.try_element_at(F.filter(cells, lambda x: x["predicate"] == p), F.lit(1)))
    rows = rows.select("question_id", "nct_id", "position", F.posexplode(asked).alias("p_pos", "c")).filter("c IS NOT NULL")
    blank = F.coalesce("c.value", F.lit("")) == ""
    found = rows.select(
        "question_id", F.struct(F.col("position").alias("p_pos"), F.col("p_pos").alias("e_pos")).alias("item_order"),
        F.concat("nct_id", F.lit(" · "), "c.label").alias("label"),
        F.concat("nct_id", F.lit(" 的"), "c.label", F.lit("为"), "c.value", F.lit("。")).alias("text"), F.lit("trial").alias("subject_type"),
        F.col("nct_id").alias("subject_id"), "c.predicate", "c.value", F.array(F.concat_ws(":", F.lit("trial"), "nct_id", "c.predicate")).alias("citation_keys"),
        F.when(blank, "missing_direct_evidence").alias("gap_reason"))
    empty = plans.join(rows.select("question_id").distinct(), "question_id", "left_anti")
    return _items(found).unionByName(_missing(empty, F.coalesce(F.nullif(F.array_join("trial_ids", ", "), F.lit("")), F.lit("符合条件的临床试验"))))


def change_items(plans: DataFrame, events: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """Claims of change plans: the newest ``limit`` events of the window that concern the named entities and targets.

    ``events`` are resolved change events: event_id, event_type, subject_type, subject_id, predicate, detected_at, old_text,
    new_text, entity_ids[], entity_names[], targets[]. Plans with the same window and filters share one selection.
    """
    p = plans.withColumn("__sig", F.sha2(F.concat_ws("\u001f", F.col("days").cast("string"), F.array_join(F.array_sort("entity_ids"), ","),
                                                     F.array_join(F.array_sort("targets"), ",")), 256))
    selections = p.groupBy("__sig").agg(F.first("days").alias("days"), F.first("entity_ids").alias("want_ids"), F.first("targets").alias("want_targets"))
    # A selection is a union of parts (entity or any, target or any, window); the newest events of each part hold the newest of the union.
    some = lambda items: F.when(F.size(items) > 0, F.transform(items, F.lower)).otherwise(F.array(F.lit("")))
    parts = selections.select("__sig", "days", "want_targets", F.explode(F.when(F.size("want_ids") > 0, F.col("want_ids")).otherwise(F.array(F.lit("")))).alias("__entity"))
    parts = parts.select("__sig", "days", "__entity", F.explode(some("want_targets")).alias("__target")).distinct()
    wanted = parts.select("days", "__entity", "__target").distinct()
    none = F.array().cast("array<string>")
    recent = events.withColumn("__at", F.try_to_timestamp("detected_at")).filter(F.col("__at") <= now)
    recent = recent.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce("entity_ids", none)))).alias("__entity"))
    recent = recent.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.coalesce("targets", none), F.lower)))).alias("__target"))
    in_window = (F.unix_micros(now) - F.unix_micros("__at")) <= F.col("days").cast("bigint") * F.lit(86_400_000_000)
    order = [F.desc("__at"), F.desc("event_id")]
    heads = first_per_group(recent.join(broadcast_if_small(wanted), ["__entity", "__target"]).filter(in_window), ["__entity", "__target", "days"], order, limit)
    met = parts.join(heads.drop("position"), ["__entity", "__target", "days"]).drop("__entity", "__target", "days").dropDuplicates(["__sig", "event_id"])
    chosen = first_per_group(met, ["__sig"], order, limit)
    subject = F.coalesce(F.nullif(F.array_join("entity_names", ", "), F.lit("")), F.col("subject_id"))
    text = F.concat(subject, F.lit(" 在 "), "detected_at", F.lit(" 检测到 "), "event_type", F.lit("："), "old_text", F.lit(" → "), "new_text", F.lit("。"))
    rows = p.select("question_id", "__sig").join(chosen, "__sig").select(
        "question_id", F.struct(F.col("position").alias("p_pos"), F.lit(0).alias("e_pos")).alias("item_order"),
        F.concat_ws(" · ", subject, "event_type").alias("label"), text.alias("text"), "subject_type", "subject_id",
        F.coalesce("predicate", "event_type").alias("predicate"), F.concat_ws(" → ", "old_text", "new_text").alias("value"),
        F.array("event_id").alias("citation_keys"), F.lit(None).cast("string").alias("gap_reason"))
    empty = plans.join(rows.select("question_id").distinct(), "question_id", "left_anti")
    return _items(rows).unionByName(_missing(empty, F.concat(F.lit("最近 "), F.col("days").cast("string"), F.lit(" 天变化"))))


def _missing(plans: DataFrame, label: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return plans.select(
        "question_id", F.struct(F.lit(0).alias("p_pos"), F.lit(0).alias("e_pos")).alias("item_order"), label.alias("label"), none.alias("text"),
        none.alias("subject_type"), none.alias("subject_id"), none.alias("predicate"), none.alias("value"),
        F.array().cast("array<string>").alias("citation_keys"), F.lit("no_matching_record").alias("gap_reason"))


def assemble(items: DataFrame) -> DataFrame:
    """One answer per question from its claims and gaps.

    Citations are numbered by first use. No claim refuses, claims with gaps answer in part.
    """
    fields = ["label", "text", "subject_type", "subject_id", "predicate", "value", "citation_keys", "gap_reason"]
    per = items.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("item_order", *fields))).alias("__i"))
    claims, gaps = F.filter("__i", lambda i: i["gap_reason"].isNull()), F.filter("__i", lambda i: i["gap_reason"].isNotNull())
    a = per.select("question_id", claims.alias("claims"), gaps.alias("gaps"))
    a = a.withColumn("citation_keys", F.array_distinct(F.flatten(F.transform("claims", lambda c: c["citation_keys"]))))
    marks = lambda c: F.array_join(F.transform(c["citation_keys"], lambda k: F.concat(
        F.lit("[S"), F.array_position(F.col("citation_keys"), k).cast("string"), F.lit("]"))), "")
    claim_lines = F.transform("claims", lambda c: F.concat(F.lit("- "), c["text"], F.lit(" "), marks(c)))
    details = F.create_map(*[F.lit(x) for pair in v.GAP_DETAILS for x in pair])
    gap_lines = F.transform("gaps", lambda g: F.concat(F.lit("- "), g["label"], F.lit("："), details[g["gap_reason"]]))
    has_claims, has_gaps = F.size("claims") > 0, F.size("gaps") > 0
    head = F.when(has_claims, claim_lines).otherwise(F.array(F.lit("现有结构化证据不足，无法可靠回答。")))
    tail = F.when(has_gaps, F.concat(F.array(F.lit(""), F.lit("未回答：")), gap_lines)).otherwise(F.array().cast("array<string>"))
    return a.select(
        "question_id", F.when(~has_claims, "refused").when(has_gaps, "partial").otherwise("answered").alias("status"),
        F.when(~has_claims, "structured_evidence_insufficient").when(has_gaps, "partial_evidence").alias("refusal_reason"),
        F.array_join(F.concat(head, tail), "\n").alias("answer"), F.size("claims").alias("claim_count"), F.size("gaps").alias("gap_count"),
        "citation_keys", F.transform("claims", lambda c: F.struct(c["subject_id"].alias("subject_id"), c["predicate"].alias("predicate"),
                                                                 F.array(c["value"]).alias("values"))).alias("claims"))


# ---------------------------------------------------------------- sources and citations


def number_sources(results: DataFrame, *, max_sources: int = 5, per_source: int = 1400, total: int = 7000) -> DataFrame:
    """Cut the excerpts of the first results to the character budgets and number the non-empty ones ``S1``, ``S2``, ...

    Returns one row per question with ``sources``: (citation_id, source_index, source_type, retrieval_document_id, excerpt).
    """
    kept = results.filter(F.col("rank") <= max_sources)
    per = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "source_type", "retrieval_document_id", "content"))).alias("__r"))
    none = F.array().cast("array<struct<citation_id:string,source_index:int,source_type:string,retrieval_document_id:string,excerpt:string>>")

    def add(acc: Column, r: Column) -> Column:
        left = F.lit(total) - acc["used"]
        excerpt = tx.strip(F.substring(r["content"], F.lit(1), F.least(F.lit(per_source), left)))
        use = (left > 0) & (excerpt != "")
        row = F.struct(F.concat(F.lit("S"), (F.size(acc["out"]) + 1).cast("string")).alias("citation_id"), F.size(acc["out"]).alias("source_index"),
                       r["source_type"].alias("source_type"), r["retrieval_document_id"].alias("retrieval_document_id"), excerpt.alias("excerpt"))
        return F.struct(F.when(use, F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"),
                        F.when(use, acc["used"] + F.length(excerpt)).otherwise(acc["used"]).alias("used"))

    folded = F.aggregate("__r", F.struct(none.alias("out"), F.lit(0).alias("used")), add, lambda acc: acc["out"])
    return per.select("question_id", folded.alias("sources"))


def format_context(sources: Column) -> Column:
    """Numbered source blocks as one text."""
    block = lambda s: F.concat_ws("\n", F.concat(F.lit("["), s["citation_id"], F.lit("]")), F.concat(F.lit("source_type: "), s["source_type"]),
                                  F.concat(F.lit("document_id: "), s["retrieval_document_id"]), F.lit("content:"), s["excerpt"])
    return F.array_join(F.transform(sources, block), "\n\n")


def citation_ids(text: Column) -> Column:
    """``S<n>`` ids inside square brackets, distinct, in order of appearance."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(?i)\bS(\d+)\b"), F.lit(1))))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("S"), F.regexp_replace(n, r"^0+(?=\d)", ""))))


def claim_lines(answer: Column) -> Column:
    """Lines of an answer that state something: no headings, no comments, six characters or more without citations."""
    cleaned = F.transform(F.split(answer, LINE_BREAK), lambda line: tx.strip(F.ltrim(tx.strip(line), F.lit(BULLETS))))

    def is_claim(line: Column) -> Column:
        heading = F.lower(F.rtrim(line, F.lit("：:"))).isin(*v.HEADINGS)
        bare = tx.strip(F.regexp_replace(line, r"\[[^\]]+\]", ""))
        return (line != "") & ~heading & ~line.startswith("#") & ~F.upper(line).startswith("REFUSE:") & (F.length(bare) >= 6)

    return F.filter(cleaned, is_claim)


def citation_check(answers: DataFrame, answer: str = "answer", available: str = "available") -> DataFrame:
    """Add cited ids, unknown ids, claim counts, coverage and validity; ``available`` is the array of known ids."""
    a = answers.withColumn("cited", citation_ids(F.col(answer))).withColumn("__c", claim_lines(F.col(answer)))
    covered = F.size(F.filter("__c", lambda c: F.size(citation_ids(c)) > 0))
    coverage = F.when(F.size("__c") > 0, covered.cast("double") / F.size("__c").cast("double")).otherwise(F.lit(0.0))
    unknown = F.array_except("cited", F.col(available))
    valid = (F.size("cited") > 0) & (F.size(unknown) == 0) & (F.size("__c") > 0) & (coverage == 1.0)
    return a.select(*answers.columns, "cited", unknown.alias("invalid"), F.size("__c").alias("claim_count"), covered.alias("cited_claim_count"),
                    F.round(coverage, 4).alias("coverage"), valid.alias("valid"))


def support_terms(folded: Column) -> Column:
    """Material terms of a claim: words, numbers and CJK runs of two characters or more, without noise words."""
    text = F.ltrim(tx.strip(F.regexp_replace(folded, r"\[[^\]]+\]", " ")), F.lit(BULLETS))
    for connector in v.CONNECTORS:
        text = F.replace(text, F.lit(connector), F.lit(" "))
    found = F.regexp_extract_all(text, F.lit(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*|\d+(?:\.\d+)?|[一-鿿]{2,}"), F.lit(0))
    terms = F.transform(found, lambda w: F.btrim(w, F.lit("-")))
    return F.array_distinct(F.filter(terms, lambda w: ~w.isin(*v.SUPPORT_NOISE) & (F.length(w) >= 2)))


def claim_support(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per claim line: is every material term found in the excerpts it cites?

    ``answers`` carries ``sources`` as built by :func:`number_sources`.
    """
    c = answers.select("question_id", "sources", F.posexplode(claim_lines(F.col(answer))).alias("claim_index", "claim"))
    c = c.withColumn("cited", citation_ids(F.col("claim")))
    used = F.filter("sources", lambda s: F.array_contains(F.col("cited"), s["citation_id"]))
    c = c.withColumn("__evidence", tx.fold(F.array_join(F.transform(used, lambda s: s["excerpt"]), " ")))
    c = c.withColumn("terms", support_terms(tx.fold(F.col("claim"))))
    c = c.withColumn("missing_terms", F.filter("terms", lambda w: ~F.contains(F.col("__evidence"), w)))
    known = F.transform("sources", lambda s: s["citation_id"])
    reason = (F.when(F.size("cited") == 0, "missing_citation").when(F.size(F.array_except("cited", known)) > 0, "unknown_citation")
              .when(F.size("terms") == 0, "no_verifiable_terms").when(F.size("missing_terms") > 0, "terms_not_in_cited_evidence"))
    return c.select("question_id", "claim_index", "claim", "cited", "terms", "missing_terms", reason.alias("reason"), reason.isNull().alias("supported"))


# ---------------------------------------------------------------- extraction


def extraction_terms(question: Column) -> Column:
    """Lower-case query words of two characters or more with the words their concepts add."""
    lowered = F.lower(question)
    words = F.regexp_extract_all(F.lower(retrieval.expand_query(question)), F.lit("[a-z0-9]+"), F.lit(0))
    added = [F.when(F.contains(lowered, F.lit(m)), F.array(*[F.lit(w) for w in extra])).otherwise(F.array().cast("array<string>"))
             for m, extra in v.QUERY_CONCEPTS]
    return F.array_distinct(F.filter(F.concat(words, *added), lambda w: F.length(w) > 1))


def _prefixes(question: Column, kind: Column) -> Column:
    low = F.lower(question)
    profile = [F.when(tx.any_of(low, m) & ~tx.any_of(low, but), F.lit(p)) for p, m, but in v.PROFILE_PREFIXES]
    trial = [F.when(tx.any_of(low, m) if m else F.lit(True), F.lit(p)) for p, m in v.TRIAL_PREFIXES]
    none = F.array().cast("array<string>")
    return (F.when(kind == "adc_profile", F.array_compact(F.array(*profile))).when(kind == "clinical_trial", F.array_compact(F.array(*trial)))
            .otherwise(none))


def extract_answers(numbered: DataFrame, questions: DataFrame, *, limit: int = 4, max_chars: int = 420) -> DataFrame:
    """Quote the lines and sentences that answer a question.

    Lines of the first source with a requested label come first; then sentences with the most query terms until ``limit``
    quotes are there. Equal texts count once. Without any candidate the answer starts with ``REFUSE:``.
    """
    numbered = written(numbered)
    q = numbered.join(questions.select("question_id", "question"), "question_id")
    first = F.try_element_at("sources", F.lit(1))
    q = q.withColumn("terms", extraction_terms(F.col("question"))).withColumn("prefixes", _prefixes(F.col("question"), first["source_type"]))
    q = q.withColumn("labelled", (first["source_type"] == "adc_profile") & (F.size("prefixes") > 0))
    starts = lambda unit: F.exists("prefixes", lambda p: F.lower(unit).startswith(p))
    lines = q.select("question_id", "prefixes", F.posexplode(F.split(first["excerpt"], LINE_BREAK)).alias("at", "u")).withColumn(
        "unit", tx.strip(F.col("u"))).filter((F.col("unit") != "") & starts(F.col("unit")))
    chosen = lines.select("question_id", F.lit(0).alias("tier"), F.lit(0).alias("score"), F.lit(0).alias("source_index"), F.col("at").alias("unit_index"),
                          "unit", F.lit("S1").alias("citation_id"))
    s = q.select("question_id", "terms", "prefixes", "labelled", F.explode("sources").alias("s"))
    units = s.select("question_id", "terms", "prefixes", "labelled", "s.source_index", "s.citation_id", F.posexplode(F.filter(F.transform(
        F.split("s.excerpt", r"\n+|(?<=[.!?。！？])\s+"), tx.strip), lambda u: u != "")).alias("unit_index", "unit"))
    score = F.size(F.filter("terms", lambda w: F.contains(F.lower("unit"), w)))
    units = units.filter(~F.col("labelled") | starts(F.col("unit"))).withColumn("score", score).filter("score > 0")
    found = units.select("question_id", F.lit(1).alias("tier"), "score", "source_index", "unit_index", "unit", "citation_id")
    order = F.struct("tier", (-F.col("score")).alias("s"), "source_index", "unit_index")
    once = chosen.unionByName(found).withColumn("norm", tx.squeeze(F.lower("unit"))).groupBy("question_id", "norm").agg(
        F.min_by(F.struct("tier", "score", "source_index", "unit_index", "unit", "citation_id"), order).alias("b")).select("question_id", "b.*")
    window = Window.partitionBy("question_id").orderBy("tier", F.desc("score"), "source_index", "unit_index")
    picked = once.withColumn("position", F.row_number().over(window)).filter((F.col("tier") == 0) | (F.col("position") <= limit))
    quote = F.concat(F.lit("- 证据摘录："), F.rtrim(F.substring("unit", 1, max_chars), F.lit(tx.WHITESPACE)), F.lit(" ["), "citation_id", F.lit("]"))
    texts = picked.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", quote.alias("t")))),
                                                                       lambda x: x["t"]), "\n").alias("answer"))
    return numbered.join(texts, "question_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit("REFUSE: 检索片段中没有与问题直接对应的事实。")))


def literature_answers(questions: DataFrame, results: DataFrame, mode: str = "sparse", max_sources: int = 5) -> DataFrame:
    """Retrieved rows to checked answers: evidence guard, numbering, extraction, citation check, claim support.

    Unsupported claims are withheld; a question without a supported claim is refused.
    """
    results = written(results)
    reasons = qs.evidence_refusal(questions, results, mode)
    accepted = reasons.filter("refusal_reason IS NULL").select("question_id")
    numbered = number_sources(results.join(accepted, "question_id", "left_semi"), max_sources=max_sources)
    drafts = extract_answers(numbered, questions)
    drafts = written(citation_check(drafts.withColumn("available", F.transform("sources", lambda s: s["citation_id"]))))
    claims = claim_support(drafts)
    line = F.concat(F.lit("- "), "claim")
    kept = claims.groupBy("question_id").agg(
        F.count_if("supported").alias("supported_claims"), F.count_if(~F.col("supported")).alias("withheld_claims"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("claim_index", line.alias("t"))))), lambda x: x["t"]), "\n")
        .alias("shown"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("claim_index", "cited")))), lambda x: x["cited"])))
        .alias("citations"))
    j = questions.select("question_id").join(reasons, "question_id", "left").join(
        drafts.select("question_id", "valid", F.col("answer").alias("draft")), "question_id", "left").join(kept, "question_id", "left")
    n = F.coalesce("supported_claims", F.lit(0))
    reason = (F.when(F.col("refusal_reason").isNotNull(), F.col("refusal_reason")).when(F.col("draft").startswith("REFUSE:"), "model_refusal")
              .when(~F.coalesce("valid", F.lit(False)), "citation_validation_failed").when(n == 0, "text_support_validation_failed"))
    j = j.withColumn("__r", reason)
    return j.select(
        "question_id", F.when(F.col("__r").isNotNull(), "refused").when(F.col("withheld_claims") > 0, "partial").otherwise("answered").alias("status"),
        F.coalesce("__r", F.when(F.col("withheld_claims") > 0, F.lit("partial_evidence"))).alias("refusal_reason"),
        F.when(F.col("__r").isNull(), F.col("shown")).alias("answer"), F.when(F.col("__r").isNull(), n).otherwise(0).alias("supported_claims"),
        F.when(F.col("__r").isNull(), F.col("citations")).alias("citations"))


def requested_items(question: Column) -> Column:
    """Checklist of the things a question asks for, in a fixed order."""
    low = F.lower(question)
    klass = tx.any_of(low, ("payload class", "载荷类型", "payload 类型"))
    phase = F.contains(low, F.lit("phase")) | low.rlike(r"(?:[ivx]+|[一二三四])\s*/?[ivx]*\s*期")
    rows = (
        (tx.any_of(low, ("靶点", "target")), "靶点 / target"), (klass, "payload class / 载荷类型"),
        (~klass & tx.any_of(low, ("payload", "载荷")), "payload / 载荷"), (tx.any_of(low, ("药物抗体比", "dar")), "药物抗体比 / DAR"),
        (tx.any_of(low, ("linker", "连接子")), "linker / 连接子"), (tx.any_of(low, ("研发状态", "开发状态")), "研发状态"),
        (tx.any_of(low, ("招募状态",)), "招募状态"), (tx.any_of(low, ("注册号", "nct")), "临床试验注册号"), (phase, "临床试验阶段"),
        (tx.any_of(low, ("主要终点", "primary outcome", "endpoint")), "主要终点"),
        (tx.any_of(low, ("pubmed", "哪篇文献")), "文献标识（标题或 PMID）"),
        (tx.any_of(low, ("细胞内转运", "intracellular trafficking")), "细胞内转运"),
        (tx.any_of(low, ("dxd 释放", "payload 释放", "载荷释放")), "payload 释放"),
        (tx.any_of(low, ("抗肿瘤活性", "antitumor activity")), "抗肿瘤活性"))
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rows]))
