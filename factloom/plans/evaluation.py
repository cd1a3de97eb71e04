"""Scoring, paired statistics, question-set checks and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import stats
from factloom.operators import audits, evaluation as ev
from factloom.plans.common import table as t

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# Every labelled document is a benchmark question; its id decides the kind of answer and what the system got wrong.
SCORE_SQL = """
g AS (SELECT l.doc_id AS k, lang AS category, quality, toxic, (['structured', 'comparison', 'trial_record', 'evidence_document', 'refusal'])[l.doc_id % 5 + 1] AS kind
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'refused' WHEN k % 13 = 0 THEN 'error' WHEN kind = 'refusal' THEN 'refused' WHEN k % 3 = 0 THEN 'partial' ELSE 'answered' END AS status,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 17 = 0 THEN 'comparison' ELSE kind END AS route, k % 2 = 0 AS allow_partial,
  CASE kind WHEN 'structured' THEN 1 WHEN 'comparison' THEN 2 WHEN 'trial_record' THEN 3 END AS cells FROM g),
c AS (SELECT *, CASE kind WHEN 'refusal' THEN CAST(status = 'refused' AS DOUBLE) WHEN 'evidence_document' THEN CAST(k % 4 <> 1 AS DOUBLE)
  ELSE CAST((CASE WHEN k % 7 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN cells >= 2 AND k % 6 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN cells >= 3 AND k % 8 <> 0 THEN 1 ELSE 0 END) AS DOUBLE)
    / CAST(cells AS DOUBLE) END AS credit FROM s),
sc AS (SELECT CAST(k AS VARCHAR) AS question_id, category, CAST(coalesce(route = kind, false) AS DOUBLE) AS route,
  CAST((kind = 'refusal' AND status = 'refused') OR (kind <> 'refusal' AND status IN ('answered', 'partial')) AS DOUBLE) AS status,
  CASE WHEN allow_partial THEN credit ELSE CAST(credit >= 1 AS DOUBLE) END AS answer_field, CAST(credit >= 1 AS DOUBLE) AS answer,
  CAST(kind <> 'evidence_document' OR k % 4 <> 1 AS DOUBLE) AS evidence, CAST((status = 'refused') = (kind = 'refusal') AS DOUBLE) AS refusal FROM c)"""


def scored_questions(spark, sf):
    k, strings = F.col("doc_id"), F.array().cast("array<string>")
    kinds = F.array(*[F.lit(x) for x in ("structured", "comparison", "trial_record", "evidence_document", "refusal")])
    base = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn(
        "kind", F.element_at(kinds, (k % 5 + 1).cast("int")))
    kind = F.col("kind")
    doc = F.concat(F.lit("pubmed:"), k.cast("string"))
    cell = lambda subject, field, value: F.struct(subject.alias("subject_id"), F.lit(field).alias("field"), F.array(value).alias("values"), F.lit(False).alias("is_list"))
    none = F.lit(None).cast("string")
    cells = (F.when(kind == "structured", F.array(cell(none, "quality", F.col("quality").cast("string"))))
             .when(kind == "comparison", F.array(cell(F.lit("a"), "payload", F.lit("One")), cell(F.lit("b"), "payload", F.lit("Two"))))
             .when(kind == "trial_record", F.array(cell(doc, "id", doc), cell(doc, "status", F.lit("OPEN")), cell(doc, "phases", F.lit("PHASE2"))))
             .otherwise(F.array().cast("array<struct<subject_id:string,field:string,values:array<string>,is_list:boolean>>")))
    gold = base.select(
        k.cast("string").alias("question_id"), F.col("lang").alias("category"), kind.alias("expected_route"),
        F.when(kind == "refusal", F.array(F.lit("refused"))).otherwise(F.array(F.lit("answered"), F.lit("partial"))).alias("expected_status"), "kind",
        cells.alias("expected_cells"), F.array(F.lit("alias one")).alias("allowed"), F.array(doc).alias("accepted_documents"),
        F.when(kind == "evidence_document", F.array(doc)).otherwise(strings).alias("evidence_ids"), (k % 2 == 0).alias("allow_partial"),
        (kind == "refusal").alias("should_refuse"))
    claim = lambda subject, predicate, value: F.struct(subject.alias("subject_id"), F.lit(predicate).alias("predicate"), F.array(value).alias("values"))
    wrong = lambda ok, value: F.when(ok, value).otherwise("no such value")
    claims = (F.when(kind == "structured", F.array(claim(F.lit("x"), "adc.quality", wrong(k % 7 != 0, F.col("quality").cast("string")))))
              .when(kind == "comparison", F.array(claim(F.lit("a"), "adc.payload", wrong(k % 7 != 0, F.lit(" ONE "))), claim(F.lit("b"), "adc.payload", wrong(k % 6 != 0, F.lit("two")))))
              .when(kind == "trial_record", F.array(claim(doc, "trial.id", wrong(k % 7 != 0, doc)), claim(doc, "trial.status", wrong(k % 6 != 0, F.lit("open"))),
                                                    claim(doc, "trial.phases", wrong(k % 8 != 0, F.lit("phase2")))))
              .otherwise(F.array().cast("array<struct<subject_id:string,predicate:string,values:array<string>>>")))
    status = (F.when(k % 11 == 0, "refused").when(k % 13 == 0, "error").when(kind == "refusal", "refused").when(k % 3 == 0, "partial").otherwise("answered"))
    outputs = base.select(
        k.cast("string").alias("question_id"), status.alias("status"), F.when(k % 9 == 0, None).when(k % 17 == 0, "comparison").otherwise(kind).alias("route"),
        claims.alias("claims"), F.when(k % 4 != 1, F.array(k.cast("string"))).otherwise(strings).alias("cited"))
    return gold, outputs


@query("WITH " + SCORE_SQL + """
SELECT question_id, category, route, status, round(answer_field, 6) AS answer_field, answer, evidence, refusal FROM sc""")
def answer_scores(spark, sf):
    return ev.score_answers(*scored_questions(spark, sf)).withColumn("answer_field", F.round("answer_field", 6))


@query("WITH " + SCORE_SQL + """
SELECT coalesce(category, 'overall') AS category, count(*) AS questions, round(avg(route), 6) AS route, round(avg(status), 6) AS status,
  round(avg(answer_field), 6) AS answer_field, round(avg(answer), 6) AS answer, round(avg(evidence), 6) AS evidence, round(avg(refusal), 6) AS refusal
FROM sc GROUP BY ROLLUP(category)""")
def benchmark_scoring(spark, sf):
    return ev.score_report(ev.score_answers(*scored_questions(spark, sf)))


PAIR_SQL = """
pr AS (SELECT lang, source, quality = 1 AS sys, toxic = 0 AS base FROM labels JOIN documents USING (doc_id)),
pc AS (SELECT GROUPS, count(*) AS question_count, count(*) FILTER (WHERE sys) AS system_success, count(*) FILTER (WHERE base) AS baseline_success,
  count(*) FILTER (WHERE sys AND base) AS both_success, count(*) FILTER (WHERE sys AND NOT base) AS system_only, count(*) FILTER (WHERE NOT sys AND base) AS baseline_only
  FROM pr GROUP BY ALL),
pp AS (SELECT *, system_only + baseline_only AS discordant FROM pc),
pv AS (SELECT *, CASE WHEN discordant = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(discordant + 1.0) - lgamma(i + 1.0) - lgamma(discordant - i + 1.0)
  - discordant * ln(2.0))) FROM generate_series(0, least(system_only, baseline_only)) g(i))) END AS p FROM pp)"""


def label_pairs(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "source")
    return t(spark, sf, "labels").join(d, "doc_id").select("lang", "source", (F.col("quality") == 1).alias("system"), (F.col("toxic") == 0).alias("baseline"))


@query("WITH " + PAIR_SQL.replace("GROUPS", "lang") + """
SELECT lang, question_count, system_success, baseline_success, both_success, system_only, baseline_only, round(CAST(system_success AS DOUBLE) / question_count, 6) AS system_rate,
  round(CAST(baseline_success AS DOUBLE) / question_count, 6) AS baseline_rate, round(CAST(system_only - baseline_only AS DOUBLE) / question_count, 6) AS difference,
  discordant, round(CAST(p AS DOUBLE), 6) AS p_value FROM pv""")
def paired_mcnemar(spark, sf):
    return ev.with_exact_test(ev.paired_counts(label_pairs(spark, sf), ["lang"]))


@query("WITH " + PAIR_SQL.replace("GROUPS", "lang, source") + """,
r AS (SELECT lang, source, round(CAST(p AS DOUBLE), 6) AS p, row_number() OVER (PARTITION BY lang ORDER BY round(CAST(p AS DOUBLE), 6), source) AS rk, count(*) OVER (PARTITION BY lang) AS m FROM pv)
SELECT lang, source, p AS p_value, round(least(1.0, max((m - rk + 1) * p) OVER (PARTITION BY lang ORDER BY p, source ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""")
def holm_adjust(spark, sf):
    tested = ev.with_exact_test(ev.paired_counts(label_pairs(spark, sf), ["lang", "source"])).select("lang", "source", "p_value")
    return stats.holm_adjust(tested, "p_value", ["lang"], ["source"]).withColumn("adjusted", F.round("adjusted", 6))


LOW, HIGH = ev.bootstrap_positions(0.95, 10_000)


@query("WITH " + PAIR_SQL.replace("GROUPS", "lang") + f""",
it AS (SELECT *, unnest(range(10000)) AS i FROM pc),
q AS (SELECT *, unnest(range((question_count + 3) // 4)) AS j FROM it),
h AS (SELECT *, md5('0:' || lang || ':' || i || ':' || j) AS h FROM q),
w AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM h),
u AS (SELECT *, (CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) * question_count) >> 32 AS pick FROM w WHERE 4 * j + k < question_count),
s AS (SELECT lang, i, sum(CASE WHEN pick < system_only THEN 1 WHEN pick < system_only + baseline_only THEN -1 ELSE 0 END) AS d FROM u GROUP BY 1, 2),
r AS (SELECT lang, d, row_number() OVER (PARTITION BY lang ORDER BY d) - 1 AS place FROM s),
b AS (SELECT lang, max(d) FILTER (WHERE place = {LOW}) AS l, max(d) FILTER (WHERE place = {HIGH}) AS h FROM r GROUP BY 1)
SELECT lang, round(CAST(system_only - baseline_only AS DOUBLE) / question_count, 6) AS difference, round(CAST(l AS DOUBLE) / question_count, 6) AS ci_lower,
  round(CAST(h AS DOUBLE) / question_count, 6) AS ci_upper FROM pc JOIN b USING (lang)""")
def bootstrap_intervals(spark, sf):
    return ev.bootstrap_interval(ev.paired_counts(label_pairs(spark, sf), ["lang"]), ["lang"]).select(
        "lang", "difference", "ci_lower", "ci_upper")


@query("""
WITH p AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1),
z AS (SELECT *, CAST(1.959963984540054 AS DOUBLE) * CAST(1.959963984540054 AS DOUBLE) AS zz, s / n AS q FROM p)
SELECT lang, round(greatest(0.0, (q + zz / (2 * n)) / (1 + zz / n) - CAST(1.959963984540054 AS DOUBLE) * sqrt(q * (1 - q) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS lower_bound,
  round(least(1.0, (q + zz / (2 * n)) / (1 + zz / n) + CAST(1.959963984540054 AS DOUBLE) * sqrt(q * (1 - q) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS upper_bound FROM z""")
def wilson_bounds(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    c = t(spark, sf, "labels").join(d, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("s"))
    low, high = stats.wilson_interval(F.col("s"), F.col("n"))
    return c.select("lang", F.round(low, 6).alias("lower_bound"), F.round(high, 6).alias("upper_bound"))


@query("""
SELECT coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(quality AS VARCHAR) END, 'None') || '->' || CAST(toxic AS VARCHAR) AS pair, count(*) AS n
FROM labels GROUP BY 1""")
def confusion_pairs(spark, sf):
    d = t(spark, sf, "labels").withColumn("quality", F.when(F.col("doc_id") % 9 != 0, F.col("quality")))
    return ev.confusion(d, "quality", "toxic")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS question_id FROM labels WHERE (CASE WHEN quality = 1 THEN 'answered' ELSE 'refused' END) IS DISTINCT FROM
  (CASE WHEN doc_id % 10 = 0 THEN NULL WHEN quality = 1 AND doc_id % 4 <> 0 THEN 'answered' ELSE 'refused' END)""")
def ablation_changed(spark, sf):
    labels = t(spark, sf, "labels").withColumn("question_id", F.col("doc_id").cast("string"))
    good = F.col("quality") == 1
    left = labels.select("question_id", F.when(good, "answered").otherwise("refused").alias("status"))
    right = labels.select("question_id", F.when(F.col("doc_id") % 10 == 0, None).when(good & (F.col("doc_id") % 4 != 0), "answered").otherwise("refused").alias("status"))
    return ev.changed_outputs(left, right, ["status"])


@query("WITH " + SCORE_SQL + """
SELECT CASE WHEN k % 3 = 0 THEN 'test' ELSE 'dev' END AS split, count(*) AS question_count, count(*) FILTER (WHERE route = kind) AS route_match_count,
  count(*) FILTER (WHERE NOT coalesce(route = kind, false)) AS route_mismatch_count, count(*) FILTER (WHERE route IS NULL) AS route_missing_count,
  round(CAST(count(*) FILTER (WHERE route = kind) AS DOUBLE) / count(*), 4) AS route_match_rate,
  count(*) FILTER (WHERE (kind = 'refusal' AND status = 'refused') OR (kind <> 'refusal' AND status IN ('answered', 'partial'))) AS status_match_count,
  count(*) FILTER (WHERE status = 'error') AS error_count FROM c GROUP BY 1""")
def split_match_counts(spark, sf):
    gold, outputs = scored_questions(spark, sf)
    split = F.when(F.col("question_id").cast("bigint") % 3 == 0, "test").otherwise("dev")
    return ev.split_audit(outputs, gold.withColumn("split", split).select("question_id", "split", "expected_route", "expected_status"))


@query("WITH " + SCORE_SQL + """
SELECT round(avg(CASE WHEN route IS NOT NULL THEN CAST(route = kind AS DOUBLE) END), 4) AS route_match_rate,
  round(avg(CAST((kind = 'refusal' AND status = 'refused') OR (kind <> 'refusal' AND status IN ('answered', 'partial')) AS DOUBLE)), 4) AS status_match_rate,
  count(*) FILTER (WHERE status IN ('answered', 'partial') AND k % 10 = 1) AS invalid_citation_displays, CAST(sum(k % 3) AS BIGINT) AS unsupported_claim_displays,
  count(*) FILTER (WHERE status = 'error') AS errors FROM c""")
def arm_diagnostics(spark, sf):
    gold, outputs = scored_questions(spark, sf)
    k = F.col("question_id").cast("bigint")
    return ev.arm_diagnostics(outputs.withColumn("citation_valid", k % 10 != 1).withColumn("unsupported_claims", k % 3), gold)


@query("WITH " + SCORE_SQL + """,
x AS (SELECT kind = 'refusal' AS r, status, k % 10 <> 1 AS valid, k % 4 <> 1 AS gold, CAST(k % 5 AS DOUBLE) / 4 AS recall FROM c)
SELECT round(CAST(count(*) FILTER (WHERE NOT r AND status = 'answered') AS DOUBLE) / count(*) FILTER (WHERE NOT r), 4) AS answer_success_rate,
 round(CAST(count(*) FILTER (WHERE r AND status = 'refused') AS DOUBLE) / count(*) FILTER (WHERE status = 'refused'), 4) AS refusal_precision,
 round(CAST(count(*) FILTER (WHERE r AND status = 'refused') AS DOUBLE) / count(*) FILTER (WHERE r), 4) AS refusal_recall,
 round(CAST(count(*) FILTER (WHERE NOT r AND status = 'refused') AS DOUBLE) / count(*) FILTER (WHERE NOT r), 4) AS false_refusal_rate,
 round(CAST(count(*) FILTER (WHERE NOT r AND valid) AS DOUBLE) / count(*) FILTER (WHERE NOT r AND status = 'answered'), 4) AS citation_validity_rate,
 round(CAST(count(*) FILTER (WHERE NOT r AND gold) AS DOUBLE) / count(*) FILTER (WHERE NOT r), 4) AS gold_citation_hit_rate,
 round(CAST(count(*) FILTER (WHERE NOT r AND status = 'answered' AND valid AND gold) AS DOUBLE) / count(*) FILTER (WHERE NOT r), 4) AS grounded_answer_rate,
 round(avg(CASE WHEN NOT r THEN recall END), 4) AS key_fact_recall, round(CAST(count(*) FILTER (WHERE status = 'error') AS DOUBLE) / count(*), 4) AS error_rate FROM x""")
def generation_report(spark, sf):
    gold, outputs = scored_questions(spark, sf)
    k = F.col("question_id").cast("bigint")
    rows = outputs.join(gold.select("question_id", "should_refuse"), "question_id").select(
        "should_refuse", "status", (k % 10 != 1).alias("citation_valid"), (k % 4 != 1).alias("gold_citation_hit"), ((k % 5).cast("double") / F.lit(4.0)).alias("key_fact_recall"))
    return ev.generation_metrics(rows)


@query("""
WITH h AS (SELECT 'b' || item_id AS question_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS k FROM benchmark
  UNION ALL SELECT 'd' || doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT CASE WHEN doc_id % 101 = 0 THEN 'd' || (doc_id * 2) ELSE 'x' || doc_id END AS eid,
  regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS k FROM documents WHERE doc_id % 2 = 1),
w AS (SELECT k, count(*) AS exposed_count, min(eid) AS first_exposed_id FROM e WHERE k <> '' GROUP BY 1)
SELECT question_id, 'wording' AS kind, exposed_count, first_exposed_id FROM h JOIN w USING (k)
UNION ALL SELECT question_id, 'id', count(*), min(eid) FROM h JOIN e ON eid = question_id GROUP BY 1""")
def contamination_check(spark, sf):
    docs = t(spark, sf, "documents")
    k = F.col("doc_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    holdout = t(spark, sf, "benchmark").select(name("b", F.col("item_id")).alias("question_id"), F.col("text").alias("question")).unionByName(
        docs.filter("doc_id % 2 = 0").select(name("d", k).alias("question_id"), F.col("text").alias("question")))
    exposed = docs.filter("doc_id % 2 = 1").select(F.when(k % 101 == 0, name("d", k * 2)).otherwise(name("x", k)).alias("question_id"), F.col("text").alias("question"))
    return ev.overlapping_questions(holdout, exposed)


@query("""
WITH l AS (SELECT doc_id AS line, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '[1]' ELSE '' END AS odd, CASE doc_id % 7 WHEN 2 THEN '' WHEN 3 THEN 'q' || (doc_id // 14) ELSE 'q' || doc_id || 'u' END AS qid,
  CASE WHEN doc_id % 7 = 4 THEN '' ELSE lang END AS q FROM documents),
first AS (SELECT qid, min(line) AS first_line FROM l WHERE odd = '' AND qid <> '' GROUP BY 1)
SELECT line, 'invalid_json' AS reason FROM l WHERE odd IS NULL UNION ALL SELECT line, 'row_must_be_object' FROM l WHERE odd = '[1]'
UNION ALL SELECT line, 'missing_question_id' FROM l WHERE odd = '' AND qid = '' UNION ALL SELECT line, 'duplicate_question_id' FROM l JOIN first USING (qid) WHERE odd = '' AND line > first_line
UNION ALL SELECT line, 'invalid_question_text' FROM l WHERE odd = '' AND q = ''""")
def question_file_audit(spark, sf):
    k = F.col("doc_id")
    case = k % 7
    qid = F.when(case == 2, "").when(case == 3, F.concat(F.lit("q"), F.floor(k / 14).cast("string"))).otherwise(F.concat(F.lit("q"), k.cast("string"), F.lit("u")))
    line = F.to_json(F.struct(qid.alias("question_id"), F.when(case == 4, "").otherwise(F.col("lang")).alias("question")))
    lines = t(spark, sf, "documents").select(k.alias("line"), F.when(case == 0, '{"question_id": ').when(case == 1, "[1]").otherwise(line).alias("value"))
    return ev.question_file_issues(lines)


@query("""
WITH h AS (SELECT sha256(CAST(item_id AS VARCHAR) || chr(31) || text) AS h, item_id FROM benchmark),
s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS w{i}" for i in range(8)) + """ FROM h)
SELECT 'question_count' AS item, CAST(n AS VARCHAR) AS value FROM s
UNION ALL SELECT 'version', 'questions_' || sha256(n || chr(31) || """ + " || chr(31) || ".join(f"w{i}" for i in range(8)) + """) FROM s
UNION ALL SELECT 'split:' || CASE WHEN item_id % 3 = 0 THEN 'test' ELSE 'dev' END, CAST(count(*) AS VARCHAR) FROM benchmark GROUP BY 1
UNION ALL SELECT 'category:c' || (item_id % 4), CAST(count(*) AS VARCHAR) FROM benchmark GROUP BY 1""")
def question_set_manifest(spark, sf):
    k = F.col("item_id")
    return ev.question_set_manifest(t(spark, sf, "benchmark").select(
        k.cast("string").alias("question_id"), F.col("text").alias("question"), F.when(k % 3 == 0, "test").otherwise("dev").alias("split"),
        F.concat(F.lit("c"), (k % 4).cast("string")).alias("category")))


# ---------------------------------------------------------------- audits

LINK_SQL = """
links AS (SELECT 'adc' AS entity_type, CAST(l_partkey + CASE WHEN l_orderkey % 97 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS entity_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'trial' ELSE 'document' END AS source_record_type,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE CAST(l_orderkey % 1200 AS VARCHAR) END AS source_record_id, l_returnflag AS matched_alias FROM lineitem)"""


def audit_links(spark, sf):
    trial = F.col("l_linenumber") % 2 == 0
    return t(spark, sf, "lineitem").select(
        F.lit("adc").alias("entity_type"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 97 == 0, 1000000).otherwise(0)).cast("string").alias("entity_id"),
        F.when(trial, "trial").otherwise("document").alias("source_record_type"),
        F.when(trial, F.col("l_orderkey").cast("string")).otherwise((F.col("l_orderkey") % 1200).cast("string")).alias("source_record_id"),
        F.col("l_returnflag").alias("matched_alias"))


@query("WITH " + LINK_SQL + """
SELECT entity_type, source_record_type, count(*) AS links, count(DISTINCT entity_id) AS entities, count(DISTINCT source_record_id) AS records FROM links GROUP BY 1, 2""")
def link_coverage(spark, sf):
    return audits.link_coverage(audit_links(spark, sf))


@query("WITH " + LINK_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, count(DISTINCT CASE WHEN source_record_type = 'trial' THEN source_record_id END) AS trials,
  count(DISTINCT CASE WHEN source_record_type = 'document' THEN source_record_id END) AS documents FROM part LEFT JOIN links ON entity_id = CAST(p_partkey AS VARCHAR) GROUP BY 1""")
def entity_link_coverage(spark, sf):
    catalogue = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"))
    return audits.entity_coverage(catalogue, audit_links(spark, sf))


@query("WITH " + LINK_SQL + """
SELECT 'orphan_trial_links' AS fault, count(*) AS n FROM links WHERE source_record_type = 'trial' AND source_record_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
UNION ALL SELECT 'orphan_document_links', count(*) FROM links WHERE source_record_type = 'document' AND source_record_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
UNION ALL SELECT 'unknown_entities', count(*) FROM links WHERE entity_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)
UNION ALL SELECT 'unmatched_aliases', count(*) FROM links WHERE NOT EXISTS (SELECT 1 FROM part WHERE CAST(p_partkey AS VARCHAR) = entity_id AND
  (CASE WHEN p_size % 3 = 0 THEN 'A' WHEN p_size % 3 = 1 THEN 'N' ELSE 'R' END) = matched_alias)""")
def dataset_audit(spark, sf):
    part = t(spark, sf, "part")
    key = F.col("p_partkey").cast("string").alias("entity_id")
    alias = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "N").otherwise("R")
    return audits.link_faults(
        audit_links(spark, sf), part.select(key), t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("nct_id")),
        t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id")), part.select(F.lit("adc").alias("entity_type"), key, alias.alias("alias")))


@query("""
SELECT count(*) AS record_count, count(*) FILTER (WHERE u = '') AS missing_url_count, count(*) FILTER (WHERE u <> '' AND NOT starts_with(u, 'https://')) AS non_https_url_count,
  count(DISTINCT nullif(u, '')) AS distinct_url_count, count(*) FILTER (WHERE regexp_matches(u, '^[A-Za-z]+://[^/?#]+/?$')) AS generic_url_count,
  CASE WHEN count(*) FILTER (WHERE u = '' OR NOT starts_with(u, 'https://')) > 0 THEN 'needs_review' ELSE 'pass' END AS status
FROM (SELECT CASE WHEN page_id % 25 = 3 THEN ' ' WHEN page_id % 25 = 4 THEN 'https://host.example/' ELSE url END AS raw, trim(raw) AS u FROM pages)""")
def url_quality(spark, sf):
    k = F.col("page_id") % 25
    return audits.url_quality(t(spark, sf, "pages").select(F.when(k == 3, " ").when(k == 4, "https://host.example/").otherwise(F.col("url")).alias("url")), "url")


LOCATOR_SQL = """
WITH cells AS (SELECT p_partkey AS adc_id, unnest(['p_brand', 'p_type', 'p_name']) AS field, unnest([p_brand, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_type END, p_name]) AS expected FROM part),
cand AS (SELECT l_partkey AS adc_id, (['p_brand', 'p_type', 'p_name'])[l_linenumber % 3 + 1] AS field, CASE WHEN l_suppkey % 5 = 0 THEN 'http://old.example/a' WHEN l_suppkey % 5 = 1
  THEN 'https://www.fda.gov/item' ELSE 'https://s.example/x' END AS url, CASE WHEN l_returnflag = 'A' THEN upper(p_brand) ELSE 'other' END AS value FROM lineitem JOIN part ON p_partkey = l_partkey),
pc AS (SELECT c.adc_id, c.field, count(url) AS n, coalesce(bool_or(lower(value) = lower(expected)), false) AS match, coalesce(bool_or(contains(url, 'fda.gov')), false) AS reg
  FROM cells c LEFT JOIN (SELECT * FROM cand WHERE starts_with(url, 'https://')) x ON x.adc_id = c.adc_id AND x.field = c.field WHERE coalesce(expected, '') <> '' GROUP BY 1, 2)
SELECT field, count(*) AS expected, count(*) FILTER (WHERE n > 0) AS covered, count(*) FILTER (WHERE n = 0) AS missing, round(CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) / count(*), 4) AS coverage,
  round(CAST(count(*) FILTER (WHERE match) AS DOUBLE) / count(*) FILTER (WHERE n > 0), 4) AS value_match_rate, count(*) FILTER (WHERE reg) AS regulator_covered FROM pc GROUP BY 1"""


@query(LOCATOR_SQL)
def locator_coverage(spark, sf):
    part = t(spark, sf, "part")
    catalogue = part.select(F.col("p_partkey").alias("adc_id"), "p_brand", F.when(F.col("p_size") % 6 == 0, "").otherwise(F.col("p_type")).alias("p_type"), "p_name")
    fields = F.array(F.lit("p_brand"), F.lit("p_type"), F.lit("p_name"))
    s = F.col("l_suppkey") % 5
    candidates = t(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(
        F.col("l_partkey").alias("adc_id"), F.element_at(fields, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("field"),
        F.when(s == 0, "http://old.example/a").when(s == 1, "https://www.fda.gov/item").otherwise("https://s.example/x").alias("url"),
        F.when(F.col("l_returnflag") == "A", F.upper("p_brand")).otherwise("other").alias("value"))
    return audits.locator_coverage(catalogue, candidates, ["p_brand", "p_type", "p_name"])


@query("""
SELECT 'duplicate_adc_name' AS problem, lower(p_name) AS value FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'blank_adc_name', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 100 = 9
UNION ALL SELECT 'unknown_status', CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'LARGE'""".replace(
    "lower(p_name) AS value FROM part GROUP BY 2", "lower(p_name) AS value FROM part WHERE p_partkey % 100 <> 9 GROUP BY 2"))
def catalogue_problems(spark, sf):
    catalogue = t(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("adc_id"), F.when(F.col("p_partkey") % 100 == 9, " ").otherwise(F.col("p_name")).alias("adc_name"), F.col("p_type").alias("catalog_status"))
    return audits.catalogue_problems(catalogue, ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "SMALL"])


@query("""
SELECT problem, CAST(k AS VARCHAR) AS adc_id FROM (SELECT 'missing_in_policy' AS problem, p_partkey AS k FROM part WHERE p_partkey % 50 = 1
UNION ALL SELECT 'unknown_in_policy', p_partkey + 1000000 FROM part WHERE p_partkey % 50 = 2
UNION ALL SELECT 'unknown_class', p_partkey FROM part WHERE p_partkey % 50 = 3)""")
def scope_problems(spark, sf):
    k = F.col("p_partkey")
    catalogue = t(spark, sf, "part").select(k.cast("string").alias("adc_id"))
    records = t(spark, sf, "part").filter(k % 50 != 1).select(
        F.when(k % 50 == 2, k + 1000000).otherwise(k).cast("string").alias("adc_id"), F.when(k % 50 == 3, "other").when(k % 2 == 0, "core").otherwise("extended").alias("scope_class")).unionByName(
        t(spark, sf, "part").filter(k % 50 == 2).select(k.cast("string").alias("adc_id"), F.lit("core").alias("scope_class")))
    return audits.scope_problems(catalogue, {"core": True, "extended": False}, records)
