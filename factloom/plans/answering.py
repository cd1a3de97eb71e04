"""Question guarding, routing, answering and claim checks over questions derived from the driver tables.

Customers ask about suppliers: each customer key picks one of twelve question forms and two of the first ten suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx, vocabulary as v
from factloom.operators import answers, questions as qs
from factloom.plans.common import table as t
from factloom.plans.retrieval import SPARSE_SQL, benchmark_questions, sparse_results
from factloom.plans.temporal import CARD_FIELDS, CARD_SQL, event_policy, observations
from factloom.operators import cards, facts

QUERIES = {}
ORACLES = {}

FORMS = (
    "{a} 的靶点是什么？", "比较 {a} 和 {b} 的载荷。", "最近30天 {a} 有什么变化？", "试验 {n} 当前登记状态和阶段是什么？",
    "请给出一篇与 {a} 的机制相关的文献证据。PMID: 12", " ", "给我某位患者的个体化用药剂量。", "{a} 没有来源时，请直接补全 DAR。",
    "预测未来 {a} 会获批吗？", "What is the weather in town {n}x?", "{a} payload class and linker type, 抗体亚型?",
    "{a} 与化疗的对比试验 II期 招募状态如何，今天？",
)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def customer_questions(spark, sf):
    """Questions of all forms; together they name every supplier."""
    k = F.col("c_custkey")
    n = t(spark, sf, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    name = lambda x: F.concat(F.lit("Supplier#"), F.lpad(x.cast("string"), 9, "0"))
    fill = {"{a}": name(k % n), "{b}": name((k * 7 + 3) % n), "{n}": F.concat(F.lit("NCT"), F.lpad((k % 500).cast("string"), 8, "0"))}
    text = F.lit("")
    for i, form in enumerate(FORMS):
        filled = F.lit(form)
        for mark, value in fill.items():
            if mark in form:
                filled = F.replace(filled, F.lit(mark), value)
        text = F.when(k % len(FORMS) == i, filled).otherwise(text)
    return t(spark, sf, "customer").select(k.cast("string").alias("question_id"), text.alias("question"))


def supplier_forms(spark, sf):
    return t(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("entity_name"), F.col("s_name").alias("form"))


def _form_sql(form: str) -> str:
    fill = {"{a}": "a", "{b}": "b", "{n}": "n"}
    out = f"'{form}'"
    for mark, name in fill.items():
        if mark in form:
            out = f"replace({out}, '{mark}', {name})"
    return out


QUESTIONS_SQL = """
sn AS (SELECT max(s_suppkey) + 1 AS sn FROM supplier),
qq AS (SELECT c_custkey AS k, 'Supplier#' || lpad(CAST(c_custkey % sn AS VARCHAR), 9, '0') AS a, 'Supplier#' || lpad(CAST((c_custkey * 7 + 3) % sn
   AS VARCHAR), 9, '0') AS b, 'NCT' || lpad(CAST(c_custkey % 500 AS VARCHAR), 8, '0') AS n FROM customer, sn),
q AS (SELECT CAST(k AS VARCHAR) AS question_id, CASE k % 12 """ + " ".join(
    f"WHEN {i} THEN {_form_sql(form)}" for i, form in enumerate(FORMS)) + """ END AS question FROM qq),
ql AS (SELECT *, lower(replace(replace(replace(question, '？', '?'), '，', ','), '：', ':')) AS l FROM q),
hit AS (SELECT question_id, CAST(s_suppkey AS VARCHAR) AS entity_id, strpos(l, lower(s_name)) AS pos FROM ql JOIN supplier ON contains(l, lower(s_name))),
ent AS (SELECT question_id, entity_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pos, entity_id) AS INTEGER) AS position FROM hit)"""


def _any(markers) -> str:
    return "(" + " OR ".join(f"contains(l, '{m}')" for m in markers) + ")"


GUARD_SQL = "WITH " + QUESTIONS_SQL + f"""
SELECT question_id, CASE WHEN trim(question) = '' THEN 'empty_question' WHEN length(trim(question)) > 500 THEN 'question_too_long'
  WHEN {_any(v.UNSAFE_PATTERNS)} OR (({_any(v.PERSONAL_CONTEXT)} OR regexp_matches(l, '{v.PERSONAL_CONTEXT_REGEX}'))
    AND ({_any(v.PERSONAL_ACTION)} OR regexp_matches(l, '{v.PERSONAL_ACTION_REGEX}'))) THEN 'personalized_medical_advice'
  WHEN {_any(v.NO_SOURCE_PATTERNS)} AND {_any(v.FILL_IN_ACTIONS)} THEN 'unsupported_fact_completion'
  WHEN {_any(v.FUTURE_PATTERNS)} THEN 'future_or_unpublished_claim'
  WHEN NOT (question_id IN (SELECT question_id FROM hit) OR {_any(v.DOMAIN_TERMS)} OR regexp_matches(question, '(?i)\\b(?:NCT\\d{{8}}|PMID\\s*:?\\s*\\d+)\\b'))
    THEN 'out_of_scope' ELSE 'allowed' END AS decision FROM ql"""


@query(GUARD_SQL)
def question_guard(spark, sf):
    dictionary = t(spark, sf, "supplier").select(
        F.lit("adc").alias("entity_type"), F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("canonical_name"),
        tx.normalize_text(F.col("s_name")).alias("alias"), F.lit(0).alias("position"))
    return qs.guard_questions(customer_questions(spark, sf), dictionary).select(
        "question_id", F.coalesce("refusal_reason", F.lit("allowed")).alias("decision"))


@query("WITH " + QUESTIONS_SQL + " SELECT question_id, entity_id, position FROM ent")
def question_entities(spark, sf):
    from factloom.operators.entities import resolve_in_questions
    return resolve_in_questions(customer_questions(spark, sf), supplier_forms(spark, sf), key="question_id", question="question").select(
        "question_id", "entity_id", "position")


def _fields_sql() -> str:
    asked = dict(v.FIELD_MARKERS) | dict(v.UNSUPPORTED_FIELD_MARKERS)
    cells = []
    for field, markers in v.FIELD_MARKERS:
        rule = _any(markers)
        for general, specific, but in v.FIELD_OVERRIDES:
            if general == field:
                rule += f" AND (NOT {_any(asked[specific])} OR {_any(but)})"
        cells.append(f"CASE WHEN {rule} THEN '{field}' END")
    cells += [f"CASE WHEN {_any(m)} THEN '{f}' END" for f, m in v.UNSUPPORTED_FIELD_MARKERS]
    return "list_filter([" + ", ".join(cells) + "], lambda x: x IS NOT NULL)"


def _first_sql(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {_any(m)} THEN '{name}'" for name, m in pairs) + " ELSE '' END"


ROUTER_SQL = "WITH " + QUESTIONS_SQL + f""",
f AS (SELECT ql.question_id, l, (SELECT count(*) FROM ent WHERE ent.question_id = ql.question_id) AS known,
   (SELECT coalesce(string_agg(entity_id, ',' ORDER BY position), '') FROM ent WHERE ent.question_id = ql.question_id) AS entity_ids,
   list_distinct(list_transform(regexp_extract_all(question, '(?i)\\b(NCT\\d{{8}})\\b', 1), lambda x: upper(x))) AS trials,
   {_any(v.COMPARISON_MARKERS)} AS comparison, {_any(v.CHANGE_MARKERS)} AS change, {_any(v.TRIAL_MARKERS)} AS trial_word,
   {_any(v.LITERATURE_MARKERS)} AS literature, {_fields_sql()} AS fields,
   list_filter([{", ".join(f"CASE WHEN {_any(m)} THEN '{p}' END" for p, m in v.TRIAL_FIELD_MARKERS)}], lambda x: x IS NOT NULL) AS trial_fields,
   {_first_sql(v.SOURCE_TYPE_MARKERS)} AS source_type, {_first_sql(v.TOPIC_MARKERS)} AS topic,
   {_first_sql([(p, (m,)) for m, p in v.PHASE_MARKERS])} AS phase,
   CASE WHEN {_any(v.MONTH_MARKERS)} THEN 30 WHEN {_any(v.DAY_MARKERS)} THEN 1 ELSE 7 END AS days FROM ql),
g AS (SELECT *, trial_word OR len(trials) > 0 AS trial FROM f),
r AS (SELECT *, CASE WHEN comparison AND NOT trial THEN CASE WHEN known >= 2 THEN 'comparison' WHEN literature THEN 'literature_evidence' ELSE 'refusal' END
   WHEN change THEN 'change_query' WHEN trial THEN 'trial_lookup' WHEN literature THEN 'literature_evidence' WHEN known > 0 THEN 'structured_fact'
   ELSE 'refusal' END AS route FROM g)
SELECT question_id, route, entity_ids, CASE WHEN route IN ('comparison', 'structured_fact') THEN array_to_string(CASE WHEN len(fields) > 0 THEN fields ELSE
   ['{"', '".join(v.PROFILE_DEFAULTS)}'] END, ',') WHEN route = 'trial_lookup' THEN array_to_string(CASE WHEN len(trial_fields) > 0 THEN trial_fields ELSE
   ['{"', '".join(v.TRIAL_DEFAULTS)}'] END, ',') ELSE '' END AS predicates, array_to_string(trials, ',') AS trial_ids,
  CAST(CASE route WHEN 'change_query' THEN 0.98 WHEN 'trial_lookup' THEN CASE WHEN len(trials) > 0 THEN 1.0 ELSE 0.92 END WHEN 'literature_evidence' THEN 0.9
   WHEN 'structured_fact' THEN CASE WHEN len(fields) > 0 THEN 1.0 ELSE 0.85 END WHEN 'refusal' THEN CASE WHEN comparison AND NOT trial THEN 1.0 ELSE 0.95 END
   ELSE 1.0 END AS DOUBLE) AS confidence, CASE WHEN route = 'change_query' THEN days ELSE 0 END AS days, source_type, topic, phase FROM r"""


@query(ROUTER_SQL)
def question_router(spark, sf):
    plans = qs.route_questions(customer_questions(spark, sf), supplier_forms(spark, sf))
    joined = lambda c: F.array_join(c, ",").alias(c)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return plans.select("question_id", "route", joined("entity_ids"), joined("predicates"), joined("trial_ids"), "confidence",
                        F.coalesce("days", F.lit(0)).alias("days"), blank("source_type"), blank("topic"), blank("phase"))


# ---------------------------------------------------------------- structured answers

FIELD_PLANS_SQL = """,
un AS (SELECT max(user_id) + 1 AS un FROM events),
cq AS (SELECT CAST(c_custkey AS VARCHAR) AS question_id, CAST(c_custkey % un AS VARCHAR) AS e1, CAST((c_custkey + 4) % un AS VARCHAR) AS e2,
   ['user.click', 'user.purchase', CASE WHEN c_custkey % 2 = 0 THEN 'user.refund' ELSE 'user.view' END, 'user.colour'] AS preds FROM customer, un),
pl AS (SELECT question_id, CAST(unnest([1, 2]) AS INT) AS e_pos, unnest([e1, e2]) AS subject_id, preds FROM cq),
pp AS (SELECT question_id, e_pos, subject_id, CAST(unnest([1, 2, 3, 4]) AS INT) AS p_pos, unnest(preds) AS predicate FROM pl),
lab AS (SELECT * FROM (VALUES ('user.click', 'Click'), ('user.view', 'View'), ('user.purchase', 'Purchase'), ('user.refund', 'Refund')) l(predicate, label)),
card AS (SELECT subject_id, predicate, CASE WHEN display_value IS NULL THEN 'missing' WHEN conflicted THEN 'conflicted' ELSE 'current' END AS status,
   display_value, coalesce(evidence_count, 0) AS n FROM subj CROSS JOIN spec LEFT JOIN agg USING (subject_id, predicate)),
it AS (SELECT pp.*, 'User ' || pp.subject_id AS name, label, status, display_value, coalesce(n, 0) AS n FROM pp LEFT JOIN lab USING (predicate)
   LEFT JOIN card USING (subject_id, predicate))"""


def _assemble_sql(first: str, second: str, keep: str = "true") -> str:
    return f""",
ia AS (SELECT *, status = 'current' AS is_claim FROM it WHERE {keep}),
ib AS (SELECT *, coalesce(sum(CASE WHEN is_claim THEN n ELSE 0 END) OVER (PARTITION BY question_id ORDER BY {first}, {second}
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ia),
cl AS (SELECT question_id, string_agg('- ' || name || ' 的' || label || '为' || display_value || '。 ' || array_to_string(list_transform(
   generate_series(CAST(before + 1 AS BIGINT), CAST(before + n AS BIGINT)), lambda i: '[S' || i || ']'), ''), chr(10) ORDER BY {first}, {second}) AS lines, count(*) AS n
   FROM ib WHERE is_claim GROUP BY 1),
ga AS (SELECT question_id, string_agg('- ' || name || ' · ' || coalesce(label, predicate) || '：' || CASE WHEN label IS NULL THEN
   '当前结构化模式没有该属性的字段定义，系统不会用相近字段代答。' WHEN status = 'conflicted' THEN '存在未解决的来源冲突，系统不选择单一值。'
   ELSE '当前事实层没有该字段的直接证据。' END, chr(10) ORDER BY {first}, {second}) AS lines, count(*) AS n FROM ib WHERE NOT coalesce(is_claim, false) GROUP BY 1)
SELECT question_id, CASE WHEN cl.n IS NULL THEN 'refused' WHEN ga.n IS NOT NULL THEN 'partial' ELSE 'answered' END AS status,
  coalesce(cl.lines, '现有结构化证据不足，无法可靠回答。') || CASE WHEN ga.n IS NULL THEN '' ELSE chr(10) || chr(10) || '未回答：' || chr(10) || ga.lines END AS answer,
  coalesce(cl.n, 0) AS claim_count, coalesce(ga.n, 0) AS gap_count FROM (SELECT DISTINCT question_id FROM it) LEFT JOIN cl USING (question_id)
LEFT JOIN ga USING (question_id)"""


def field_plans(spark, sf):
    """Two users for each question; together the questions ask for all users there can be."""
    k, n = F.col("c_custkey"), t(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]
    e = F.array((k % n).cast("string"), ((k + 4) % n).cast("string"))
    return t(spark, sf, "customer").select(
        k.cast("string").alias("question_id"), e.alias("entity_ids"), F.transform(e, lambda x: F.concat(F.lit("User "), x)).alias("entity_names"),
        F.array(F.lit("user.click"), F.lit("user.purchase"), F.when(k % 2 == 0, "user.refund").otherwise("user.view"), F.lit("user.colour")).alias("predicates"))


def field_answers(spark, sf, fields_first):
    policy = event_policy()
    r = facts.reconcile(observations(spark, sf), policy)
    subjects = r.facts.select("subject_id").distinct()
    fields = cards.card_fields(subjects, r.facts, r.evidence, None, policy, CARD_FIELDS, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    shown = r.facts.filter("valid_to IS NULL AND status IN ('current', 'conflicted')").select("fact_id")
    citations = r.evidence.filter("is_current").join(shown, "fact_id", "left_semi").groupBy("subject_id", "predicate").agg(
        F.array_sort(F.collect_set("fact_evidence_id")).alias("citation_keys"))
    items = answers.field_items(field_plans(spark, sf), fields, citations, fields_first=fields_first)
    return answers.assemble(items).select("question_id", "status", "answer", F.col("claim_count").cast("bigint").alias("claim_count"),
                                          F.col("gap_count").cast("bigint").alias("gap_count"))


@query(CARD_SQL + FIELD_PLANS_SQL + _assemble_sql("e_pos", "p_pos"))
def structured_answers(spark, sf):
    return field_answers(spark, sf, False)


@query(CARD_SQL + FIELD_PLANS_SQL + _assemble_sql("p_pos", "e_pos", "label IS NOT NULL"))
def comparison_answers(spark, sf):
    return field_answers(spark, sf, True)


TRIAL_SQL = """
WITH tr AS (SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS nct_id, o_orderkey, o_orderstatus AS overall_status,
   'PHASE' || (o_orderkey % 3 + 1) AS phase, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS enrollment FROM orders),
pl AS (SELECT CAST(c_custkey AS VARCHAR) AS question_id, c_custkey % 4 AS kind, 'NCT' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS want,
   CAST(c_custkey AS BIGINT) AS entity, CASE WHEN c_custkey % 5 = 0 THEN 'PHASE2' END AS want_phase FROM customer),
cand AS (SELECT question_id, tr.* FROM pl JOIN tr ON kind = 0 AND nct_id = want WHERE want_phase IS NULL OR phase = want_phase
  UNION ALL SELECT DISTINCT question_id, tr.* FROM pl JOIN lineitem ON kind IN (1, 2) AND l_partkey = entity JOIN tr ON tr.o_orderkey = l_orderkey
   WHERE want_phase IS NULL OR phase = want_phase
  UNION ALL SELECT question_id, h.nct_id, h.o_orderkey, h.overall_status, h.phase, h.enrollment FROM pl JOIN (SELECT *, row_number() OVER (ORDER BY nct_id) AS ra,
    row_number() OVER (PARTITION BY phase ORDER BY nct_id) AS rp FROM tr) h ON kind = 3 AND ((want_phase IS NULL AND ra <= 5)
    OR (phase = want_phase AND rp <= 5))),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY nct_id) AS position FROM cand) WHERE position <= 5),
cells AS (SELECT question_id, nct_id, position, CAST(unnest([1, 2, 3]) AS INT) AS p_pos, unnest([overall_status, phase, enrollment]) AS value,
   unnest(['试验状态', '试验阶段', '入组人数']) AS label FROM top),
cl AS (SELECT question_id, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1),
ga AS (SELECT question_id, count(*) AS n FROM cells WHERE value IS NULL GROUP BY 1),
lines AS (SELECT question_id, string_agg('- ' || nct_id || ' 的' || label || '为' || value || '。 [S' || i || ']', chr(10) ORDER BY i) AS text FROM
   (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position, p_pos) AS i FROM cells WHERE value IS NOT NULL) GROUP BY 1)
SELECT question_id, CASE WHEN cl.n IS NULL THEN 'refused' WHEN ga.n IS NOT NULL THEN 'partial' ELSE 'answered' END AS status,
  coalesce(cl.n, 0) AS claim_count, CASE WHEN cl.n IS NULL AND ga.n IS NULL THEN 1 ELSE coalesce(ga.n, 0) END AS gap_count,
  coalesce(lines.text, '') AS claim_text
FROM pl LEFT JOIN cl USING (question_id) LEFT JOIN ga USING (question_id) LEFT JOIN lines USING (question_id)"""


@query(TRIAL_SQL)
def trial_answers(spark, sf):
    key = F.col("o_orderkey")
    none, strings = F.lit(None).cast("string"), F.array().cast("array<string>")
    trials = t(spark, sf, "orders").select(
        F.concat(F.lit("NCT"), F.lpad(key.cast("string"), 8, "0")).alias("nct_id"), F.col("o_orderstatus").alias("overall_status"),
        F.array(F.concat(F.lit("PHASE"), (key % 3 + 1).cast("string"))).alias("phases"), strings.alias("conditions"), strings.alias("interventions"),
        strings.alias("primary_outcomes"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("enrollment"), none.alias("start_date"),
        none.alias("completion_date"))
    links = t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("entity_id"),
                                            F.concat(F.lit("NCT"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("nct_id"))
    k = F.col("c_custkey")
    kind, own = k % 4, F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0"))
    plans = t(spark, sf, "customer").select(
        k.cast("string").alias("question_id"), F.when(kind == 0, F.array(own)).otherwise(strings).alias("trial_ids"),
        F.when(kind.isin(1, 2), F.array(k.cast("string"))).otherwise(strings).alias("entity_ids"),
        F.array(F.lit("trial.overall_status"), F.lit("trial.phases"), F.lit("trial.enrollment")).alias("predicates"),
        F.when(k % 5 == 0, "PHASE2").alias("phase"))
    a = answers.assemble(answers.trial_items(plans, trials, links))
    claims = F.when(F.col("claim_count") > 0, F.split("answer", "\n\n未回答：")[0]).otherwise("")
    return a.select("question_id", "status", F.col("claim_count").cast("bigint").alias("claim_count"), F.col("gap_count").cast("bigint").alias("gap_count"),
                    claims.alias("claim_text"))


CHANGE_ANSWERS_SQL = """
WITH ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS entity, event_type, ts FROM events),
pl AS (SELECT CAST(c_custkey AS VARCHAR) AS question_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_custkey % 40 AS VARCHAR) END AS want,
   ([1, 7, 30])[c_custkey % 3 + 1] AS days FROM customer),
sel AS (SELECT DISTINCT want, days FROM pl),
hits AS (SELECT want, days, event_id, row_number() OVER (PARTITION BY want, days ORDER BY date_trunc('second', ts) DESC, CAST(event_id AS VARCHAR) DESC) AS position
  FROM sel JOIN ev ON (want IS NULL OR entity = want) AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 DAY * days
   AND TIMESTAMP '2024-01-20 00:00:00'),
per AS (SELECT want, days, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY position) AS ids FROM hits WHERE position <= 20 GROUP BY 1, 2)
SELECT question_id, CASE WHEN n IS NULL THEN 'refused' ELSE 'answered' END AS status, coalesce(n, 0) AS claim_count, coalesce(ids, '') AS citations
FROM pl LEFT JOIN per ON per.days = pl.days AND per.want IS NOT DISTINCT FROM pl.want"""


@query(CHANGE_ANSWERS_SQL)
def change_answers(spark, sf):
    strings = F.array().cast("array<string>")
    user = F.col("user_id").cast("string")
    events = t(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.lit("user").alias("subject_type"), user.alias("subject_id"),
        F.lit(None).cast("string").alias("predicate"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("detected_at"), F.lit("-").alias("old_text"),
        F.col("value").cast("string").alias("new_text"), F.array(user).alias("entity_ids"), F.array(user).alias("entity_names"), strings.alias("targets"))
    k = F.col("c_custkey")
    plans = t(spark, sf, "customer").select(
        k.cast("string").alias("question_id"), F.when(k % 4 == 3, strings).otherwise(F.array((k % 40).cast("string"))).alias("entity_ids"),
        strings.alias("targets"), F.element_at(F.array(F.lit(1), F.lit(7), F.lit(30)), (k % 3 + 1).cast("int")).alias("days"))
    a = answers.assemble(answers.change_items(plans, events, F.lit("2024-01-20 00:00:00").cast("timestamp")))
    return a.select("question_id", "status", F.col("claim_count").cast("bigint").alias("claim_count"),
                    F.array_join("citation_keys", ",").alias("citations"))


# ---------------------------------------------------------------- citations

CITED_SQL = """
base AS (SELECT conv_id || '-' || turn AS question_id, turn, text FROM conversations WHERE role = 'assistant'),
marked AS (SELECT question_id, turn, CASE turn % 4 WHEN 0 THEN '结论：' || chr(10) || text ELSE text END AS body FROM base),
numbered AS (SELECT question_id, turn, list_transform(string_split(body, chr(10)), lambda x, i: CASE WHEN (i + turn) % 5 = 0 THEN x WHEN (i + turn) % 7 = 0
   THEN x || ' [S9]' ELSE x || ' [S' || (i % 3 + 1) || ']' END) AS ls FROM marked),
claims AS (SELECT question_id, list_filter(list_transform(ls, lambda x: trim(ltrim(trim(x), '-*•0123456789.、 '))), lambda x: x <> '' AND
   NOT list_contains(['答案', '回答', '依据', '结论', 'answer', 'evidence'], lower(rtrim(x, '：:'))) AND NOT starts_with(x, '#') AND NOT starts_with(upper(x), 'REFUSE:')
   AND length(trim(regexp_replace(x, '\\[[^\\]]+\\]', '', 'g'))) >= 6) AS cs, array_to_string(ls, chr(10)) AS answer FROM numbered)"""


def cited_answers(spark, sf):
    c = t(spark, sf, "conversations").filter("role = 'assistant'")
    body = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("结论：\n"), "text")).otherwise(F.col("text"))

    def mark(x, i):
        n = i + 1 + F.col("turn")
        return (F.when(n % 5 == 0, x).when(n % 7 == 0, F.concat(x, F.lit(" [S9]")))
                .otherwise(F.concat(x, F.lit(" [S"), ((i + 1) % 3 + 1).cast("string"), F.lit("]"))))

    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), "text",
                    F.array_join(F.transform(F.split(body, "\n"), mark), "\n").alias("answer"))


@query("WITH " + CITED_SQL + """,
c AS (SELECT question_id, list_distinct(list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda n: 'S' || n)) AS cited, cs,
   len(list_filter(cs, lambda x: regexp_matches(x, '\\[S\\d+\\]'))) AS covered FROM claims)
SELECT question_id, array_to_string(list_sort(cited), ',') AS cited, array_to_string(list_filter(cited, lambda x: NOT list_contains(['S1', 'S2', 'S3'], x)), ',')
  AS invalid, CAST(len(cs) AS BIGINT) AS claim_count, CAST(covered AS BIGINT) AS cited_claim_count,
  CASE WHEN len(cs) > 0 THEN round(CAST(covered AS DOUBLE) / CAST(len(cs) AS DOUBLE), 4) ELSE 0.0 END AS coverage,
  len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(['S1', 'S2', 'S3'], x))) = 0 AND len(cs) > 0 AND covered = len(cs) AS valid FROM c""")
def citation_coverage(spark, sf):
    a = cited_answers(spark, sf).withColumn("available", F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")))
    return answers.citation_check(a).select(
        "question_id", F.array_join(F.array_sort("cited"), ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"),
        F.col("claim_count").cast("bigint").alias("claim_count"), F.col("cited_claim_count").cast("bigint").alias("cited_claim_count"), "coverage", "valid")


def _connector_sql(expr: str) -> str:
    for connector in v.CONNECTORS:
        expr = f"replace({expr}, '{connector}', ' ')"
    return expr


SUPPORT_SQL = "WITH " + CITED_SQL + f""",
src AS (SELECT question_id, [{{'id': 'S1', 't': substr(text, 1, 400)}}, {{'id': 'S2', 't': substr(text, 200, 600)}}, {{'id': 'S3', 't': substr(text, 500)}}] AS s FROM base),
one AS (SELECT question_id, CAST(unnest(generate_series(0, len(cs) - 1)) AS INTEGER) AS claim_index, unnest(cs) AS claim FROM claims WHERE len(cs) > 0),
x AS (SELECT one.*, s, list_distinct(list_transform(regexp_extract_all(claim, '\\[S(\\d+)\\]', 1), lambda n: 'S' || n)) AS cited FROM one JOIN src USING (question_id)),
y AS (SELECT *, replace(lower(array_to_string(list_transform(list_filter(s, lambda e: list_contains(cited, e.id)), lambda e: e.t), ' ')), 'ß', 'ss') AS ev,
   list_distinct(list_filter(list_transform(regexp_extract_all({_connector_sql("ltrim(trim(regexp_replace(replace(lower(claim), 'ß', 'ss'), '\\[[^\\]]+\\]', ' ', 'g')), '-*•0123456789.、 ')")},
   '[a-z][a-z0-9]*(?:-[a-z0-9]+)*|\\d+(?:\\.\\d+)?|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda w: trim(w, '-')), lambda w: length(w) >= 2 AND NOT list_contains(
   ['{"', '".join(v.SUPPORT_NOISE)}'], w))) AS terms FROM x),
z AS (SELECT *, list_filter(terms, lambda w: NOT contains(ev, w)) AS missing FROM y)
SELECT question_id, claim_index, CAST(len(terms) AS BIGINT) AS term_count, CAST(len(missing) AS BIGINT) AS missing_count, CASE WHEN len(cited) = 0 THEN 'missing_citation'
  WHEN list_contains(cited, 'S9') THEN 'unknown_citation' WHEN len(terms) = 0 THEN 'no_verifiable_terms' WHEN len(missing) > 0 THEN 'terms_not_in_cited_evidence'
  ELSE 'supported' END AS verdict FROM z"""


@query(SUPPORT_SQL)
def text_support_check(spark, sf):
    cut = lambda name, start, n: F.struct(F.lit(name).alias("citation_id"), F.substring(F.col("text"), F.lit(start), n).alias("excerpt"))
    a = cited_answers(spark, sf).withColumn("sources", F.array(cut("S1", 1, F.lit(400)), cut("S2", 200, F.lit(600)), cut("S3", 500, F.length("text"))))
    return answers.claim_support(a).select(
        "question_id", "claim_index", F.size("terms").cast("bigint").alias("term_count"), F.size("missing_terms").cast("bigint").alias("missing_count"),
        F.coalesce("reason", F.lit("supported")).alias("verdict"))


# ---------------------------------------------------------------- extraction

NUMBERED_SQL = """,
res AS (SELECT s.question_id, s.rank, s.document_id, d.text FROM sparse s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.document_id WHERE s.rank <= 5),
lst AS (SELECT question_id, list({'o': CAST([] AS STRUCT(cid VARCHAR, doc VARCHAR, ex VARCHAR)[]), 'u': 0, 'd': document_id, 't': text} ORDER BY rank) AS r FROM res GROUP BY 1),
fold AS (SELECT question_id, list_reduce(r, lambda a, x: CASE WHEN a.u < 7000 AND trim(substr(x.t, 1, least(1400, 7000 - a.u)), W) <> ''
   THEN {'o': list_append(a.o, {'cid': 'S' || (len(a.o) + 1), 'doc': x.d, 'ex': trim(substr(x.t, 1, least(1400, 7000 - a.u)), W)}),
     'u': a.u + length(trim(substr(x.t, 1, least(1400, 7000 - a.u)), W)), 'd': '', 't': ''} ELSE a END,
   {'o': CAST([] AS STRUCT(cid VARCHAR, doc VARCHAR, ex VARCHAR)[]), 'u': 0, 'd': '', 't': ''}).o AS o FROM lst),
num AS (SELECT question_id, CAST(unnest(generate_series(0, len(o) - 1)) AS INTEGER) AS source_index, unnest(o, max_depth := 2) FROM fold)""".replace(
    ", W)", ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


def numbered_sources(spark, sf):
    found = sparse_results(spark, sf, 5).select("question_id", "rank", "retrieval_document_id")
    docs = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("retrieval_document_id"), F.lit("pubmed").alias("source_type"),
                                            F.col("text").alias("content"))
    return answers.number_sources(found.join(docs, "retrieval_document_id"))


@query(SPARSE_SQL + NUMBERED_SQL + """
SELECT question_id, cid AS citation_id, doc AS document_id, CAST(length(ex) AS INTEGER) AS excerpt_chars, md5(ex) AS excerpt_md5 FROM num""")
def budgeted_context(spark, sf):
    return numbered_sources(spark, sf).select("question_id", F.explode("sources").alias("s")).select(
        "question_id", "s.citation_id", F.col("s.retrieval_document_id").alias("document_id"), F.length("s.excerpt").alias("excerpt_chars"),
        F.md5("s.excerpt").alias("excerpt_md5"))


PICKED_SQL = """,
terms AS (SELECT CAST(item_id AS VARCHAR) AS question_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1)) AS ts FROM benchmark),
un AS (SELECT question_id, source_index, cid, list_filter(list_transform(regexp_split_to_array(regexp_replace(ex, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+'),
   lambda x: trim(x)), lambda x: x <> '') AS us FROM num),
u1 AS (SELECT question_id, source_index, cid, CAST(unnest(generate_series(0, len(us) - 1)) AS INT) AS unit_index, unnest(us) AS unit FROM un WHERE len(us) > 0),
sc2 AS (SELECT u1.*, len(list_filter(ts, lambda w: contains(lower(unit), w))) AS score FROM u1 JOIN terms USING (question_id)),
dd AS (SELECT *, row_number() OVER (PARTITION BY question_id, trim(regexp_replace(lower(unit), '\\s+', ' ', 'g')) ORDER BY score DESC, source_index, unit_index) AS dup
   FROM sc2 WHERE score > 0),
pk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_index, unit_index) AS position FROM dd WHERE dup = 1)"""


@query(SPARSE_SQL + NUMBERED_SQL + PICKED_SQL + """
SELECT question_id, string_agg('- 证据摘录：' || rtrim(substr(unit, 1, 420)) || ' [' || cid || ']', chr(10) ORDER BY position) AS answer FROM pk WHERE position <= 4 GROUP BY 1""")
def extractive_sentences(spark, sf):
    return answers.extract_answers(numbered_sources(spark, sf), benchmark_questions(spark, sf)).select("question_id", "answer")


def _anchors_sql() -> str:
    said = lambda text, group: "(" + " OR ".join(f"contains({text}, '{m}')" for m in group) + ")"
    return " OR ".join(f"({said('low', g)} AND NOT {said('ev', g)})" for g in v.TOPIC_ANCHORS)


LITERATURE_SQL = SPARSE_SQL + NUMBERED_SQL + PICKED_SQL + f""",
al AS (SELECT s.question_id, arg_min(s.score, s.rank) AS top_score, trim(regexp_replace(replace(lower(string_agg(concat_ws(' ', s.document_id, s.document_id, d.source, d.text),
   ' ' ORDER BY s.rank)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS ev FROM sparse s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.document_id WHERE s.rank <= 5 GROUP BY 1),
qs AS (SELECT CAST(item_id AS VARCHAR) AS question_id, replace(lower(text), 'ß', 'ss') AS low, list_transform(list_concat(
   regexp_extract_all(text, '(?i)\\bPMID\\s*:?[ \\t]*(\\d+)\\b', 1), regexp_extract_all(text, '(?i)\\b(NCT\\d{{8}})\\b', 1),
   list_filter(regexp_extract_all(text, '\\b[A-Za-z]{{2,}}[- ]?\\d{{2,}}[A-Za-z0-9-]*\\b'), lambda x: NOT regexp_matches(x, '(?i)^(PMID\\b|NCT\\d{{8}}\\b)'))),
   lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS ids FROM benchmark),
guard AS (SELECT question_id, CASE WHEN top_score IS NULL THEN 'no_retrieval_results' WHEN top_score < 0.5 THEN 'low_retrieval_relevance'
   WHEN len(list_filter(ids, lambda x: x <> '' AND NOT contains(ev, x))) > 0 THEN 'specific_identifier_not_found' WHEN {_anchors_sql()} THEN 'topic_not_supported' END AS why
   FROM qs LEFT JOIN al USING (question_id)),
cl AS (SELECT question_id, cid, position, '证据摘录：' || rtrim(substr(unit, 1, 420)) || ' [' || cid || ']' AS claim, ex FROM pk JOIN num USING (question_id, cid) WHERE position <= 4),
ct AS (SELECT *, replace(lower(ex), 'ß', 'ss') AS ev, list_distinct(list_filter(list_transform(regexp_extract_all(
   {_connector_sql("ltrim(trim(regexp_replace(replace(lower(claim), 'ß', 'ss'), '\\[[^\\]]+\\]', ' ', 'g')), '-*•0123456789.、 ')")},
   '[a-z][a-z0-9]*(?:-[a-z0-9]+)*|\\d+(?:\\.\\d+)?|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda w: trim(w, '-')), lambda w: length(w) >= 2 AND NOT list_contains(
   ['{"', '".join(v.SUPPORT_NOISE)}'], w))) AS terms FROM cl),
cs AS (SELECT *, len(terms) > 0 AND len(list_filter(terms, lambda w: NOT contains(ev, w))) = 0 AS ok FROM ct),
kept AS (SELECT question_id, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS withheld, string_agg('- ' || claim, chr(10) ORDER BY position) FILTER (WHERE ok)
   AS shown FROM cs GROUP BY 1),
ci AS (SELECT question_id, string_agg(cid, ',' ORDER BY p) AS citations FROM (SELECT question_id, cid, min(position) AS p FROM cs WHERE ok GROUP BY 1, 2) GROUP BY 1),
fin AS (SELECT g.question_id, coalesce(why, CASE WHEN kept.n IS NULL THEN 'model_refusal' WHEN kept.n = 0 THEN 'text_support_validation_failed' END) AS no, n, withheld, shown, citations
   FROM guard g LEFT JOIN kept USING (question_id) LEFT JOIN ci USING (question_id))
SELECT question_id, CASE WHEN no IS NOT NULL THEN 'refused' WHEN withheld > 0 THEN 'partial' ELSE 'answered' END AS status,
  coalesce(no, CASE WHEN withheld > 0 THEN 'partial_evidence' END) AS refusal_reason, CASE WHEN no IS NULL THEN shown END AS answer,
  CASE WHEN no IS NULL THEN n ELSE 0 END AS supported_claims, CASE WHEN no IS NULL THEN citations END AS citations FROM fin"""


@query(LITERATURE_SQL)
def literature_answers(spark, sf):
    found = sparse_results(spark, sf, 5)
    docs = t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("retrieval_document_id"), F.col("doc_id").cast("string").alias("source_record_id"),
        F.lit("pubmed").alias("source_type"), F.col("source").alias("title"), F.col("text").alias("content"))
    results = found.select("question_id", "rank", "score", "retrieval_document_id").join(docs, "retrieval_document_id")
    out = answers.literature_answers(benchmark_questions(spark, sf), results)
    return out.select("question_id", "status", "refusal_reason", "answer", "supported_claims", F.array_join("citations", ",").alias("citations"))
