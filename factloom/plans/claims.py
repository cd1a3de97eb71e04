"""Canonical values, claim checks and nested cards over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import ids, text as tx
from factloom.operators import cards, claims, facts
from factloom.plans.common import table as t
from factloom.plans.temporal import CARD_SQL, NOW, STEPS_SQL, event_policy, observations

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query("""
WITH p AS (SELECT p_partkey, trim(p_name) AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part),
c AS (SELECT p_partkey, '{"Name":' || to_json(name)::VARCHAR || ',"lists":[[],[' || size || ',' || size || '.5],{}],"nested":{"a":null,"b":[{"brand":' || to_json(brand)::VARCHAR
  || ',"name":' || to_json(name)::VARCHAR || '},true],"price":' || CAST(CAST(round(price) AS BIGINT) AS VARCHAR) || '.0},"é":-0.5}' AS canonical FROM p)
SELECT p_partkey, canonical, sha256(canonical) AS value_hash, json_extract_string(canonical, '$.nested.b[0].brand') AS brand FROM c""")
def canonical_nested(spark, sf):
    """Objects written with unsorted members, spaces and loose number forms, in one canonical text."""
    p = t(spark, sf, "part")
    name, size = F.to_json(F.array(F.concat(F.lit("  "), "p_name", F.lit("\n")))), F.col("p_size").cast("string")
    name = F.substr(name, F.lit(2), F.length(name) - 2)
    brand = F.to_json(F.array("p_brand"))
    brand = F.substr(brand, F.lit(2), F.length(brand) - 2)
    loose = F.concat(F.lit('{ "é" : -5e-1, "nested": {"price": '), F.round("p_retailprice").cast("bigint").cast("string"), F.lit('.00, "b": [ {"name": '), name, F.lit(', "brand":'), brand,
                     F.lit('}, true ], "a" : null},\n "lists": [[ ], ['), size, F.lit(", "), size, F.lit('.50], { }], "Name": '), name, F.lit("}"))
    text = ids.canonical_json(loose, tx.strip)
    return p.select("p_partkey", text.alias("canonical")).select(
        "p_partkey", "canonical", ids.value_hash("canonical").alias("value_hash"), F.get_json_object("canonical", "$.nested.b[0].brand").alias("brand"))


@query("WITH " + STEPS_SQL + """,
held_facts AS (SELECT f.*, coalesce(f.closed_seq IS NULL AND st.status IN ('current', 'conflicted'), false) AS is_open FROM fact f LEFT JOIN st USING (subject_id, predicate, val)),
known AS (SELECT subject_id, predicate, val, bool_or(is_open) AS is_open FROM held_facts GROUP BY 1, 2, 3),
field AS (SELECT subject_id, predicate, count(*) AS n, count(*) FILTER (WHERE is_open) AS n_open FROM known GROUP BY 1, 2),
e AS (SELECT seq, subject_id, predicate, source, ids, old_ids, unnest(list_distinct(list_concat(ids, old_ids))) AS id FROM steps),
tr AS (SELECT *, list_contains(ids, id) AND NOT list_contains(old_ids, id) AS opens, list_contains(old_ids, id) AND NOT list_contains(ids, id) AS closes FROM e),
oc AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY subject_id, predicate, source, id ORDER BY seq) AS n FROM tr WHERE opens OR closes),
sp AS (SELECT subject_id, predicate, source, id, n, min(seq) AS opened, bool_or(closes) AS gone FROM oc GROUP BY 1, 2, 3, 4, 5),
proof AS (SELECT f.subject_id, f.predicate, f.val, f.opened_seq, arg_max(NOT gone, (opened, source)) AS is_current FROM sp JOIN fact f ON f.subject_id = sp.subject_id
  AND f.predicate = sp.predicate AND f.val = split_part(id, '|', 2) AND f.opened_seq <= sp.opened AND (f.closed_seq IS NULL OR f.closed_seq > sp.opened) GROUP BY 1, 2, 3, 4),
claim AS (SELECT h.*, p.is_current, h.opened_seq % 6 AS v, CASE WHEN h.opened_seq % 6 = 3 THEN CAST(CAST(h.val AS BIGINT) + 1000 AS VARCHAR) ELSE h.val END AS said
  FROM held_facts h JOIN proof p USING (subject_id, predicate, val, opened_seq)),
judged AS (SELECT c.*, CASE WHEN v = 1 THEN 'missing_field_evidence' WHEN v IN (2, 4) THEN 'citation_not_bound_to_field' WHEN k.val IS NULL THEN 'value_not_equal_to_structured_field'
  WHEN NOT k.is_open THEN 'value_no_longer_current' WHEN NOT c.is_current THEN 'evidence_no_longer_current' WHEN n_open > 1 THEN 'value_not_equal_to_structured_field' END AS reason
  FROM claim c JOIN field USING (subject_id, predicate) LEFT JOIN known k ON k.subject_id = c.subject_id AND k.predicate = c.predicate AND k.val = c.said)
SELECT subject_id || ':' || predicate || ':' || val || ':' || opened_seq AS claim_id, reason IS NULL AS supported, reason, CASE reason WHEN 'missing_field_evidence' THEN 'citation'
  WHEN 'citation_not_bound_to_field' THEN 'citation' WHEN 'value_not_equal_to_structured_field' THEN 'value' WHEN 'value_no_longer_current' THEN 'activity'
  WHEN 'evidence_no_longer_current' THEN 'activity' END AS failed_leg FROM judged""")
def claim_value_check(spark, sf):
    """A claim for every fact of the store; five of six are changed: no citation, a foreign one, another value or another field."""
    r = facts.reconcile(observations(spark, sf), event_policy())
    named = r.facts.select("fact_id", F.col("normalized_value_json").alias("value"), F.col("opened_seq").alias("fact_seq"))
    proof = r.evidence.join(named, "fact_id").withColumn("evidence_id", F.concat_ws(":", "subject_id", "predicate", "source", F.col("opened_seq").cast("string"), "value"))
    newest = proof.groupBy("fact_id").agg(F.max_by("evidence_id", F.struct("opened_seq", "source")).alias("cited"))
    v = F.col("opened_seq") % 6
    value = F.when(v == 3, (F.col("value").cast("bigint") + 1000).cast("string")).otherwise(F.concat(F.lit(" "), "value", F.lit("\n")))
    none = F.array().cast("array<string>")
    citations = F.when(v == 1, none).when(v == 2, F.array("cited", F.concat(F.lit("none:"), "cited"))).otherwise(F.array("cited"))
    made = r.facts.withColumn("value", F.col("normalized_value_json")).join(newest, "fact_id").select(
        F.concat_ws(":", "subject_id", "predicate", "value", F.col("opened_seq").cast("string")).alias("claim_id"), "subject_type", "subject_id",
        F.when(v == 4, "user.refund").otherwise(F.col("predicate")).alias("predicate"), F.array(value).alias("values"), citations.alias("citations"))
    is_open = F.col("valid_to").isNull() & F.col("status").isin("current", "conflicted")
    checked = claims.claim_checks(made, r.facts.withColumn("is_open", is_open), proof)
    return checked.select("claim_id", "supported", "reason", "failed_leg")


@query(CARD_SQL + """,
per_fact AS (SELECT subject_id, predicate, val, any_value(status) AS status, count(source) AS n, coalesce(string_agg(source || '@' || observed_at || CASE WHEN age > max_age THEN '!' ELSE '' END, ','
  ORDER BY source), '') AS proofs FROM ce GROUP BY 1, 2, 3)
SELECT subject_id, predicate, count(*) AS fact_count, CAST(sum(n) AS BIGINT) AS evidence_count, string_agg(val || ':' || status || '[' || proofs || ']', ';' ORDER BY val) AS body FROM per_fact GROUP BY 1, 2""")
def card_nested(spark, sf):
    """Fields, their current facts and the evidence of each, in one row per field; arrays shown as text."""
    policy = event_policy()
    r = facts.reconcile(observations(spark, sf), policy)
    nested = cards.nested_cards(r.facts, r.evidence, None, policy, F.lit(NOW).cast("timestamp"))
    proof = lambda e: F.concat(e["source"], F.lit("@"), e["observed_at"], F.when(e["is_stale"], "!").otherwise(""))
    fact = lambda f: F.concat(f["display_value"], F.lit(":"), f["status"], F.lit("["), F.array_join(F.transform(f["evidence"], proof), ","), F.lit("]"))
    return nested.select("subject_id", "predicate", "fact_count", "evidence_count", F.array_join(F.transform("facts", fact), ";").alias("body"))
