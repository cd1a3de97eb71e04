"""Report gates, checked unions and total orders over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gates
from factloom.operators.gates import Rule
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


@query("""
WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS "group", CAST(c_custkey AS VARCHAR) AS report, c_mktsegment AS arm, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'm' || (c_custkey % 3) END AS model,
  CASE WHEN c_custkey % 97 <> 0 THEN CAST(c_nationkey // 5 + CASE WHEN c_custkey % 211 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS questions FROM customer),
d AS (SELECT "group", min(questions) <> max(questions) OR count(questions) < count(*) AS differ FROM m GROUP BY 1)
SELECT "group", report, 'arm' AS key, 'one_of' AS rule, arm AS found FROM m WHERE arm NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
UNION ALL SELECT "group", report, 'model', 'present', model FROM m WHERE trim(model) = ''
UNION ALL SELECT "group", report, 'model', 'one_of', model FROM m WHERE arm = 'BUILDING' AND model NOT IN ('m0', 'm1')
UNION ALL SELECT "group", report, 'questions', 'same', questions FROM m JOIN d USING ("group") WHERE differ""")
def report_gate(spark, sf):
    """Every customer as a report of its nation, held to a table of constraints."""
    k = F.col("c_custkey")
    values = {"arm": F.col("c_mktsegment"), "model": F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("m"), (k % 3).cast("string"))),
              "questions": F.when(k % 97 != 0, (F.floor(F.col("c_nationkey") / 5) + F.when(k % 211 == 0, 1).otherwise(0)).cast("string"))}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in values.items()])).alias("m")
    metadata = t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("group"), k.cast("string").alias("report"), rows).select("group", "report", "m.*")
    rules = (Rule("arm", "one_of", ("BUILDING", "MACHINERY", "FURNITURE")), Rule("model", "present"), Rule("model", "one_of", ("m0", "m1"), ("arm", "BUILDING")), Rule("questions", "same"))
    return gates.report_violations(metadata, rules)


@query("""
WITH o AS (SELECT CAST(o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS question_id, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'partial' ELSE 'unknown' END AS status,
  CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS answer FROM orders WHERE true),
g AS (SELECT question_id, count(*) AS n, bool_or(status NOT IN ('answered', 'partial', 'refused', 'error')) AS bad, bool_or(answer IS NULL) AS no FROM o GROUP BY 1),
b AS (SELECT coalesce(c.q, g.question_id) AS question_id, c.q, g.* EXCLUDE (question_id) FROM (SELECT CAST(c_custkey AS VARCHAR) AS q FROM customer) c FULL JOIN g ON c.q = g.question_id)
SELECT question_id, unnest(list_filter([CASE WHEN n IS NULL THEN 'missing_output' END, CASE WHEN q IS NULL THEN 'unknown_question' END, CASE WHEN n > 1 THEN 'more_than_one_output' END,
  CASE WHEN bad THEN 'invalid_status' END, CASE WHEN no THEN 'missing_answer' END], lambda x: x IS NOT NULL)) AS reason FROM b""")
def arm_output_gate(spark, sf):
    """Orders as outputs for the questions of customers; some have many, some none, some belong to nobody."""
    k = F.col("o_orderkey")
    outputs = t(spark, sf, "orders").select(
        (F.col("o_custkey") + F.when(k % 50 == 0, 1_000_000).otherwise(0)).cast("string").alias("question_id"),
        F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown").alias("status"), F.when(k % 31 != 0, F.col("o_orderpriority")).alias("answer"))
    return gates.output_violations(outputs, t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("question_id")))


@query("""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS question_id, '{"brand":' || to_json(p_brand)::VARCHAR || ',"claims":[{"size":' || p_size || ',"type":' || to_json(p_type)::VARCHAR
  || '}],"missing":null,"question_id":"' || p_partkey || '","text":' || to_json(p_name)::VARCHAR || '}' AS output FROM part)
SELECT question_id, output, 'sha256:' || sha256(output) AS output_hash FROM r""")
def system_row_hash(spark, sf):
    rows = t(spark, sf, "part").select(
        F.col("p_name").alias("text"), F.col("p_partkey").cast("string").alias("question_id"), F.array(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"))).alias("claims"),
        F.lit(None).cast("string").alias("missing"), F.col("p_brand").alias("brand"))
    return gates.with_output_hash(rows)


@query("""
SELECT 'items:' || item_id AS question_id, 'items' AS part, sha256(text) AS text_hash FROM benchmark
UNION ALL SELECT 'parts:' || p_partkey, 'parts', sha256(p_name) FROM part UNION ALL SELECT 'nations:' || n_nationkey, 'nations', sha256(n_name) FROM nation""")
def checked_union(spark, sf):
    """Three files of questions under each other; the numbers of rows are stated and checked inside the plan."""
    parts = {name: t(spark, sf, table).select(F.col(key).alias("question_id"), F.sha2(text, 256).alias("text_hash"))
             for name, table, key, text in (("items", "benchmark", "item_id", "text"), ("parts", "part", "p_partkey", "p_name"), ("nations", "nation", "n_nationkey", "n_name"))}
    counts = {name: df.count() for name, df in parts.items()}
    return gates.checked_union(parts, counts).select("question_id", "part", "text_hash")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, lower(p_name), p_partkey) AS position FROM part")
def catalogue_order(spark, sf):
    return gates.in_order(t(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), [F.col("p_brand"), F.lower("p_name"), F.col("p_partkey")]).select("p_partkey", "position")
