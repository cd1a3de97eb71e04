"""Run log, gates and merges over the driver tables.

Every event day is a run, every event type a source and every user of the day a collected record.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import merge, runs
from factloom.operators.relational import orphans
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


RUNS_SQL = """
members AS (SELECT DISTINCT 'run-' || strftime(ts, '%Y%m%d') AS run_id, event_type AS source, CAST(user_id AS VARCHAR)
   AS source_record_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS started_at FROM events),
runs AS (SELECT run_id, source, epoch_us(min(started_at)) AS started_us, epoch_us(min(started_at)) + 3600000000 AS finished_us,
   CASE WHEN day(min(started_at)) % 9 = 4 THEN 'failed' WHEN day(min(started_at)) % 7 = 3 THEN 'partial' ELSE 'complete' END AS status,
   day(min(started_at)) % 5 <> 2 AS is_complete, day(min(started_at)) % 10 = 2 AS planned, count(*) AS collected_count,
   CASE WHEN day(min(started_at)) % 4 <> 1 THEN count(*) + day(min(started_at)) % 3 END AS expected_count FROM members GROUP BY 1, 2)"""


def members_frame(spark, sf):
    return t(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_record_id"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("started_at")).distinct()


def runs_frame(spark, sf):
    r = members_frame(spark, sf).groupBy("run_id", "source").agg(
        F.min("started_at").alias("started_at"), F.count(F.lit(1)).alias("collected_count"))
    day = F.dayofmonth("started_at")
    return r.select(
        "run_id", "source", "started_at", (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        F.when(day % 9 == 4, "failed").when(day % 7 == 3, "partial").otherwise("complete").alias("status"),
        F.lit(1).alias("attempts"), F.when(day % 4 != 1, F.col("collected_count") + day % 3).alias("expected_count"),
        "collected_count", (day % 5 != 2).alias("is_complete"), F.lit(None).cast("string").alias("error_text"),
        (day % 10 == 2).alias("planned_truncation"))


@query("WITH " + RUNS_SQL + """
SELECT source, arg_max(run_id, (finished_us, run_id)) AS run_id, arg_max(collected_count, (finished_us, run_id)) AS collected_count,
  arg_max(status, (finished_us, run_id)) AS status FROM runs GROUP BY 1""")
def latest_run_per_source(spark, sf):
    return runs.latest_runs(runs_frame(spark, sf)).select("source", "run_id", "collected_count", "status")


DROP_SQL = "WITH " + RUNS_SQL + """,
c AS (SELECT r.*, (SELECT arg_max(p.collected_count, (p.finished_us, p.run_id)) FROM runs p WHERE p.source = r.source
   AND p.status = 'complete' AND (p.finished_us, p.run_id) < (r.finished_us, r.run_id)) AS baseline FROM runs r WHERE status = 'complete')"""


@query(DROP_SQL + """
SELECT run_id, source, collected_count, coalesce(baseline, 0) AS baseline, coalesce(round(CAST(collected_count AS DOUBLE)
  / CAST(nullif(baseline, 0) AS DOUBLE), 4), 1.0) AS ratio, coalesce(CAST(collected_count AS DOUBLE) / CAST(nullif(baseline, 0) AS DOUBLE)
  >= CAST(0.9 AS DOUBLE), true) AS passed FROM c""")
def count_drop_gate(spark, sf):
    return runs.count_drops(runs_frame(spark, sf), 0.1)


MISSING_SQL = "WITH " + RUNS_SQL + """,
pr AS (SELECT r.run_id, r.source, (SELECT arg_max(p.run_id, (p.finished_us, p.run_id)) FROM runs p WHERE p.source = r.source
   AND p.status = 'complete' AND p.is_complete AND (p.finished_us, p.run_id) < (r.finished_us, r.run_id)) AS previous_run_id
   FROM runs r WHERE status = 'complete' AND is_complete),
gone AS (SELECT pr.run_id, pr.previous_run_id, pr.source, m.source_record_id FROM pr JOIN members m ON m.run_id = pr.previous_run_id
   AND m.source = pr.source WHERE NOT EXISTS (SELECT 1 FROM members n WHERE n.run_id = pr.run_id AND n.source = pr.source
   AND n.source_record_id = m.source_record_id))"""


@query(MISSING_SQL + " SELECT run_id, previous_run_id, source, source_record_id FROM gone")
def missing_records(spark, sf):
    return runs.missing_records(runs_frame(spark, sf), members_frame(spark, sf)).select(
        "run_id", "previous_run_id", "source", "source_record_id")


@query(MISSING_SQL + """
SELECT 'source.record_missing' AS event_type, source || ':' || source_record_id AS subject_id, '{"previous_run_id":"' ||
  previous_run_id || '","run_id":"' || run_id || '"}' AS details_json FROM gone
UNION ALL SELECT 'source.collection_failed', source, '{"error":"","run_id":"' || run_id || '"}' FROM runs
WHERE status IN ('partial', 'failed')""")
def source_run_events(spark, sf):
    return runs.source_events(runs_frame(spark, sf), members_frame(spark, sf)).select("event_type", "subject_id", "details_json")


@query("WITH " + RUNS_SQL + """
SELECT run_id, source, CASE WHEN status = 'failed' THEN 'unknown' WHEN status = 'complete' AND is_complete AND expected_count IS NOT NULL
  THEN CASE WHEN collected_count >= expected_count THEN 'complete' ELSE 'partial' END WHEN status = 'partial' OR NOT is_complete
  THEN 'partial' ELSE 'unknown' END AS coverage_state, coalesce(round(CAST(collected_count AS DOUBLE) / CAST(expected_count AS DOUBLE), 6), -1.0)
  AS coverage_ratio, CASE WHEN expected_count IS NULL THEN 'expected_count_missing_or_nonpositive' END AS coverage_ratio_reason FROM runs""")
def source_coverage(spark, sf):
    return runs.source_coverage(runs_frame(spark, sf)).withColumn("coverage_ratio", F.coalesce("coverage_ratio", F.lit(-1.0)))


@query("WITH " + RUNS_SQL + """
SELECT run_id, source, CASE WHEN started_us <= epoch_us(TIMESTAMP '2024-01-25 06:00:00') - 86400000000 * 2 AND collected_count % 4 = 1
   THEN 'failed' WHEN collected_count % 4 = 1 THEN 'running' ELSE status END AS status,
  CASE WHEN collected_count % 4 <> 1 THEN finished_us WHEN started_us <= epoch_us(TIMESTAMP '2024-01-25 06:00:00') - 86400000000 * 2
   THEN epoch_us(TIMESTAMP '2024-01-25 06:00:00') ELSE -1 END AS finished_us FROM runs""")
def stale_run_recovery(spark, sf):
    r = runs_frame(spark, sf)
    open_ = F.col("collected_count") % 4 == 1
    r = r.withColumn("status", F.when(open_, "running").otherwise(F.col("status"))).withColumn(
        "finished_at", F.when(~open_, F.col("finished_at")))
    done = runs.stale_runs(r, F.lit("2024-01-25 06:00:00").cast("timestamp"), "2 DAYS")
    return done.select("run_id", "source", "status", F.coalesce(F.unix_micros("finished_at"), F.lit(-1)).alias("finished_us"))


GATES_SQL = MISSING_SQL + """,
drops AS (SELECT r.run_id, r.source, r.collected_count, (SELECT arg_max(p.collected_count, (p.finished_us, p.run_id)) FROM runs p
   WHERE p.source = r.source AND p.status = 'complete' AND (p.finished_us, p.run_id) < (r.finished_us, r.run_id)) AS baseline
   FROM runs r WHERE status = 'complete' AND run_id = 'run-20240122'),
gates AS (
SELECT 'ingestion_run_status' AS name, coalesce(bool_and(status IN ('complete', 'skipped')), false) AS passed, true AS blocking FROM runs
  WHERE run_id = 'run-20240122'
UNION ALL SELECT 'source_status:' || w.source, coalesce(r.status = 'complete', false), true FROM (VALUES ('click'), ('error'), ('refund')) w(source)
  LEFT JOIN runs r ON r.source = w.source AND r.run_id = 'run-20240122'
UNION ALL SELECT 'count_anomaly:' || source, coalesce(collected_count >= 0.75 * baseline, true), true FROM drops WHERE source IN ('click', 'error')
UNION ALL SELECT 'missing_detection_scope:' || source, planned, NOT planned FROM runs WHERE run_id = 'run-20240122' AND status = 'complete'
  AND NOT is_complete AND source IN ('click', 'error')
UNION ALL SELECT 'missing_records', (SELECT count(*) FROM gone WHERE run_id = 'run-20240122') <= 5, true
UNION ALL SELECT 'foreign_keys', NOT EXISTS (SELECT 1 FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)), true)"""


def gates(spark, sf):
    broken = orphans(t(spark, sf, "events"), t(spark, sf, "customer"), ["user_id"], ["c_custkey"])
    return runs.refresh_gates(runs_frame(spark, sf), members_frame(spark, sf), "run-20240122", ["click", "error", "refund"],
                              max_missing=5, integrity=[("foreign_keys", broken)])


@query(GATES_SQL + " SELECT name, passed, blocking FROM gates")
def refresh_gates(spark, sf):
    return gates(spark, sf)


@query(GATES_SQL + " SELECT bool_and(passed OR NOT blocking) AS passed FROM gates")
def refresh_decision(spark, sf):
    return runs.gates_passed(gates(spark, sf))


# ---------------------------------------------------------------- merges

PART_DELTA_SQL = """
delta AS (SELECT CASE WHEN p_partkey % 40 = 3 THEN p_partkey + 1000000 ELSE p_partkey END AS p_partkey, upper(p_name) AS p_name,
   CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE p_brand || 'x' END AS p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || '!' END
   AS p_type, p_size + 1 AS p_size FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 3 = 0)"""


def part_delta(part):
    k = F.col("p_partkey")
    return part.filter("p_partkey % 2 = 1 OR p_partkey % 3 = 0").select(
        F.when(k % 40 == 3, k + 1000000).otherwise(k).alias("p_partkey"), F.upper("p_name").alias("p_name"),
        F.when(k % 6 == 0, "unknown").otherwise(F.concat("p_brand", F.lit("x"))).alias("p_brand"),
        F.when(k % 4 != 0, F.concat("p_type", F.lit("!"))).alias("p_type"), (F.col("p_size") + 1).alias("p_size"))


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query("WITH " + PART_DELTA_SQL + """
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name,
  CASE WHEN n.p_partkey IS NULL OR (n.p_brand = 'unknown' AND o.p_partkey IS NOT NULL) THEN o.p_brand ELSE n.p_brand END AS p_brand,
  coalesce(n.p_type, o.p_type) AS p_type, coalesce(n.p_size, o.p_size) AS p_size
FROM part o FULL JOIN delta n ON o.p_partkey = n.p_partkey""")
def merge_upsert_coalesce(spark, sf):
    part = t(spark, sf, "part").select(*PART_COLUMNS)
    return merge.merge_catalogue(part, part_delta(part), "p_partkey", overwrite=["p_name"], unknown={"p_brand": ("unknown",)})


@query("WITH " + PART_DELTA_SQL + """
SELECT p_partkey, p_name, p_brand, p_type, p_size FROM delta
UNION ALL SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM delta)""")
def upsert_last_write_wins(spark, sf):
    part = t(spark, sf, "part").select(*PART_COLUMNS)
    return merge.last_write_wins(part, part_delta(part), ["p_partkey"])


@query("""
WITH o AS (SELECT DISTINCT p_brand AS owner, p_name AS alias FROM part WHERE p_size < 30),
n AS (SELECT DISTINCT p_brand AS owner, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS alias FROM part WHERE p_size >= 30)
SELECT owner, alias FROM o UNION ALL SELECT owner, min(alias) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.owner = n.owner
  AND lower(o.alias) = lower(n.alias)) GROUP BY owner, lower(alias)""")
def insert_or_ignore_aliases(spark, sf):
    part = t(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    old = part.filter("p_size < 30").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("alias")).distinct()
    new = part.filter("p_size >= 30").select(F.col("p_brand").alias("owner"), name.alias("alias"))
    return merge.insert_or_ignore(old, new, ["owner", "alias"], fold_case=["alias"])


@query("""
WITH s AS (SELECT DISTINCT source, CAST(doc_id % 200 AS VARCHAR) AS source_record_id, sha256(lang) AS content_hash, doc_id < 300 AS early
  FROM documents)
SELECT source, source_record_id, content_hash, bool_or(early) AS known_before FROM s GROUP BY 1, 2, 3""")
def append_snapshots(spark, sf):
    s = t(spark, sf, "documents").select(
        "source", (F.col("doc_id") % 200).cast("string").alias("source_record_id"), F.sha2("lang", 256).alias("content_hash"),
        (F.col("doc_id") < 300).alias("known_before"))
    return merge.append_snapshots(s.filter("known_before").distinct(), s.filter("NOT known_before"))


@query("""
SELECT l_partkey AS entity_id, l_orderkey AS record_id, 'exact' AS match_method FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_partkey, l_orderkey, 'relinked' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""")
def relink_replace(spark, sf):
    lines = t(spark, sf, "lineitem")
    link = lambda df, how: df.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("record_id"),
                                     F.lit(how).alias("match_method"), "l_returnflag")
    new = link(lines.filter("l_returnflag = 'R' AND l_quantity > 25"), "relinked")
    return merge.replace_where(link(lines, "exact"), new, F.col("l_returnflag") == "R").drop("l_returnflag")
