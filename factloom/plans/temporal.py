"""Fact store, freshness and evidence cards over the events table.

Users are subjects, event types are fields and ``k % 3`` picks the source. The value is a bucket of the event value; every
tenth ``k`` takes the value back and every seventh gives two values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import cards, fact_batch, facts
from factloom.operators.scan import neighbour
from factloom.operators.relational import latest_per_key
from factloom.operators.stages import checkpoint_folder, written
from factloom.plans.common import table as t
from factloom.policy import Policy, parse_policy, load_policy

QUERIES = {}
ORACLES = {}
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def event_policy() -> Policy:
    base = load_policy()
    source = lambda name, age, sure: {"display_name": name, "cadence": "daily", "max_age_hours": age, "authoritative": sure}
    field = lambda how: {"value_type": "integer", "cardinality": "one", "conflict_resolution": how,
                         "preferred_sources": ["registry", "literature"]}
    return parse_policy({
        "policy_version": "0.6.0", "fact_statuses": ["current", "superseded", "conflicted"],
        "verification_statuses": list(base.verification_statuses),
        "answer_routes": ["structured_fact", "comparison", "change_query", "trial_lookup", "literature_evidence", "refusal"],
        "scope": {}, "change_types": {e: c for e, c in base.change_types.items() if c["tracked_field"] is None},
        "sources": {"registry": source("Registry", 48, True), "literature": source("Literature", 240, True),
                    "curated_seed": source("Seed", None, False)},
        "fields": {"user.click": field("flag_conflict"), "user.view": field("preserve_all"),
                   "user.purchase": field("authoritative_first"), "user.signup": field("flag_conflict"),
                   "user.error": field("flag_conflict")},
    })


def observations(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.floor(F.col("value") / F.lit(25.0)).cast("bigint")
    source = F.element_at(F.array(F.lit("registry"), F.lit("literature"), F.lit("curated_seed")), (k % 3 + 1).cast("int"))
    one = lambda x: facts.value_struct(F.lit("user.value"), x.cast("string"), x.cast("string"))
    values = (F.when(k % 10 == 0, F.array().cast(facts.VALUES_TYPE)).when(k % 7 == 0, F.array(one(v), one(v + 1)))
              .otherwise(F.array(one(v))))
    return t(spark, sf, "events").select(
        F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"),
        F.concat(F.lit("user."), "event_type").alias("predicate"), values.cast(facts.VALUES_TYPE).alias("values"),
        source.alias("source"), source.alias("source_record_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
        F.concat_ws("/", F.lit("https://records.example"), (k % 2).cast("string")).alias("source_url"),
        F.lit(None).cast("string").alias("snapshot_id"), F.lit(1.0).alias("confidence"), F.lit("events_v1").alias("extractor"),
        F.lit("needs_review").alias("review_status"), F.col("event_id").alias("seq"))


OBS_SQL = """
obs AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS subject_id, 'user.' || event_type AS predicate,
  (['registry', 'literature', 'curated_seed'])[k % 3 + 1] AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed_at,
  'https://records.example/' || (k % 2) AS url, CASE WHEN k % 10 = 0 THEN CAST([] AS VARCHAR[])
    WHEN k % 7 = 0 THEN [CAST(v AS VARCHAR), CAST(v + 1 AS VARCHAR)] ELSE [CAST(v AS VARCHAR)] END AS vals
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value / 25) AS BIGINT) AS v FROM events)),
rank_of AS (SELECT * FROM (VALUES ('registry', 0), ('literature', 1), ('curated_seed', 3)) r(source, rnk)),
how AS (SELECT * FROM (VALUES ('user.click', 'flag'), ('user.view', 'all'), ('user.purchase', 'first'),
  ('user.signup', 'flag'), ('user.error', 'flag')) h(predicate, how))"""

STEPS_SQL = OBS_SQL + """,
seen AS (SELECT *, list_transform(vals, lambda v: url || '|' || v) AS ids,
  coalesce(lag(vals) OVER w, CAST([] AS VARCHAR[])) AS old_vals,
  coalesce(lag(list_transform(vals, lambda v: url || '|' || v)) OVER w, CAST([] AS VARCHAR[])) AS old_ids
  FROM obs WINDOW w AS (PARTITION BY subject_id, predicate, source ORDER BY seq)),
steps AS (SELECT * FROM seen WHERE ids <> old_ids),
vr AS (SELECT seq, subject_id, predicate, source, observed_at, url, val, CAST(list_contains(vals, val) AS INT)
   - CAST(list_contains(old_vals, val) AS INT) AS delta FROM
   (SELECT *, unnest(list_distinct(list_concat(vals, old_vals))) AS val FROM steps)),
sup AS (SELECT *, sum(delta) OVER (PARTITION BY subject_id, predicate, val ORDER BY seq) AS support FROM vr),
isl AS (SELECT *, sum(CASE WHEN delta = 1 AND support = 1 THEN 1 ELSE 0 END) OVER (
   PARTITION BY subject_id, predicate, val ORDER BY seq) AS island FROM sup),
fact AS (SELECT subject_id, predicate, val, island, min(seq) AS opened_seq, arg_min(observed_at, seq) AS valid_from,
   arg_min(source, seq) AS opener, max(CASE WHEN delta = -1 AND support = 0 THEN observed_at END) AS valid_to,
   max(CASE WHEN delta = -1 AND support = 0 THEN seq END) AS closed_seq FROM isl GROUP BY 1, 2, 3, 4),
last_obs AS (SELECT subject_id, predicate, source, arg_max(vals, seq) AS vals FROM obs GROUP BY 1, 2, 3),
held AS (SELECT subject_id, predicate, source, unnest(list_distinct(vals)) AS val FROM last_obs),
pv AS (SELECT subject_id, predicate, val, min(rnk) AS rnk, count(DISTINCT source) AS source_count,
   string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM held JOIN rank_of USING (source) GROUP BY 1, 2, 3),
pf AS (SELECT subject_id, predicate, count(*) AS open_values, min(rnk) AS best FROM pv GROUP BY 1, 2),
st AS (SELECT pv.*, open_values, CASE how WHEN 'flag' THEN CASE WHEN open_values > 1 THEN 'conflicted' ELSE 'current' END
   WHEN 'all' THEN 'current' ELSE CASE WHEN rnk = best THEN 'current' ELSE 'superseded' END END AS status
   FROM pv JOIN pf USING (subject_id, predicate) JOIN how USING (predicate))"""


@query("WITH " + STEPS_SQL + """
SELECT 'fact_' || substr(sha256('user' || chr(31) || subject_id || chr(31) || predicate || chr(31) || sha256(val) || chr(31)
   || valid_from || chr(31) || opener), 1, 32) AS fact_id, fact.subject_id, fact.predicate, val AS value, valid_from,
  valid_to, CASE WHEN closed_seq IS NOT NULL THEN 'superseded' ELSE st.status END AS status, opened_seq
FROM fact LEFT JOIN st USING (subject_id, predicate, val)""")
def fact_history(spark, sf):
    f = facts.reconcile(observations(spark, sf), event_policy()).facts
    return f.select("fact_id", "subject_id", "predicate", F.col("normalized_value_json").alias("value"), "valid_from",
                    "valid_to", "status", "opened_seq")


@query("WITH " + STEPS_SQL + """,
e AS (SELECT seq, subject_id, predicate, source, observed_at, ids, old_ids, unnest(list_distinct(list_concat(ids, old_ids)))
   AS id FROM steps),
tr AS (SELECT *, list_contains(ids, id) AND NOT list_contains(old_ids, id) AS opens,
   list_contains(old_ids, id) AND NOT list_contains(ids, id) AS closes FROM e),
oc AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY subject_id, predicate, source, id ORDER BY seq) AS n FROM tr
   WHERE opens OR closes),
sp AS (SELECT subject_id, predicate, source, id, n, min(seq) AS opened_seq, min(observed_at) AS observed_at,
   max(CASE WHEN closes THEN observed_at END) AS valid_to FROM oc GROUP BY 1, 2, 3, 4, 5)
SELECT sp.subject_id, sp.predicate, sp.source, split_part(id, '|', 2) AS value, split_part(id, '|', 1) AS source_url,
  sp.opened_seq, sp.observed_at, sp.valid_to, sp.valid_to IS NULL AS is_current, f.opened_seq AS fact_opened_seq
FROM sp JOIN fact f ON f.subject_id = sp.subject_id AND f.predicate = sp.predicate AND f.val = split_part(id, '|', 2)
  AND f.opened_seq <= sp.opened_seq AND (f.closed_seq IS NULL OR f.closed_seq > sp.opened_seq)""")
def fact_evidence_intervals(spark, sf):
    r = facts.reconcile(observations(spark, sf), event_policy())
    f = r.facts.select("fact_id", F.col("opened_seq").alias("fact_opened_seq"), F.col("normalized_value_json").alias("value"))
    return r.evidence.join(f, "fact_id").select(
        "subject_id", "predicate", "source", "value", "source_url", "opened_seq", "observed_at", "valid_to", "is_current",
        "fact_opened_seq")


BATCH_CUT_SQL = "(SELECT max(event_id) * 7 // 10 FROM events)"


def batch_on_store(spark, sf):
    """The store of all observations up to a cut, written, and the later ones applied to it as a batch."""
    policy, seen = event_policy(), written(observations(spark, sf))
    cut = seen.agg(F.max("seq")).first()[0] * 7 // 10
    before = facts.reconcile(seen.filter(F.col("seq") < cut), policy)
    path = f"{checkpoint_folder(spark).rstrip('/')}/facts-{uuid.uuid4().hex}"
    fact_batch.write_state(before.facts, before.evidence, path)
    batch = seen.filter(F.col("seq") >= cut)
    open_facts, current = fact_batch.read_open(spark, path, batch)
    return fact_batch.read_state(spark, path), fact_batch.apply_batch(open_facts, current, batch, policy)


@query("WITH " + STEPS_SQL + """
SELECT 'fact_' || substr(sha256('user' || chr(31) || subject_id || chr(31) || predicate || chr(31) || sha256(val) || chr(31)
   || valid_from || chr(31) || opener), 1, 32) AS fact_id, fact.subject_id, fact.predicate, val AS value, valid_from,
  valid_to, CASE WHEN closed_seq IS NOT NULL THEN 'superseded' ELSE st.status END AS status, opened_seq
FROM fact LEFT JOIN st USING (subject_id, predicate, val)""")
def fact_batch_store(spark, sf):
    """Old store and batch together: the same facts as one fold over everything."""
    before, applied = batch_on_store(spark, sf)
    f, _ = fact_batch.merged(*before, applied)
    return f.select("fact_id", "subject_id", "predicate", F.col("normalized_value_json").alias("value"), "valid_from",
                    "valid_to", "status", "opened_seq")


EVENT_SQL = """,
open_before AS (SELECT s.seq, s.subject_id, s.predicate, s.source, f.val, min(r.rnk) AS rnk FROM steps s
   JOIN fact f ON f.subject_id = s.subject_id AND f.predicate = s.predicate AND f.opened_seq < s.seq
     AND (f.closed_seq IS NULL OR f.closed_seq >= s.seq)
   JOIN hold h ON h.subject_id = s.subject_id AND h.predicate = s.predicate AND h.val = f.val AND h.from_seq < s.seq
     AND (h.to_seq IS NULL OR h.to_seq >= s.seq) JOIN rank_of r ON r.source = h.source GROUP BY ALL),
open_after AS (SELECT s.seq, s.subject_id, s.predicate, s.source, f.val, min(r.rnk) AS rnk FROM steps s
   JOIN fact f ON f.subject_id = s.subject_id AND f.predicate = s.predicate AND f.opened_seq <= s.seq
     AND (f.closed_seq IS NULL OR f.closed_seq > s.seq)
   JOIN hold h ON h.subject_id = s.subject_id AND h.predicate = s.predicate AND h.val = f.val AND h.from_seq <= s.seq
     AND (h.to_seq IS NULL OR h.to_seq > s.seq) JOIN rank_of r ON r.source = h.source GROUP BY ALL),
lb AS (SELECT seq, list(val ORDER BY val) AS vals, count(*) AS n FROM (SELECT *, min(rnk) OVER (PARTITION BY seq) AS best
   FROM open_before) JOIN how USING (predicate) WHERE how <> 'first' OR rnk = best GROUP BY 1),
la AS (SELECT seq, list(val ORDER BY val) AS vals, count(*) AS n FROM (SELECT *, min(rnk) OVER (PARTITION BY seq) AS best
   FROM open_after) JOIN how USING (predicate) WHERE how <> 'first' OR rnk = best GROUP BY 1),
j AS (SELECT s.*, how, coalesce(array_to_string(lb.vals, ','), '') AS old_list, coalesce(array_to_string(la.vals, ','), '')
   AS new_list, how = 'flag' AND coalesce(lb.n, 0) > 1 AS was, how = 'flag' AND coalesce(la.n, 0) > 1 AS now
   FROM steps s JOIN how USING (predicate) LEFT JOIN lb USING (seq) LEFT JOIN la USING (seq))"""

HOLD_SQL = """,
hr AS (SELECT seq, subject_id, predicate, source, val, delta FROM vr WHERE delta <> 0),
hn AS (SELECT *, lead(seq) OVER (PARTITION BY subject_id, predicate, source, val ORDER BY seq) AS nxt FROM hr),
hold AS (SELECT subject_id, predicate, source, val, seq AS from_seq, nxt AS to_seq FROM hn WHERE delta = 1)"""

CHANGES_SQL = "WITH " + STEPS_SQL + HOLD_SQL + EVENT_SQL + """,
ev AS (SELECT seq, subject_id, predicate, source, observed_at, 'fact.value_changed' AS event_type, 'medium' AS severity,
   old_list, new_list FROM j WHERE len(old_vals) > 0 AND list_sort(list_distinct(old_vals)) <> list_sort(list_distinct(vals))
UNION ALL SELECT seq, subject_id, predicate, source, observed_at, 'fact.conflict_detected', 'high', old_list, new_list FROM j
   WHERE now AND NOT was
UNION ALL SELECT seq, subject_id, predicate, source, observed_at, 'fact.conflict_resolved', 'medium', old_list, new_list
   FROM j WHERE was AND NOT now)"""


@query(CHANGES_SQL + f""",
e AS (SELECT seq, subject_id, predicate, source, ids, old_ids, unnest(list_distinct(ids)) AS id FROM steps),
brought AS (SELECT * FROM e WHERE NOT list_contains(old_ids, id)),
cut AS (SELECT {BATCH_CUT_SQL} AS c),
n AS (SELECT (SELECT count(*) FROM steps, cut WHERE seq >= c) AS processed, (SELECT count(*) FROM obs, cut WHERE seq >= c) AS given)
SELECT processed AS groups_processed, given - processed AS idempotent_groups, (SELECT count(*) FROM fact, cut WHERE opened_seq >= c) AS facts_created,
  (SELECT count(*) FROM brought, cut WHERE seq >= c) AS evidence_created, (SELECT count(*) FROM ev, cut WHERE seq >= c) AS changes_created FROM n""")
def fact_batch_counters(spark, sf):
    return batch_on_store(spark, sf)[1].counters


@query(CHANGES_SQL + """
SELECT seq, subject_id, predicate, source, observed_at AS detected_at, event_type, severity, '[' || old_list || ']' AS old_value,
  '[' || new_list || ']' AS new_value FROM ev""")
def change_events(spark, sf):
    return fact_events(spark, sf).select(
        "seq", "subject_id", "predicate", "source", "detected_at", "event_type", "severity",
        F.col("old_value_json").alias("old_value"), F.col("new_value_json").alias("new_value"))


def fact_events(spark, sf):
    policy = event_policy()
    return facts.change_events(facts.change_steps(observations(spark, sf)), policy)


@query("WITH " + STEPS_SQL + """
SELECT subject_id, predicate, val AS value, source_count, sources, open_values, CAST(rnk AS INTEGER) AS rank, status FROM st""")
def fact_current_state(spark, sf):
    return facts.latest_state(observations(spark, sf), event_policy()).select(
        "subject_id", "predicate", F.col("value_json").alias("value"), "source_count", "sources", "open_values", "rank", "status")


@query("WITH " + STEPS_SQL + """
SELECT predicate, count(*) FILTER (WHERE status = 'conflicted') AS conflicted_values,
  count(DISTINCT CASE WHEN status = 'conflicted' THEN subject_id END) AS conflicted_fields,
  count(DISTINCT subject_id) AS fields FROM st GROUP BY 1""")
def conflict_flags(spark, sf):
    state = facts.latest_state(observations(spark, sf), event_policy())
    clash = F.col("status") == "conflicted"
    return state.groupBy("predicate").agg(
        F.count_if(clash).alias("conflicted_values"), F.countDistinct(F.when(clash, F.col("subject_id"))).alias("conflicted_fields"),
        F.countDistinct("subject_id").alias("fields"))


@query("WITH " + STEPS_SQL + """
SELECT subject_id, predicate, val AS value, CAST(rnk AS INTEGER) AS rank, status FROM st""")
def preferred_source_rank(spark, sf):
    return facts.latest_state(observations(spark, sf), event_policy()).select("subject_id", "predicate", F.col("value_json").alias("value"), "rank", "status")


@query("""
WITH w AS (SELECT event_id, user_id, event_type, value, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY event_id)
  AS nxt FROM events)
SELECT event_id, user_id, event_type, value, epoch_us(ts) AS valid_from_us, coalesce(epoch_us(nxt), -1) AS valid_to_us, nxt IS NULL AS is_current
FROM w""")
def fact_history_scd2(spark, sf):
    """Every event as a version that ends where the next one of the same user and type starts."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", us.alias("valid_from_us"))
    nxt = neighbour(e, ["user_id", "event_type"], "event_id", {"valid_to_us": "valid_from_us"}, direction="next")
    return nxt.select("event_id", "user_id", "event_type", "value", "valid_from_us",
                      F.coalesce("valid_to_us", F.lit(-1)).alias("valid_to_us"), F.col("valid_to_us").isNull().alias("is_current"))


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def dedup_latest(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH e AS (SELECT event_id, (['registry', 'literature', 'curated_seed', 'other'])[CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1]
   AS source, ts, event_id % 11 = 0 AS lost FROM events),
a AS (SELECT event_id, source, CASE source WHEN 'registry' THEN 48 WHEN 'literature' THEN 240 END AS max_age_hours,
  CASE WHEN NOT lost THEN greatest(0.0, round(CAST(epoch_us(TIMESTAMP '2024-01-28 00:00:00') - epoch_us(date_trunc('second', ts)) AS DOUBLE)
    / 3600000000.0, 2)) END AS age_hours FROM e)
SELECT event_id, source, coalesce(max_age_hours, -1) AS max_age_hours, CASE WHEN source = 'curated_seed' THEN 'demo_source' WHEN source = 'other'
  THEN 'not_applicable' WHEN age_hours IS NULL THEN 'unknown' WHEN age_hours > max_age_hours THEN 'stale' ELSE 'current' END
  AS freshness_status, coalesce(age_hours > max_age_hours, false) AS is_stale
FROM a""")
def freshness_status(spark, sf):
    sources = F.array(F.lit("registry"), F.lit("literature"), F.lit("curated_seed"), F.lit("other"))
    k = F.get_json_object("props", "$.k").cast("int")
    e = t(spark, sf, "events").select(
        "event_id", F.element_at(sources, k % 4 + 1).alias("source"), F.lit(None).cast("string").alias("fetched_at"),
        F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("observed_at"))
    fresh = facts.freshness(e, event_policy(), F.lit("2024-01-28 00:00:00").cast("timestamp"))
    return fresh.select("event_id", "source", F.coalesce("max_age_hours", F.lit(-1)).alias("max_age_hours"), "freshness_status",
                        F.coalesce("is_stale", F.lit(False)).alias("is_stale"))


LONG_SQL = """
WITH f AS (SELECT p_partkey, unnest([
  {'p': 'adc.target', 'j': '"' || p_brand || '"'}, {'p': 'adc.antibody', 'j': NULL},
  {'p': 'adc.linker_name', 'j': CASE WHEN p_size % 5 <> 0 THEN '"L' || p_size || '"' END}, {'p': 'adc.linker_type', 'j': NULL},
  {'p': 'adc.payload_name', 'j': '"' || p_type || '"'}, {'p': 'adc.payload_class', 'j': NULL},
  {'p': 'adc.dar', 'j': CASE WHEN p_size % 7 <> 0 THEN CAST(CAST(p_size AS DOUBLE) / 2 AS VARCHAR) END},
  {'p': 'adc.indication', 'j': NULL},
  {'p': 'adc.development_status', 'j': CASE WHEN p_size > 25 THEN '"approved"' ELSE '"investigational"' END},
  {'p': 'adc.company', 'j': NULL}]) AS x FROM part)"""


def long_facts(spark, sf):
    from factloom.plans.text import part_catalogue
    catalogue = part_catalogue(spark, sf).withColumn("seq", F.col("entity_id").cast("bigint"))
    return facts.catalogue_observations(catalogue, F.lit("2024-01-01T00:00:00+00:00"))


@query(LONG_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS subject_id, x.p AS predicate, x.j AS value_json,
  CASE WHEN x.j IS NOT NULL THEN x.p || '[' || substr(sha256(x.j), 1, 12) || ']' END AS source_locator FROM f""")
def wide_to_long_facts(spark, sf):
    v = F.try_element_at("values", F.lit(1))
    return long_facts(spark, sf).select("subject_id", "predicate", v["value_json"].alias("value_json"),
                                        v["source_locator"].alias("source_locator"))


@query("""
SELECT p_partkey, 'snap_' || substr(sha256('registry' || chr(31) || p_partkey || chr(31) || sha256(p_name)), 1, 32) AS snapshot_id,
  'ev_' || substr(sha256('registry' || chr(31) || p_partkey || chr(31) || 'mentions'), 1, 24) AS evidence_id,
  sha256('"' || p_brand || '"') AS value_hash FROM part""")
def digest_ids(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey", ids.snapshot_id(F.lit("registry"), "p_partkey", F.sha2("p_name", 256)).alias("snapshot_id"),
        ids.evidence_mention_id(F.lit("registry"), "p_partkey", F.lit("mentions")).alias("evidence_id"),
        ids.value_hash(ids.json_string(F.col("p_brand"))).alias("value_hash"))


# ---------------------------------------------------------------- cards

CARD_FIELDS = (("user.click", "Click"), ("user.view", "View"), ("user.purchase", "Purchase"), ("user.signup", "Sign-up"),
               ("user.error", "Error"), ("user.refund", "Refund"))

CARD_SQL = "WITH " + STEPS_SQL + """,
subj AS (SELECT DISTINCT subject_id FROM obs),
spec AS (SELECT * FROM (VALUES ('user.click'), ('user.view'), ('user.purchase'), ('user.signup'), ('user.error'), ('user.refund'))
  s(predicate)),
cur AS (SELECT * FROM st WHERE status IN ('current', 'conflicted')),
lastobs AS (SELECT subject_id, predicate, source, arg_max(vals, seq) AS vals, arg_max(url, seq) AS url FROM obs GROUP BY 1, 2, 3),
evs AS (SELECT subject_id, predicate, source, val, url || '|' || val AS id FROM (SELECT *, unnest(list_distinct(vals)) AS val FROM lastobs)),
since AS (SELECT e.*, (SELECT max(s.seq) FROM steps s WHERE s.subject_id = e.subject_id AND s.predicate = e.predicate
   AND s.source = e.source AND list_contains(s.ids, e.id) AND NOT list_contains(s.old_ids, e.id)) AS oseq FROM evs e),
ev AS (SELECT since.*, o.observed_at, CASE since.source WHEN 'registry' THEN 48 WHEN 'literature' THEN 240 END AS max_age,
   greatest(0.0, round(CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(strptime(o.observed_at, '%Y-%m-%d %H:%M:%S')) AS DOUBLE)
     / 3600000000.0, 2)) AS age FROM since JOIN obs o ON o.seq = oseq),
ce AS (SELECT cur.subject_id, cur.predicate, cur.val, cur.status, ev.source, ev.observed_at, ev.age, ev.max_age FROM cur LEFT JOIN ev
   ON ev.subject_id = cur.subject_id AND ev.predicate = cur.predicate AND ev.val = cur.val),
agg AS (SELECT subject_id, predicate, bool_or(status = 'conflicted') AS conflicted, bool_or(coalesce(age > max_age, false)) AS stale,
   bool_or(source IS NOT NULL AND source <> 'curated_seed') AS external, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
   count(source) AS evidence_count, max(observed_at) AS latest_observed_at, string_agg(DISTINCT val, '；' ORDER BY val) AS display_value
   FROM ce GROUP BY 1, 2)"""


def card_fields(spark, sf):
    policy = event_policy()
    r = facts.reconcile(observations(spark, sf), policy)
    subjects = observations(spark, sf).select("subject_id").distinct()
    return cards.card_fields(subjects, r.facts, r.evidence, None, policy, CARD_FIELDS, F.lit(NOW).cast("timestamp"))


@query(CARD_SQL + """
SELECT subject_id, predicate, CASE WHEN display_value IS NULL THEN 'missing' WHEN conflicted THEN 'conflicted' ELSE 'current' END AS status,
  CASE WHEN display_value IS NULL THEN 'unknown' WHEN conflicted THEN CASE WHEN stale THEN 'stale' ELSE 'mixed' END
    WHEN stale THEN 'stale' WHEN NOT external THEN 'demo_source' ELSE 'current' END AS freshness_status,
  coalesce(display_value, '未记录') AS display_value, coalesce(sources, '') AS sources, coalesce(evidence_count, 0) AS evidence_count,
  latest_observed_at, coalesce(evidence_count > 0, false) AS traceability_complete,
  CASE WHEN display_value IS NULL THEN 'not_applicable' ELSE 'needs_review' END AS review_status
FROM subj CROSS JOIN spec LEFT JOIN agg USING (subject_id, predicate)""")
def evidence_card(spark, sf):
    return card_fields(spark, sf).select(
        "subject_id", "predicate", "status", "freshness_status", "display_value", "sources", "evidence_count",
        "latest_observed_at", "traceability_complete", "review_status")


@query(CARD_SQL + """,
cells AS (SELECT subject_id, predicate, CASE WHEN display_value IS NULL THEN 'missing' WHEN conflicted THEN 'conflicted' ELSE 'current' END
   || ':' || coalesce(display_value, '未记录') AS cell FROM subj CROSS JOIN spec LEFT JOIN agg USING (subject_id, predicate))
SELECT predicate, max(CASE WHEN subject_id = '1' THEN cell END) AS "1", max(CASE WHEN subject_id = '2' THEN cell END) AS "2",
  max(CASE WHEN subject_id = '7' THEN cell END) AS "7" FROM cells GROUP BY 1""")
def comparison_pivot(spark, sf):
    return cards.compare(card_fields(spark, sf), ["1", "2", "7", "2"])


@query(CARD_SQL + """
SELECT subject_id, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_count,
  count(*) FILTER (WHERE display_value IS NULL) AS missing_fields, count(*) FILTER (WHERE conflicted) AS conflicted_fields,
  count(*) FILTER (WHERE stale) AS stale_fields, bool_and(display_value IS NULL OR evidence_count > 0) AS traceability_complete
FROM subj CROSS JOIN spec LEFT JOIN agg USING (subject_id, predicate) GROUP BY 1""")
def evidence_brief(spark, sf):
    return cards.card_summary(card_fields(spark, sf))
