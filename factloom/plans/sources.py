"""Source scans, lookups and audits over the driver tables; files are written from the tables first and then scanned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.operators import audits, entities, facts, retrieval, runs
from factloom.operators.stages import checkpoint_folder
from factloom.plans.common import table as t
from factloom.plans.temporal import CHANGES_SQL, STEPS_SQL, event_policy, fact_events, observations
from factloom.functions import text as tx
from factloom.sources import files

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def _folder(spark, kind):
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@query("""
SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split,
  CASE WHEN item_id % 4 = 0 THEN 'held_out' ELSE 'development_exposed' END AS evaluation_use FROM benchmark""")
def question_file_scan(spark, sf):
    """Benchmark items written as JSON lines with missing fields, and read with the defaults of a question file."""
    k, path = F.col("item_id"), _folder(spark, "questions")
    t(spark, sf, "benchmark").select(k.cast("string").alias("question_id"), F.col("text").alias("question"), F.when(k % 3 == 0, "test").alias("split"),
                                     F.when(k % 4 == 0, "held_out").alias("evaluation_use")).write.json(path)
    return files.read_questions(spark, path).select("question_id", "question", "split", "evaluation_use")


@query("SELECT 'p' || p_partkey AS adc_id, 'dar' AS field, 'https://x.example/' || p_partkey AS url, CAST(p_size AS VARCHAR) AS value FROM part")
def locator_scan(spark, sf):
    path = _folder(spark, "locators")
    k = F.col("p_partkey").cast("string")
    t(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("adc_id"), F.lit("dar").alias("field"), F.concat(F.lit("https://x.example/"), k).alias("url"), F.col("p_size").cast("string").alias("value")).write.json(path)
    return files.read_locators(spark, path)


@query("""
WITH n AS (SELECT s_suppkey, ' ' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM supplier),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SUPPLIER  #' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') || '.' ELSE c_name END AS name FROM customer)
SELECT c_custkey, CAST(s_suppkey AS VARCHAR) AS entity_id FROM c LEFT JOIN n ON n.n = ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' '""")
def exact_lookup(spark, sf):
    k = F.col("c_custkey")
    names = t(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("SUPPLIER  #"), F.lpad((k % 150).cast("string"), 9, "0"), F.lit("."))).otherwise(F.col("c_name")).alias("name"))
    dictionary = t(spark, sf, "supplier").select(
        F.lit("company").alias("entity_type"), F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("canonical_name"), tx.normalize_text(F.col("s_name")).alias("alias"), F.lit(0).alias("position"))
    return entities.exact_canonical(names, dictionary, name="name", entity_type="company").select("c_custkey", "entity_id")


@query("""
WITH x AS (SELECT p_partkey, unnest([{'p': 'part.brand', 'v': CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END}, {'p': 'part.size', 'v': CAST(p_size AS VARCHAR)}, {'p': 'part.type', 'v': CASE WHEN p_partkey % 5 <> 0 THEN p_type END}]) AS i FROM part)
SELECT 'ev_' || substr(sha256('parts' || chr(31) || p_partkey || chr(31) || p_partkey || chr(31) || i.p), 1, 24) AS evidence_id, CAST(p_partkey AS VARCHAR) AS source_record_id, i.p AS predicate, i.v AS value, i.p || ': ' || i.v AS evidence_text
FROM x WHERE coalesce(i.v, '') <> ''""")
def attribute_rows(spark, sf):
    k = F.col("p_partkey")
    parts = t(spark, sf, "part").select(k.cast("string").alias("record"), k.cast("string").alias("entity"), F.lit("u").alias("url"), F.when(k % 4 != 0, F.col("p_brand")).otherwise("").alias("brand"), F.col("p_size").alias("size"),
                                        F.when(k % 5 != 0, F.col("p_type")).alias("type"))
    rows = entities.attribute_evidence(parts, source="parts", record_id="record", entity_id="entity", columns={"part.brand": "brand", "part.size": "size", "part.type": "type"}, url="url")
    return rows.select("evidence_id", "source_record_id", "predicate", "value", "evidence_text")


@query("WITH " + STEPS_SQL + " SELECT subject_id, val AS value, status, sources FROM st WHERE predicate = 'user.view' AND status IN ('current', 'conflicted')")
def current_facts(spark, sf):
    """Open facts of one field with the sources that support them; the filter is the feature."""
    r = facts.reconcile(observations(spark, sf), event_policy())
    found = facts.current_facts(r.facts, r.evidence, subject_type="user", predicate="user.view")
    return found.select("subject_id", F.col("normalized_value_json").alias("value"), "status", F.array_join("sources", ",").alias("sources"))


@query(CHANGES_SQL + " SELECT seq, subject_id, predicate, observed_at AS detected_at, severity FROM ev WHERE event_type = 'fact.conflict_detected'")
def event_list(spark, sf):
    return facts.list_events(fact_events(spark, sf), event_type="fact.conflict_detected").select("seq", "subject_id", "predicate", "detected_at", "severity")


@query("""
WITH o AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, CASE WHEN event_id % 13 = 0 THEN 'user.nothing' ELSE 'user.' || event_type END AS predicate,
  CASE WHEN event_id % 17 = 0 THEN 'nobody' ELSE 'registry' END AS source, CASE WHEN event_id % 19 = 0 THEN 'maybe' ELSE 'needs_review' END AS review, event_id % 23 = 0 AS empty, event_id // 2 AS seq FROM events)
SELECT 'unknown_field' AS reason, subject_id, predicate, source FROM o WHERE predicate = 'user.nothing'
UNION ALL SELECT 'unknown_source', subject_id, predicate, source FROM o WHERE source = 'nobody' UNION ALL SELECT 'unknown_review_status', subject_id, predicate, source FROM o WHERE review = 'maybe'
UNION ALL SELECT 'empty_value', subject_id, predicate, source FROM o WHERE empty
UNION ALL SELECT 'duplicate_group', subject_id, predicate, source FROM (SELECT subject_id, predicate, source, seq FROM o GROUP BY ALL HAVING count(*) > 1)""")
def batch_violations(spark, sf):
    """Faults of a batch of observations in which fields, sources, statuses and values have been spoilt."""
    k, e = F.col("event_id"), t(spark, sf, "events")
    value = F.when(k % 23 == 0, '""').otherwise("1")
    rows = e.select(
        F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.when(k % 13 == 0, "user.nothing").otherwise(F.concat(F.lit("user."), "event_type")).alias("predicate"),
        F.when(k % 17 == 0, "nobody").otherwise("registry").alias("source"), F.lit("r").alias("source_record_id"), F.when(k % 19 == 0, "maybe").otherwise("needs_review").alias("review_status"),
        F.lit(None).cast("string").alias("snapshot_id"), F.array(facts.value_struct(F.lit("x"), value, value)).alias("values"), F.floor(k / 2).cast("bigint").alias("seq"))
    return facts.observation_violations(rows, event_policy())


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders WHERE o_orderdate > DATE '1997-01-01'")
def late_records(spark, sf):
    d = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("shown"))
    return audits.late_dates(d, "shown", F.lit("1997-01-01").cast("date"), "o_orderkey").select("o_orderkey", "shown")


@query("""
WITH h AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'entrez' ELSE 'accepted' END AS event, l_shipdate AS d, l_orderkey % 9 <> 0 AS bound FROM lineitem WHERE l_orderkey % 10 <> 0),
p AS (SELECT l_orderkey, bool_and(bound) AS bound, bool_or(event = 'entrez' AND d <= DATE '1996-01-01') AS indexed FROM h GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, CASE WHEN p.bound IS NULL THEN 'raw_record_missing' WHEN NOT bound THEN 'raw_hash_mismatch' WHEN indexed THEN 'advance_issue_date' ELSE 'needs_review' END AS review
FROM orders LEFT JOIN p ON l_orderkey = o_orderkey WHERE o_orderdate > DATE '1995-06-01'""")
def late_review(spark, sf):
    """Orders after a cut-off as late records, their lines as the events of the raw files; each tenth record has lost its file."""
    key = F.col("l_orderkey")
    histories = t(spark, sf, "lineitem").where(key % 10 != 0).select(
        key.cast("string").alias("source_record_id"), F.when(F.col("l_linenumber") % 2 == 0, "entrez").otherwise("accepted").alias("event"), F.col("l_shipdate").alias("event_date"),
        F.lit("a").alias("raw_hash"), F.when(key % 9 == 0, "b").otherwise("a").alias("expected_hash"))
    shown = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source_record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"))
    late = audits.late_dates(shown, "issued", F.lit("1995-06-01").cast("date"), "source_record_id")
    return audits.late_publication_review(late, histories, F.lit("1996-01-01").cast("date")).select("source_record_id", "review")


@query("""
WITH d AS (SELECT CASE doc_id % 5 WHEN 0 THEN '/home/a/' || doc_id WHEN 1 THEN 'C:\\raw\\' || doc_id WHEN 2 THEN 'raw/' || doc_id ELSE '' END AS raw_path, 'https://x/' || doc_id AS url FROM documents)
SELECT 'raw_path' AS "column", count(*) FILTER (WHERE regexp_matches(raw_path, '^([A-Za-z]:[\\\\/]|/(home|Users|root|tmp|var|mnt)/)')) AS n FROM d
UNION ALL SELECT 'url', count(*) FILTER (WHERE NOT starts_with(url, 'https://')) FROM d""")
def absolute_path_counts(spark, sf):
    k = F.col("doc_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("/home/a/"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("C:\\raw\\"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("raw/"), k.cast("string"))).otherwise("")
    return audits.absolute_paths(t(spark, sf, "documents").select(path.alias("raw_path"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url")))


@query("""SELECT (SELECT count(*) FROM documents) AS stored, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total,
  round((SELECT count(*) FROM documents)::DOUBLE / max(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS share FROM events""")
def collection_share(spark, sf):
    return runs.collection_scope(t(spark, sf, "events"), "props", t(spark, sf, "documents"), "$.k")


def _expansion_sql() -> str:
    cells = ", ".join(f"CASE WHEN contains(q, '{marker}') THEN '{words}' END" for marker, words in retrieval.TERM_EXPANSIONS.items())
    markers = "[" + ", ".join(f"'{m}'" for m in retrieval.TERM_EXPANSIONS) + "]"
    return f"""
WITH s AS (SELECT doc_id, {markers}[doc_id % {len(retrieval.TERM_EXPANSIONS)} + 1] || ' ' || text || ' ' || {markers}[doc_id % 7 + 1] AS q FROM documents)
SELECT doc_id, md5(concat_ws(' ', q, {cells})) AS expanded FROM s"""


@query(_expansion_sql())
def expanded_queries(spark, sf):
    """Every document as a question with two marked terms, and the words that these add."""
    markers = F.array(*[F.lit(m) for m in retrieval.TERM_EXPANSIONS])
    pick = lambda n: F.element_at(markers, (F.col("doc_id") % n + 1).cast("int"))
    q = F.concat(pick(len(retrieval.TERM_EXPANSIONS)), F.lit(" "), "text", F.lit(" "), pick(7))
    return t(spark, sf, "documents").select("doc_id", q.alias("q")).select("doc_id", F.md5(retrieval.expand_query(F.col("q"))).alias("expanded"))


@query("""
WITH s AS (SELECT doc_id, 'raw/' || CASE WHEN doc_id % 11 = 0 THEN 'lost/' ELSE '' END || doc_id AS raw_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END) AS content_hash, sha256(text) AS real FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN content_hash = real THEN 'valid' ELSE 'hash_mismatch' END AS integrity FROM s""")
def snapshot_audit(spark, sf):
    k, d = F.col("doc_id"), t(spark, sf, "documents")
    stored = d.select(F.concat(F.lit("raw/"), k.cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    claimed = d.select("doc_id", F.concat(F.lit("raw/"), F.when(k % 11 == 0, "lost/").otherwise(""), k.cast("string")).alias("raw_path"),
                       F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("content_hash"))
    return audits.snapshot_integrity(claimed, stored).select("doc_id", "integrity")
