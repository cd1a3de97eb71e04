"""Catalogue, coverage and link queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import relational as rel
from factloom.operators.scan import pair_with_next
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
SELECT 'entity_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM part
UNION ALL SELECT 'target_count', CAST(count(DISTINCT p_brand) AS DOUBLE) FROM part
UNION ALL SELECT 'approved_count', CAST(count(*) FILTER (WHERE p_type = 'PROMO') AS DOUBLE) FROM part
UNION ALL SELECT 'supplier_count', CAST(count(*) AS DOUBLE) FROM supplier
UNION ALL SELECT 'customer_count', CAST(count(*) AS DOUBLE) FROM customer""")
def catalog_stats(spark, sf):
    part = t(spark, sf, "part").agg(
        F.count(F.lit(1)).alias("entity_count"), F.countDistinct("p_brand").alias("target_count"),
        F.count_if(F.col("p_type") == "PROMO").alias("approved_count"),
    )
    others = [t(spark, sf, n).agg(F.count(F.lit(1)).alias(f"{n}_count")) for n in ("supplier", "customer")]
    return rel.union_all([rel.long_metrics(df) for df in (part, *others)])


def part_aliases(part):
    forms = F.array(
        F.upper("p_name"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")),
    )
    return part.select("p_partkey", F.explode(forms).alias("alias"))


@query("""
WITH a AS (SELECT p_partkey, unnest([upper(p_name), 'P-' || p_partkey, p_brand || '/' || p_size]) AS alias FROM part),
g AS (SELECT p_partkey, string_agg(DISTINCT alias, ' | ' ORDER BY alias) AS aliases,
             bool_or(contains(lower(alias), 'd#1')) AS hit FROM a GROUP BY 1)
SELECT p.p_partkey, p_name, p_brand, p_type, aliases FROM part p LEFT JOIN g USING (p_partkey)
WHERE contains(lower(p_name), 'd#1') OR contains(lower(p_brand), 'd#1') OR contains(lower(p_type), 'd#1') OR hit""")
def entity_search_ilike(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return rel.search_catalogue(
        part.drop("p_size"), part_aliases(part), "d#1", key="p_partkey", search_columns=["p_name", "p_brand", "p_type"]
    )


@query("""
SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ' | ' ORDER BY n_name), '') AS nations, count(n_name) AS n
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 20 GROUP BY ALL""")
def fk_left_listagg(spark, sf):
    nation = t(spark, sf, "nation").filter("n_nationkey < 20")
    names = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_join(F.sort_array(F.collect_list("n_name")), " | ").alias("nations"), F.count("n_name").alias("n")
    )
    return t(spark, sf, "region").join(names, "r_regionkey", "left").select(
        "r_regionkey", "r_name", F.coalesce("nations", F.lit("")).alias("nations"), F.coalesce("n", F.lit(0)).alias("n")
    )


@query("""
SELECT 'document_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents
UNION ALL SELECT 'document_with_body_count', CAST(count(*) FILTER (WHERE length(trim(text)) > 0) AS DOUBLE)
  FROM documents
UNION ALL SELECT 'body_coverage', CASE WHEN count(*) > 0 THEN round(CAST(count(*) FILTER
  (WHERE length(text) >= 500) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) ELSE 0.0 END FROM documents
UNION ALL SELECT 'order_count', CAST(count(*) AS DOUBLE) FROM orders
UNION ALL SELECT 'open_order_count', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) FROM orders
UNION ALL SELECT 'failed_order_count', CAST(count(*) FILTER (WHERE o_orderstatus IN ('P', 'F')) AS DOUBLE) FROM orders
UNION ALL SELECT 'linked_customer_count', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders
UNION ALL SELECT 'unlinked_customer_count', CAST(count(*) AS DOUBLE) FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'source:' || source, CAST(count(*) AS DOUBLE) FROM documents GROUP BY source
UNION ALL SELECT 'status:' || coalesce(nullif(o_orderstatus, 'P'), 'UNKNOWN'), CAST(count(*) AS DOUBLE) FROM orders
  GROUP BY coalesce(nullif(o_orderstatus, 'P'), 'UNKNOWN')""")
def quality_metrics(spark, sf):
    documents, orders, customer = (t(spark, sf, n) for n in ("documents", "orders", "customer"))
    long_body = F.count_if(F.length("text") >= 500)
    doc = documents.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.length(F.trim("text")) > 0).alias("document_with_body_count"),
        rel.ratio(long_body, F.count(F.lit(1))).alias("body_coverage"),
    )
    order = orders.agg(
        F.count(F.lit(1)).alias("order_count"), F.count_if(F.col("o_orderstatus") == "O").alias("open_order_count"),
        F.count_if(F.col("o_orderstatus").isin("P", "F")).alias("failed_order_count"),
        F.countDistinct("o_custkey").alias("linked_customer_count"),
    )
    unlinked = rel.orphans(customer, orders, ["c_custkey"], ["o_custkey"]).agg(
        F.count(F.lit(1)).alias("unlinked_customer_count"))
    statuses = orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    grouped = [
        counts.select(F.concat(F.lit(f"{label}:"), F.col(label)).alias("metric"), F.col("n").cast("double").alias("value"))
        for label, counts in (("source", rel.labelled_counts(documents, "source")),
                              ("status", rel.labelled_counts(statuses, "status")))
    ]
    return rel.union_all([*[rel.long_metrics(df) for df in (doc, order, unlinked)], *grouped])


@query("""
SELECT coalesce(CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN'
                ELSE o_orderpriority END, 'UNKNOWN') AS priority, count(*) AS n FROM orders GROUP BY 1""")
def group_counts_null_label(spark, sf):
    priority = (F.when(F.col("o_orderpriority") == "3-MEDIUM", None)
                .when(F.col("o_orderpriority") == "5-LOW", "UNKNOWN").otherwise(F.col("o_orderpriority")))
    return rel.labelled_counts(t(spark, sf, "orders").select(priority.alias("priority")), "priority")


@query("""
SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders,
  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS finished_orders,
  count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) AS linked_customers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def conditional_distinct_coverage(spark, sf):
    customer = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return customer.join(orders, "c_custkey", "left").groupBy("c_mktsegment").agg(
        F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"),
        F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("finished_orders"),
        F.countDistinct(F.when(F.col("o_orderkey").isNotNull(), F.col("c_custkey"))).alias("linked_customers"),
    )


@query("""
WITH e AS (SELECT l_returnflag AS predicate, l_orderkey || '-' || l_linenumber AS fact_id, l_linestatus AS source,
    CASE WHEN l_suppkey % 10 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN 'https://s' || l_suppkey || '.example/'
         ELSE 'https://s' || l_suppkey || '.example/item' END AS url, l_quantity > 5 AS has_evidence FROM lineitem)
SELECT predicate, count(DISTINCT fact_id) AS facts,
  count(DISTINCT CASE WHEN has_evidence THEN fact_id END) AS facts_with_evidence,
  count(DISTINCT CASE WHEN url <> '' THEN fact_id END) AS facts_with_url,
  count(DISTINCT nullif(url, '')) AS distinct_urls, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  count(*) FILTER (WHERE url = '') AS missing_urls,
  count(*) FILTER (WHERE regexp_matches(url, '^[a-z]+://[^/]+/?$')) AS generic_urls
FROM e GROUP BY 1""")
def provenance_rollup(spark, sf):
    key = F.col("l_suppkey").cast("string")
    url = (F.when(F.col("l_suppkey") % 10 == 0, "")
           .when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("https://s"), key, F.lit(".example/")))
           .otherwise(F.concat(F.lit("https://s"), key, F.lit(".example/item"))))
    e = t(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("predicate"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id"),
        F.col("l_linestatus").alias("source"), url.alias("url"), (F.col("l_quantity") > 5).alias("has_evidence"),
    )
    return rel.provenance(e)


@query("""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
  CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS surplus_rows,
  greatest(coalesce(max(n), 1), 1) AS largest_group FROM g""")
def duplicate_logical_groups(spark, sf):
    return rel.duplicate_groups(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT 'customer_without_order' AS kind, c_custkey AS id FROM customer
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'order_without_customer', o_orderkey FROM orders
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)
UNION ALL SELECT 'part_without_matching_line', p_partkey FROM part
 WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = p_size)""")
def orphan_anti_join(spark, sf):
    customer, orders, part, lineitem = (t(spark, sf, n) for n in ("customer", "orders", "part", "lineitem"))
    kinds = {
        "customer_without_order": (rel.orphans(customer, orders, ["c_custkey"], ["o_custkey"]), "c_custkey"),
        "order_without_customer": (rel.orphans(orders, customer, ["o_custkey"], ["c_custkey"]), "o_orderkey"),
        "part_without_matching_line": (
            rel.orphans(part, lineitem, ["p_partkey", "p_size"], ["l_partkey", "l_linenumber"]), "p_partkey"),
    }
    return rel.union_all([df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
                          for kind, (df, key) in kinds.items()])


@query("""
SELECT s_suppkey, s_name, s_nationkey FROM supplier
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_discount > 0.08)""")
def semi_join_bridge(spark, sf):
    links = t(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 49 AND l_discount > 0.08D")
    return t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").join(
        links.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")


@query("""
SELECT p_type, o_orderstatus, count(*) AS links, count(DISTINCT p_partkey) AS parts,
  count(DISTINCT o_orderkey) AS orders
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def three_way_link_join(spark, sf):
    orders = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    part = t(spark, sf, "part").select("p_partkey", "p_type")
    return lines.join(orders, "o_orderkey").join(part, "p_partkey").groupBy("p_type", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("p_partkey").alias("parts"),
        F.countDistinct("o_orderkey").alias("orders"),
    )


@query("""
SELECT c_mktsegment, count(*) AS row_count, count(o_orderkey) AS open_orders, count(l_orderkey) AS returned_lines,
  count(*) FILTER (WHERE o_orderkey IS NULL) AS unsupported
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def left_chain_on_predicate(spark, sf):
    customer = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    current = t(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        "l_orderkey", F.col("l_orderkey").alias("o_orderkey"))
    chain = customer.join(current, "c_custkey", "left").join(lines, "o_orderkey", "left")
    return chain.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("o_orderkey").alias("open_orders"),
        F.count("l_orderkey").alias("returned_lines"), F.count_if(F.col("o_orderkey").isNull()).alias("unsupported"),
    )


@query("""
WITH r AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN -p_partkey ELSE p_partkey END AS p_partkey, p_name,
   CASE WHEN p_partkey % 11 = 0 THEN upper(p_brand) ELSE p_brand END AS p_brand,
   CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type,
   CASE WHEN p_partkey % 17 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part),
j AS (SELECT coalesce(l.p_partkey, r.p_partkey) AS p_partkey, l.p_partkey AS lk, r.p_partkey AS rk,
   [{'field': 'p_name', 'l': l.p_name, 'r': r.p_name}, {'field': 'p_brand', 'l': l.p_brand, 'r': r.p_brand},
    {'field': 'p_type', 'l': l.p_type, 'r': r.p_type},
    {'field': 'p_size', 'l': CAST(l.p_size AS VARCHAR), 'r': CAST(r.p_size AS VARCHAR)}] AS d
   FROM part l FULL JOIN r ON l.p_partkey = r.p_partkey)
SELECT p_partkey, '*' AS field, NULL AS left_value, NULL AS right_value,
  CASE WHEN rk IS NULL THEN 'left_only' ELSE 'right_only' END AS kind FROM j WHERE lk IS NULL OR rk IS NULL
UNION ALL SELECT p_partkey, x.field, x.l, x.r, 'changed' FROM
  (SELECT p_partkey, unnest(d) AS x FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL) WHERE x.l IS DISTINCT FROM x.r""")
def full_outer_field_diff(spark, sf):
    part = t(spark, sf, "part")
    k = F.col("p_partkey")
    changed = part.select(
        F.when(k % 50 == 7, -k).otherwise(k).alias("p_partkey"), "p_name",
        F.when(k % 11 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(k % 13 == 0, None).otherwise(F.col("p_type")).alias("p_type"),
        F.when(k % 17 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
    )
    return rel.field_differences(part, changed, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


SUBJECT_TYPES = {"click": "entity", "view": "target", "purchase": "trial", "signup": "publication",
                 "error": "source_record"}

POLYMORPHIC_SQL = """
WITH ev AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'entity' WHEN 'view' THEN 'target'
    WHEN 'purchase' THEN 'trial' WHEN 'signup' THEN 'publication' ELSE 'source_record' END AS subject_type,
  CASE event_type WHEN 'view' THEN 'Brand#' || (user_id % 25 + 1) ELSE CAST(user_id AS VARCHAR) END AS subject_id
  FROM events),
links AS (
  SELECT DISTINCT 'trial' AS subject_type, CAST(l_orderkey AS VARCHAR) AS subject_id, 'entity' AS entity_type,
    CAST(l_partkey AS VARCHAR) AS entity_id FROM lineitem
  UNION ALL SELECT 'publication', CAST(doc_id AS VARCHAR), 'target', 'Brand#' || (doc_id % 25 + 1) FROM documents
  UNION ALL SELECT DISTINCT 'source_record', CAST(l_suppkey AS VARCHAR), 'entity', CAST(l_partkey AS VARCHAR)
    FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A'),
hits AS (SELECT event_id, subject_type AS entity_type, subject_id AS entity_id FROM ev
    WHERE subject_type IN ('entity', 'target')
  UNION SELECT event_id, entity_type, entity_id FROM ev JOIN links USING (subject_type, subject_id)),
x AS (SELECT event_id, CASE WHEN entity_type = 'entity' THEN entity_id END AS entity_id, p_name AS entity_name,
    CASE WHEN entity_type = 'target' THEN entity_id ELSE p_brand END AS target
  FROM hits LEFT JOIN part ON entity_type = 'entity' AND CAST(p_partkey AS VARCHAR) = entity_id)
SELECT event_id, subject_type, subject_id,
  coalesce(string_agg(DISTINCT entity_id, ',' ORDER BY entity_id), '') AS entity_ids,
  coalesce(string_agg(DISTINCT entity_name, ',' ORDER BY entity_name), '') AS entity_names,
  coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS targets
FROM ev LEFT JOIN x USING (event_id) GROUP BY ALL"""


@query(POLYMORPHIC_SQL)
def polymorphic_resolution(spark, sf):
    types = F.create_map(*[F.lit(v) for pair in SUBJECT_TYPES.items() for v in pair])
    events = t(spark, sf, "events").select(
        "event_id", types[F.col("event_type")].alias("subject_type"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")))
        .otherwise(F.col("user_id").cast("string")).alias("subject_id"),
    )
    lines = t(spark, sf, "lineitem")

    def bridge(df, subject_type, subject, entity_type, entity):
        return df.select(F.lit(subject_type).alias("subject_type"), subject.cast("string").alias("subject_id"),
                         F.lit(entity_type).alias("entity_type"), entity.cast("string").alias("entity_id"))

    links = rel.union_all([
        bridge(lines, "trial", F.col("l_orderkey"), "entity", F.col("l_partkey")).distinct(),
        bridge(t(spark, sf, "documents"), "publication", F.col("doc_id"), "target",
               F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string"))),
        bridge(lines.filter("l_quantity = 50 AND l_returnflag = 'A'"), "source_record", F.col("l_suppkey"), "entity",
               F.col("l_partkey")).distinct(),
    ])
    catalogue = t(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("entity_name"),
        F.col("p_brand").alias("target"))
    return rel.resolve_subjects(events, links, catalogue)


@query("""
SELECT event_id, event_type, user_id, value, epoch_us(ts) AS detected_us FROM events
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00'
  AND event_type IN ('purchase', 'error', 'signup')""")
def trailing_window_changes(spark, sf):
    recent = rel.trailing_window(t(spark, sf, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7)
    return rel.conjunctive_filter(recent, event_type=["purchase", "error", "signup"]).select(
        "event_id", "event_type", "user_id", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("detected_us"),
    ).orderBy(F.desc("detected_us"), F.desc("event_id"))


@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') IN ('7', '42')""")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k")
    return t(spark, sf, "events").filter(k.isin("7", "42")).select(
        "event_id", "event_type", k.cast("bigint").alias("k"))


@query("""
SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS documents,
  CAST(sum(n_chars) AS BIGINT) AS chars, round(CAST(sum(n_chars) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS mean_chars
FROM documents GROUP BY ROLLUP(lang, source)""")
def category_rollup(spark, sf):
    return t(spark, sf, "documents").rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"),
        F.round(F.sum("n_chars").cast("double") / F.count(F.lit(1)).cast("double"), 4).alias("mean_chars"),
    ).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"),
             "documents", "chars", "mean_chars")


@query("""
SELECT o_orderkey AS left_key, coalesce(lead(o_orderkey) OVER (ORDER BY o_orderkey),
  (SELECT min(o_orderkey) FROM orders)) AS right_key FROM orders""")
def pair_generator_wrap(spark, sf):
    return pair_with_next(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""
WITH f AS (SELECT unnest([{'field': 'p_name', 'v': p_name}, {'field': 'p_brand', 'v': nullif(p_brand, 'Brand#7')},
   {'field': 'p_type', 'v': CASE WHEN p_type = 'PROMO' THEN ' ' ELSE p_type END},
   {'field': 'p_size', 'v': CAST(p_size AS VARCHAR)}]) AS x FROM part)
SELECT x.field AS field, count(*) FILTER (WHERE trim(coalesce(x.v, '')) <> '') AS present,
  count(*) FILTER (WHERE trim(coalesce(x.v, '')) = '') AS missing,
  round(CAST(count(*) FILTER (WHERE trim(coalesce(x.v, '')) <> '') AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS coverage
FROM f GROUP BY 1""")
def catalog_field_coverage(spark, sf):
    part = t(spark, sf, "part").select(
        "p_name", F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"),
        F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col("p_type")).alias("p_type"), "p_size")
    return rel.field_coverage(part, part.columns)


@query("""
SELECT CASE WHEN p_size <= 25 THEN 'core' ELSE 'extended' END AS scope, p_type AS status, count(*) AS n
FROM part GROUP BY 1, 2""")
def scope_crosstab(spark, sf):
    scope = F.when(F.col("p_size") <= 25, "core").otherwise("extended")
    return t(spark, sf, "part").groupBy(scope.alias("scope"), F.col("p_type").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey,
    l_linenumber, l_shipdate) AS position FROM lineitem) WHERE position <= 3""")
def representative_per_entity(spark, sf):
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"),
             F.col("l_shipdate")]
    return rel.first_per_group(t(spark, sf, "lineitem"), ["l_partkey"], order, 3).select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "position")


@query("""
SELECT lang, doc_id, CAST(position AS INTEGER) AS position FROM (SELECT lang, doc_id, row_number() OVER (
  PARTITION BY lang ORDER BY sha256('{"pilot":"v1","question_id":"' || doc_id || '"}'), doc_id) AS position
  FROM documents) WHERE position <= 5""")
def pilot_sample(spark, sf):
    rank = F.sha2(F.concat(F.lit('{"pilot":"v1","question_id":"'), F.col("doc_id").cast("string"), F.lit('"}')), 256)
    return rel.first_per_group(t(spark, sf, "documents").select("lang", "doc_id"), ["lang"],
                               [rank, F.col("doc_id")], 5)
