"""The audit of whole tables from declared rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.profiler import KeyRule, RowRule, audit
from factloom.plans.common import table as t

RULES = (
    RowRule("order_price_high", "orders", "o_totalprice > 300000", "o_orderkey", "warning"),
    RowRule("order_status_open", "orders", "o_orderstatus NOT IN ('F', 'O')", "o_orderkey"),
    RowRule("order_price_missing", "orders", "o_totalprice IS NULL", "o_orderkey"),
    RowRule("customer_in_debt", "customer", "c_acctbal < 0", "c_custkey", "warning"),
    RowRule("document_empty", "documents", "coalesce(length(text), 0) = 0", "doc_id"),
    RowRule("document_short", "documents", "length(text) < 200", "doc_id", "warning"),
    KeyRule("order_once", "orders", ("o_orderkey",)),
    KeyRule("document_text_class_once", "documents", ("source", "lang"), severity="warning"),
    KeyRule("order_customer_known", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    KeyRule("customer_has_orders", "customer", ("c_custkey",), "orders", ("o_custkey",), "warning"),
    KeyRule("document_labelled", "documents", ("doc_id",), "labels", ("doc_id",), "warning"),
)

SQL = """
WITH v AS (
  SELECT 'order_price_high' AS rule, 'orders' AS table_name, 'warning' AS severity, o_totalprice > 300000 AS bad, CAST(o_orderkey AS VARCHAR) AS offender FROM orders
  UNION ALL SELECT 'order_status_open', 'orders', 'error', o_orderstatus NOT IN ('F', 'O'), CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'order_price_missing', 'orders', 'error', o_totalprice IS NULL, CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'customer_in_debt', 'customer', 'warning', c_acctbal < 0, CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'document_empty', 'documents', 'error', coalesce(length(text), 0) = 0, CAST(doc_id AS VARCHAR) FROM documents
  UNION ALL SELECT 'document_short', 'documents', 'warning', length(text) < 200, CAST(doc_id AS VARCHAR) FROM documents
  UNION ALL SELECT 'order_once', 'orders', 'error', count(*) > 1, '["' || o_orderkey || '"]' FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey
  UNION ALL SELECT 'document_text_class_once', 'documents', 'warning', count(*) > 1, '["' || source || '","' || lang || '"]' FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang
  UNION ALL SELECT 'order_customer_known', 'orders', 'error', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k), '["' || k || '"]' FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL)
  UNION ALL SELECT 'customer_has_orders', 'customer', 'warning', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k), '["' || k || '"]' FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IS NOT NULL)
  UNION ALL SELECT 'document_labelled', 'documents', 'warning', NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k), '["' || k || '"]' FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL)),
g AS (SELECT rule, table_name, severity, count(*) AS checked, count(*) FILTER (WHERE bad) AS faults, list_sort(list_distinct(list(offender) FILTER (WHERE bad))) AS found FROM v GROUP BY ALL)
SELECT rule, table_name, severity, checked, faults, round(faults / checked, 6) AS share, CASE WHEN faults > 0 THEN severity ELSE 'pass' END AS status,
  coalesce(array_to_string(found[1:5], ';'), '') AS offenders FROM g"""


def table_audit(spark, sf):
    """Rules of rows and keys over four tables, with the five smallest offenders of each rule."""
    tables = {name: t(spark, sf, name) for name in ("orders", "customer", "documents", "labels")}
    return audit(tables, RULES).withColumn("offenders", F.concat_ws(";", "offenders"))


QUERIES = {"table_audit": table_audit}
ORACLES = {"table_audit": SQL}
