"""An audit of whole tables from declared rules: few scans whatever the number of rules, one shuffle for all key rules.

Row rules are conditions of a single row. All rules of a table are counted in one aggregate without grouping, so tasks hand on one row of
counters, and a second scan of the columns in the rules lists the offenders. Key rules say that a key occurs once, or that it occurs in
another table. Their keys stand in one long table ``(rule, key, own, other)`` that is counted on the map side and grouped once.

Every faulty rule comes with its smallest offenders, at most ``samples`` of them; they are cut where the rows lie before they are ranked.

Cases: a condition that is NULL counts as met; a key with a NULL column is no key, neither twice nor missing; a table without rows gives
counts of zero and passes; equal offenders are listed once, those without a key are counted only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """Rows of ``table`` for which ``fault`` (a SQL condition) holds are faulty; ``key`` (a SQL expression) names them."""
    name: str
    table: str
    fault: str
    key: str
    severity: str = "error"


@dataclass(frozen=True)
class KeyRule:
    """``columns`` of ``table`` occur once, or in ``other_columns`` of ``other`` if that is given."""
    name: str
    table: str
    columns: tuple[str, ...]
    other: str | None = None
    other_columns: tuple[str, ...] = ()
    severity: str = "error"


def _row_counts(table: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """(rule, checked, faults) of all row rules of one table from one aggregate."""
    counted = table.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.expr(r.fault)).alias(f"__{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("__n").alias("checked"), F.col(f"__{i}").alias("faults")) for i, r in enumerate(rules)])
    return counted.select(F.inline(rows))


def _row_offenders(table: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.expr(r.fault), F.struct(F.lit(r.name).alias("rule"), F.expr(r.key).cast("string").alias("offender"))) for r in rules]))
    return table.select(F.inline(found))


def _keys(tables: Mapping[str, DataFrame], rule: KeyRule) -> DataFrame:
    """(rule, key, own, other) of one rule; the key is JSON text, so that parts of several columns can't run together."""
    def side(name: str, columns: Sequence[str], own: int) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        key = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        return tables[name].where(known).select(F.lit(rule.name).alias("rule"), key.alias("key"), F.lit(own).alias("own"), F.lit(1 - own).alias("other"))

    mine = side(rule.table, rule.columns, 1)
    return mine.unionAll(side(rule.other, rule.other_columns, 0)) if rule.other else mine


def _ranked(offenders: DataFrame, samples: int) -> DataFrame:
    """(rule, offenders): the smallest of each rule; the limit of a rule is applied before the shuffle as well."""
    rank = F.rank().over(Window.partitionBy("rule").orderBy("offender"))
    few = offenders.where("offender IS NOT NULL").distinct().withColumn("place", rank).where(F.col("place") <= samples)
    return few.groupBy("rule").agg(F.array_sort(F.collect_list("offender")).alias("offenders"))


def audit(tables: Mapping[str, DataFrame], rules: Sequence[RowRule | KeyRule], samples: int = 5) -> DataFrame:
    """(rule, table_name, severity, checked, faults, share, status, offenders), one row for each rule.

    ``checked`` counts rows for row rules and distinct keys for key rules; ``status`` is ``pass``, or the severity if there are faults.
    """
    names = [r.name for r in rules]
    if len(names) != len(set(names)) or not names:
        raise ValueError("rules need names of their own")
    counts, offenders = [], []
    for name in dict.fromkeys(r.table for r in rules if isinstance(r, RowRule)):
        own = [r for r in rules if isinstance(r, RowRule) and r.table == name]
        counts.append(_row_counts(tables[name], own))
        offenders.append(_row_offenders(tables[name], own))
    keyed = [r for r in rules if isinstance(r, KeyRule)]
    if keyed:
        refers: Column = F.col("rule").isin(*[r.name for r in keyed if r.other])
        met = reduce(DataFrame.unionAll, [_keys(tables, r) for r in keyed]).groupBy("rule", "key").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
        wrong = F.when(refers, F.col("other") == 0).otherwise(F.col("own") > 1)
        met = met.where("own > 0").select("rule", "key", wrong.alias("wrong"))
        counts.append(met.groupBy("rule").agg(F.count(F.lit(1)).alias("checked"), F.count_if("wrong").alias("faults")))
        offenders.append(met.where("wrong").select("rule", F.col("key").alias("offender")))
    listed = tables[rules[0].table].sparkSession.createDataFrame([(r.name, r.table, r.severity) for r in rules], "rule string, table_name string, severity string")
    joined = listed.join(reduce(DataFrame.unionAll, counts), "rule", "left").join(_ranked(reduce(DataFrame.unionAll, offenders), samples), "rule", "left")
    checked, faults = F.coalesce("checked", F.lit(0)), F.coalesce("faults", F.lit(0))
    share = F.when(checked > 0, F.round(faults / checked, 6)).otherwise(0.0)
    return joined.select("rule", "table_name", "severity", checked.alias("checked"), faults.alias("faults"), share.alias("share"),
                         F.when(faults > 0, F.col("severity")).otherwise("pass").alias("status"), F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders"))
