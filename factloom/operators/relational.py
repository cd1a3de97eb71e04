"""Catalogue search, coverage counts, link joins and field comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.urls import is_generic_url


def contains_ignoring_case(column: Column, query: str) -> Column:
    """Substring test; the characters % and _ in the query stand for themselves."""
    return F.contains(F.lower(column), F.lit(query.strip().lower()))


def search_catalogue(catalogue: DataFrame, aliases: DataFrame, query: str, *, key: str,
                     search_columns: Sequence[str], alias: str = "alias") -> DataFrame:
    """Rows whose search columns or any alias contain the query, with the aliases joined by `` | ``.

    A blank query returns every row.
    """
    per_key = aliases.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(alias)), " | ").alias("aliases"),
        F.bool_or(contains_ignoring_case(F.col(alias), query)).alias("__alias_hit"),
    )
    own = reduce(
        lambda a, b: a | b,
        [F.coalesce(contains_ignoring_case(F.col(c), query), F.lit(False)) for c in search_columns],
    )
    hit = F.lit(not query.strip()) | own | F.coalesce(F.col("__alias_hit"), F.lit(False))
    return (
        catalogue.join(per_key, key, "left").filter(hit)
        .withColumn("aliases", F.coalesce("aliases", F.lit(""))).drop("__alias_hit")
    )


def conjunctive_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; a ``None`` argument sets no condition, a list means membership."""
    for column, value in wanted.items():
        if value is None:
            continue
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set))
                       else F.col(column) == F.lit(value))
    return df


def long_metrics(row: DataFrame, group: str | None = None) -> DataFrame:
    """Turn a one-row aggregate into ``(metric, value)`` rows."""
    names = [c for c in row.columns if c != group]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                for n in names]))
    return row.select(pairs.alias("p")).select("p.metric", "p.value")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded quotient, 0.0 for an empty denominator."""
    return F.when(
        denominator > 0, F.round(numerator.cast("double") / denominator.cast("double"), digits)
    ).otherwise(F.lit(0.0))


def labelled_counts(df: DataFrame, column: str, label: str = "UNKNOWN") -> DataFrame:
    """Counts per value; NULL is labelled before grouping, so it merges with rows that already carry the label."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(label)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, duplicated groups, surplus rows and the largest group (1 when nothing repeats)."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
        F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("largest_group"),
    )


def provenance(evidence: DataFrame) -> DataFrame:
    """Facts per predicate: with evidence, with URL, distinct URLs, sources, missing and generic URLs.

    ``evidence(predicate, fact_id, source, url, has_evidence)``. Facts and URLs are reduced to one row each first, so no row
    is expanded per distinct count and URLs are parsed once.
    """
    per_fact = evidence.groupBy("predicate", "fact_id").agg(
        F.bool_or("has_evidence").alias("e"), F.bool_or(F.col("url") != "").alias("u"))
    facts = per_fact.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("e").alias("facts_with_evidence"), F.count_if("u").alias("facts_with_url"))
    per_url = evidence.groupBy("predicate", "url").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("s"))
    generic = is_generic_url(F.col("url"))
    links = per_url.groupBy("predicate").agg(
        F.count_if(F.col("url") != "").alias("distinct_urls"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))), ",").alias("sources"),
        F.coalesce(F.sum(F.when(F.col("url") == "", F.col("n"))), F.lit(0)).alias("missing_urls"),
        F.coalesce(F.sum(F.when(generic, F.col("n"))), F.lit(0)).alias("generic_urls"))
    return facts.join(links, "predicate")


def orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent (NULL keys count as orphans)."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_keys)])
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(child_keys)])
    return child.join(keys, condition, "left_anti")


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Compare two versions of a keyed table: rows only on one side, and one row per differing field."""
    lhs = left.select(key, F.lit(True).alias("__in_l"), *[F.col(f).cast("string").alias(f"__l_{f}") for f in fields])
    rhs = right.select(key, F.lit(True).alias("__in_r"), *[F.col(f).cast("string").alias(f"__r_{f}") for f in fields])
    joined = lhs.join(rhs, key, "full_outer")
    only = F.when(F.col("__in_r").isNull(), "left_only").when(F.col("__in_l").isNull(), "right_only")
    one_sided = F.array(F.struct(
        F.lit("*").alias("field"), F.lit(None).cast("string").alias("left_value"),
        F.lit(None).cast("string").alias("right_value"), only.alias("kind"),
    ))
    changed = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__l_{f}").alias("left_value"),
                           F.col(f"__r_{f}").alias("right_value"), F.lit("changed").alias("kind")) for f in fields]),
        lambda d: ~d["left_value"].eqNullSafe(d["right_value"]),
    )
    return joined.select(key, F.explode(F.when(only.isNotNull(), one_sided).otherwise(changed)).alias("d")).select(
        key, "d.field", "d.left_value", "d.right_value", "d.kind"
    )


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-blank count per required field, as rows, from one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").alias(f) for f in fields],
    )
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields]))
    return counts.select("__n", items.alias("i")).select(
        "i.field", "i.present", (F.col("__n") - F.col("i.present")).alias("missing"),
        ratio(F.col("i.present"), F.col("__n")).alias("coverage"),
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of every group, numbered from 1.

    The filter on ``row_number`` becomes a group limit that runs before the shuffle, so a hot group moves at most
    ``limit`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """Last-write-wins rows by ``max_by``; combines on the map side, so a hot key does not gather its rows."""
    keyed = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(v) if isinstance(v, str) else v for v in version])
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*keyed), order).alias("__last"))
    return latest.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in keyed])


def resolve_subjects(events: DataFrame, links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Entities and targets behind polymorphic event subjects.

    ``events(event_id, subject_type, subject_id)``; ``links(subject_type, subject_id, entity_type, entity_id)`` bridges
    trial, publication and source-record subjects; ``catalogue(entity_id, entity_name, target)``. Subjects of type
    ``entity`` and ``target`` stand for themselves. Returns sorted, comma-joined id, name and target lists per event.
    """
    # Lists are built once per subject and then joined to its events, so a busy subject is not multiplied by its links.
    subject = ["subject_type", "subject_id"]
    subjects = events.select(*subject).distinct()
    linked = links.join(subjects, subject, "left_semi").select(*subject, "entity_type", "entity_id")
    direct = subjects.filter(F.col("subject_type").isin("entity", "target")).select(
        *subject, F.col("subject_type").alias("entity_type"), F.col("subject_id").alias("entity_id"))
    hits = direct.unionByName(linked).distinct()
    named = hits.filter(F.col("entity_type") == "entity").join(catalogue, "entity_id", "left").select(
        *subject, "entity_id", "entity_name", "target")
    none = F.lit(None).cast("string")
    plain = hits.filter(F.col("entity_type") == "target").select(
        *subject, none.alias("entity_id"), none.alias("entity_name"), F.col("entity_id").alias("target"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per_subject = named.unionByName(plain).groupBy(*subject).agg(
        joined("entity_id").alias("entity_ids"), joined("entity_name").alias("entity_names"), joined("target").alias("targets"))
    return events.join(per_subject, subject, "left").select(
        *events.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ("entity_ids", "entity_names", "targets")])


def trailing_window(events: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Events of the last 1, 7 or 30 days; both ends belong to the window, unparsable times drop out."""
    if days not in {1, 7, 30}:
        raise ValueError("days must be one of 1, 7 or 30")
    return events.filter(F.col(time).between(now - F.expr(f"INTERVAL {days} DAYS"), now))
