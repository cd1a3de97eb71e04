"""Source run log: missing records, failures, count drops, stale runs and publication gates.

``runs(run_id, source, started_at, finished_at, status, attempts, expected_count, collected_count, is_complete, error_text,
planned_truncation)`` has one row per run and source, ``members(run_id, source, source_record_id)`` the records each run saw.
The run log is small next to its members: it grows with runs times sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators.relational import latest_per_key


def previous_runs(runs: DataFrame, *, need_complete_flag: bool) -> DataFrame:
    """Add the latest earlier complete run of the same source.

    Missing-record detection needs a previous run that is ``is_complete`` as well; the count baseline does not.
    """
    usable = F.col("status") == "complete"
    if need_complete_flag:
        usable = usable & F.col("is_complete")
    window = Window.partitionBy("source").orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(usable, F.struct("run_id", "collected_count")), ignorenulls=True).over(window)
    return runs.withColumn("__p", last).select(
        *runs.columns, F.col("__p.run_id").alias("previous_run_id"), F.col("__p.collected_count").alias("previous_count"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per source by finish time, else start time."""
    return latest_per_key(runs, ["source"], [F.coalesce("finished_at", "started_at"), "run_id"])


def missing_records(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Records of the previous complete run that a complete run no longer has; other runs report nothing."""
    complete = (F.col("status") == "complete") & F.col("is_complete")
    pairs = previous_runs(runs, need_complete_flag=True).filter(complete & F.col("previous_run_id").isNotNull()).select(
        "run_id", "source", "previous_run_id", "finished_at")
    before = members.withColumnRenamed("run_id", "previous_run_id").join(pairs, ["previous_run_id", "source"])
    return before.join(members, ["run_id", "source", "source_record_id"], "left_anti").select(
        "run_id", "previous_run_id", "source", "source_record_id", "finished_at")


def source_events(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Events of the run log: ``source.record_missing`` and ``source.collection_failed``."""
    missing = missing_records(runs, members).select(
        F.lit("source.record_missing").alias("event_type"), F.lit("source_record").alias("subject_type"),
        F.concat_ws(":", "source", "source_record_id").alias("subject_id"), "source", "source_record_id",
        F.col("finished_at").alias("detected_at"), F.lit('{"present":true}').alias("old_value_json"),
        F.lit('{"present":false}').alias("new_value_json"),
        F.concat(F.lit('{"previous_run_id":'), ids.json_string(F.col("previous_run_id")), F.lit(',"run_id":'),
                 ids.json_string(F.col("run_id")), F.lit("}")).alias("details_json"), "run_id")
    failed = runs.filter(F.col("status").isin("partial", "failed")).select(
        F.lit("source.collection_failed").alias("event_type"), F.lit("source").alias("subject_type"),
        F.col("source").alias("subject_id"), "source", F.lit(None).cast("string").alias("source_record_id"),
        F.col("finished_at").alias("detected_at"), F.lit("{}").alias("old_value_json"),
        F.concat(F.lit('{"status":'), ids.json_string(F.col("status")), F.lit("}")).alias("new_value_json"),
        F.concat(F.lit('{"error":'), ids.json_string(F.coalesce("error_text", F.lit(""))), F.lit(',"run_id":'),
                 ids.json_string(F.col("run_id")), F.lit("}")).alias("details_json"), "run_id")
    events = missing.unionByName(failed)
    return events.withColumn("event_id", ids.prefixed_id(
        "chg_", 32, "event_type", "subject_type", "subject_id", "source", "source_record_id", "detected_at", "old_value_json",
        "new_value_json", "details_json"))


def count_drops(runs: DataFrame, max_drop: float = 0.25) -> DataFrame:
    """Collected count against the previous complete run; no baseline or a zero baseline passes."""
    if not 0 <= max_drop < 1:
        raise ValueError("max_drop must be in [0, 1)")
    r = previous_runs(runs, need_complete_flag=False).filter("status = 'complete'")
    quotient = F.try_divide(F.col("collected_count").cast("double"), F.col("previous_count").cast("double"))
    return r.select(
        "run_id", "source", "collected_count", F.coalesce("previous_count", F.lit(0)).alias("baseline"),
        F.coalesce(F.round(quotient, 4), F.lit(1.0)).alias("ratio"),
        F.coalesce(quotient >= F.lit(1.0 - max_drop), F.lit(True)).alias("passed"))


def stale_runs(runs: DataFrame, now: Column, max_age: str) -> DataFrame:
    """Mark running runs that started at or before ``now - max_age`` as failed."""
    late = (F.col("status") == "running") & (F.col("started_at") <= now - F.expr(f"INTERVAL {max_age}"))
    return runs.select(
        *[c for c in runs.columns if c not in {"status", "finished_at", "error_text"}],
        F.when(late, now).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(late, "failed").otherwise(F.col("status")).alias("status"),
        F.when(late, "recovered stale run").otherwise(F.col("error_text")).alias("error_text"))


def restart_source_run(runs: DataFrame, members: DataFrame, run_id: str, source: str, started_at: Column) -> tuple[DataFrame, DataFrame]:
    """Reset one source of a run: counters back to zero, its membership rows removed."""
    here = (F.col("run_id") == run_id) & (F.col("source") == source)
    reset = {"started_at": started_at, "finished_at": F.lit(None), "status": F.lit("running"), "attempts": F.lit(0),
             "expected_count": F.lit(None), "collected_count": F.lit(0), "is_complete": F.lit(False), "error_text": F.lit(None)}
    fresh = runs.select(*[F.when(here, reset[c].cast(runs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in reset
                          else F.col(c) for c in runs.columns])
    return fresh, members.filter(~here)


def run_status_report(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id).orderBy("source")


def source_coverage(runs: DataFrame) -> DataFrame:
    """Coverage state and ratio per run; a missing denominator gives NULL and a reason, never zero."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    whole = F.coalesce(F.col("is_complete"), F.lit(False))
    expected, collected = F.col("expected_count"), F.col("collected_count")
    state = (F.when(status.isin("unknown", "skipped", "failed"), "unknown")
             .when((status == "complete") & whole & expected.isNotNull(),
                   F.when(collected.isNull() | (collected >= expected), "complete").otherwise("partial"))
             .when((status == "partial") | ~whole, "partial").otherwise("unknown"))
    no_ratio = (F.when(expected.isNull() | (expected <= 0), "expected_count_missing_or_nonpositive")
                .when(collected.isNull(), "collected_count_missing"))
    ratio = F.when(no_ratio.isNull(), F.round(F.try_divide(collected.cast("double"), expected.cast("double")), 6))
    return runs.select("run_id", "source", state.alias("coverage_state"), ratio.alias("coverage_ratio"),
                       no_ratio.alias("coverage_ratio_reason"))


def refresh_gates(runs: DataFrame, members: DataFrame, run_id: str, required_sources: Sequence[str], *,
                  max_drop: float = 0.25, max_missing: int = 0, integrity: Sequence[tuple[str, DataFrame]] = ()) -> DataFrame:
    """Checks of one run as rows ``(name, passed, blocking)``.

    ``integrity`` names frames that must be empty, such as duplicate keys or orphans.
    """
    if max_missing < 0:
        raise ValueError("max_missing cannot be negative")
    spark = runs.sparkSession
    wanted = spark.createDataFrame([(s,) for s in required_sources], "source string")
    current = wanted.join(runs.filter(F.col("run_id") == run_id), "source", "left")
    complete = F.coalesce(F.col("status") == "complete", F.lit(False))
    gate = lambda name, passed, blocking=F.lit(True): (F.struct(
        name.alias("name"), passed.alias("passed"), blocking.alias("blocking")))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("source"))
    status = current.select(gate(named("source_status:"), complete).alias("g"))
    run_ok = runs.filter(F.col("run_id") == run_id).agg(
        F.coalesce(F.bool_and(F.col("status").isin("complete", "skipped")), F.lit(False)).alias("ok"))
    overall = run_ok.select(gate(F.lit("ingestion_run_status"), F.col("ok")).alias("g"))
    drops = count_drops(runs, max_drop).filter(F.col("run_id") == run_id).join(wanted, "source", "left_semi")
    counts = drops.select(gate(named("count_anomaly:"), F.col("passed")).alias("g"))
    planned = F.coalesce(F.col("planned_truncation"), F.lit(False))
    scope = current.filter(complete & ~F.col("is_complete")).select(
        gate(named("missing_detection_scope:"), planned, ~planned).alias("g"))
    gone = missing_records(runs, members).filter(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("n"))
    missing = gone.select(gate(F.lit("missing_records"), F.col("n") <= max_missing).alias("g"))
    rows = overall.unionByName(status).unionByName(counts).unionByName(scope).unionByName(missing)
    for name, bad in integrity:
        rows = rows.unionByName(bad.limit(1).agg(F.count(F.lit(1)).alias("n")).select(
            gate(F.lit(name), F.col("n") == 0).alias("g")))
    return rows.select("g.*")


def gates_passed(gates: DataFrame) -> DataFrame:
    return gates.agg(F.bool_and(F.col("passed") | ~F.col("blocking")).alias("passed"))


def collection_scope(summaries: DataFrame, summary_json: str, stored: DataFrame, path: str = "$.total_available") -> DataFrame:
    """Largest total any run reported, and the stored share of it; NULL when no run reported one."""
    total = summaries.agg(F.max(F.get_json_object(summary_json, path).try_cast("bigint")).alias("total"))
    count = stored.agg(F.count(F.lit(1)).alias("stored"))
    return count.select("stored", total.scalar().alias("total")).select(
        "*", F.round(F.try_divide(F.col("stored").cast("double"), F.col("total").cast("double")), 6).alias("share"))
