"""A batch of new observations on top of a stored fact store, without its history.

The open state of a field is what a new observation can change: its current evidence by source record and its open facts. The fold of
:mod:`factloom.operators.facts` starts from those rows instead of from all old observations, so the work is bounded by the fields that the
batch names. Old store + batch is the store of all observations together; a test holds the two against each other.

A stored state is partitioned by open/closed and by a hash of the field, so a batch reads the open rows of its own partitions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.operators import facts as f
from factloom.operators import scan
from factloom.operators.sizes import broadcast_if_small
from factloom.operators.stages import written
from factloom.policy import Policy

BUCKETS = 64


@dataclass(frozen=True)
class Applied:
    """What a batch has made of the fields it names: rows to be merged by :func:`merged`, the new events and the counters."""

    facts: DataFrame
    evidence: DataFrame
    events: DataFrame
    counters: DataFrame


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*f.KEY), F.lit(buckets)).cast("int")


def write_state(facts: DataFrame, evidence: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store both tables so that a batch finds the open rows of its fields."""
    for name, rows, is_open in (("facts", facts, F.col("valid_to").isNull()), ("evidence", evidence, F.col("is_current"))):
        dealt = rows.withColumn("open", is_open).withColumn("bucket", _bucket(buckets)).repartition("open", "bucket")
        dealt.write.partitionBy("open", "bucket").parquet(f"{path}/{name}")


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a stored state, whole."""
    return tuple(spark.read.parquet(f"{path}/{name}").drop("open", "bucket") for name in ("facts", "evidence"))


def read_open(spark: SparkSession, path: str, batch: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Open facts and current evidence in the partitions of the batch's fields."""
    touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]  # one number for each bucket at most
    here = F.col("bucket").isin(*touched) if touched else F.lit(False)
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("open") & here).drop("open", "bucket") for name in ("facts", "evidence"))


def _held(facts: DataFrame, evidence: DataFrame, keys: DataFrame) -> DataFrame:
    """Current evidence of the fields with its value and the fact as the fold carries it."""
    fact = F.struct(F.col("opened_seq").alias("seq"), "fact_id", "valid_from", "review_status").alias("stored_fact")
    named = facts.filter("valid_to IS NULL").join(keys, f.KEY, "left_semi").select("fact_id", F.col("normalized_value_json").alias("value_json"), "display_value", fact)
    return evidence.filter("is_current").join(keys, f.KEY, "left_semi").join(named, "fact_id")


def apply_batch(facts: DataFrame, evidence: DataFrame, batch: DataFrame, policy: Policy, block: int = scan.DEFAULT_BLOCK, fold_block: int = f.FOLD_BLOCK) -> Applied:
    """Fold a batch into the open rows of a store.

    ``facts`` and ``evidence`` may hold any rows of the store; only open ones of the batch's fields are used. Every ``seq`` of the batch lies
    after those of the store.
    """
    spark = batch.sparkSession
    fresh = written(f.with_evidence(batch))
    since = fresh.agg(F.min("seq")).first()[0]
    if since is None:
        return Applied(facts.limit(0), evidence.limit(0), f.change_events(f.change_steps(batch, block), policy, block, fold_block), _counters(spark, 0, 0, 0, 0, 0))
    held = written(_held(facts, evidence, broadcast_if_small(fresh.select(*f.KEY).distinct())))
    late = held.agg(F.max("opened_seq")).first()[0]
    if late is not None and late >= since:
        raise ValueError(f"the batch begins at {since}, but the store has evidence of {late}")

    shape = fresh.schema["evidence"].dataType.elementType.names
    item = F.struct(*[F.col("fact_evidence_id").alias("evidence_id") if c == "evidence_id" else F.col(c) for c in shape])
    newest = [c for c in fresh.columns if c not in {*f.RECORD, "seq", "evidence"}]
    starts = held.groupBy(*f.RECORD).agg(F.max("opened_seq").alias("seq"), F.sort_array(F.collect_list(item)).alias("evidence"), *[F.max_by(c, "opened_seq").alias(c) for c in newest])
    given = starts.select(*fresh.columns).unionByName(fresh)
    lengths = f.Lengths.of(given, block)
    seen = f.together(f.with_previous(rows, cut) for rows, cut in lengths.parts(given))

    groups = Observation("groups")
    is_new, changed = F.col("seq") >= since, f.changes_evidence()
    counted = seen.observe(groups, F.count_if(is_new & changed).alias("processed"), F.count_if(is_new & ~changed).alias("idempotent"))
    steps = written(counted.filter(changed))

    rows = f.value_rows(steps.filter(is_new))
    none = held.schema["stored_fact"].dataType
    same = held.groupBy(*f.RECORD, "value_hash").agg(
        F.max("opened_seq").alias("seq"), F.first("value_json").alias("value_json"), F.first("display_value").alias("display_value"), F.first("stored_fact").alias("stored_fact"),
        *[F.max_by(c, "opened_seq").alias(c) for c in newest])
    kept = same.withColumns({"delta": F.lit(1), "opened": F.array().cast(rows.schema["opened"].dataType), "closed": F.array().cast("array<string>")})
    values = rows.withColumn("stored_fact", F.lit(None).cast(none)).unionByName(kept.select(*rows.columns, "stored_fact"))
    parts = [(written(f._with_opener(rows, policy, cut)), stored, cut) for (rows, cut), (stored, _) in zip(lengths.parts(values), lengths.parts(held), strict=True)]
    values = f.together(rows for rows, _, _ in parts)

    proof, store = Observation("evidence"), Observation("facts")
    new = F.col("opened_seq") >= since
    spans = written(f.together(f._evidence(rows, cut, stored) for rows, stored, cut in parts).observe(proof, F.count_if(new).alias("created")))
    found = written(f._facts(values, spans, policy).observe(store, F.count_if(new).alias("created")))
    told = Observation("events")
    events = written(f.Reconciled(found, spans, steps, policy, block, fold_block, since).events.observe(told, F.count(F.lit(1)).alias("created")))
    counters = _counters(spark, groups.get["processed"], groups.get["idempotent"], store.get["created"], proof.get["created"], told.get["created"])
    return Applied(found, spans, events, counters)


def _counters(spark: SparkSession, *numbers: int) -> DataFrame:
    return spark.createDataFrame([numbers], "groups_processed long, idempotent_groups long, facts_created long, evidence_created long, changes_created long")


def merged(facts: DataFrame, evidence: DataFrame, applied: Applied) -> tuple[DataFrame, DataFrame]:
    """The whole store after a batch: rows of the batch's fields that it has folded again are replaced, all others stay."""
    def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))

    return upsert(facts, applied.facts, ["fact_id", "opened_seq"]), upsert(evidence, applied.evidence, [*f.RECORD, "fact_evidence_id", "opened_seq"])
