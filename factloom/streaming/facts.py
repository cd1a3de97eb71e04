"""Observations and source events as streams.

Refreshes run in batches; these jobs do the same on a stream of files. Streams read with ``Trigger.AvailableNow`` behave like
one batch over everything that has arrived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom import schemas

CHANGE_SCHEMA = ("subject_type string, subject_id string, predicate string, source string, source_record_id string, seq bigint, "
                 "observed_at string, old_values array<string>, new_values array<string>")
RECORD = ["subject_type", "subject_id", "predicate", "source", "source_record_id"]


def read_observations(spark: SparkSession, location: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.OBSERVATION).option("maxFilesPerTrigger", files_per_batch).json(location)


def append_batches(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append observations to a table.

    Each micro-batch goes to its own folder and replaces it when it is run again, so a restart writes nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{schemas.OBSERVATION}, batch int").parquet(target).drop("batch")


def value_changes(stream: DataFrame) -> DataFrame:
    """Value changes of each source record as they arrive.

    State is the last value set and ``seq`` of one source record, so even a subject with many sources is spread over
    tasks. Observations older than the state are ignored. The first observation of a record is no change.
    """
    slim = stream.select(*RECORD, "seq", "observed_at", F.transform("values", lambda v: v["value_json"]).alias("new_values"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (list(state.get[0]), state.get[1]) if state.exists else (None, -1)
        rows = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if row.seq <= last:
                continue
            values = sorted(set(row.new_values))
            if known and values != known:
                rows.append((*key, row.seq, row.observed_at, known, values))
            known, last = values, row.seq
        state.update((known or [], int(last)))
        yield pd.DataFrame(rows, columns=[*RECORD, "seq", "observed_at", "old_values", "new_values"])

    return slim.groupBy(*RECORD).applyInPandasWithState(
        update, CHANGE_SCHEMA, "known array<string>, last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", lateness: str | None = "1 hour", window: str = "1 day", slide: str | None = None,
                    group: str = "event_type") -> DataFrame:
    """Event counts and value sums per time window and type; rows later than ``lateness`` drop out.

    Pass ``lateness=None`` when the stream has its watermark already, as after :func:`unique_events`.
    """
    if lateness is not None:
        events = events.withWatermark(time, lateness)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return events.groupBy(span.alias("w"), group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n", "total")


def unique_events(events: DataFrame, key: str = "event_id", time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Drop events whose id was seen within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
