"""Running sums and previous/next rows along an ordered sequence, safe for hot keys.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts all rows of one key into one task. Here ``seq`` must be a unique
integer, so the block ``floor(seq / block)`` holds at most ``block`` rows of any key. Windows run inside
``(key, block)``; one summary row per ``(key, block)`` carries the state from block to block. Rows are shuffled once, on
``(key, block)``; the summaries that carry nothing are dropped, so for short histories the join side is almost empty and
is broadcast at run time. Key columns must not be NULL.

Where no key has many rows, cutting them by ``seq`` only makes a summary row of almost every row. ``block=None`` says that every key fits a task:
one window for each key, no summaries and no join. Frames that are dealt by some of the keys already are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 18
_BLK = "__blk"


def with_block(df: DataFrame, seq: str, block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Add the block column, unless a scan over the same keys left it in place."""
    if block is None:
        return df
    if block < 1:
        raise ValueError("block must be positive")
    if _BLK in df.columns:
        return df
    return df.withColumn(_BLK, F.floor(F.col(seq) / F.lit(block)).cast("bigint"))


def _spanning(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the keys that reach over more than one block; only these hand a state on."""
    if not keys:
        return df
    spans = df.groupBy(*keys).agg(F.min(_BLK).alias("__lo"), F.max(_BLK).alias("__hi")).filter("__lo < __hi").select(*keys)
    return df.join(spans, list(keys), "left_semi")


def _finish(df: DataFrame, keep_block: bool, *extra: str) -> DataFrame:
    return df.drop(*extra) if keep_block else df.drop(_BLK, *extra)


def running_sum(df: DataFrame, keys: Sequence[str], seq: str, sums: dict[str, str | Column],
                block: int | None = DEFAULT_BLOCK, keep_block: bool = False) -> DataFrame:
    """Add ``out = sum(value)`` over the rows of the key up to and including this row."""
    df = with_block(df, seq, block)
    for out, value in sums.items():
        df = df.withColumn(f"__v_{out}", (F.col(value) if isinstance(value, str) else value).cast("bigint"))
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.sum(f"__v_{out}").over(whole) for out in sums}).drop(*[f"__v_{out}" for out in sums])
    on = [*keys, _BLK]
    totals = df.groupBy(*on).agg(*[F.sum(f"__v_{out}").alias(f"__t_{out}") for out in sums])
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*on, *[F.sum(f"__t_{out}").over(before).alias(f"__c_{out}") for out in sums]).filter(
        " OR ".join(f"__c_{out} <> 0" for out in sums))
    inside = Window.partitionBy(*on).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for out in sums:
        df = df.withColumn(out, F.sum(f"__v_{out}").over(inside))
    df = df.join(carry, on, "left")
    for out in sums:
        df = df.withColumn(out, F.col(out) + F.coalesce(F.col(f"__c_{out}"), F.lit(0)))
    return _finish(df, keep_block, *[f"__v_{out}" for out in sums], *[f"__c_{out}" for out in sums])


def running_last(df: DataFrame, keys: Sequence[str], seq: str, values: dict[str, Column],
                 block: int | None = DEFAULT_BLOCK, keep_block: bool = False) -> DataFrame:
    """Add ``out`` = the last non-NULL value of the key up to and including this row."""
    df = with_block(df, seq, block)
    for out, value in values.items():
        df = df.withColumn(f"__v_{out}", value)
    if block is None:
        whole = Window.partitionBy(*keys, F.col(seq).isNull()).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.last(f"__v_{out}", ignorenulls=True).over(whole) for out in values}).drop(*[f"__v_{out}" for out in values])
    on = [*keys, _BLK]
    ends = _spanning(df, keys).groupBy(*on).agg(*[F.max_by(f"__v_{out}", F.when(F.col(f"__v_{out}").isNotNull(), F.col(seq)))
                                 .alias(f"__t_{out}") for out in values])
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*on, *[F.last(f"__t_{out}", ignorenulls=True).over(before).alias(f"__c_{out}") for out in values])
    carry = carry.filter(" OR ".join(f"__c_{out} IS NOT NULL" for out in values))
    inside = Window.partitionBy(*on).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for out in values:
        df = df.withColumn(out, F.last(f"__v_{out}", ignorenulls=True).over(inside))
    df = df.join(carry, on, "left")
    for out in values:
        df = df.withColumn(out, F.coalesce(out, f"__c_{out}"))
    return _finish(df, keep_block, *[f"__v_{out}" for out in values], *[f"__c_{out}" for out in values])


def neighbour(df: DataFrame, keys: Sequence[str], seq: str, columns: dict[str, str], *, direction: str = "previous",
              block: int | None = DEFAULT_BLOCK, keep_block: bool = False) -> DataFrame:
    """Add the named columns of the previous (or next) row of the same key as ``{out: source column}``."""
    if direction not in {"previous", "next"}:
        raise ValueError(f"unknown direction: {direction}")
    back = direction == "previous"
    df = with_block(df, seq, block)
    if block is None:
        whole = Window.partitionBy(*keys, F.col(seq).isNull()).orderBy(seq)
        return df.withColumns({out: (F.lag if back else F.lead)(src).over(whole) for out, src in columns.items()})
    on = [*keys, _BLK]
    payload = F.struct(F.col(seq).alias("__s"), *[F.col(src).alias(out) for out, src in columns.items()])
    edges = _spanning(df, keys).groupBy(*on).agg((F.max_by if back else F.min_by)(payload, F.col(seq)).alias("__edge"))
    along = Window.partitionBy(*keys).orderBy(_BLK)
    carry = edges.select(*on, (F.lag if back else F.lead)("__edge").over(along).alias("__carry")).filter("__carry IS NOT NULL")
    inside = Window.partitionBy(*on).orderBy(seq)
    df = df.withColumn("__near", (F.lag if back else F.lead)(payload).over(inside))
    df = df.join(carry, on, "left").withColumn("__near", F.coalesce("__near", "__carry"))
    for out in columns:
        df = df.withColumn(out, F.col(f"__near.{out}"))
    return _finish(df, keep_block, "__near", "__carry")


def pair_with_next(df: DataFrame, key: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pair every row with the one after it in ``key`` order; the last row pairs with the first (``i -> i+1 mod n``)."""
    nexts = neighbour(df.select(key), [], key, {"__next": key}, direction="next", block=block)
    first = df.agg(F.min(key).alias("__first"))
    return nexts.withColumn("right_key", F.coalesce("__next", first.select("__first").scalar())).select(
        F.col(key).alias("left_key"), "right_key"
    )
