"""Mixing sources by temperature to a target, realised as budgeted permutations cut into blocks.

Source shares of tokens are raised to an exponent and normalised to weights. The exponent is bisected on a grid of ``2 ** STEPS`` values
between 0 (all sources alike) and 1 (shares as they are): the largest exponent at which the entropy of the weights is at least a target,
or the smallest one at which no source is repeated more often than a limit. A pass over the (small) source table evaluates the 31 points
that five halvings can ask for.

Each source gets its weight's part of the token budget. It is read in passes; in each the documents stand in a pseudo-random order of their
own (a hash of seed, pass and document). Whole passes come first, the last is kept up to the document that reaches the budget. The place
in a source's stream, as a part of its budget, names the block, so each block holds all sources in their weights and is put in an order of
its own. Running sums go over hash ranges of two levels, so that no window holds a whole source. Rows without tokens can crowd in one block; a block of
more than ``BLOCK_ROWS`` rows is put in order by ranges of its hash.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.

Cases: a null source is a source of its own; null and empty texts have no tokens and stand in the order like others, with no effect on
budgets; without any tokens every row is kept once; rows that agree in doc_id share a place in the order and are kept or left together;
an empty table gives no rows; other columns pass ``mixed`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.files import free_name
from factloom.operators.stages import written

STEPS = 20
BLOCK_TOKENS = 100_000
BLOCK_ROWS = 1 << 16
NONE = "\x00none"


def _hash(*parts: Column | str) -> Column:
    """A 60-bit number from MD5 of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and tokens of each row."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), words.cast("long").alias("tokens"))


def shares(slim: DataFrame) -> DataFrame:
    """(source, total) of the sources with tokens."""
    return slim.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0")


def exponent(sources: DataFrame, budget: int, total: int, max_repeats: float | None, min_entropy: float | None) -> int:
    """The exponent as a number of grid steps out of ``2 ** STEPS``."""
    grid = 1 << STEPS
    low, high = 0, grid  # the wanted grid value lies in [low, high]
    seek_small = max_repeats is not None
    while low < high:
        points, spans = set(), [(low, high)]
        for _ in range(5):
            spans = [s for a, b in spans if a < b for m in [(a + b + (not seek_small)) // 2] for s in (((a, m), (m + 1, b)) if seek_small else ((a, m - 1), (m, b))) if points.add(m) is None]
        at = sources.select((F.col("total") / F.lit(float(total))).alias("share"), "total", F.explode(F.array(*[F.lit(p) for p in sorted(points)])).alias("k"))
        power = at.withColumn("power", F.pow("share", F.col("k") / F.lit(float(grid))))
        rows = power.groupBy("k").agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.log("power")).alias("plogp"), F.max(F.col("power") * F.lit(float(budget)) / F.col("total")).alias("most")).collect()  # 31 rows at most
        holds = {r.k: (r.most / r.z <= max_repeats) if seek_small else (r.plogp / r.z * -1 + math.log(r.z) >= min_entropy) for r in rows}
        for _ in range(5):
            if low >= high:
                break
            middle = (low + high + (not seek_small)) // 2
            if seek_small:
                low, high = (low, middle) if holds[middle] else (middle + 1, high)
            else:
                low, high = (middle, high) if holds[middle] else (low, middle - 1)
    return low


def weights(slim: DataFrame, budget: int | None = None, max_repeats: float | None = 4.0, min_entropy: float | None = None) -> DataFrame:
    """(source, total, weight, quota, passes, rest): quota tokens are ``passes`` whole passes and ``rest`` tokens of one more."""
    sources = written(shares(slim))
    total = sources.select(F.sum("total")).first()[0]
    empty = "source string, total long, weight double, quota long, passes long, rest long, grid_step long"
    if not total:
        return slim.sparkSession.createDataFrame([], empty)
    budget = total if budget is None else budget
    k = exponent(sources, budget, total, max_repeats, None if max_repeats is not None else min_entropy)
    powered = sources.withColumn("power", F.pow(F.col("total") / F.lit(float(total)), F.lit(k) / F.lit(float(1 << STEPS))))
    z = powered.select(F.sum("power")).first()[0]
    weighed = powered.select("source", "total", (F.col("power") / F.lit(z)).alias("weight"), F.round(F.col("power") / F.lit(z) * F.lit(float(budget))).cast("long").alias("quota"))
    return written(weighed.select("*", F.expr("quota div total").alias("passes"), F.expr("quota % total").alias("rest"), F.lit(k).cast("long").alias("grid_step")))


def plan(slim: DataFrame, weighed: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each document and pass: doc_id, source, tokens, pass, place_key and start (tokens of its source before it).

    Rows are summed by ranges of the hash: 1,024 ranges of a source and pass, 1,024 parts of a range, and the rows of a part.
    """
    known = slim.join(weighed, "source", "left")
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    turns = F.when(F.col("total").isNull(), F.array(F.lit(0).cast("long"))).when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = known.withColumn("pass", F.explode(turns)).withColumn("place_key", _hash(F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    top, part = F.shiftright("place_key", 50).alias("top"), F.shiftright("place_key", 40).alias("part")
    rows = written(rows.select("doc_id", "source", "tokens", "total", "quota", "passes", "rest", "pass", "place_key", top, part))
    parts = rows.groupBy("source", "pass", "top", "part").agg(F.sum("tokens").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy("source", "pass", "top").agg(F.sum("n").alias("m")).withColumn("top_start", F.coalesce(F.sum("m").over(before("source", "pass").orderBy("top")), F.lit(0))).drop("m")
    starts = parts.withColumn("part_start", F.coalesce(F.sum("n").over(before("source", "pass", "top").orderBy("part")), F.lit(0))).join(tops, ["source", "pass", "top"]).select("source", "pass", "part", (F.col("part_start") + F.col("top_start")).alias("base"))
    inside = Window.partitionBy("source", "pass", "part").orderBy("place_key").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "pass", "part"]).withColumn("start", F.col("base") + F.col("inner"))


def kept_rows(planned: DataFrame) -> DataFrame:
    """The rows of whole passes, and of the last one those that start before the budget is reached."""
    return planned.where("total IS NULL OR pass < passes OR start < rest")


def in_ranges(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows with the range of their order_key in a crowded block (0 in others), and (block, range, before): the rows of a crowded block in earlier ranges.

    Both small tables have at most (rows / ``block_rows``) blocks and twice as many ranges.
    """
    crowded = written(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("block", F.expr(f"n div {block_rows}L + 1").alias("ranges")))
    number = F.expr("shiftright(order_key, 30) * ranges div 1073741824L")  # the key has 60 bits
    dealt = placed.join(F.broadcast(crowded), "block", "left").withColumn("range", F.coalesce(number, F.lit(0).cast("long")))
    sizes = dealt.where("ranges IS NOT NULL").groupBy("block", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.drop("ranges"), sizes.select("block", "range", F.sum("n").over(earlier).alias("before"))


def blocks(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 4.0, min_entropy: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mixture in order: doc_id, source, pass, n_tokens, block and place (in its block)."""
    slim = written(counted(docs))
    weighed = weights(slim, budget, max_repeats, min_entropy)
    whole = weighed.select(F.sum("quota")).first()[0] or 0
    count = max(1, -(-whole // block_tokens))
    kept = kept_rows(plan(slim, weighed, seed))
    at = F.floor((F.col("pass") * F.col("total") + F.col("start")).cast("double") * F.lit(float(count)) / F.col("quota")).cast("long")
    placed = kept.withColumn("block", F.coalesce(F.least(at, F.lit(count - 1).cast("long")), F.lit(0).cast("long")))
    key = _hash(F.lit(f"{seed}:order"), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = written(placed.select("doc_id", "source", "pass", "tokens", "block", key.alias("order_key")))
    dealt, before = in_ranges(placed, block_rows)
    order = Window.partitionBy("block", "range").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "tokens")
    numbered = dealt.withColumn("inner", F.row_number().over(order) - 1).join(F.broadcast(before), ["block", "range"], "left")
    return numbered.select(
        "doc_id", F.when(F.col("source") != NONE, F.col("source")).alias("source"), F.col("pass"), F.col("tokens").alias("n_tokens"), "block", (F.col("inner") + F.coalesce("before", F.lit(0))).cast("long").alias("place"))


def mixed(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 4.0, min_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it; the columns stay as they are.

    A partial pass is a bound on the hash for each source, so texts are filtered and repeated where they lie.
    """
    slim = written(counted(docs))
    weighed = weights(slim, budget, max_repeats, min_entropy)
    partial = kept_rows(plan(slim, weighed, seed)).where("pass = passes AND rest > 0").groupBy("source").agg(F.max("place_key").alias("__bound"))
    source, passes, bound, name, copy = (free_name(f"__{c}", docs.columns) for c in ("source", "passes", "bound", "name", "copy"))
    bounds = written(weighed.join(partial, "source", "left").select(F.col("source").alias(source), F.col("passes").alias(passes), F.col("__bound").alias(bound)))
    named = docs.withColumn(name, F.coalesce(F.col("source").cast("string"), F.lit(NONE)))
    met = named.join(bounds, F.col(name) == F.col(source), "left")
    key = _hash(F.lit(str(seed)), F.col(passes).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    times = F.when(F.col(passes).isNull(), F.lit(1)).otherwise(F.col(passes) + F.coalesce((key <= F.col(bound)).cast("long"), F.lit(0))).cast("int")
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
