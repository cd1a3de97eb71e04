"""Gates of evaluation reports: declared constraints, one output per question, hashed rows, checked unions. Faults are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import ids, text as tx
from factloom.operators.stages import written

STATUSES = ("answered", "partial", "refused", "error")


@dataclass(frozen=True)
class Rule:
    """A constraint on one key of the metadata.

    ``present``: not blank; ``one_of``: one of ``expected``; ``same``: the reports of a group agree (and all have it). ``where`` limits a rule to reports whose
    metadata has that value.
    """

    key: str
    kind: str
    expected: tuple[str, ...] = ()
    where: tuple[str, str] | None = None


def report_violations(metadata: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(group, report, key, rule, found) of every constraint that a report breaks.

    ``metadata(group, report, key, value)``: all keys of all reports, each once. The keys of a report meet in one aggregate, all rules of all reports are checked
    in that pass; what a group disagrees on is one more aggregate over the keys of ``same`` rules.
    """
    keys = sorted({k for r in rules for k in ([r.key] + ([r.where[0]] if r.where else []))})
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    wide = metadata.where(F.col("key").isin(*keys)).groupBy("group", "report").agg(*[value(k).alias(f"v{i}") for i, k in enumerate(keys)])
    named = metadata.select("group", "report").distinct().join(wide, ["group", "report"], "left")
    at = {k: F.col(f"v{i}") for i, k in enumerate(keys)}

    same = sorted({r.key for r in rules if r.kind == "same"})
    if same:
        differing = lambda k: (F.min(at[k]) != F.max(at[k])) | (F.count(at[k]) < F.count(F.lit(1)))
        agreed = named.groupBy("group").agg(*[differing(k).alias(f"d{same.index(k)}") for k in same])
        named = named.join(agreed, "group")

    def broken(r: Rule) -> Column:
        blank = tx.strip(F.coalesce(at[r.key], F.lit(""))) == ""
        fails = {"present": lambda: blank, "one_of": lambda: ~F.coalesce(at[r.key].isin(*r.expected), F.lit(False)), "same": lambda: F.coalesce(F.col(f"d{same.index(r.key)}"), F.lit(True))}[r.kind]()
        return fails & F.coalesce(at[r.where[0]] == r.where[1], F.lit(False)) if r.where else fails

    faults = F.array_compact(F.array(*[F.when(broken(r), F.struct(F.lit(r.key).alias("key"), F.lit(r.kind).alias("rule"), at[r.key].alias("found"))) for r in rules]))
    return named.select("group", "report", F.explode(faults).alias("f")).select("group", "report", "f.*")


def output_violations(outputs: DataFrame, questions: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """(question_id, reason): an arm gives exactly one output per question, with a known status and an answer text.

    ``outputs(question_id, status, answer)``. Both sides are counted by question before they meet.
    """
    bad_status = ~F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    given = outputs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad_status).alias("bad_status"), F.bool_or(F.col("answer").isNull()).alias("no_answer"))
    asked = questions.groupBy("question_id").agg(F.lit(True).alias("asked"))
    both = asked.withColumnRenamed("question_id", "q").join(given, F.col("q").eqNullSafe(F.col("question_id")), "full_outer")
    reasons = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing_output"), F.when(F.col("asked").isNull(), "unknown_question"), F.when(F.col("n") > 1, "more_than_one_output"),
        F.when(F.col("bad_status"), "invalid_status"), F.when(F.col("no_answer"), "missing_answer")))
    return both.select(F.coalesce("q", "question_id").alias("question_id"), F.explode(reasons).alias("reason"))


def with_output_hash(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, output, output_hash): each row as canonical JSON, nulls kept, and the hash of that text."""
    body = ids.canonical_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))
    return rows.select(key, body.alias("output")).withColumn("output_hash", F.concat(F.lit("sha256:"), F.sha2("output", 256)))


def checked_union(parts: Mapping[str, DataFrame], counts: Mapping[str, int], key: str = "question_id") -> DataFrame:
    """The parts under each other, ids rewritten to ``<part>:<id>``, with ``part``.

    Reading the result fails unless each part has the stated number of rows and all ids are there and different; the check is a part of the plan.
    """
    rows = None
    for name, df in parts.items():
        one = df.withColumns({key: F.when(tx.strip(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))), "part": F.lit(name)})
        rows = one if rows is None else rows.unionByName(one)
    each = rows.groupBy("part", key).agg(F.count(F.lit(1)).alias("n"))
    seen = each.agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, p in enumerate(counts)],
                    F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col(key).isNull()).alias("blank"))
    right = (F.col("most") <= 1) & (F.col("blank") == 0)
    for i, expected in enumerate(counts.values()):
        right = right & (F.col(f"n{i}") == expected)
    verdict = seen.select(F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("the parts do not have the stated numbers of different ids")).cast("boolean")).alias("ok"))
    return rows.join(F.broadcast(verdict), F.col("ok")).drop("ok")  # one row


def in_order(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows with their place (from 1) in a total order; ``order`` leaves no ties.

    Rows are sorted by ranges; only one number for each range is summed up, so no task holds more than a range.
    """
    inner = F.monotonically_increasing_id()  # number of the range in the upper bits, place in it in the lower 33
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", inner))
    part = F.shiftrightunsigned("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return dealt.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, name)
