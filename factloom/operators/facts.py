"""Versioned fact store: observations in, facts, evidence and change events out.

An observation is the complete set of values one source record gives for ``(subject, predicate)`` at one time; an empty
set takes the values back. Observations carry a unique integer ``seq``, the order in which they arrived.

All history is derived with running sums along ``seq`` (see :mod:`factloom.operators.scan`). Fields are dealt to the tasks once and folded there; a
field with more than ``block`` observations (counted) is cut into blocks and spread over many tasks:

* the evidence set of a source record before a step is the set of its previous observation;
* a value is open while at least one source record supports it; its support count is a running sum of +1 and -1;
* evidence is current from the step that brings it to the step of the same source record that no longer has it.

A value that returns after a gap (A, B, A) opens a new fact and a new evidence interval.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.functions import text as tx
from factloom.operators import scan
from factloom.operators.stages import written
from factloom.policy import Policy

KEY = ["subject_type", "subject_id", "predicate"]
RECORD = [*KEY, "source", "source_record_id"]
VALUES_TYPE = "array<struct<value_json:string,display_value:string,source_locator:string,evidence_text:string>>"
FOLD_BLOCK = 50_000
#: Observations of short fields that one task folds, about.
TASK_ROWS = 100_000


# ---------------------------------------------------------------- observations


def value_struct(predicate: Column, value_json: Column, display: Column) -> Column:
    return F.struct(value_json.alias("value_json"), display.alias("display_value"),
                    ids.value_locator(predicate, value_json).alias("source_locator"),
                    F.lit(None).cast("string").alias("evidence_text"))


def _values(predicate: str, column: str, kind: str) -> Column:
    """Value array of one field.

    Kinds: text, number, texts, ``objects:<member>`` for one-member objects, nested (any struct, map or array as one value) or nesteds (an array of
    such values).
    """
    name, c = F.lit(predicate), F.col(column)
    none = F.array().cast(VALUES_TYPE)
    if kind == "number":
        shown = c.cast("string")
        return F.when(c.isNotNull(), F.array(value_struct(name, shown, shown))).otherwise(none)
    if kind == "text":
        shown = tx.strip(c)
        return F.when(F.coalesce(shown, F.lit("")) != "",
                      F.array(value_struct(name, ids.json_string(shown), shown))).otherwise(none)
    if kind in ("nested", "nesteds"):
        whole = lambda x: ids.canonical_json(F.to_json(x, {"ignoreNullFields": "false"}), tx.strip)
        if kind == "nested":
            return F.when(c.isNotNull(), F.array(value_struct(name, whole(c), whole(c)))).otherwise(none)
        return F.coalesce(F.transform(F.array_compact(c), lambda x: value_struct(name, whole(x), whole(x))), none)
    items = F.coalesce(c, F.array().cast("array<string>"))
    if kind == "texts":
        return F.transform(items, lambda v: value_struct(name, ids.json_string(tx.strip(v)), tx.strip(v)))
    member = kind.split(":", 1)[1]

    def obj(v: Column) -> Column:
        body = ids.json_string(tx.strip(v))
        return value_struct(name, F.concat(F.lit('{"' + member + '":'), body, F.lit("}")),
                            F.concat(F.lit('{"' + member + '": '), body, F.lit("}")))
    return F.transform(items, obj)


def observe(records: DataFrame, fields: dict[str, tuple[str, str]], *, subject_type: str, subject_id: str, source: str,
            record_id: str, observed_at: Column, source_url: Column, snapshot_id: Column | None, extractor: str) -> DataFrame:
    """Wide records to one observation per field: ``{predicate: (column, kind)}``. ``records`` must carry ``seq``."""
    rows = F.array(*[F.struct(F.lit(p).alias("predicate"), _values(p, c, kind).cast(VALUES_TYPE).alias("values"))
                     for p, (c, kind) in fields.items()])
    null = F.lit(None).cast("string")
    return records.select(
        F.lit(subject_type).alias("subject_type"), F.col(subject_id).cast("string").alias("subject_id"),
        F.lit(source).alias("source"), F.col(record_id).cast("string").alias("source_record_id"),
        observed_at.alias("observed_at"), source_url.alias("source_url"),
        (null if snapshot_id is None else snapshot_id).alias("snapshot_id"), F.lit(1.0).alias("confidence"),
        F.lit(extractor).alias("extractor"), F.lit("needs_review").alias("review_status"), "seq",
        F.explode(rows).alias("f"),
    ).select("*", "f.predicate", "f.values").drop("f")


def catalogue_observations(catalogue: DataFrame, observed_at: Column) -> DataFrame:
    """Ten fields per curated catalogue row; an unknown linker type counts as no value."""
    df = catalogue.withColumn("linker_type", F.nullif("linker_type", F.lit("unknown")))
    fields = {f"adc.{c}": (c, "number" if c == "dar" else "text") for c in (
        "target", "antibody", "linker_name", "linker_type", "payload_name", "payload_class", "dar", "indication",
        "development_status", "company")}
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.lit("public-seed"))
    return observe(df, fields, subject_type="adc", subject_id="entity_id", source="curated_seed", record_id="entity_id",
                   observed_at=observed_at, source_url=url, snapshot_id=None, extractor="curated_seed_v1")


def registry_observations(records: DataFrame, observed_at: Column, snapshot_id: Column) -> DataFrame:
    """Eight fields per third-party catalogue record, with the status text mapped to the status enum.

    ``target`` must hold the canonical target already (see ``match_dictionary``).
    """
    df = records.withColumn("development_status", tx.development_status(F.col("drug_status"), None))
    fields = {"adc.target": ("target", "text"), "adc.antibody": ("antibody_name", "text"),
              "adc.linker_name": ("linker_name", "text"), "adc.payload_name": ("payload_name", "text"),
              "adc.dar": ("dar", "number"), "adc.indication": ("representative_indication", "text"),
              "adc.development_status": ("development_status", "text"), "adc.company": ("organization", "text")}
    return observe(df, fields, subject_type="adc", subject_id="entity_id", source="adcdb", record_id="adcdb_id",
                   observed_at=observed_at, source_url=F.col("detail_url"), snapshot_id=snapshot_id,
                   extractor="adcdb_structured_v1")


def trial_observations(trials: DataFrame, observed_at: Column, snapshot_id: Column) -> DataFrame:
    fields = {"trial.overall_status": ("overall_status", "text"), "trial.phases": ("phases", "texts"),
              "trial.conditions": ("conditions", "texts"), "trial.interventions": ("interventions", "objects:name"),
              "trial.primary_outcomes": ("primary_outcomes", "objects:measure"),
              "trial.enrollment": ("enrollment", "number"), "trial.start_date": ("start_date", "text"),
              "trial.completion_date": ("completion_date", "text")}
    return observe(trials, fields, subject_type="trial", subject_id="nct_id", source="clinicaltrials", record_id="nct_id",
                   observed_at=observed_at, source_url=F.col("source_url"), snapshot_id=snapshot_id,
                   extractor="clinicaltrials_structured_v1")


def publication_observations(publications: DataFrame, observed_at: Column, snapshot_id: Column) -> DataFrame:
    df = publications.withColumn("publication_type", F.array().cast("array<string>"))
    fields = {"publication.title": ("title", "text"), "publication.abstract": ("abstract", "text"),
              "publication.publication_date": ("publication_date", "text"),
              "publication.publication_type": ("publication_type", "texts")}
    return observe(df, fields, subject_type="publication", subject_id="source_record_id", source="pubmed",
                   record_id="source_record_id", observed_at=observed_at, source_url=F.col("source_url"),
                   snapshot_id=snapshot_id, extractor="pubmed_structured_v1")


def observation_violations(observations: DataFrame, policy: Policy, snapshots: DataFrame | None = None,
                           batch: str | None = None) -> DataFrame:
    """Rows that make a batch unacceptable: ``(reason, subject_id, predicate, source)``."""
    shown = ["subject_id", "predicate", "source"]

    def rows(df: DataFrame, reason: str) -> DataFrame:
        return df.select(F.lit(reason).alias("reason"), *shown)

    found = rows(observations.filter(~F.col("predicate").isin(*policy.fields)), "unknown_field")
    found = found.unionByName(rows(observations.filter(~F.col("source").isin(*policy.sources)), "unknown_source"))
    found = found.unionByName(rows(
        observations.filter(~F.col("review_status").isin(*policy.verification_statuses)), "unknown_review_status"))
    group = [*RECORD, *([batch] if batch else ["seq"])]
    found = found.unionByName(rows(observations.groupBy(*group).count().filter("count > 1"), "duplicate_group"))
    empty = F.exists("values", lambda v: v["value_json"].isNull() | v["value_json"].isin("null", '""'))
    found = found.unionByName(rows(observations.filter(empty), "empty_value"))
    if snapshots is not None:
        s = snapshots.select("snapshot_id", F.col("source").alias("__s"), F.col("source_record_id").alias("__r"))
        j = observations.filter("snapshot_id IS NOT NULL").join(s, "snapshot_id", "left")
        found = found.unionByName(rows(j.filter("__s IS NULL"), "unknown_snapshot"))
        found = found.unionByName(rows(j.filter("__s <> source OR __r <> source_record_id"), "snapshot_mismatch"))
    return found


def require_valid(observations: DataFrame, policy: Policy, snapshots: DataFrame | None = None,
                  batch: str | None = None) -> None:
    """Reject the whole batch when any observation is invalid."""
    bad = observation_violations(observations, policy, snapshots, batch).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.reason}: {r.subject_id} {r.predicate} {r.source}" for r in bad))


# ---------------------------------------------------------------- steps


def with_evidence(observations: DataFrame) -> DataFrame:
    def full(v: Column) -> Column:
        value_hash = F.sha2(v["value_json"], 256)
        quote = F.coalesce(v["evidence_text"], F.concat("predicate", F.lit(": "), v["display_value"]))
        content = ids.digest("subject_type", "subject_id", "predicate", "source", "source_record_id", "snapshot_id",
                             "source_url", v["source_locator"], value_hash, quote)
        return F.struct(F.concat(F.lit("fe_"), F.substring(content, 1, 32)).alias("evidence_id"), v["value_json"],
                        v["display_value"], value_hash.alias("value_hash"), v["source_locator"],
                        quote.alias("evidence_text"), content.alias("content_hash"))

    # evidence_id leads the struct, so sorting puts equal identities next to each other
    df = observations.withColumn("evidence", F.sort_array(F.transform("values", full))).drop("values")
    same_as_before = lambda e, i: (i > 0) & (
        F.try_element_at(F.col("evidence"), F.when(i > 0, i).otherwise(1))["evidence_id"] == e["evidence_id"])
    return df.withColumn("evidence", F.filter("evidence", lambda e, i: ~F.coalesce(same_as_before(e, i), F.lit(False))))


def _ids(evidence: str) -> Column:
    return F.transform(evidence, lambda e: e["evidence_id"])


@dataclass(frozen=True)
class Lengths:
    """Which fields are too long for one task, and the number of tasks for the others."""

    block: int
    tasks: int
    long: DataFrame | None

    @staticmethod
    def of(rows: DataFrame, block: int) -> Lengths:
        counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("longest")).first()
        tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen.rows // 2_000))
        long = written(counts.where(F.col("n") > block).select(*KEY)) if (seen.longest or 0) > block else None
        return Lengths(block, max(1, tasks, -(-seen.rows // TASK_ROWS)), long)

    def parts(self, df: DataFrame) -> list[tuple[DataFrame, int | None]]:
        """The rows of the short fields, which need no blocks, and those of the long ones with their block."""
        if self.long is None:
            return [(df, None)]
        marked = F.broadcast(self.long.select(*[F.col(k).alias(f"__long_{k}") for k in KEY]))  # at most one for ``block`` rows
        same = F.lit(True)
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"__long_{k}"))
        return [(df.join(marked, same, "left_anti"), None), (df.join(marked, same, "left_semi"), self.block)]

    def dealt(self, df: DataFrame) -> list[tuple[DataFrame, int | None]]:
        """``parts`` with all rows of a short field in one task."""
        return [(rows.repartition(self.tasks, *KEY) if block is None else rows, block) for rows, block in self.parts(df)]


def together(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def change_steps(observations: DataFrame, block: int = scan.DEFAULT_BLOCK) -> DataFrame:
    """Observations that change the evidence of their source record, with the evidence held before the step."""
    return together(_steps(rows, cut) for rows, cut in Lengths.of(observations, block).dealt(observations))


def _steps(observations: DataFrame, block: int | None) -> DataFrame:
    return with_previous(with_evidence(observations), block).filter(changes_evidence())


def with_previous(observations: DataFrame, block: int | None = scan.DEFAULT_BLOCK) -> DataFrame:
    """Every observation (with evidence) and what its source record held before it."""
    seen = scan.neighbour(observations if block is None else written(observations), RECORD, "seq", {"before": "evidence"}, block=block)
    return seen.withColumn("before", F.coalesce("before", F.filter("evidence", lambda e: F.lit(False))))


def changes_evidence() -> Column:
    return _ids("evidence") != _ids("before")


def value_rows(steps: DataFrame) -> DataFrame:
    """One row per step and value held before or after it, with the support change and the evidence that comes or goes."""
    step_values = F.array_distinct(F.transform(F.concat("before", "evidence"), lambda e: e["value_hash"]))
    r = steps.withColumn("value_hash", F.explode(step_values))
    mine = lambda side: F.filter(side, lambda e: e["value_hash"] == F.col("value_hash"))
    r = r.withColumn("__now", mine("evidence")).withColumn("__old", mine("before"))
    r = r.withColumn("delta", (F.size("__now") > 0).cast("int") - (F.size("__old") > 0).cast("int"))
    r = r.withColumn("opened", F.filter("__now", lambda e: ~F.array_contains(_ids("before"), e["evidence_id"])))
    r = r.withColumn("closed", F.transform(
        F.filter("__old", lambda e: ~F.array_contains(_ids("evidence"), e["evidence_id"])), lambda e: e["evidence_id"]))
    first = F.coalesce(F.try_element_at(F.col("__now"), F.lit(1)), F.try_element_at(F.col("__old"), F.lit(1)))
    return r.withColumn("value_json", first["value_json"]).withColumn("display_value", first["display_value"]).drop(
        "__now", "__old", "evidence", "before")


@dataclass(frozen=True)
class Reconciled:
    facts: DataFrame
    evidence: DataFrame
    steps: DataFrame
    policy: Policy
    block: int
    fold_block: int
    #: Events of earlier steps are left out; they are only there to start from.
    since: int | None = None

    @cached_property
    def events(self) -> DataFrame:
        """Built when first asked for."""
        events = change_events(self.steps, self.policy, self.block, self.fold_block)
        return events if self.since is None else events.filter(F.col("seq") >= self.since)


def reconcile(observations: DataFrame, policy: Policy, block: int = scan.DEFAULT_BLOCK,
              fold_block: int = FOLD_BLOCK) -> Reconciled:
    """Fact store of the given observations.

    ``facts``: identity, value, status and validity of every value ever open. ``evidence``: every evidence interval and
    its fact. ``events``: value changes and conflict edges. ``steps``: the observations that changed something.
    """
    parts = []
    for rows, cut in Lengths.of(observations, block).dealt(observations):
        steps = _steps(rows, cut) if cut is None else written(_steps(rows, cut))
        values = written(_with_opener(value_rows(steps), policy, cut))
        parts.append((steps, values, _evidence(values, cut)))
    steps, values, evidence = (together(frames) for frames in zip(*parts, strict=True))
    evidence = written(evidence)
    return Reconciled(written(_facts(values, evidence, policy)), evidence, steps, policy, block, fold_block)


def _with_opener(values: DataFrame, policy: Policy, block: int | None) -> DataFrame:
    on = [*KEY, "value_hash"]
    v = values if block is None else written(values)
    v = scan.running_sum(v, on, "seq", {"support": "delta"}, block)
    v = v if block is None else written(v)
    opens = (F.col("delta") == 1) & (F.col("support") == 1)
    fact_id = ids.prefixed_id("fact_", 32, *KEY, "value_hash", "observed_at", F.coalesce("snapshot_id", "source"))
    opener = F.struct(F.col("seq").alias("seq"), fact_id.alias("fact_id"), F.col("observed_at").alias("valid_from"),
                      F.col("review_status").alias("review_status"))
    fact = F.when(opens, opener)
    if "stored_fact" in v.columns:  # values that were open before the first step keep their fact
        fact = F.coalesce(F.col("stored_fact"), fact)
    v = scan.running_last(v, on, "seq", {"fact": fact}, block)
    return v.withColumn("closes", (F.col("delta") == -1) & (F.col("support") == 0))


def _facts(values: DataFrame, evidence: DataFrame, policy: Policy) -> DataFrame:
    on = [*KEY, "value_hash"]
    found = values.groupBy(*on, F.col("fact.fact_id").alias("fact_id"), F.col("fact.seq").alias("opened_seq")).agg(
        F.first("fact.valid_from").alias("valid_from"), F.first("fact.review_status").alias("review_status"),
        F.min_by("value_json", "seq").alias("normalized_value_json"), F.min_by("display_value", "seq").alias("display_value"),
        F.max(F.when(F.col("closes"), F.col("observed_at"))).alias("valid_to"),
        F.bool_or("closes").alias("__closed"),
    )
    support = evidence.filter("is_current").groupBy(*on).agg(
        F.min(policy.source_rank(F.col("predicate"), F.col("source"))).alias("rank"))
    per_field = support.groupBy(*KEY).agg(F.count(F.lit(1)).alias("open_values"), F.min("rank").alias("best_rank"))
    # Closed facts need no status lookup and stay out of the joins.
    ranked = found.where(~F.col("__closed")).join(support, on, "left").join(per_field, KEY, "left")
    ranked = ranked.unionByName(found.where(F.coalesce("__closed", F.lit(True))), allowMissingColumns=True)
    how = policy.resolution(F.col("predicate"))
    status = (F.when(F.col("__closed"), "superseded")
              .when(how == "flag_conflict", F.when(F.col("open_values") > 1, "conflicted").otherwise("current"))
              .when(how == "preserve_all", "current")
              .otherwise(F.when(F.col("rank") == F.col("best_rank"), "current").otherwise("superseded")))
    kind = policy.value_type(F.col("predicate"))
    return ranked.select(
        "fact_id", *KEY, "normalized_value_json", "display_value", kind.alias("value_type"), "value_hash",
        status.alias("status"), "valid_from", F.when(F.col("__closed"), F.col("valid_to")).alias("valid_to"), "review_status",
        F.lit(policy.version).alias("policy_version"),
        ids.digest(*KEY, "normalized_value_json", kind, F.lit(policy.version)).alias("content_hash"), "opened_seq")


_BODY = ("fact_id", "value_hash", "snapshot_id", "source_url", "confidence", "extractor", "review_status", "observed_at",
         "source_locator", "evidence_text", "content_hash")


def _evidence(values: DataFrame, block: int | None, stored: DataFrame | None = None) -> DataFrame:
    """Evidence intervals; ``stored`` has evidence that was current before the first step."""
    common = [*RECORD, "seq", "observed_at"]
    brought = values.select(*common, "value_hash", "snapshot_id", "source_url", "confidence", "extractor", "review_status",
                            "fact", F.explode("opened").alias("e"))
    body = F.struct("seq", "fact.fact_id", "value_hash", "snapshot_id", "source_url", "confidence", "extractor",
                    "review_status", "observed_at", "e.source_locator", "e.evidence_text", "e.content_hash")
    opened = brought.select(*common, F.col("e.evidence_id").alias("evidence_id"), body.alias("__open"))
    closed = values.select(*common, F.explode("closed").alias("evidence_id"))
    if stored is not None:
        kept = F.struct(F.col("opened_seq").alias("seq"), *[F.col(c) for c in _BODY])
        opened = opened.unionByName(stored.select(*RECORD, F.col("opened_seq").alias("seq"), "observed_at", F.col("fact_evidence_id").alias("evidence_id"), kept.alias("__open")))
    both = opened.unionByName(closed, allowMissingColumns=True)
    on = [*RECORD, "evidence_id"]
    both = both.repartition(*on) if block is None else written(both)
    spans = scan.running_last(both, on, "seq", {"span": F.col("__open")}, block)
    ends = F.max(F.when(F.col("__open").isNull(), F.col("observed_at"))).alias("valid_to")
    spans = spans.groupBy(*on, F.col("span.seq").alias("opened_seq")).agg(F.first("span").alias("o"), ends)
    return spans.select(F.col("evidence_id").alias("fact_evidence_id"), *RECORD, *[F.col(f"o.{n}").alias(n) for n in _BODY],
                        "valid_to", F.col("valid_to").isNull().alias("is_current"), "opened_seq")


# ---------------------------------------------------------------- change events

def change_events(steps: DataFrame, policy: Policy, block: int = scan.DEFAULT_BLOCK, fold_block: int = FOLD_BLOCK) -> DataFrame:
    """Events of all steps, by a sweep over the intervals in which values are open.

    A step adds +1 and -1 to the support of the values it brings and takes back; running sums along ``seq`` give the points where a value opens
    or closes, and of these the number of open values of a field. So the steps with an event are known from sums alone. The open values before
    and after them are listed last: events of a field are numbered, an interval becomes the range of numbers that lie in it, and only these
    ranges are written out, cut at multiples of ``fold_block``. The rows are those of the lists in the result; intervals without events cost none.

    Where the best source decides, a value has one interval per rank of its sources, and a list keeps the values of its best rank.
    """
    texts = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda e: e["value_json"])))
    slim = written(steps.select(*RECORD, "seq", "observed_at", "snapshot_id", texts("before").alias("old_values"), texts("evidence").alias("new_values")))
    return together(_change_events(rows, policy, cut, fold_block) for rows, cut in Lengths.of(slim, block).parts(slim))


def _change_events(slim: DataFrame, policy: Policy, block: int | None, fold_block: int) -> DataFrame:
    how = policy.resolution(F.col("predicate"))
    track = F.when(how == "authoritative_first", policy.source_rank(F.col("predicate"), F.col("source"))).otherwise(F.lit(0))
    moved = lambda values, by: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(by).alias("by")))
    shifts = F.concat(moved(F.array_except("new_values", "old_values"), 1), moved(F.array_except("old_values", "new_values"), -1))
    tracks = [*KEY, "value", "track"]
    points = slim.select(*KEY, "seq", track.alias("track"), F.inline(shifts))
    points = scan.running_sum(points, tracks, "seq", {"support": "by"}, block)
    opens, closes = (F.col("by") == 1) & (F.col("support") == 1), (F.col("by") == -1) & (F.col("support") == 0)
    points = points.where(opens | closes).groupBy(*KEY, "seq").agg(F.collect_list(F.struct("value", "track", "by")).alias("points"))  # those of one step

    turned = slim.join(points, [*KEY, "seq"], "left")
    turned = turned.withColumn("turn", F.when(how == "flag_conflict", F.coalesce(F.aggregate("points", F.lit(0), lambda n, x: n + x["by"]), F.lit(0))).otherwise(0))
    turned = scan.running_sum(turned, KEY, "seq", {"open_values": "turn"}, block, keep_block=True)
    was, now = F.col("open_values") - F.col("turn") > 1, F.col("open_values") > 1
    changed = (F.size("old_values") > 0) & (F.col("old_values") != F.col("new_values"))
    kinds = F.array_compact(F.array(F.when(changed, "value_changed"), F.when(~was & now, "fact.conflict_detected").when(was & ~now, "fact.conflict_resolved")))
    numbered = turned.withColumn("kinds", kinds).withColumn("here", F.least(F.size("kinds"), F.lit(1)))
    numbered = written(scan.running_sum(numbered, KEY, "seq", {"upto": "here"}, block).drop("turn", "open_values"))

    # Events before (<= below) and up to (<= upto) the points of an interval; an interval that is still open ends with the last event.
    at = numbered.select(*KEY, "seq", "upto", (F.col("upto") - F.col("here")).alias("below"), F.inline("points"))
    ends = {"end_upto": "upto", "end_below": "below"}
    spans = scan.neighbour(at, tracks, "seq", ends, direction="next", block=block).where("by = 1")
    spans = spans.join(numbered.groupBy(*KEY).agg(F.max("upto").alias("last")).where("last > 0"), KEY)
    side = lambda name, low, high: F.struct(F.lit(name).alias("side"), (F.col(low) + 1).alias("low"), F.coalesce(high, "last").alias("high"))
    ranges = spans.select(*tracks, F.inline(F.array(side("old", "upto", "end_upto"), side("new", "below", "end_below")))).where("low <= high")
    parts = ranges.withColumn("part", F.explode(F.expr(f"sequence(low div {fold_block}, high div {fold_block})")))
    first = F.col("part") * fold_block
    each = parts.select(*tracks, "side", F.explode(F.sequence(F.greatest("low", first), F.least("high", first + (fold_block - 1)))).alias("upto"))
    step = ["source", "source_record_id", "snapshot_id", "observed_at", "seq", "old_values", "new_values", "kinds"]
    events = numbered.where("here = 1").select(*KEY, "upto", F.struct(*step).alias("step"))
    listed = lambda name: F.collect_list(F.when(F.col("side") == name, F.struct("track", "value"))).alias(name)
    both = events.unionByName(each, allowMissingColumns=True).groupBy(*KEY, "upto").agg(F.first("step", ignorenulls=True).alias("step"), listed("old"), listed("new"))
    both = both.select(*KEY, "step.*", "old", "new")

    def text(values: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", values), F.lit("]"))

    def best(name: str) -> Column:
        least = F.array_min(F.transform(name, lambda x: x["track"]))
        return text(F.array_sort(F.transform(F.filter(name, lambda x: x["track"] == least), lambda x: x["value"])))

    details = F.when(F.col("event_type") == "value_changed", F.concat(
        F.lit('{"new_source_values":'), text(F.col("new_values")), F.lit(',"old_source_values":'), text(F.col("old_values")), F.lit("}"))).otherwise('{"conflict_resolution":"flag_conflict"}')
    swept = both.select(*RECORD, "snapshot_id", "observed_at", "seq", "old_values", "new_values", F.coalesce(best("old"), F.lit("[]")).alias("old_value_json"),
                        F.coalesce(best("new"), F.lit("[]")).alias("new_value_json"), F.explode("kinds").alias("event_type")).withColumn("details_json", details)
    kind = F.when(F.col("event_type") == "value_changed", policy.change_type(F.col("predicate"))).otherwise(F.col("event_type"))
    named = swept.withColumn("event_type", kind)
    content = ids.digest("event_type", *KEY, "source", "source_record_id", "snapshot_id", "observed_at", "old_value_json",
                         "new_value_json", "details_json")
    return named.withColumn("content_hash", content).select(
        F.concat(F.lit("chg_"), F.substring("content_hash", 1, 32)).alias("event_id"), "event_type",
        policy.severity(F.col("event_type")).alias("severity"), *KEY, "old_value_json", "new_value_json",
        F.col("observed_at").alias("detected_at"), "source", "source_record_id", "snapshot_id",
        policy.attention(F.col("event_type")).alias("review_required"), F.lit("needs_review").alias("review_status"),
        "details_json", "content_hash", "seq")


# ---------------------------------------------------------------- views


def latest_state(observations: DataFrame, policy: Policy) -> DataFrame:
    """Current facts without history: latest observation per source record, then conflict and source rank per field.

    Only ``max_by`` and counts, no ordering of whole histories.
    """
    order = F.max_by(F.col("values"), F.col("seq")).alias("values")
    latest = observations.groupBy(*RECORD).agg(order)
    held = latest.select(*RECORD, F.explode("values").alias("v")).select(
        *RECORD, F.col("v.value_json").alias("value_json"), F.col("v.display_value").alias("display_value"))
    per_value = held.groupBy(*KEY, "value_json").agg(
        F.first("display_value").alias("display_value"), F.countDistinct("source").alias("source_count"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.min(policy.source_rank(F.col("predicate"), F.col("source"))).alias("rank"))
    per_field = per_value.groupBy(*KEY).agg(F.count(F.lit(1)).alias("open_values"), F.min("rank").alias("best_rank"))
    how = policy.resolution(F.col("predicate"))
    status = (F.when(how == "flag_conflict", F.when(F.col("open_values") > 1, "conflicted").otherwise("current"))
              .when(how == "preserve_all", "current")
              .otherwise(F.when(F.col("rank") == F.col("best_rank"), "current").otherwise("superseded")))
    return per_value.join(per_field, KEY).select(
        *KEY, "value_json", "display_value", "source_count", "sources", "open_values", "rank", status.alias("status"))


def current_facts(facts: DataFrame, evidence: DataFrame, *, subject_type: str | None = None, subject_id: str | None = None,
                  predicate: str | None = None) -> DataFrame:
    """Open facts that count, with the sorted sources of their current evidence."""
    f = facts.filter("valid_to IS NULL AND status IN ('current', 'conflicted')")
    for column, value in (("subject_type", subject_type), ("subject_id", subject_id), ("predicate", predicate)):
        if value is not None:
            f = f.filter(F.col(column) == value)
    sources = evidence.filter("is_current").groupBy("fact_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return f.join(sources, "fact_id", "left").withColumn(
        "sources", F.coalesce("sources", F.array().cast("array<string>")))


def list_events(events: DataFrame, *, subject_type: str | None = None, subject_id: str | None = None,
                event_type: str | None = None) -> DataFrame:
    for column, value in (("subject_type", subject_type), ("subject_id", subject_id), ("event_type", event_type)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events.orderBy("detected_at", "event_id")


def freshness(df: DataFrame, policy: Policy, now: Column, *, source: str = "source", fetched_at: str = "fetched_at",
              observed_at: str = "observed_at") -> DataFrame:
    """Add age and freshness status; the reference time is the fetch time, else the observation time."""
    reference = F.coalesce(F.try_to_timestamp(F.col(fetched_at)), F.try_to_timestamp(F.col(observed_at)))
    hours = (F.unix_micros(now) - F.unix_micros(reference)).cast("double") / F.lit(3_600_000_000.0)
    age = F.when(hours.isNotNull(), F.greatest(F.lit(0.0), F.round(hours, 2)))
    limit = policy.max_age_hours(F.col(source))
    status = (F.when(limit.isNull(), F.when(F.col(source) == "curated_seed", "demo_source").otherwise("not_applicable"))
              .when(reference.isNull(), "unknown").when(age > limit, "stale").otherwise("current"))
    stale = F.when(limit.isNotNull() & reference.isNotNull(), age > limit)
    return df.select("*", age.alias("age_hours"), limit.alias("max_age_hours"), status.alias("freshness_status"),
                     stale.alias("is_stale"))
