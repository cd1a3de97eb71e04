"""The distributed fold against a plain sequential walk."""

import random

import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import fact_batch, facts
from factloom.policy import load_policy, parse_policy
import json
from pathlib import Path

SOURCES = ("adcdb", "curated_seed", "clinicaltrials")
FIELDS = ("adc.dar", "adc.company", "trial.overall_status")


def observation(seq, subject, predicate, source, values, url="https://x", record=None):
    return ("adc", subject, predicate, source, record or source, f"2024-01-01 00:00:{seq:06d}", url, None, 1.0, "x", "needs_review", seq,
            [(v, v, f"{predicate}[{v}]", None) for v in values])


def walk(rows, policy):
    """Facts, evidence intervals and events by walking the observations in order."""
    state, facts_, intervals, events = {}, [], [], []
    for row in sorted(rows, key=lambda r: r[11]):
        _, subject, predicate, source, record, at, url, *_ , seq, values = row
        s = state.setdefault((subject, predicate), {"held": {}, "open": {}})
        held = s["held"].get((source, record), {})
        new = {(v[0], url): v[0] for v in values}
        if set(new) == set(held):
            continue

        def listed():
            rule = policy.fields[predicate]
            live = {}
            for (src, _), ev in s["held"].items():
                for v in ev.values():
                    live.setdefault(v, set()).add(src)
            how, preferred = rule["conflict_resolution"], rule["preferred_sources"]
            if how == "authoritative_first" and live:
                rank = lambda v: min(preferred.index(x) if x in preferred else len(preferred) + 1 for x in live[v])
                best = min(map(rank, live))
                live = {v: x for v, x in live.items() if rank(v) == best}
            return sorted(live), how == "flag_conflict" and len(live) > 1

        old_list, was = listed()
        before = sorted(set(held.values()))
        for key in held:
            if key not in new:
                intervals[held_index[(subject, predicate, source, record, key)]][5] = at
        s["held"][(source, record)] = new
        live = {v for ev in s["held"].values() for v in ev.values()}
        for v in list(s["open"]):
            if v not in live:
                facts_[s["open"].pop(v)][4] = at
        for v in sorted(set(new.values())):
            if v not in s["open"]:
                s["open"][v] = len(facts_)
                facts_.append([subject, predicate, v, at, None])
        for key, v in new.items():
            if key not in held:
                held_index[(subject, predicate, source, record, key)] = len(intervals)
                intervals.append([subject, predicate, source, v, at, None])
        new_list, now = listed()
        after = sorted(set(new.values()))
        text = lambda x: "[" + ",".join(x) + "]"
        if before and before != after:
            events.append((seq, subject, predicate, source, "value", text(old_list), text(new_list)))
        if was != now:
            events.append((seq, subject, predicate, source, "detected" if now else "resolved", text(old_list), text(new_list)))
    return facts_, intervals, events


held_index = {}


@pytest.mark.parametrize("seed,block,fold_block", [(2, 7, 3), (3, 16, 1)])
def test_fold_equals_walk(spark, seed, block, fold_block):
    rng = random.Random(seed)
    policy = load_policy()
    rows = []
    for seq in range(400):
        hot = rng.random() < 0.5  # one field holds half of all observations
        subject, predicate = ("hot", "adc.dar") if hot else (f"s{rng.randrange(6)}", rng.choice(FIELDS))
        values = rng.sample(["1", "2", "3", "4"], rng.choice([0, 1, 1, 1, 2]))
        rows.append(observation(seq, subject, predicate, rng.choice(SOURCES), values, rng.choice(["https://a", "https://b"]), rng.choice(["r1", "r2"])))
    held_index.clear()
    want_facts, want_intervals, want_events = walk(rows, policy)
    df = spark.createDataFrame(rows, schemas.OBSERVATION).repartition(5)
    got = facts.reconcile(df, policy, block, fold_block)
    assert sorted(map(tuple, got.facts.select("subject_id", "predicate", "normalized_value_json", "valid_from", "valid_to").collect()), key=str) == sorted(
        map(tuple, want_facts), key=str)
    ev = got.evidence.join(got.facts.select("fact_id", "normalized_value_json"), "fact_id")
    assert sorted(map(tuple, ev.select("subject_id", "predicate", "source", "normalized_value_json", "observed_at", "valid_to").collect()), key=str) == sorted(
        map(tuple, want_intervals), key=str)
    kind = F.when(F.col("event_type") == "fact.conflict_detected", "detected").when(F.col("event_type") == "fact.conflict_resolved", "resolved").otherwise("value")
    assert sorted(map(tuple, got.events.select("seq", "subject_id", "predicate", "source", kind, "old_value_json", "new_value_json").collect())) == sorted(want_events)
    # every piece of evidence belongs to exactly one fact, ids are unique, replaying gives the same store
    assert got.evidence.join(got.facts, "fact_id", "left_anti").isEmpty()
    assert got.facts.groupBy("fact_id").count().filter("count > 1").isEmpty()
    again = facts.reconcile(df.repartition(3), policy, 1000, 50)
    assert again.facts.exceptAll(got.facts).isEmpty() and again.events.exceptAll(got.events).isEmpty()
    # the shortcut without history agrees on the open facts
    short = facts.latest_state(df, policy).select("subject_id", "predicate", "value_json", "status")
    full = got.facts.filter("valid_to IS NULL").select("subject_id", "predicate", F.col("normalized_value_json").alias("value_json"), "status")
    assert short.exceptAll(full).isEmpty() and full.exceptAll(short).isEmpty()


def test_scenarios(spark):
    policy = load_policy()
    rows = [observation(1, "a", "adc.dar", "adcdb", ["8.0"]), observation(2, "a", "adc.dar", "adcdb", ["8.0"]),
            observation(3, "b", "adc.dar", "adcdb", ["8.0"]), observation(4, "b", "adc.dar", "adcdb", ["7.6"]),
            observation(5, "c", "adc.dar", "adcdb", ["8.0"]), observation(6, "c", "adc.dar", "curated_seed", ["7.6"]), observation(7, "c", "adc.dar", "curated_seed", ["8.0"]),
            observation(8, "d", "adc.dar", "adcdb", ["8.0"]), observation(9, "d", "adc.dar", "adcdb", []),
            observation(10, "e", "adc.dar", "adcdb", ["1"]), observation(11, "e", "adc.dar", "adcdb", ["2"]), observation(12, "e", "adc.dar", "adcdb", ["1"]),
            observation(13, "u", "adc.dar", "adcdb", ["8.0"]), observation(14, "u", "adc.dar", "adcdb", ["8.0"], "https://new")]
    got = facts.reconcile(spark.createDataFrame(rows, schemas.OBSERVATION), policy)
    current = {r.subject_id: (r.display_value, list(r.sources)) for r in facts.current_facts(got.facts, got.evidence).collect()}
    assert current == {"a": ("8.0", ["adcdb"]), "b": ("7.6", ["adcdb"]), "c": ("8.0", ["adcdb", "curated_seed"]), "e": ("1", ["adcdb"]), "u": ("8.0", ["adcdb"])}
    events = [(r.subject_id, r.event_type) for r in facts.list_events(got.events).collect()]
    assert events.count(("b", "adc.structure.changed")) == 1
    assert ("c", "fact.conflict_detected") in events and ("c", "fact.conflict_resolved") in events
    assert not [e for e in events if e[0] in {"a", "u"}]
    assert got.facts.filter("subject_id = 'e'").count() == 3
    assert got.evidence.filter("subject_id = 'u'").count() == 2 and got.facts.filter("subject_id = 'u'").count() == 1


def test_batches_are_rejected_as_a_whole(spark):
    policy = load_policy()
    good = observation(1, "a", "adc.dar", "adcdb", ["1"])
    facts.require_valid(spark.createDataFrame([good], schemas.OBSERVATION), policy)
    for bad in (observation(2, "a", "adc.nothing", "adcdb", ["1"]), observation(2, "a", "adc.dar", "nobody", ["1"]), good,
                observation(2, "a", "adc.dar", "adcdb", ['""'])):
        with pytest.raises(ValueError):
            facts.require_valid(spark.createDataFrame([good, bad], schemas.OBSERVATION), policy)
    snapshots = spark.createDataFrame([("s1", "adcdb", "other")], "snapshot_id string, source string, source_record_id string")
    for snapshot in ("s1", "s2"):
        row = (*good[:7], snapshot, *good[8:])
        with pytest.raises(ValueError):
            facts.require_valid(spark.createDataFrame([row], schemas.OBSERVATION), policy, snapshots)


def test_freshness(spark):
    rows = [("clinicaltrials", None, "2024-01-01T00:00:00Z"), ("clinicaltrials", "2024-01-03T00:00:00+00:00", "2023-01-01"), ("curated_seed", None, "2020-01-01"),
            ("pubmed", None, "not a date"), ("clinicaltrials", None, "2024-01-02T00:00:00Z")]
    df = spark.createDataFrame(rows, "source string, fetched_at string, observed_at string")
    out = [(r.freshness_status, r.age_hours) for r in facts.freshness(df, load_policy(), F.lit("2024-01-04 00:00:00").cast("timestamp")).collect()]
    assert out == [("stale", 72.0), ("current", 24.0), ("demo_source", 35136.0), ("unknown", None), ("current", 48.0)]


def test_policy_references():
    payload = json.loads((Path(__file__).parent.parent / "factloom/data/evidence_policy.json").read_text())
    parse_policy(payload)
    for change in (lambda p: p["fields"]["adc.dar"]["preferred_sources"].append("nobody"), lambda p: p["fact_statuses"].remove("current"),
                   lambda p: p["scope"]["prohibited_jobs"].append("comparison"), lambda p: p["fields"]["trial.phases"].update(preferred_sources=["curated_seed"]),
                   lambda p: p["change_types"]["source.record_missing"].update(tracked_field="adc.nothing"), lambda p: p["scope"]["targets"].append("HER2")):
        broken = json.loads(json.dumps(payload))
        change(broken)
        with pytest.raises(ValueError):
            parse_policy(broken)


def test_a_batch_on_a_stored_state_equals_one_fold(spark, tmp_path):
    rng, policy = random.Random(11), load_policy()
    rows = [observation(i, f"s{rng.randrange(4)}", rng.choice(FIELDS), rng.choice(SOURCES), rng.sample(["1", "2", "3"], rng.randrange(3)), rng.choice(["https://x", "https://y"]), f"r{rng.randrange(2)}")
            for i in range(1, 241)]
    rows = [r for r in rows if not (r[2] == "trial.overall_status" and r[3] == "curated_seed")]
    table = spark.createDataFrame(rows, schemas.OBSERVATION)
    whole = facts.reconcile(table, policy, 20, 10)
    show = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    store, events, cuts = None, None, (0, 120, 125, 241)
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        batch = table.where((F.col("seq") >= low) & (F.col("seq") < high))
        if store is None:
            first = facts.reconcile(batch, policy)
            store, events = (first.facts, first.evidence), first.events
            continue
        fact_batch.write_state(*store, str(tmp_path / f"state{number}"), buckets=8)
        applied = fact_batch.apply_batch(*fact_batch.read_open(spark, str(tmp_path / f"state{number}"), batch, buckets=8), batch, policy, 20, 10)
        counters = applied.counters.first()
        assert counters.groups_processed + counters.idempotent_groups == batch.count()
        assert counters.changes_created == applied.events.count()
        store, events = fact_batch.merged(*store, applied), events.unionByName(applied.events)
    assert show(store[0]) == show(whole.facts)
    assert show(store[1]) == show(whole.evidence)
    assert show(events) == show(whole.events)


def test_a_batch_must_come_later_and_may_be_empty(spark):
    policy = load_policy()
    table = spark.createDataFrame([observation(5, "a", "adc.dar", "adcdb", ["1"])], schemas.OBSERVATION)
    store = facts.reconcile(table, policy)
    with pytest.raises(ValueError):
        fact_batch.apply_batch(store.facts, store.evidence, table, policy)
    nothing = fact_batch.apply_batch(store.facts, store.evidence, table.limit(0), policy)
    assert tuple(nothing.counters.first()) == (0, 0, 0, 0, 0) and nothing.facts.isEmpty() and nothing.events.isEmpty()


def test_short_fields_are_dealt_once_whatever_their_sequence_spans(spark):
    one = facts.value_struct(F.lit("user.click"), F.col("id").cast("string"), F.col("id").cast("string"))
    seen = spark.range(60).select(
        F.lit("user").alias("subject_type"), (F.col("id") % 3).cast("string").alias("subject_id"), F.lit("user.click").alias("predicate"), F.array(one).cast(facts.VALUES_TYPE).alias("values"),
        F.lit("registry").alias("source"), F.lit("r").alias("source_record_id"), F.lit("2024-01-01").alias("observed_at"), F.lit("u").alias("source_url"),
        F.lit(None).cast("string").alias("snapshot_id"), (F.col("id") * 10**6).alias("seq"))
    plan = facts.change_steps(seen)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
    cut = facts.change_steps(seen, 5)  # 20 observations of each field: long ones
    assert "Join" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, cut.collect())) == sorted(map(str, facts.change_steps(seen).collect()))
