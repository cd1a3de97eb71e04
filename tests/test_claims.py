"""Canonical JSON, structured claim checks and nested cards."""

import json
import random

from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import ids, text as tx
from factloom.operators import cards, claims, facts
from factloom.policy import load_policy


def some_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind == 0:
        return rng.choice([0, -0.0, 8, 8.0, 1.5, -3, 1e16, 1.5e-7, 123456789.25, 1e22, 0.0001, 12345678901234567890, 7.6, 100000.0, 2**53])
    if kind == 1:
        return rng.choice(["  a b ", "é\n", '"q"', "back\\slash", "\u0001n5", "\u0001t", "tab\t", "\u001f x", "", "日本", "/", "a:b", "8", ":"])
    if kind < 4:
        return [None, True][kind - 2]
    if kind < 6:
        return "word"
    if kind < 8:
        return {rng.choice(["b", "a", "é", "z k", "A", "\u0001n1", 'x"y', "back\\", ":", ""]) + str(rng.randrange(3)): some_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]


def stripped(v):
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, dict):
        return {k: stripped(x) for k, x in v.items()}
    return [stripped(x) for x in v] if isinstance(v, list) else v


def test_canonical_json_is_that_of_a_plain_encoder(spark):
    rng = random.Random(4)
    values = [some_value(rng, 4) for _ in range(200)]
    rows = [(json.dumps(v, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1])), json.dumps(stripped(v), ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for i, v in enumerate(values)]
    rows += [("{bad", None), ("", None), (None, None), ('{"a":1,"a":2}', None), ("8 or so", None), ("1,2", None), ("1],[2", None), ("1,0],[2", None), (" 8.50 ", "8.5")]
    for r in spark.createDataFrame(rows, "t string, want string").select("t", "want", ids.canonical_json(F.col("t"), tx.strip).alias("got")).collect():
        assert r.got == r.want, r.t


def test_nested_values_become_facts(spark):
    rows = [(1, [{"z": " b ", "a": 1.0}, {"z": None, "a": 8.5}], {"k": ["x "]}), (2, None, None)]
    df = spark.createDataFrame(rows, "seq long, places array<struct<z:string,a:double>>, more map<string,array<string>>").withColumn("id", F.col("seq").cast("string"))
    seen = facts.observe(df, {"p.places": ("places", "nesteds"), "p.more": ("more", "nested")}, subject_type="p", subject_id="id", source="s", record_id="id", observed_at=F.lit("t"), source_url=F.lit("u"),
                         snapshot_id=None, extractor="x")
    got = {(r.subject_id, r.predicate): [v.value_json for v in r["values"]] for r in seen.collect()}
    assert got == {("1", "p.places"): ['{"a":1.0,"z":"b"}', '{"a":8.5,"z":null}'], ("1", "p.more"): ['{"k":["x"]}'], ("2", "p.places"): [], ("2", "p.more"): []}


def hashed(spark, rows):
    df = spark.createDataFrame(rows, "subject_id string, predicate string, value string, is_open boolean")
    return df.select(F.lit("adc").alias("subject_type"), "subject_id", "predicate", ids.value_hash("value").alias("value_hash"), "is_open")


def test_each_leg_of_a_claim(spark):
    store = hashed(spark, [("a", "adc.dar", "8.0", True), ("a", "adc.dar", "7.0", False), ("a", "adc.x", '{"a":1,"b":[2]}', True), ("b", "adc.dar", "1", True), ("b", "adc.dar", "2", True)])
    proof = spark.createDataFrame([("S1", "adc", "a", "adc.dar", True), ("S2", "adc", "a", "adc.dar", False), ("S3", "adc", "a", "adc.x", True), ("S4", "adc", "b", "adc.dar", True)],
                                  "evidence_id string, subject_type string, subject_id string, predicate string, is_current boolean")
    cases = [("right", "a", "adc.dar", ["8.0"], ["S1", "S1"], None), ("loose", "a", "adc.x", ['{ "b": [2], "a": 1 }'], ["S3"], None), ("wrong", "a", "adc.dar", ["7.5"], ["S1"], "value_not_equal_to_structured_field"),
             ("type", "a", "adc.dar", ["8"], ["S1"], "value_not_equal_to_structured_field"), ("old", "a", "adc.dar", ["7.0"], ["S1"], "value_no_longer_current"),
             ("stale", "a", "adc.dar", ["8.0"], ["S2"], "evidence_no_longer_current"), ("none", "a", "adc.dar", ["8.0"], [], "missing_field_evidence"), ("null", "a", "adc.dar", ["8.0"], None, "missing_field_evidence"),
             ("foreign", "a", "adc.dar", ["8.0"], ["S1", "S3"], "citation_not_bound_to_field"), ("field", "c", "adc.dar", ["8.0"], ["S9"], "citation_not_bound_to_field"),
             ("half", "b", "adc.dar", ["1"], ["S4"], "value_not_equal_to_structured_field"), ("both", "b", "adc.dar", ["2", "1", "1"], ["S4"], None), ("empty", "a", "adc.dar", [], ["S1"], "value_not_equal_to_structured_field"),
             ("text", "a", "adc.dar", ["8.0 or so"], ["S1"], "value_not_equal_to_structured_field")]
    made = spark.createDataFrame([c[:5] for c in cases], "claim_id string, subject_id string, predicate string, values array<string>, citations array<string>").withColumn("subject_type", F.lit("adc"))
    got = {r.claim_id: (r.reason, r.supported) for r in claims.claim_checks(made, store, proof).collect()}
    assert got == {c[0]: (c[5], c[5] is None) for c in cases}
    assert claims.claim_checks(made.limit(0), store, proof).isEmpty()


def test_nested_cards_keep_all_evidence_on_pages(spark):
    policy = load_policy()
    rows = [("adc", "a", "adc.dar", "adcdb", f"r{i:03d}", f"2024-01-01 00:00:{i:02d}", "https://x", None, 1.0, "x", "needs_review", i + 1, [(v, v, "l", None) for v in (["8.0"] if i % 4 else ["8.0", f"{i}"])])
            for i in range(40)]
    store = facts.reconcile(spark.createDataFrame(rows, schemas.OBSERVATION), policy)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    whole = cards.nested_cards(store.facts, store.evidence, None, policy, now)
    paged = cards.nested_cards(store.facts, store.evidence, None, policy, now, fact_limit=2, evidence_limit=5)
    listed = lambda df: sorted((f.display_value, e.source_record_id) for r in df.collect() for f in r.facts for e in f.evidence)
    assert whole.count() == 1 and paged.count() > 3 and len(listed(whole)) == 50
    assert listed(paged) == listed(whole)
    for r in paged.collect():
        assert (r.fact_count, r.evidence_count, r.review_status) == (11, 50, "needs_review")
        assert [f.display_value for f in r.facts] == sorted(f.display_value for f in r.facts)
    body = json.loads(cards.brief_json(whole).first().body)
    assert body["fact_count"] == 11 and [list(f) for f in body["facts"]][0] == sorted(body["facts"][0])
    lines = [r.text for r in cards.brief_lines(whole, policy).orderBy("page", "line").collect()]
    assert sum(x.startswith("#### ") for x in lines) == 11 and sum(x.startswith("- **") for x in lines) == 50


def test_every_character_of_a_string_is_escaped_as_by_a_plain_encoder(spark):
    texts = [chr(c) for c in range(0x80)] + ["a\x1fb\\\"\n\x0b", "", "é日\U0001f600\x7f ", "\x0e" * 3, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.json_string(F.col("t")).alias("j"))
    for r in df.collect():
        assert r.j == (None if r.t is None else json.dumps(r.t, ensure_ascii=False))
