"""Report gates, checked unions and total orders."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import gates
from factloom.operators.gates import Rule


def test_each_kind_of_rule(spark):
    rows = [("g", "r1", "arm", "a"), ("g", "r1", "model", "m"), ("g", "r1", "set", "1"), ("g", "r2", "arm", "b"), ("g", "r2", "set", "1"), ("h", "r1", "arm", "c"), ("h", "r1", "model", " "), ("h", "r1", "set", "1"),
            ("h", "r2", "arm", None), ("h", "r2", "model", "x"), ("h", "r2", "other", "1")]
    rules = [Rule("arm", "one_of", ("a", "b")), Rule("model", "present"), Rule("set", "same"), Rule("model", "one_of", ("m",), ("arm", "a"))]
    got = sorted(map(tuple, gates.report_violations(spark.createDataFrame(rows, "group string, report string, key string, value string"), rules).collect()), key=str)
    assert got == sorted([("g", "r2", "model", "present", None), ("h", "r1", "arm", "one_of", "c"), ("h", "r1", "model", "present", " "), ("h", "r2", "arm", "one_of", None),
                          ("h", "r1", "set", "same", "1"), ("h", "r2", "set", "same", None)], key=str)


def test_outputs_and_questions_must_meet_one_to_one(spark):
    outputs = spark.createDataFrame([("1", "answered", "x"), ("2", "what", "x"), ("3", "error", None), ("3", "error", "x"), ("9", "partial", "x"), (None, "partial", "x")], "question_id string, status string, answer string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "question_id string")
    got = sorted(map(tuple, gates.output_violations(outputs, asked).collect()), key=str)
    assert got == sorted([("2", "invalid_status"), ("3", "missing_answer"), ("3", "more_than_one_output"), ("4", "missing_output"), ("9", "unknown_question"), (None, "unknown_question")], key=str)


def test_row_hash_does_not_depend_on_the_order_of_columns(spark):
    df = spark.createDataFrame([("1", [("b", 2)], None)], "question_id string, claims array<struct<z:string,a:int>>, gone string")
    one, two = gates.with_output_hash(df).first(), gates.with_output_hash(df.select("gone", "claims", "question_id")).first()
    assert one.output_hash == two.output_hash and one.output == '{"claims":[{"a":2,"z":"b"}],"gone":null,"question_id":"1"}'


def test_a_union_with_other_numbers_or_repeated_ids_fails(spark):
    a, b = (spark.createDataFrame(rows, "question_id string, q string") for rows in ([("1", "x"), ("2", "y")], [("1", "z")]))
    assert sorted(r.question_id for r in gates.checked_union({"a": a, "b": b}, {"a": 2, "b": 1}).collect()) == ["a:1", "a:2", "b:1"]
    for parts, counts in (({"a": a, "b": b}, {"a": 2, "b": 2}), ({"a": a.unionAll(a)}, {"a": 4}), ({"a": spark.createDataFrame([(" ", "x")], a.schema)}, {"a": 1}), ({"a": spark.createDataFrame([(None, "x")], a.schema)}, {"a": 1})):
        with pytest.raises(Exception, match="stated numbers"):
            gates.checked_union(parts, counts).collect()


def test_places_in_a_total_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "B", "b", None])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(9)
    got = gates.in_order(df, [F.lower("name").asc_nulls_first(), F.col("k")]).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[0]))
    assert [(r.k, r.name) for r in sorted(got, key=lambda r: r.position)] == order
    assert sorted(r.position for r in got) == list(range(1, 3_001))
