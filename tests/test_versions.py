"""Canonical JSON text and id checks."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import evaluation


def test_json_text_of_control_characters(spark):
    texts = ["plain é 语", 'a"b\\c', "".join(map(chr, range(32))), "\x7f ", "", "\\u0001"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.json_string(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in got} == {t: json.dumps(t, ensure_ascii=False) for t in texts}


def test_unequal_question_ids_are_an_error(spark):
    left, right = (spark.createDataFrame([(q, "a") for q in ids_], "question_id string, status string") for ids_ in (["q1", "q2"], ["q1"]))
    with pytest.raises(ValueError, match="q2"):
        evaluation.changed_outputs(left, right, ["status"])
