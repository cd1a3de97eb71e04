"""The audit of declared rules against hand-made counts."""

import pytest

from factloom.operators.profiler import KeyRule, RowRule, audit


def test_rules_count_and_name_offenders(spark):
    trials = spark.createDataFrame([(i, "d" if i % 3 else None, i % 4, "x") for i in range(12)] + [(3, "d", 3, "x"), (None, "e", 9, "y")], "id long, drug string, phase int, rule string").repartition(3)
    drugs = spark.createDataFrame([("d",), ("d",), ("f",), (None,)], "name string")
    empty = spark.createDataFrame([], "id long")
    rules = [RowRule("phase", "trials", "phase > 2", "id"), RowRule("drug", "trials", "drug = 'nothing'", "id", "warning"), RowRule("none", "empty", "id > 0", "id"),
             KeyRule("once", "trials", ("id",)), KeyRule("pair", "trials", ("id", "phase")), KeyRule("known", "trials", ("drug",), "drugs", ("name",)), KeyRule("used", "drugs", ("name",), "trials", ("drug",), "warning"), KeyRule("no_keys", "empty", ("id",))]
    got = {r.rule: (r.checked, r.faults, r.share, r.status, r.offenders) for r in audit({"trials": trials, "drugs": drugs, "empty": empty}, rules, samples=2).collect()}
    assert got == {
        "phase": (14, 5, round(5 / 14, 6), "error", ["11", "3"]), "drug": (14, 0, 0.0, "pass", []), "none": (0, 0, 0.0, "pass", []),
        "once": (12, 1, round(1 / 12, 6), "error", ['["3"]']), "pair": (12, 1, round(1 / 12, 6), "error", ['["3","3"]']), "known": (2, 1, 0.5, "error", ['["e"]']),
        "used": (2, 1, 0.5, "warning", ['["f"]']), "no_keys": (0, 0, 0.0, "pass", [])}
    with pytest.raises(ValueError):
        audit({"trials": trials}, [rules[0], rules[0]])
