"""Block-wise scans against plain Python."""

import random

import pytest

from factloom.operators import scan
from pyspark.sql import functions as F


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_scans(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("aaab"), seq, rng.randrange(-3, 4)) for seq in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int").repartition(4)
    ordered, total, last, prev, want = sorted(rows, key=lambda r: r[1]), {}, {}, {}, {}
    for k, seq, v in ordered:
        total[k] = total.get(k, 0) + v
        if v > 0:
            last[k] = v
        want[seq] = (total[k], last.get(k), prev.get(k))
        prev[k] = v
    got = scan.running_sum(df, ["k"], "seq", {"total": "v"}, block)
    got = scan.running_last(got, ["k"], "seq", {"last": F.when(F.col("v") > 0, F.col("v"))}, block)
    got = scan.neighbour(got, ["k"], "seq", {"before": "v"}, block=block)
    assert {r.seq: (r.total, r["last"], r.before) for r in got.collect()} == want
    after = {r.seq: r["after"] for r in scan.neighbour(df, ["k"], "seq", {"after": "v"}, direction="next", block=block).collect()}
    for k in "ab":
        own = [r for r in ordered if r[0] == k]
        assert all(after[a[1]] == b[2] for a, b in zip(own, own[1:])) and after[own[-1][1]] is None


def test_pairs_wrap_around(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(7)], "k bigint")
    pairs = dict(map(tuple, scan.pair_with_next(df, "k", block=4).collect()))
    assert pairs == {0: 3, 3: 6, 6: 9, 9: 12, 12: 15, 15: 18, 18: 0}
