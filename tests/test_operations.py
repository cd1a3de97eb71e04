"""Run log, gates, merges, statistics, question sets and streams."""

import datetime as dt
import hashlib
import math
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import stats
from factloom.operators import audits, benchmark, evaluation, merge, relational, runs
from factloom.streaming import facts as streams

T0 = dt.datetime(2024, 1, 1)


def run(n, source="s", status="complete", complete=True, count=10, planned=False, expected=None):
    return (f"r{n}", source, T0 + dt.timedelta(days=n), T0 + dt.timedelta(days=n, hours=1), status, 1, expected, count, complete, None, planned)


def gate_map(spark, log, members, run_id, **options):
    g = runs.refresh_gates(spark.createDataFrame(log, schemas.RUN), spark.createDataFrame(members, schemas.MEMBER), run_id, ["s"], **options)
    return {r.name: (r.passed, r.blocking) for r in g.collect()}, runs.gates_passed(g).first()[0]


def test_gates(spark):
    log = [run(1), run(2, count=9)]
    members = [("r1", "s", str(i)) for i in range(10)] + [("r2", "s", str(i)) for i in range(9)]
    checks, passed = gate_map(spark, log, members, "r2")
    assert checks["missing_records"] == (False, True) and checks["count_anomaly:s"] == (True, True) and not passed
    assert gate_map(spark, log, members, "r2", max_missing=1)[1]
    # a partial run reports a failure, not missing records
    events = runs.source_events(spark.createDataFrame([run(1), run(2, status="partial", complete=False)], schemas.RUN), spark.createDataFrame(members, schemas.MEMBER))
    assert [r.event_type for r in events.collect()] == ["source.collection_failed"]
    # planned truncation switches missing detection off without blocking; an unplanned one blocks
    for planned in (True, False):
        checks, passed = gate_map(spark, [run(1), run(2, complete=False, planned=planned)], members, "r2")
        assert checks["missing_detection_scope:s"] == (planned, not planned) and checks["missing_records"] == (True, True) and passed == planned
    # an empty complete response drops the count and loses every record
    checks, passed = gate_map(spark, [run(1), run(2, count=0)], members[:10], "r2")
    assert checks["count_anomaly:s"] == (False, True) and checks["missing_records"][0] is False and not passed
    assert gate_map(spark, [run(1, count=0), run(2)], [], "r2")[0]["count_anomaly:s"] == (True, True)
    assert gate_map(spark, [run(1)], [], "r9")[0]["source_status:s"] == (False, True)


def test_run_maintenance(spark):
    log = spark.createDataFrame([run(1, status="running"), run(5, status="running"), run(1, "t")], schemas.RUN)
    done = {(r.run_id, r.source): r.status for r in runs.stale_runs(log, F.lit("2024-01-06 01:00:00").cast("timestamp"), "3 DAYS").collect()}
    assert done == {("r1", "s"): "failed", ("r5", "s"): "running", ("r1", "t"): "complete"}
    members = spark.createDataFrame([("r1", "s", "a"), ("r1", "t", "b")], schemas.MEMBER)
    fresh, left = runs.restart_source_run(log, members, "r1", "t", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    row = fresh.filter("run_id = 'r1' AND source = 't'").first()
    assert (row.status, row.collected_count, row.finished_at) == ("running", 0, None) and [r.source for r in left.collect()] == ["s"]
    states = {r.run_id: (r.coverage_state, r.coverage_ratio, r.coverage_ratio_reason) for r in runs.source_coverage(spark.createDataFrame(
        [run(1, expected=10), run(2, expected=20), run(3), run(4, status="failed", expected=10), run(5, complete=False, expected=0)], schemas.RUN)).collect()}
    none = "expected_count_missing_or_nonpositive"
    assert states == {"r1": ("complete", 1.0, None), "r2": ("partial", 0.5, None), "r3": ("unknown", None, none), "r4": ("unknown", 1.0, None), "r5": ("partial", None, none)}


def test_merges(spark):
    old = spark.createDataFrame([("a", "Old", "HER2", 1.0, "approved"), ("b", "Keep", "X", None, "unknown")], "k string, n string, target string, dar double, development_status string")
    new = spark.createDataFrame([("a", "New", "unknown", None, "unknown"), ("c", "Add", "unknown", 2.0, "unknown")], old.schema)
    got = {r.k: tuple(r)[1:] for r in merge.merge_catalogue(old, new, "k", overwrite=["n"]).collect()}
    assert got == {"a": ("New", "HER2", 1.0, "approved"), "b": ("Keep", "X", None, "unknown"), "c": ("Add", "unknown", 2.0, "unknown")}
    kept = {r.k: r.n for r in merge.update_keeping(old, new, "k", ["n"]).collect()}
    assert kept == {"a": "Old", "b": "Keep", "c": "Add"}
    cat = spark.createDataFrame([("e", "N", ["z"], "T", None, None, None, None, 1.0, None, "unknown", None, "u", "reviewed")],
                                "entity_id string, name string, aliases array<string>, target string, antibody string, linker_name string, payload_name string, payload_class string, "
                                "dar double, indication string, development_status string, company string, source_url string, data_review_status string")
    ext = spark.createDataFrame([("e", None, "ab", None, "pay", None, "Org", ["a", "z"], "Brand", None, "approved", "https://d")],
                                "entity_id string, target string, antibody_name string, linker_name string, payload_name string, representative_indication string, organization string, "
                                "synonyms array<string>, brand_name string, dar double, development_status string, detail_url string")
    row = merge.merge_external_record(ext, cat, "entity_id").first()
    assert (row.target, row.antibody, row.aliases, row.dar, row.company, row.data_review_status) == ("T", "ab", ["Brand", "a", "z"], 1.0, "Org", "needs_review")
    red = merge.redact_paths(spark.createDataFrame([("/home/x/a.json",), ("C:\\d\\b.xml",), ("",)], "raw_path string"), "raw_path", "trials")
    assert [r.raw_path for r in red.collect()] == ["raw/trials/a.json", "raw/trials/b.xml", ""]


def test_search_takes_wildcards_literally(spark):
    c = spark.createDataFrame([("1", "50% alpha", "T"), ("2", "beta", "T"), ("3", "gamma", None)], "k string, n string, p string")
    a = spark.createDataFrame([("2", "A_1"), ("2", "B"), ("3", "AX1")], "k string, alias string")
    find = lambda q: sorted(r.k for r in relational.search_catalogue(c, a, q, key="k", search_columns=["n", "p"]).collect())
    assert (find("%"), find("a_1"), find(" "), find("ALPHA")) == (["1"], ["2"], ["1", "2", "3"], ["1"])


def test_statistics(spark):
    for s, n in ((9, 11), (0, 0), (3, 3), (500, 1100), (2, 40)):
        k = min(s, n - s)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert math.isclose(stats._two_sided(s, n), exact, rel_tol=1e-9)
    assert 0 < stats._two_sided(10**6, 2 * 10**6 + 1500) < 1
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.9)], "f string, k string, p double")
    got = {r.k: round(r.adjusted, 6) for r in stats.holm_adjust(df, "p", ["f"], ["k"]).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.9}
    pairs = spark.createDataFrame([(True, False)] * 9 + [(False, True)] * 2 + [(True, True)] * 30, "system boolean, baseline boolean").withColumn("g", F.lit("x"))
    counts = evaluation.with_exact_test(evaluation.paired_counts(pairs, ["g"]))
    row = evaluation.bootstrap_interval(counts, ["g"], iterations=2000).first()
    assert (row.system_only, row.baseline_only, row.discordant, row.p_value) == (9, 2, 11, 0.06543)
    assert row.ci_lower < row.difference < row.ci_upper and -0.05 < row.ci_lower < 0.1
    assert row == evaluation.bootstrap_interval(counts, ["g"], iterations=2000).first()


def test_bootstrap_draws_are_md5_words(spark):
    def plain(n, plus, minus, name, iterations):
        for i in iterations:
            draws = [int.from_bytes(hashlib.md5(f"{name}:{i}:{j}".encode()).digest()[4 * k:4 * k + 4], "big") * n >> 32 for j in range(-(-n // 4)) for k in range(4) if 4 * j + k < n]
            yield sum(1 if d < plus else -1 if d < plus + minus else 0 for d in draws)

    for n, plus, minus, name in ((1, 1, 0, "0:x"), (403, 90, 120, "0:é"), (64, 0, 64, "0:" + "long" * 30)):
        quads = -(-n // 4)
        row = {"name": name, "n": n, "p": plus, "m": minus, "i": 8, "i_end": 103}
        cells = pd.DataFrame([{**row, "j": 0, "j_end": quads // 3}, {**row, "j": quads // 3, "j_end": quads}])
        sums = pd.concat(evaluation._draws(iter([cells]))).groupby("__i")["d"].sum()
        assert sums.tolist() == list(plain(n, plus, minus, name, range(8, 103)))
    # 20,000 pairs: 50 million digests of 4 draws, in no more than a fraction of the time of one digest after the other
    counts = spark.createDataFrame([("x", 20_000, 3_000, 2_900)], "g string, question_count long, system_only long, baseline_only long")
    begun = time.perf_counter()
    assert evaluation.bootstrap_interval(counts, ["g"]).first().ci_lower < 0.005
    assert time.perf_counter() - begun < 60


def test_question_sets(spark):
    a = spark.createDataFrame([("1", "What is X?"), ("2", "b")], "question_id string, question string")
    b = spark.createDataFrame([("9", "what IS x"), ("9", "WHAT is x!"), ("2", "other")], a.schema)
    got = sorted(map(tuple, evaluation.overlapping_questions(a, b).collect()))
    assert got == [("1", "wording", 2, "9"), ("2", "id", 1, "2")]
    with pytest.raises(ValueError):
        evaluation.require_same_ids(a, b)
    rows = spark.createDataFrame([("q", "dev", "c", "t", "refusal", ["refused"], True, "refusal", [], "m"), ("w", "x", "c", " ", "refusal", [], False, "odd", [("pubmed", "", "u", "f")], "")],
                                 "question_id string, split string, category string, question string, expected_route string, expected_status array<string>, should_refuse boolean, kind string, "
                                 "evidence_sources array<struct<source_type:string,source_record_id:string,source_url:string,field:string>>, primary_metric string")
    bad = evaluation.benchmark_violations(rows, splits=["dev"], categories=["c"], statuses=["refused"], kinds=["refusal"], routes=["refusal"])
    assert {r.reason for r in bad.collect()} == {"invalid_split", "empty_question", "invalid_status", "refusal_mismatch", "invalid_answer_kind", "incomplete_source", "missing_metric"}
    assert {r.question_id for r in bad.collect()} == {"w"}


def test_generated_benchmark_scores_itself(spark):
    cat = spark.createDataFrame([("e1", "Alpha", "HER2", "P1", 0), ("e2", "Beta", "TROP2", None, 1), ("e3", "Gamma", "HER2", "P3", 2)],
                                "entity_id string, name string, target string, payload_name string, entity_number bigint")
    trials = spark.createDataFrame([("N1", "OPEN", ["PHASE1", "PHASE2"]), ("N2", "DONE", ["PHASE3"])], "nct_id string, overall_status string, phases array<string>")
    tl = spark.createDataFrame([("e1", "N2"), ("e1", "N1"), ("e2", "N2")], "entity_id string, nct_id string")
    pubs = spark.createDataFrame([("pubmed:1", "Other", "about alpha"), ("pubmed:2", "Alpha study", "")], "document_id string, title string, abstract string")
    pl = spark.createDataFrame([("e1", "pubmed:1"), ("e1", "pubmed:2")], "entity_id string, document_id string")
    names = cat.select("entity_id", "name")
    topics = spark.createDataFrame([("pubmed:1", "safety"), ("pubmed:2", "other")], "document_id string, topic string")
    gold = relational.union_all([
        benchmark.fact_questions(cat), benchmark.comparison_questions(cat.filter("payload_name IS NOT NULL")), benchmark.trial_questions(trials, tl),
        benchmark.literature_questions(pubs, pl, names), benchmark.topic_questions(topics, pl, names),
        benchmark.refusal_questions(spark.createDataFrame([("refusal_1", "x")], "question_id string, question string"))]).cache()
    by_id = {r.question_id: r for r in gold.collect()}
    assert by_id["fact_e2_payload_name"].kind == "gap" and by_id["literature_e1"].accepted_documents == ["pubmed:2", "pubmed:1"]
    assert by_id["compare_0"].question == "比较 Alpha 和 Gamma 的载荷。" and by_id["compare_2"].question == "比较 Gamma 和 Alpha 的载荷。"
    assert by_id["trial_e1"].question.startswith("试验 N1 ") and by_id["topic_safety_e1"].accepted_documents == ["pubmed:1"]
    outputs = gold.select(
        "question_id", F.when(F.col("should_refuse") | (F.col("kind") == "gap"), "refused").otherwise("answered").alias("status"), F.col("expected_route").alias("route"),
        F.transform("expected_cells", lambda c: F.struct(F.coalesce(c["subject_id"], F.lit("s")).alias("subject_id"), F.concat(F.lit("adc."), c["field"]).alias("predicate"),
                                                         c["values"].alias("values"))).alias("claims"), F.col("accepted_documents").alias("cited"))
    scores = evaluation.score_answers(gold.withColumn("evidence_ids", F.col("accepted_documents")), outputs)
    total = {r.category: r for r in evaluation.score_report(scores).collect()}["overall"]
    assert total.route == 1.0 and total.status == 1.0 and total.evidence == 1.0
    assert {r.question_id for r in scores.filter("answer < 1").collect()} == {"fact_e2_payload_name"}


def test_audit_pieces(spark):
    late = audits.late_dates(spark.createDataFrame([("1", "2024-05"), ("2", "2023"), ("3", "bad")], "source_record_id string, d string"), "d", F.lit("2024-01-01").cast("date"), "source_record_id")
    assert [r.source_record_id for r in late.collect()] == ["1"]
    h = spark.createDataFrame([("1", "entrez", dt.date(2023, 5, 1), "h", "h")], "source_record_id string, event string, event_date date, raw_hash string, expected_hash string")
    assert audits.late_publication_review(late, h, F.lit("2024-01-01").cast("date")).first().review == "advance_issue_date"
    c = spark.createDataFrame([("a", "marketed"), ("b", "withdrawn")], "adc_id string, catalog_status string")
    r = spark.createDataFrame([("a", "x"), ("b", "y")], "adc_id string, scope_class string")
    assert {x.scope: x.n for x in audits.scope_counts(c, {"x": True, "y": False}, r).collect()} == {"core:marketed": 1, "extended:withdrawn": 1}


def test_streams(spark, tmp_path):
    from test_facts import observation

    source = tmp_path / "in"
    batches = [[observation(1, "a", "adc.dar", "adcdb", ["1"]), observation(2, "a", "adc.dar", "curated_seed", ["9"])],
               [observation(3, "a", "adc.dar", "adcdb", ["1"]), observation(4, "a", "adc.dar", "adcdb", ["2"])], [observation(5, "a", "adc.dar", "adcdb", [])]]
    for batch in batches:
        spark.createDataFrame(batch, schemas.OBSERVATION).coalesce(1).write.mode("append").json(str(source))
    stream = streams.read_observations(spark, str(source), files_per_batch=1)
    query = streams.value_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.seq, r.old_values, r.new_values) for r in spark.table("changes").collect()) == [(4, ["1"], ["2"]), (5, ["2"], [])]
    streams.append_batches(streams.read_observations(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert streams.read_appended(spark, str(tmp_path / "out")).count() == 5
    events = spark.createDataFrame([(i, T0 + dt.timedelta(hours=7 * i), "view" if i % 2 else "click", float(i)) for i in range(10)] * 2, "event_id bigint, ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streams.windowed_counts(streams.unique_events(live), lateness=None).writeStream.format("memory").queryName("windows").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] in (7, 8)
