"""Raw files to a published version, a second refresh, and questions answered from it."""

import pytest
from pyspark.sql import functions as F

from factloom import workflow
from factloom.operators import cards, merge, retrieval, service
from factloom.policy import load_policy
from raw_files import write_raw


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("flow")
    root = str(base / "published")
    first = workflow.refresh(spark, write_raw(base / "raw1"), "r1", 1, "2024-01-01T00:00:00+00:00")
    assert first.passed
    workflow.publish(spark, root, "r1", first)
    second = workflow.refresh(spark, write_raw(base / "raw2", second=True), "r2", 2, "2024-01-08T00:00:00+00:00", previous=root)
    assert second.passed
    workflow.publish(spark, root, "r2", second)
    return root


def test_pointer_and_immutable_versions(spark, published):
    assert merge.current_version(spark, published) == "r2"
    assert merge.read_current(spark, published, "runs").count() == 4
    with pytest.raises(Exception):
        merge.publish_version(spark, published, "r2", {"runs": merge.read_current(spark, published, "runs")}, {})
    assert merge.current_version(spark, published) == "r2"


def test_status_change_becomes_one_event(spark, published):
    events = merge.read_current(spark, published, "events").filter("subject_id = 'NCT00000002'").collect()
    assert [(e.event_type, e.old_value_json, e.new_value_json) for e in events] == [
        ("trial.overall_status.changed", '["RECRUITING"]', '["COMPLETED"]')]
    assert events[0].severity == "high" and events[0].review_required


def test_conflicting_sources_are_flagged(spark, published):
    f = merge.read_current(spark, published, "facts").filter("subject_id = 'e1' AND predicate = 'adc.dar' AND valid_to IS NULL")
    assert sorted((r.display_value, r.status) for r in f.collect()) == [("3.5", "conflicted"), ("4.0", "conflicted")]


def test_unchanged_documents_keep_their_chunks(spark, published):
    docs = merge.read_current(spark, published, "documents")
    chunks = merge.read_current(spark, published, "chunks")
    assert docs.count() == 7
    assert chunks.select("retrieval_document_id").distinct().count() == 7
    assert chunks.filter("retrieval_document_id = 'trial:NCT00000002' AND content LIKE '%COMPLETED%'").count() == 1


def test_search_modes(spark, published):
    store = workflow.open_store(spark, published)
    index = merge.read_current(spark, published, "index")
    q = spark.createDataFrame([("a", "bystander killing payload release"), ("b", "neutropenia adverse event")], "question_id string, question string")
    for mode in ("sparse", "dense", "hybrid"):
        top = {r.question_id: r.retrieval_document_id for r in retrieval.search(mode, store.chunks, q, index=index, top_k=3).filter("rank = 1").collect()}
        assert top["a"] == "pubmed:101", mode
        assert top["b"] == "pubmed:102", mode
    with pytest.raises(ValueError):
        retrieval.search("other", store.chunks, q, index=index)


def test_questions_follow_their_routes(spark, published):
    store = workflow.open_store(spark, published)
    rows = [("fact", "Alphamab vedotin 的靶点是什么？"), ("gap", "Gammamab tesirine 的载荷是什么？"), ("conflict", "Alphamab vedotin 的 DAR 是多少？"),
            ("compare", "比较 Alphamab vedotin 和 Betamab deruxtecan 的靶点。"), ("trial", "试验 NCT00000002 当前登记状态和阶段是什么？"),
            ("change", "最近30天 Betamab deruxtecan 有什么变化？"), ("paper", "Alphamab vedotin 的机制文献 bystander killing"), ("pmid", "PMID: 102 的文献 neutropenia adverse event"),
            ("personal", "我是患者，应该使用 Alphamab vedotin 吗？"), ("scope", "What is the weather?")]
    q = spark.createDataFrame(rows, "question_id string, question string")
    out = {r.question_id: r for r in service.answer_questions(q, store, load_policy(), F.lit("2024-01-10 00:00:00").cast("timestamp")).collect()}
    assert len(out) == len(rows)
    assert (out["fact"].route, out["fact"].status) == ("structured_fact", "answered") and "HER2" in out["fact"].answer
    assert out["gap"].status == "refused" and out["conflict"].status == "refused"
    assert out["compare"].route == "comparison" and out["compare"].claim_count == 2
    assert out["trial"].route == "trial_lookup" and "COMPLETED" in out["trial"].answer and "PHASE1；PHASE2" in out["trial"].answer
    assert out["change"].route == "change_query" and "RECRUITING → COMPLETED" in out["change"].answer
    assert out["paper"].route == "literature_evidence" and out["paper"].status == "answered" and "Bystander killing" in out["paper"].answer
    assert out["pmid"].status == "answered" and "Neutropenia" in out["pmid"].answer
    assert (out["personal"].status, out["personal"].refusal_reason) == ("refused", "personalized_medical_advice")
    assert out["scope"].refusal_reason == "out_of_scope"


def test_card_and_exports(spark, published):
    store = workflow.open_store(spark, published)
    subjects = store.catalogue.select(F.col("entity_id").alias("subject_id"))
    fields = cards.card_fields(subjects, store.facts, store.evidence, None, load_policy(), cards.ENTITY_FIELDS, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    card = {r.predicate: r for r in fields.filter("subject_id = 'e1'").collect()}
    assert len(card) == 10 and card["adc.dar"].status == "conflicted" and card["adc.target"].sources == "adcdb,curated_seed"
    names = store.catalogue.select(F.col("entity_id").alias("subject_id"), "name")
    table = cards.comparison_table(fields, names, ["e1", "e2"], {"data_version": "d1"})
    assert len(table.columns) == 1 + 2 + 14 and table.count() == 10
    lines = [r.text for r in cards.comparison_markdown(fields, names, ["e1", "e2"]).collect()]
    assert lines[0] == "| 字段 | Alphamab vedotin | Betamab deruxtecan |" and len(lines) == 12 and any("（冲突）" in x for x in lines)
    with pytest.raises(ValueError):
        cards.compare(fields, ["e1"])


def test_vanished_records_block_publication(spark, published, tmp_path):
    raw = write_raw(tmp_path / "raw3", second=True)
    (tmp_path / "raw3" / "articles" / "set1.xml").write_text("<PubmedArticleSet></PubmedArticleSet>", encoding="utf-8")
    result = workflow.refresh(spark, raw, "r3", 3, "2024-01-15T00:00:00+00:00", previous=published)
    assert not result.passed
    with pytest.raises(RuntimeError):
        workflow.publish(spark, published, "r3", result)
    assert merge.current_version(spark, published) == "r2"
