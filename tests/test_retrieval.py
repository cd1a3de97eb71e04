"""Search against SQLite's FTS5 and against brute force."""

import hashlib
import math
import random
import re
import sqlite3

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import answers, evaluation, retrieval

WORDS = ["alpha", "beta", "gamma", "délta", "8.0", "payload", "linker", "载荷", "HER2", "x-ray"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
        rows.append((f"c{i:03d}", f"d{i // 2:03d}", "pubmed" if i % 3 else "adc_profile", str(i), i % 2, pick(3), pick(rng.randrange(1, 30)), pick(rng.randrange(0, 3)),
                     ([f"e{i % 4}"], ["safety"] if i % 5 == 0 else [])))
    return spark.createDataFrame(rows, "chunk_id string, retrieval_document_id string, source_type string, source_record_id string, chunk_index int, title string, "
                                       "content string, entities string, metadata struct<adc_ids:array<string>,literature_topics:array<string>>").cache()


QUERIES = {"q1": "alpha payload", "q2": "8.0 delta", "q3": "载荷 HER2 ray", "q4": "zzz"}


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(QUERIES.items()), "question_id string, question string")


def test_bm25_equals_fts5(spark, chunks, questions):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id UNINDEXED, title, content, entities, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(r.chunk_id, r.title, r.content, r.entities) for r in chunks.collect()])
    terms = {"q1": '"alpha" OR "payload" OR "warhead" OR "cytotoxic"', "q2": '"8.0" OR "delta"', "q3": '"载荷" OR "her2" OR "ray" OR "payload" OR "warhead" OR "cytotoxic"'}
    terms["q1"] = '"alpha" OR "payload"'
    want = {(q, c): -s for q, match in terms.items()
            for c, s in con.execute("SELECT chunk_id, bm25(f, 1.0, 1.0, 0.8, 1.0) FROM f WHERE f MATCH ?", (match,))}
    got = {(r.question_id, r.chunk_id): r.score for r in retrieval.bm25_scores(chunks, questions).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_sparse_search_rules(spark, chunks, questions):
    scored = {(r.question_id, r.chunk_id): r.score for r in retrieval.bm25_scores(chunks, questions).collect()}
    info = {r.chunk_id: r for r in chunks.collect()}
    named = spark.createDataFrame([("q1", "e2")], "question_id string, entity_id string")
    got = retrieval.sparse_search(chunks, questions, top_k=5, source_type="pubmed", topic="safety", question_entities=named).collect()
    for q in QUERIES:
        pool = [(s, c) for (qq, c), s in scored.items() if qq == q and info[c].source_type == "pubmed"]
        on_topic = [x for x in pool if "safety" in info[x[1]].metadata.literature_topics]
        ranked = sorted(on_topic or pool, key=lambda x: (-x[0], x[1]))[:60]
        ranked.sort(key=lambda x: (q == "q1" and "e2" in info[x[1]].metadata.adc_ids, x[0]), reverse=True)
        seen, want = set(), []
        for s, c in sorted(ranked, key=lambda x: (-(q == "q1" and "e2" in info[x[1]].metadata.adc_ids), -x[0], x[1])):
            if info[c].retrieval_document_id not in seen:
                seen.add(info[c].retrieval_document_id)
                want.append(c)
        assert [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r["rank"])] == want[:5]


def embed(text, d=384):
    import re
    low = text.casefold().replace("-", " ")
    vec = np.zeros(d)
    for token in re.findall(r"[a-z0-9]+", low) + re.findall(r"[一-鿿]", low):
        h = hashlib.sha256(token.encode()).digest()
        vec[int.from_bytes(h[:4], "little") % d] += 1.0 if h[4] & 1 else -1.0
    return vec / max(np.linalg.norm(vec), 1e-12)


def test_dense_and_hybrid(spark, chunks, questions):
    index = retrieval.build_vector_index(chunks)
    rows = {r.chunk_id: r for r in chunks.collect()}
    vectors = {c: embed(f"{r.title}\n{r.content}") for c, r in rows.items()}
    got = {r.chunk_id: np.array(r.vector) for r in index.collect()}
    assert all(np.allclose(got[c], vectors[c]) for c in vectors)
    found = retrieval.search("dense", chunks.repartition(7), questions, index=index.repartition(5), top_k=6).collect()
    for q, text in QUERIES.items():
        best = {}
        for c, v in vectors.items():
            s, d = round(float(v @ embed(text)), 5), rows[c].retrieval_document_id
            best[d] = min(best.get(d, (9, "")), (-s, c))
        want = [c for _, c in sorted(best.values())[:6]]
        assert [r.chunk_id for r in sorted((r for r in found if r.question_id == q), key=lambda r: r["rank"])] == want
    blocks = retrieval.dense_topk(index, questions.select("question_id", retrieval.hashing_embedding(F.col("question")).alias("vector")), 4, block=1)
    whole = retrieval.dense_topk(index, questions.select("question_id", retrieval.hashing_embedding(F.col("question")).alias("vector")), 4)
    grid = retrieval.dense_topk(index, questions.select("question_id", retrieval.hashing_embedding(F.col("question")).alias("vector")), 4, query_bytes=4_000)
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, whole.collect()))
    assert "FlatMapCoGroupsInPandas" in grid._jdf.queryExecution().toString()
    assert blocks.exceptAll(whole).isEmpty() and blocks.count() == whole.count()
    s = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "question_id string, retrieval_document_id string, rank int")
    d = spark.createDataFrame([("q", "c", 1), ("q", "b", 2)], "question_id string, retrieval_document_id string, rank int")
    fused = [(r.retrieval_document_id, round(r.score, 6)) for r in retrieval.fuse(s, d, top_k=3).orderBy("rank").collect()]
    assert fused == [("b", round(6 / 62 + 1 / 62, 6)), ("a", round(6 / 61, 6)), ("c", round(1 / 61, 6))]


def test_identifier_search(spark, chunks):
    q = spark.createDataFrame([("q", "see PMID: 7 and pmid 4, NCT00000001")], "question_id string, question string")
    assert [r.source_record_id for r in retrieval.identifier_search(chunks, q, source_type="pubmed").orderBy("rank").collect()] == ["4", "7"]
    assert retrieval.identifier_search(chunks, q, source_type="adc_profile").isEmpty()


def test_ir_metrics(spark):
    questions = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "question_id string, category string")
    results = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "2", 3), ("b", "9", 1)], "question_id string, document_id string, rank int")
    relevant = spark.createDataFrame([("a", "2"), ("a", "5"), ("b", "1"), ("c", "1")], "question_id string, document_id string")
    got = {r.question_id: r for r in evaluation.ir_metrics(questions, results, relevant, 10).collect()}
    assert got["a"].reciprocal_rank == 0.5 and got["a"].hit_at_1 == 0 and got["a"].hit_at_3 == 1
    assert math.isclose(got["a"].ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["b"].ndcg == 0 and got["c"].reciprocal_rank == 0


def test_citations(spark):
    rows = [("ok", "结论：\n- Alpha binds HER2 strongly [S1]\n- Beta level was 8.0 [S2][S1]"), ("missing", "Alpha binds HER2 strongly"), ("unknown", "Alpha binds HER2 strongly [S7]"),
            ("false", "Gamma binds HER2 strongly [S1]")]
    src = [("S1", 0, "pubmed", "d1", "Alpha binds HER2 strongly."), ("S2", 1, "pubmed", "d2", "The beta level was 8.0 in cells.")]
    df = spark.createDataFrame([(q, a, ["S1", "S2"], src) for q, a in rows],
                               "question_id string, answer string, available array<string>, sources array<struct<citation_id:string,source_index:int,source_type:string,"
                               "retrieval_document_id:string,excerpt:string>>")
    check = {r.question_id: (r.valid, r.coverage) for r in answers.citation_check(df).collect()}
    assert check == {"ok": (True, 1.0), "missing": (False, 0.0), "unknown": (False, 1.0), "false": (True, 1.0)}
    reasons = {}
    for r in answers.claim_support(df).orderBy("claim_index").collect():
        reasons.setdefault(r.question_id, []).append(r.reason)
    assert reasons == {"ok": [None, None], "missing": ["missing_citation"], "unknown": ["unknown_citation"], "false": ["terms_not_in_cited_evidence"]}


def test_source_budget(spark):
    rows = [("q", i, "pubmed", f"d{i}", text) for i, text in enumerate(["a" * 50, "   ", "b" * 30 + "  ", "c" * 100], 1)]
    df = spark.createDataFrame(rows, "question_id string, rank int, source_type string, retrieval_document_id string, content string")
    got = answers.number_sources(df, max_sources=5, per_source=40, total=90).first().sources
    assert [(s.citation_id, s.excerpt) for s in got] == [("S1", "a" * 40), ("S2", "b" * 30), ("S3", "c" * 20)]


def test_filters_of_each_question(spark, chunks, questions):
    index = retrieval.build_vector_index(chunks)
    info = {r.chunk_id: r for r in chunks.collect()}
    first, *others = list(QUERIES)
    entity = sorted({e for r in info.values() for e in r.metadata.adc_ids})[0]
    only = spark.createDataFrame([(first, entity)], "question_id string, entity_id string")
    topics = spark.createDataFrame([(q, "safety") for q in others] + [(first, "no such topic")], "question_id string, topic string")
    for mode in ("sparse", "dense"):
        found = retrieval.search(mode, chunks, questions, index=index, top_k=4, required_entities=only, question_topics=topics).collect()
        free = retrieval.search(mode, chunks, questions, index=index, top_k=4, required_entities=only).collect()
        ids = lambda rows: {(r.question_id, r["rank"], r.chunk_id) for r in rows if r.question_id == first}
        assert ids(found) == ids(free)  # a topic that nothing has is ignored
        assert all(entity in info[r.chunk_id].metadata.adc_ids for r in found if r.question_id == first)
        assert all("safety" in info[r.chunk_id].metadata.literature_topics for r in found if r.question_id in others)
    fused = retrieval.search("hybrid", chunks, questions, index=index, top_k=4, required_entities=only, question_topics=topics,
                             question_entities=only)
    assert set(r.chunk_id for r in retrieval.with_chunk(fused, chunks).collect()) <= set(info)


def test_scoring_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 50)
    chunks = spark.range(40).select(F.col("id").cast("string").alias("chunk_id"), F.lit("alpha beta gamma").alias("content"))
    questions = spark.createDataFrame([(str(i), "alpha gamma") for i in range(10)], "question_id string, question string")
    scored = retrieval.bm25_scores(chunks, questions)
    assert "hashpartitioning(chunk_id, 16)" in re.sub(r"#\d+L?", "", scored._jdf.queryExecution().executedPlan().toString())  # 40 chunks x 10 questions x 2 phrases
    assert scored.count() == 400


def test_embedding_by_steps(spark, monkeypatch):
    """Vectors are the same however texts and tokens are dealt to steps, and a step's matrices are of a bounded number of rows."""
    def plain(words):
        v = np.zeros(384)
        for w in words or ():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "little") % 384] += 1.0 if h[4] & 1 else -1.0
        return v / max(float(np.sqrt((v * v).sum())), 1e-12)

    texts = [["a"], None, [], ["b", "a", "b"] * 5, [f"w{i}" for i in range(40)], ["c"]]
    monkeypatch.setattr(retrieval, "STEP_TOKENS", 7)
    monkeypatch.setattr(retrieval, "STEP_ROWS", 2)
    array = pa.array([["x"], *texts], pa.list_(pa.string())).slice(1)
    assert [list(v) for v in retrieval._embedded(array, 384).to_pylist()] == [list(plain(t)) for t in texts]
    assert retrieval._embedded(array.slice(0, 0), 384).to_pylist() == []
    df = spark.createDataFrame([(1, "A-b ß 长x"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.v for r in df.select("i", retrieval.hashing_embedding(F.col("t")).alias("v")).collect()}
    assert got[1] == list(plain(["a", "b", "ss", "x", "长"])) and got[2] == got[3] == [0.0] * 384

    rows, seen = pd.DataFrame({"k": [str(i) for i in range(9)], "g": ["x", "y", "z"] * 3, "v": [np.array([float(i % 4), 1.0]) for i in range(9)]}), []
    best = retrieval._best_rows
    monkeypatch.setattr(retrieval, "_best_rows", lambda held, pdf, *rest: seen.append(len(pdf)) or best(held, pdf, *rest))
    blocks = [(["q"], np.array([[1.0, 0.0]]), None)]
    found = pd.concat(retrieval._local_topk([rows, rows[:0]], blocks, ["k", "g"], 2))
    assert max(seen) == 2 and sum(seen) == 9 and list(found["k"]) == ["3", "7"] and list(found["score"]) == [3.0, 3.0]
