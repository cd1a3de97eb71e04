"""Search and search evaluation over documents, benchmark items and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.operators import entities, evaluation, retrieval as r
from factloom.operators.inverted_index import StoredIndex
from factloom.operators.stages import checkpoint_folder
from factloom.plans.common import table as t
from factloom.plans.text import CHUNK_SQL, DICTIONARY_SQL, benchmark_dictionary, retrieval_documents
from factloom.functions import text as tx
from factloom.operators import corpus

QUERIES = {}
ORACLES = {}
QUESTION = "thre ther thor"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def document_chunks(spark, sf):
    """Documents as one-chunk records."""
    doc = F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select(
        doc.alias("chunk_id"), doc.alias("retrieval_document_id"), F.col("source").alias("source_type"),
        F.col("text").alias("content"))


def benchmark_questions(spark, sf):
    return t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


TOKENS_SQL = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"


@query(f"""
WITH x AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
c AS (SELECT term, doc_id, count(*) AS tf FROM x GROUP BY 1, 2)
SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS max_tf FROM c GROUP BY 1""")
def postings_stats(spark, sf):
    p = r.postings(document_chunks(spark, sf), ["content"])
    per = p.groupBy(F.col("phrase").alias("term"), "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))


INDEX_SQL = f"""
WITH x AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents),
c AS (SELECT token, doc_id, count(*) AS n FROM x GROUP BY 1, 2)
SELECT token, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY 1"""


def _new_index(spark):
    return StoredIndex(spark, f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")


@query(INDEX_SQL)
def index_build(spark, sf):
    """A stored index of all documents, and what it says of each token."""
    index = _new_index(spark)
    index.update(document_chunks(spark, sf))
    return index.terms()


def earlier_chunks(spark, sf):
    """The documents as they may have been before: some not there yet, some with other texts, some that are gone now."""
    chunks, k = document_chunks(spark, sf), F.crc32("chunk_id")
    before = chunks.where(k % 5 != 0).withColumn("content", F.when(k % 7 == 0, F.reverse("content")).otherwise(F.col("content")))
    gone = chunks.where(k % 11 == 0).withColumn("chunk_id", F.concat(F.lit("gone-"), "chunk_id"))
    return before.unionByName(gone)


@query(INDEX_SQL)
def index_update(spark, sf):
    """An index of earlier texts brought to the present ones: the same as a new index of these."""
    index = _new_index(spark)
    index.update(earlier_chunks(spark, sf))
    index.update(document_chunks(spark, sf))
    return index.terms()


BM25_SQL = f"""
tok AS (SELECT doc_id, source, {TOKENS_SQL} AS w FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) * CAST(0.8 AS DOUBLE) AS f FROM (SELECT doc_id, CAST(len(w) AS DOUBLE) AS dl,
   unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS n FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n_docs - n + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE))) > 0 THEN
   ln((n_docs - n + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE))) ELSE CAST(0.000001 AS DOUBLE) END AS idf FROM df, st),
sc AS (SELECT question_id, CAST(doc_id AS VARCHAR) AS document_id, round(sum(idf * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) *
   (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * (dl / avgdl)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term), st GROUP BY 1, 2)"""

QUESTION_TERMS_SQL = """
qt AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS question_id, term FROM (SELECT item_id, unnest(list_transform(list_filter(
  regexp_extract_all(text, '[A-Za-z0-9]+(?:[.+][A-Za-z0-9]+)*|[\\x{4e00}-\\x{9fff}]{2,}'), lambda w: length(w) > 1), lambda w: lower(w))) AS term FROM benchmark))"""

SPARSE_SQL = "WITH " + QUESTION_TERMS_SQL + "," + BM25_SQL + """,
sparse AS (SELECT question_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id
  ORDER BY score DESC, document_id) AS rank FROM sc) WHERE rank <= 60)"""


@query("WITH qt AS (SELECT 'q' AS question_id, unnest(['thre', 'ther', 'thor']) AS term)," + BM25_SQL + """
SELECT document_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM sc)
WHERE rank <= 10""")
def bm25_topk(spark, sf):
    question = spark.range(1).select(F.lit("q").alias("question_id"), F.lit(QUESTION).alias("question"))
    found = r.sparse_search(document_chunks(spark, sf), question, top_k=10)
    return found.select(F.col("retrieval_document_id").alias("document_id"), "score", "rank")


def sparse_results(spark, sf, k=60):
    return r.sparse_search(document_chunks(spark, sf), benchmark_questions(spark, sf), top_k=k)


@query(SPARSE_SQL + " SELECT question_id, document_id, score, rank FROM sparse WHERE rank <= 10")
def sparse_search_questions(spark, sf):
    return sparse_results(spark, sf, 10).select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


@query("WITH " + QUESTION_TERMS_SQL + "," + BM25_SQL + "," + DICTIONARY_SQL + """,
links AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id, entity_id FROM matches WHERE entity_type = 'adc'),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS r FROM sc) WHERE r <= 60),
boosted AS (SELECT f.*, EXISTS (SELECT 1 FROM links l WHERE l.document_id = f.document_id AND l.entity_id =
   CAST(CAST(f.question_id AS INT) // 2 AS VARCHAR)) AS entity_hit FROM fetched f)
SELECT question_id, document_id, entity_hit, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id
  ORDER BY entity_hit DESC, score DESC, document_id) AS rank FROM boosted) WHERE rank <= 6""")
def sparse_entity_boost(spark, sf):
    links = entities.match_dictionary(t(spark, sf, "documents").select("doc_id", "text"), benchmark_dictionary(spark, sf),
                                      key="doc_id", text="text").filter("entity_type = 'adc'")
    linked = links.groupBy(F.col("doc_id").cast("string").alias("chunk_id")).agg(F.sort_array(F.collect_set("entity_id")).alias("ids"))
    chunks = document_chunks(spark, sf).join(linked, "chunk_id", "left").withColumn("metadata", F.struct(
        F.coalesce("ids", F.array().cast("array<string>")).alias("adc_ids"))).drop("ids")
    questions = benchmark_questions(spark, sf)
    named = questions.select("question_id", F.floor(F.col("question_id").cast("int") / 2).cast("string").alias("entity_id"))
    found = r.sparse_search(chunks, questions, top_k=6, question_entities=named)
    return found.select("question_id", F.col("retrieval_document_id").alias("document_id"), "entity_hit", "score", "rank")


@query(SPARSE_SQL + " SELECT question_id, document_id, score, rank FROM sparse WHERE rank <= 10")
def index_search(spark, sf):
    """The same search from a stored index: only the buckets of the questions' tokens are read."""
    index = _new_index(spark)
    chunks = document_chunks(spark, sf)
    index.update(chunks)
    found = r.sparse_search(chunks, benchmark_questions(spark, sf), top_k=10, index=index)
    return found.select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


FILTER_SQL = """
asked AS (SELECT CAST(item_id AS VARCHAR) AS question_id, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END AS source_only,
   CASE WHEN item_id % 2 = 0 THEN ['de', 'en', 'fr', 'no such language'][item_id // 2 % 4 + 1] END AS topic FROM benchmark)"""


def filtered_questions(spark, sf):
    """Every third question is limited to one source (as entity) and every second to one language (as topic)."""
    k = F.col("item_id")
    topics = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "fr", "no such language")]), (F.floor(k / 2) % 4 + 1).cast("int"))
    q = t(spark, sf, "benchmark").select(
        k.cast("string").alias("question_id"), F.when(k % 3 == 0, F.concat(F.lit("src"), (k % 20).cast("string"))).alias("entity_id"),
        F.when(k % 2 == 0, topics).alias("topic"))
    return q.filter("entity_id IS NOT NULL").select("question_id", "entity_id"), q.filter("topic IS NOT NULL").select("question_id", "topic")


def labelled_chunks(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", "source")
    meta = F.struct(F.array("source").alias("adc_ids"), F.array("lang").alias("literature_topics")).alias("metadata")
    return document_chunks(spark, sf).join(d.select("chunk_id", meta), "chunk_id")


@query(SPARSE_SQL.split("sparse AS (")[0] + FILTER_SQL + """,
m AS (SELECT sc.question_id, document_id, score, topic, d.lang = topic AS fits FROM sc JOIN documents d ON CAST(d.doc_id AS VARCHAR) = document_id JOIN asked USING (question_id)
   WHERE source_only IS NULL OR d.source = source_only),
n AS (SELECT *, bool_or(fits) OVER (PARTITION BY question_id) AS met FROM m)
SELECT question_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank
  FROM n WHERE topic IS NULL OR fits OR NOT coalesce(met, false)) WHERE rank <= 10""")
def sparse_filters(spark, sf):
    only, topics = filtered_questions(spark, sf)
    found = r.sparse_search(labelled_chunks(spark, sf), benchmark_questions(spark, sf), top_k=10, required_entities=only, question_topics=topics)
    return found.select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


@query("""
WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'What does PMID: ' || (o_orderkey % 900) || ' report? see pmid '
   || (o_orderkey % 700 + 1) ELSE 'no identifier here ' || o_orderkey END AS question FROM orders),
i AS (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(question, '(?i)\\bPMID\\s*:?[ \\t]*(\\d+)\\b', 1)) AS id FROM q)
SELECT CAST(o_orderkey AS VARCHAR) AS question_id, id AS source_record_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY id) AS INTEGER)
  AS rank FROM i JOIN documents d ON CAST(d.doc_id AS VARCHAR) = id""")
def identifier_search(spark, sf):
    k = F.col("o_orderkey")
    with_ids = F.concat(F.lit("What does PMID: "), (k % 900).cast("string"), F.lit(" report? see pmid "), (k % 700 + 1).cast("string"))
    q = t(spark, sf, "orders").select(k.cast("string").alias("question_id"), F.when(k % 3 == 0, with_ids).otherwise(
        F.concat(F.lit("no identifier here "), k.cast("string"))).alias("question"))
    chunks = t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_record_id"), F.lit("pubmed").alias("source_type"), F.lit(0).alias("chunk_index"))
    return r.identifier_search(chunks, q, source_type="pubmed", top_k=10).select("question_id", "source_record_id", "rank")


HASH_SQL = """
w AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(l, '[a-z0-9]+'), regexp_extract_all(l, '[\\x{4e00}-\\x{9fff}]'))) AS term
   FROM (SELECT doc_id, replace(replace(lower(text), 'ß', 'ss'), '-', ' ') AS l FROM src)),
vocab AS (SELECT term, sha256(term) AS h FROM (SELECT DISTINCT term FROM w)),
slot AS (SELECT term, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 384 AS idx,
   CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sgn FROM vocab),
raw AS (SELECT doc_id, idx, CAST(sum(sgn) AS DOUBLE) AS v FROM w JOIN slot USING (term) GROUP BY 1, 2),
vec AS (SELECT doc_id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM raw WHERE v <> 0)"""


@query("WITH src AS (SELECT doc_id, text FROM documents)," + HASH_SQL + """
SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(v, 6) AS weight FROM vec""")
def hashing_embedding(spark, sf):
    v = t(spark, sf, "documents").select("doc_id", r.hashing_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("idx", "w")).filter("w <> 0").select(
        "doc_id", "idx", F.round("w", 6).alias("weight"))


CENTROID_SQL = """
e AS (SELECT vec_id, label, CAST(unnest(generate_series(1, 64)) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label, i, round(avg(x), 6) AS c FROM e GROUP BY 1, 2),
dots AS (SELECT CAST(cen.label AS VARCHAR) AS question_id, e.vec_id, e.label, round(sum(x * c), 5) AS score FROM e JOIN cen USING (i) GROUP BY 1, 2, 3),
dense AS (SELECT question_id, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id
  ORDER BY score DESC, vec_id) AS rank FROM dots) WHERE rank <= 10)"""


def label_centroids(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("c"))
    return c.groupBy(F.col("label").cast("string").alias("question_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("vector"))


def centroid_neighbours(spark, sf):
    vectors = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return r.dense_topk(vectors, label_centroids(spark, sf), 10, key="vec_id")


@query("WITH " + CENTROID_SQL + " SELECT question_id, vec_id, score, rank FROM dense")
def dense_topk(spark, sf):
    return centroid_neighbours(spark, sf).select("question_id", "vec_id", "score", "rank")


DENSE_DOC_SQL = """
src AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark),""" + HASH_SQL + """,
dd AS (SELECT -1 - q.doc_id AS item_id, d.doc_id, round(sum(q.v * d.v), 5) AS score FROM vec q JOIN vec d USING (idx) WHERE q.doc_id < 0 AND d.doc_id >= 0
   GROUP BY 1, 2),
alld AS (SELECT CAST(item_id AS VARCHAR) AS question_id, CAST(doc_id AS VARCHAR) AS document_id, coalesce(score, 0.0) AS score FROM
   (SELECT item_id, doc_id FROM benchmark, documents) LEFT JOIN dd USING (item_id, doc_id)),
densed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank FROM alld) WHERE rank <= 60)"""

HYBRID_SQL = SPARSE_SQL + "," + DENSE_DOC_SQL + """,
fused AS (SELECT question_id, document_id, min(sr) AS sr, min(dr) AS dr FROM (SELECT question_id, document_id, rank AS sr, NULL AS dr FROM sparse
   UNION ALL SELECT question_id, document_id, NULL, rank FROM densed) GROUP BY 1, 2),
fs AS (SELECT *, round(coalesce(CAST(6 AS DOUBLE) / (CAST(60 AS DOUBLE) + CAST(sr AS DOUBLE)), 0) + coalesce(CAST(1 AS DOUBLE) / (CAST(60 AS DOUBLE)
   + CAST(dr AS DOUBLE)), 0), 9) AS score FROM fused),
hybrid AS (SELECT question_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY
   score DESC, sr NULLS LAST, dr NULLS LAST, document_id) AS rank FROM fs) WHERE rank <= 10)"""


def dense_documents(spark, sf, k):
    chunks = document_chunks(spark, sf)
    index = chunks.select("chunk_id", "retrieval_document_id", r.hashing_embedding(F.col("content")).alias("vector"))
    queries = benchmark_questions(spark, sf).select("question_id", r.hashing_embedding(F.col("question")).alias("vector"))
    return r.dense_topk(index, queries, k, group="retrieval_document_id")


@query("WITH " + DENSE_DOC_SQL + " SELECT question_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM densed WHERE rank <= 10")
def dense_search_questions(spark, sf):
    return dense_documents(spark, sf, 10).select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


@query("WITH " + DENSE_DOC_SQL.split("densed AS (")[0] + FILTER_SQL + """,
m AS (SELECT a.question_id, document_id, score, topic, d.lang = topic AS fits FROM alld a JOIN documents d ON CAST(d.doc_id AS VARCHAR) = document_id
   JOIN asked ON asked.question_id = a.question_id WHERE source_only IS NULL OR d.source = source_only),
n AS (SELECT *, bool_or(fits) OVER (PARTITION BY question_id) AS met FROM m)
SELECT question_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank
  FROM n WHERE topic IS NULL OR fits OR NOT coalesce(met, false)) WHERE rank <= 10""")
def dense_filters(spark, sf):
    only, topics = filtered_questions(spark, sf)
    chunks = labelled_chunks(spark, sf)
    index = chunks.select("chunk_id", r.hashing_embedding(F.col("content")).alias("vector"))
    queries = benchmark_questions(spark, sf).select("question_id", r.hashing_embedding(F.col("question")).alias("vector"))
    found = r.dense_search(chunks, index, queries, top_k=10, required_entities=only, question_topics=topics)
    return found.select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


def hybrid_results(spark, sf):
    return r.fuse(sparse_results(spark, sf), dense_documents(spark, sf, 60), top_k=10)


@query(HYBRID_SQL + " SELECT question_id, document_id, score, rank FROM hybrid")
def hybrid_rrf(spark, sf):
    return hybrid_results(spark, sf).select("question_id", F.col("retrieval_document_id").alias("document_id"), "score", "rank")


@query("WITH " + CHUNK_SQL + """,
c AS (SELECT CAST(doc_id AS VARCHAR) AS doc, chunk_index, content, length(content) - length(replace(lower(content), 'thre', 'thr')) AS hits FROM chunks),
b AS (SELECT doc, arg_min(chunk_index, (-hits, chunk_index)) AS chunk_index FROM c WHERE hits > 0 GROUP BY 1)
SELECT 'pubmed:' || doc AS document_id, chunk_index, CAST(length(d.text) AS INTEGER) AS context_chars, md5(d.text) AS context_md5, true AS context_expanded
FROM b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = doc""")
def context_expansion(spark, sf):
    documents = retrieval_documents(spark, sf)
    lowered = F.lower("content")
    hits = F.length("content") - F.length(F.replace(lowered, F.lit("thre"), F.lit("thr")))
    chunks = corpus.chunk_documents(documents).select("retrieval_document_id", "chunk_index", "content", hits.alias("hits")).filter("hits > 0")
    best = chunks.groupBy("retrieval_document_id").agg(
        F.min_by(F.struct("chunk_index", "content"), F.struct(-F.col("hits"), F.col("chunk_index"))).alias("b")).select("retrieval_document_id", "b.*")
    return r.expand_context(best, documents).select(
        F.col("retrieval_document_id").alias("document_id"), "chunk_index", F.length("content").alias("context_chars"),
        F.md5("content").alias("context_md5"), "context_expanded")


IR_SQL = """
rel AS (SELECT CAST(label AS VARCHAR) AS question_id, count(*) AS relevant FROM embeddings GROUP BY 1),
m AS (SELECT rel.question_id, CASE WHEN CAST(rel.question_id AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS category,
   coalesce(1.0::DOUBLE / min(CASE WHEN CAST(label AS VARCHAR) = dense.question_id THEN rank END), 0.0) AS reciprocal_rank,
   coalesce(sum(CASE WHEN CAST(label AS VARCHAR) = dense.question_id THEN 1.0::DOUBLE / log2(rank + 1) END), 0.0) / (SELECT sum(1.0::DOUBLE / log2(i + 1))
     FROM generate_series(1, least(max(relevant), 10)) g(i)) AS ndcg,
   CAST(bool_or(CAST(label AS VARCHAR) = dense.question_id AND rank <= 1) AS DOUBLE) AS hit_at_1,
   CAST(bool_or(CAST(label AS VARCHAR) = dense.question_id AND rank <= 3) AS DOUBLE) AS hit_at_3,
   CAST(bool_or(CAST(label AS VARCHAR) = dense.question_id AND rank <= 5) AS DOUBLE) AS hit_at_5,
   CAST(bool_or(CAST(label AS VARCHAR) = dense.question_id AND rank <= 10) AS DOUBLE) AS hit_at_10
   FROM rel LEFT JOIN dense USING (question_id) GROUP BY 1)"""


def ir_rows(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("document_id"), F.col("label").cast("string").alias("question_id"))
    found = centroid_neighbours(spark, sf).select("question_id", F.col("vec_id").cast("string").alias("document_id"), "rank")
    questions = e.select("question_id").distinct().withColumn(
        "category", F.when(F.col("question_id").cast("int") % 2 == 0, "even").otherwise("odd"))
    return evaluation.ir_metrics(questions, found, e.select("question_id", "document_id"), 10)


@query("WITH " + CENTROID_SQL + "," + IR_SQL + """
SELECT question_id, category, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, hit_at_1, hit_at_3, hit_at_5, hit_at_10 FROM m""")
def ir_metrics(spark, sf):
    return ir_rows(spark, sf).select("question_id", "category", F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
                                     F.round("ndcg", 6).alias("ndcg"), *[f"hit_at_{k}" for k in (1, 3, 5, 10)])


@query("WITH " + CENTROID_SQL + "," + IR_SQL + """
SELECT coalesce(category, 'overall') AS category, count(*) AS questions, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(ndcg), 4) AS ndcg,
  round(avg(hit_at_1), 4) AS hit_at_1, round(avg(hit_at_3), 4) AS hit_at_3, round(avg(hit_at_5), 4) AS hit_at_5, round(avg(hit_at_10), 4) AS hit_at_10
FROM m GROUP BY ROLLUP(category)""")
def retrieval_report(spark, sf):
    return evaluation.mean_by_category(ir_rows(spark, sf), ["reciprocal_rank", "ndcg", *[f"hit_at_{k}" for k in (1, 3, 5, 10)]])


PASSAGE_SQL = """
bn AS (SELECT CAST(item_id AS VARCHAR) AS question_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
bw AS (SELECT DISTINCT question_id, array_to_string(w[i:i + 7], ' ') AS piece FROM (SELECT question_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bn)),
dn AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, ' ' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM documents),
relevant AS (SELECT DISTINCT question_id, document_id FROM bw JOIN dn ON contains(n, ' ' || piece || ' '))"""


def passage_relevance(spark, sf):
    """Documents that hold any eight words in a row of a benchmark item (an item of fewer words whole)."""
    split = t(spark, sf, "benchmark").select("item_id", F.split(tx.normalize_text(F.col("text")), " ").alias("words"))
    words = F.col("words")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 7, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 8), " "))
    items = split.select(
        F.lit("adc").alias("entity_type"), F.col("item_id").cast("string").alias("entity_id"),
        F.col("item_id").cast("string").alias("canonical_name"), F.posexplode(F.array_distinct(windows)).alias("position", "alias"))
    hits = entities.match_dictionary(t(spark, sf, "documents").select("doc_id", "text"), items, key="doc_id", text="text")
    return hits.select(F.col("entity_id").alias("question_id"), F.col("doc_id").cast("string").alias("document_id"))


@query(SPARSE_SQL + "," + PASSAGE_SQL + """
SELECT q.question_id, count(DISTINCT r.document_id) AS relevant, count(DISTINCT s.document_id) AS found_in_top10,
  coalesce(CAST(min(s.rank) AS INTEGER), 0) AS first_rank
FROM (SELECT DISTINCT question_id FROM relevant) q JOIN relevant r USING (question_id)
LEFT JOIN sparse s ON s.question_id = r.question_id AND s.document_id = r.document_id AND s.rank <= 10 GROUP BY 1""")
def passage_retrieval(spark, sf):
    relevant = passage_relevance(spark, sf)
    found = sparse_results(spark, sf, 10).select("question_id", F.col("retrieval_document_id").alias("document_id"), "rank", F.lit(True).alias("hit"))
    return relevant.join(found, ["question_id", "document_id"], "left").groupBy("question_id").agg(
        F.countDistinct("document_id").alias("relevant"), F.count_if(F.col("hit")).alias("found_in_top10"),
        F.coalesce(F.min("rank"), F.lit(0)).alias("first_rank"))
