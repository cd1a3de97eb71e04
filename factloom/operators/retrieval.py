"""Sparse, dense and hybrid retrieval over a chunk table.

``chunks`` has ``chunk_id``, ``retrieval_document_id``, ``source_type``, ``source_record_id``, the text columns and
``metadata`` with ``adc_ids`` and ``literature_topics``. Questions come as a frame ``(question_id, question)``, so one job
answers a whole question file.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.stages import written
from factloom.operators.sizes import broadcast_if_small, is_small

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
COLUMN_WEIGHTS = {"title": 1.0, "content": 0.8, "entities": 1.0}
RRF_CONSTANT = 60
SALTS = 64
#: Pairs of a question and an occurring phrase that one task scores, at most, about.
TASK_PAIRS = 8_000_000
#: Queries of so many bytes are broadcast; a cell of the grid beyond that holds as many bytes of queries and so many vectors, about.
QUERY_BYTES, CELL_VECTORS = 64 << 20, 50_000
#: Rows of vectors (or texts) and tokens of texts that a Python step works on; Arrow's batches may hold more.
STEP_ROWS, STEP_TOKENS = 1_000, 250_000

# Query terms and the words that are added for them.
TERM_EXPANSIONS = {
    "靶点": "target antigen",
    "载荷": "payload warhead cytotoxic",
    "连接子": "linker cleavable non-cleavable",
    "药物抗体比": "drug antibody ratio DAR",
    "适应证": "indication condition cancer tumor",
    "临床试验": "clinical trial study",
    "招募": "recruiting recruitment",
    "入组": "enrollment participants",
    "主要终点": "primary outcome endpoint",
    "疗效": "efficacy response survival",
    "安全性": "safety adverse event toxicity",
    "毒性": "toxicity adverse event safety",
    "乳腺癌": "breast cancer",
    "胃癌": "gastric cancer",
    "肺癌": "lung cancer NSCLC",
    "卵巢癌": "ovarian cancer",
    "尿路上皮癌": "urothelial cancer",
    "三阴性": "triple-negative TNBC",
    "状态": "status",
    "阶段": "phase",
    "研究": "study trial",
    "文献": "article publication PubMed",
    "机制": "mechanism activity internalization",
}

# Latin letters with marks and the bare letters, from their Unicode decompositions.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00))
           for c in block if unicodedata.combining(unicodedata.normalize("NFD", chr(c))[-1])}


# ---------------------------------------------------------------- tokens


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics, in text order."""
    bare = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def expand_query(question: Column) -> Column:
    added = [F.when(F.contains(question, F.lit(marker)), F.lit(words)) for marker, words in TERM_EXPANSIONS.items()]
    return F.concat_ws(" ", question, *added)


def query_tokens(question: Column) -> Column:
    """Distinct lower-case query tokens of two characters or more; ``8.0`` stays one token."""
    found = F.regexp_extract_all(expand_query(question), F.lit(
        r"[A-Za-z0-9]+(?:[.+][A-Za-z0-9]+)*|[一-鿿]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda w: F.length(w) > 1), F.lower))


def query_phrases(questions: DataFrame) -> DataFrame:
    """``(question_id, phrase)``: every query token as the index tokens it consists of."""
    words = questions.select("question_id", F.explode(query_tokens(F.col("question"))).alias("w"))
    return words.select("question_id", F.array_join(index_tokens(F.col("w")), " ").alias("phrase")).filter("phrase <> ''").distinct()


# ---------------------------------------------------------------- BM25


def postings(chunks: DataFrame, columns: Sequence[str], lengths: Sequence[int] = (1,), whole: bool = False) -> DataFrame:
    """``(chunk_id, column, phrase)`` occurrences, one row per occurrence, with the chunk's token count.

    With ``whole`` every chunk has one more row without column and with the phrase ``WHOLE``.
    """
    arrays = [index_tokens(F.col(c)) for c in columns]
    base = chunks.select("chunk_id", *[a.alias(f"__t{i}") for i, a in enumerate(arrays)])
    base = base.withColumn("tokens", sum((F.coalesce(F.size(f"__t{i}"), F.lit(0)) for i in range(len(columns))), F.lit(0)))

    def grams(i: int, n: int) -> Column:
        t = F.col(f"__t{i}")
        if n == 1:
            return t
        cut = F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)), lambda s: F.array_join(F.slice(t, s, n), " "))
        return F.when(F.size(t) >= n, cut).otherwise(F.array().cast("array<string>"))

    tagged = F.concat(*[_tag(F.concat(*[F.coalesce(grams(i, n), F.array().cast("array<string>")) for n in lengths]), c) for i, c in enumerate(columns)],
                      *([F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(WHOLE).alias("phrase")))] if whole else []))
    return base.select("chunk_id", "tokens", F.explode(tagged).alias("p")).select("chunk_id", "tokens", "p.column", "p.phrase")


def _tag(items: Column, name: str) -> Column:
    return F.transform(items, lambda p: F.struct(F.lit(name).alias("column"), p.alias("phrase")))


#: Stands for a whole chunk among the phrases; no phrase is empty.
WHOLE = ""


def phrase_counts(chunks: DataFrame, phrases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Written ``(chunk_id, tokens, phrase, f)``: weighted counts of the wanted phrases, and one row per chunk with phrase ``WHOLE``.

    The corpus is tokenised once. Occurrences are filtered by the wanted phrases and counted before they are shuffled.
    """
    columns = [c for c in weights if c in chunks.columns]
    lengths = sorted(r[0] for r in phrases.select(F.size(F.split("phrase", " "))).distinct().collect()) or [1]
    wanted = phrases.select("phrase").unionByName(chunks.sparkSession.range(1).select(F.lit(WHOLE).alias("phrase"))).distinct()
    weight = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, float(weights[c]))]), F.col("column"))
    found = postings(chunks, columns, lengths, whole=True).join(broadcast_if_small(wanted), "phrase")
    return written(found.groupBy("chunk_id", "tokens", "phrase").agg(F.sum(weight).alias("f")))


def bm25_scores(chunks: DataFrame, questions: DataFrame, weights: dict[str, float] | None = None, allowed: DataFrame | None = None,
                index=None) -> DataFrame:
    """``(question_id, chunk_id, score)`` of every chunk that contains a phrase of the question.

    ``index`` is a :class:`~factloom.operators.inverted_index.StoredIndex` of the chunks: counts are then read from the buckets of
    the questions' tokens, and the texts of the chunks are not looked at.

    Counts are brought together by chunk, the phrase table of the questions is broadcast when it is small, and the scores
    of a chunk are added up where it lies; a cut to the best rows can follow in the same task. A larger phrase table is
    joined on (phrase, salt), so a phrase that occurs in a third of the corpus is spread over many tasks. ``allowed``
    (chunk_id) limits what is scored, not the corpus statistics.
    """
    phrases = written(query_phrases(questions))
    if index is None:
        counts = phrase_counts(chunks, phrases, COLUMN_WEIGHTS if weights is None else weights)
        whole, hits = F.col("phrase") == WHOLE, counts.filter(F.col("phrase") != WHOLE)
        stats = counts.agg(F.count_if(whole).cast("double").alias("chunk_count"), F.avg(F.when(whole, F.col("tokens").cast("double"))).alias("mean_tokens"))
    else:
        hits, stats = written(index.hits(phrases, weights)), index.stats()
    found_in = hits.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("n"))
    idf = F.ln((F.col("chunk_count") - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
    rated = written(phrases.join(found_in, "phrase").join(F.broadcast(stats)).select(
        "question_id", "phrase", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"), "mean_tokens", "n"))
    total, rated = int(rated.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]), rated.drop("n")
    if allowed is not None:
        hits = hits.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    if is_small(rated):
        # A task's memory goes with its pairs and not with the bytes of its hits, so the number of tasks is set from them.
        usual = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(usual, total // 100_000), -(-total // TASK_PAIRS))
        pairs = hits.repartition(tasks, "chunk_id").join(F.broadcast(rated), "phrase")
    else:
        salted = rated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = hits.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")).join(salted, ["phrase", "salt"])
    length = F.col("tokens").cast("double") / F.col("mean_tokens")
    part = F.col("idf") * F.col("f") * F.lit(K1 + 1.0) / (F.col("f") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length))
    return pairs.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def top_rows(scored: DataFrame, limit: int, order: Sequence[Column], name: str = "rank") -> DataFrame:
    window = Window.partitionBy("question_id").orderBy(*order)
    return scored.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)


def _best_per_document(scored: DataFrame, descending: Sequence[str], top_k: int) -> DataFrame:
    """First chunk per document, then ranks 1..k; larger values come first, ties go to the smaller chunk id."""
    key = F.struct(*[(-F.col(c).cast("double")).alias(c) for c in descending], F.col("chunk_id"))
    first = scored.groupBy("question_id", "retrieval_document_id").agg(
        F.min_by(F.struct(*[c for c in scored.columns if c not in {"question_id", "retrieval_document_id"}]), key).alias("b"))
    flat = first.select("question_id", "retrieval_document_id", "b.*")
    return top_rows(flat, top_k, [F.desc(c) for c in descending] + [F.col("chunk_id")])


def _only_required(scored: DataFrame, required: DataFrame) -> DataFrame:
    """Rows whose chunk is linked to the entity that the question is limited to; other questions keep all rows."""
    only = required.select("question_id", F.col("entity_id").alias("__only"))
    return scored.join(only, "question_id", "left").filter(
        F.col("__only").isNull() | F.coalesce(F.expr("array_contains(metadata.adc_ids, __only)"), F.lit(False))).drop("__only")


def _topics(questions: DataFrame, topic: str | None, question_topics: DataFrame | None) -> DataFrame | None:
    if topic is not None:
        return questions.select("question_id", F.lit(topic).alias("topic"))
    return None if question_topics is None else question_topics.filter("topic IS NOT NULL")


def sparse_search(chunks: DataFrame, questions: DataFrame, *, top_k: int = 10, weights: dict[str, float] | None = None,
                  source_type: str | None = None, adc_id: str | None = None, topic: str | None = None,
                  question_entities: DataFrame | None = None, required_entities: DataFrame | None = None,
                  question_topics: DataFrame | None = None, index=None) -> DataFrame:
    """BM25 search with filters, over-fetch, entity boost and one chunk per document.

    A topic without any match is ignored for that question; ``question_topics(question_id, topic)`` names one per question.
    ``question_entities(question_id, entity_id)`` names the entities of each question; chunks linked to one of them come
    first. ``required_entities(question_id, entity_id)`` limits a question to chunks linked to its one entity. ``index`` is a stored index of the chunks.
    """
    fetch = max(10 * top_k, 60)
    topics = _topics(questions, topic, question_topics)
    allowed = filter_chunks(chunks, source_type, adc_id)
    info = allowed.select("chunk_id", "retrieval_document_id", *(["metadata"] if "metadata" in chunks.columns else []))
    scored = bm25_scores(chunks, questions, weights, allowed if source_type is not None or adc_id is not None else None, index)
    if required_entities is not None or topics is not None:
        scored = scored.join(info.select("chunk_id", "metadata"), "chunk_id")
    if required_entities is not None:
        scored = _only_required(scored, required_entities)
    fits = F.lit(False)
    if topics is not None:
        scored = scored.join(topics.select("question_id", F.col("topic").alias("__topic")), "question_id", "left")
        fits = F.coalesce(F.expr("array_contains(metadata.literature_topics, __topic)"), F.lit(False))
    # The best rows on and off the topic are cut apart, so that the cut comes before the shuffle; then those on it win if there are any.
    scored = scored.select("question_id", "chunk_id", "score", fits.alias("__fits"))
    window = Window.partitionBy("question_id", "__fits").orderBy(F.desc("score"), F.col("chunk_id"))
    best = scored.withColumn("__fetch", F.row_number().over(window)).filter(F.col("__fetch") <= fetch)
    if topics is not None:
        best = best.withColumn("__met", F.bool_or("__fits").over(Window.partitionBy("question_id"))).filter(F.col("__fits") | ~F.col("__met")).drop("__met")
    best = best.drop("__fits", "__fetch").join(info, "chunk_id").withColumn("entity_hit", F.lit(False))
    if question_entities is not None:
        named = question_entities.groupBy("question_id").agg(F.collect_set("entity_id").alias("__named"))
        best = best.join(named, "question_id", "left").withColumn(
            "entity_hit", F.coalesce(F.arrays_overlap("__named", "metadata.adc_ids"), F.lit(False))).drop("__named")
    return _best_per_document(best, ["entity_hit", "score"], top_k).drop("metadata")


def filter_chunks(chunks: DataFrame, source_type: str | None = None, adc_id: str | None = None) -> DataFrame:
    if source_type is not None:
        chunks = chunks.filter(F.col("source_type") == source_type)
    if adc_id is not None:
        chunks = chunks.filter(F.array_contains("metadata.adc_ids", adc_id))
    return chunks


def identifiers(question: Column, source_type: str) -> Column:
    """PMID numbers or trial ids named in the question, distinct, in order."""
    if source_type == "pubmed":
        return F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?i)\bPMID\s*:?[ \t]*(\d+)\b"), F.lit(1)))
    if source_type == "clinical_trial":
        return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"(?i)\b(NCT\d{8})\b"), F.lit(1)), F.upper))
    return F.array().cast("array<string>")


def identifier_search(chunks: DataFrame, questions: DataFrame, *, source_type: str, top_k: int = 10) -> DataFrame:
    """Chunks of the records whose ids the question names, in record and chunk order; the limit counts chunks."""
    ids = questions.select("question_id", F.explode(identifiers(F.col("question"), source_type)).alias("source_record_id"))
    hits = filter_chunks(chunks, source_type).join(broadcast_if_small(ids), "source_record_id")
    ranked = top_rows(hits, top_k, [F.col("source_record_id"), F.col("chunk_index")])
    return ranked.withColumn("score", F.lit(1.0))


def expand_context(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Replace the winning chunk of a publication by its whole document and mark the row."""
    whole = documents.filter(F.col("source_type") == "pubmed").select("retrieval_document_id", F.col("content").alias("__whole"))
    return results.join(whole, "retrieval_document_id", "left").withColumn(
        "context_expanded", F.col("__whole").isNotNull()).withColumn("content", F.coalesce("__whole", "content")).drop("__whole")


# ---------------------------------------------------------------- dense


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> tuple[int, float]:
    h = hashlib.sha256(token.encode("utf-8")).digest()
    return int.from_bytes(h[:4], "little"), 1.0 if h[4] & 1 else -1.0


def hashing_embedding(text: Column, dimension: int = 384) -> Column:
    """Signed token hashing into ``dimension`` slots, length one. Tokens are cut in the JVM."""
    lowered = F.replace(fold_case(text), F.lit("-"), F.lit(" "))
    tokens = F.concat(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)),
                      F.regexp_extract_all(lowered, F.lit(r"[一-鿿]"), F.lit(0)))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pa.Array) -> pa.Array:
        return _embedded(batch, dimension)

    return embed(tokens)


def _embedded(batch: pa.Array, dimension: int) -> pa.Array:
    """Vectors of token lists. A step takes about ``STEP_TOKENS`` tokens and ``STEP_ROWS`` rows; only its distinct tokens become Python strings."""
    offsets = np.zeros(len(batch) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False), out=offsets[1:])
    tokens = batch.flatten()
    out = np.zeros((len(batch), dimension))
    row = 0
    while row < len(batch):
        end = min(len(batch), row + STEP_ROWS, max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_TOKENS, side="right")) - 1))
        for at in range(int(offsets[row]), int(offsets[end]), STEP_TOKENS):  # a text of more tokens is added up in parts
            stop = min(int(offsets[end]), at + STEP_TOKENS)
            coded = tokens.slice(at, stop - at).dictionary_encode()
            slots = [_slot(w) for w in coded.dictionary.to_pylist()]
            place, sign = np.array([s[0] % dimension for s in slots], dtype=np.int64), np.array([s[1] for s in slots])
            word = coded.indices.to_numpy(zero_copy_only=False)
            of_row = np.searchsorted(offsets[row:end + 1], np.arange(at, stop), side="right") - 1
            out[row:end] += np.bincount(of_row * dimension + place[word], weights=sign[word], minlength=(end - row) * dimension).reshape(end - row, dimension)
        part = out[row:end]
        part /= np.maximum(np.sqrt((part * part).sum(axis=1)), 1e-12)[:, None]
        row = end
    return pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * dimension, pa.array(out.reshape(-1)))


def fold_case(text: Column) -> Column:
    """Case folding as far as the token alphabet of the embedder can tell: ``ß`` becomes ``ss``."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def dense_topk(vectors: DataFrame, queries: DataFrame, top_k: int, *, key: str = "chunk_id", group: str | None = None,
               vector: str = "vector", block: int = 1024, labels: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact top ``top_k`` by dot product for every query, as ``(question_id, key[, group], score, rank)``.

    With ``group`` only the best row of every group counts. With ``labels`` (an array column of the vectors) a query sees only
    rows that carry all labels of its ``needs``. Queries of at most ``query_bytes`` (measured) are broadcast: one pass over the vectors, whatever
    their number. More queries are joined as rows: blocks of queries and groups of vectors meet in a grid, each cell in a task of its own, and nothing
    passes the driver. In both ways a task multiplies ``block`` queries at a time and hands on its own best rows only.
    """
    needs = F.col("needs") if labels else F.array().cast("array<string>")
    numbered = written(queries.select("question_id", F.col(vector).cast("array<double>").alias("v"), needs.alias("needs")))
    keep = [key, *([group] if group else [])]
    slim = vectors.select(*keep, F.col(vector).cast("array<double>").alias("v"), *([F.col(labels).alias("labels")] if labels else []))
    schema = T.StructType([T.StructField("question_id", queries.schema["question_id"].dataType),
                           *[T.StructField(c, slim.schema[c].dataType) for c in keep], T.StructField("score", T.DoubleType())])
    asked = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v") * 8 + F.octet_length(F.to_json("needs")) + 64), F.lit(0)).alias("bytes")).first()
    if not asked.n:
        return queries.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    if asked.bytes <= query_bytes:
        shared = queries.sparkSession.sparkContext.broadcast(_query_blocks(numbered.toPandas(), block, bool(labels)))
        result = slim.mapInPandas(lambda batches: _local_topk(batches, shared.value, keep, top_k), schema)
    else:
        result = _grid_topk(slim, numbered, -(-asked.bytes // query_bytes), keep, top_k, block, bool(labels), schema)
    if group:
        first = F.min_by(F.struct(key, "score"), F.struct(-F.col("score"), F.col(key))).alias("b")
        result = result.groupBy("question_id", group).agg(first).select("question_id", group, "b.*")
    return top_rows(result, top_k, [F.desc("score"), F.col(key)])


def _query_blocks(part: pd.DataFrame, block: int, labelled: bool) -> list[tuple[list, np.ndarray, list | None]]:
    """(ids, vectors, needed labels) of ``block`` queries at a time."""
    pieces = [part.iloc[i:i + block] for i in range(0, len(part), block)]
    return [(p["question_id"].tolist(), np.stack(p["v"].to_numpy()), [list(n) for n in p["needs"]] if labelled else None) for p in pieces]


def _grid_topk(slim: DataFrame, queries: DataFrame, query_groups: int, keep: list[str], top_k: int, block: int, labelled: bool, schema: T.StructType) -> DataFrame:
    """Local best rows of each cell of (group of vectors, group of queries)."""
    vector_groups = max(1, -(-slim.count() // CELL_VECTORS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = slim.withColumn("__g", F.pmod(F.xxhash64(keep[0]), F.lit(vector_groups))).withColumn("__b", numbers(query_groups))
    right = queries.withColumn("__b", F.pmod(F.xxhash64("question_id"), F.lit(query_groups))).withColumn("__g", numbers(vector_groups))

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = list(_local_topk([rows], _query_blocks(asked, block, labelled), keep, top_k)) if len(rows) and len(asked) else []
        return pd.concat(found) if found else pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})

    return left.groupBy("__g", "__b").cogroup(right.groupBy("__g", "__b")).applyInPandas(cell, schema)


def _best_rows(best: pd.DataFrame | None, pdf: pd.DataFrame, names: list, q: np.ndarray, wanted: list | None, keep: list[str], top_k: int) -> pd.DataFrame:
    """The best rows of a block of queries after one more batch of vectors."""
    key = keep[0]
    scores = np.round(np.stack(pdf["v"].to_numpy()) @ q.T, 5) + 0.0
    if wanted is not None:  # rows that lack a label that the query needs are not seen
        sets = [set(x) if x is not None else set() for x in pdf["labels"]]
        lacks = {w: np.fromiter((w not in s for s in sets), bool, len(sets)) for w in {w for ws in wanted for w in ws}}
        for i, ws in enumerate(wanted):
            for w in ws:
                scores[lacks[w], i] = -np.inf
    # A row below the top_k-th best (of the groups' best) of its batch cannot count; equal scores stay for the sort.
    heads = scores
    if len(keep) > 1:
        code = pd.factorize(pdf[keep[1]])[0]
        order = np.argsort(code, kind="stable")
        heads = np.maximum.reduceat(scores[order], np.searchsorted(code[order], np.arange(code.max() + 1)), axis=0)
    enough = scores > -np.inf
    if len(heads) > top_k:
        enough &= scores >= np.partition(heads, len(heads) - top_k, axis=0)[len(heads) - top_k]
    query, row = np.nonzero(enough.T)
    found = pd.DataFrame({"q": query, "score": scores[row, query], **{c: pdf[c].to_numpy()[row] for c in keep}})
    best = found if best is None else pd.concat([best, found])
    best = best.sort_values(["q", "score", key], ascending=[True, False, True], kind="stable")
    if len(keep) > 1:
        best = best.groupby(["q", keep[1]], sort=False).head(1)
    return best.groupby("q", sort=False).head(top_k)


def _local_topk(batches: Iterable[pd.DataFrame], blocks: list[tuple[list, np.ndarray, list | None]], keep: list[str], top_k: int) -> Iterator[pd.DataFrame]:
    """Best rows of one task for all blocks of queries, kept up to date batch by batch."""
    best: list[pd.DataFrame | None] = [None] * len(blocks)
    for pdf in (batch.iloc[i:i + STEP_ROWS] for batch in batches for i in range(0, len(batch), STEP_ROWS)):
        best = [_best_rows(held, pdf, *one, keep, top_k) for held, one in zip(best, blocks, strict=True)]
    for held, (names, _, _) in zip(best, blocks, strict=True):
        if held is not None:
            yield pd.DataFrame({"question_id": [names[i] for i in held["q"]], **{c: held[c].to_numpy() for c in keep}, "score": held["score"].to_numpy()})


def dense_search(chunks: DataFrame, index: DataFrame, queries: DataFrame, *, top_k: int = 10, source_type: str | None = None,
                 adc_id: str | None = None, topic: str | None = None, required_entities: DataFrame | None = None,
                 question_topics: DataFrame | None = None) -> DataFrame:
    """Dense search over ``index(chunk_id, vector)``. Filters run before scoring; every document counts with its best chunk.

    ``required_entities`` and ``question_topics`` are filters per question as in :func:`sparse_search`.
    """
    topics = _topics(queries, topic, question_topics)
    allowed = filter_chunks(chunks, source_type, adc_id)
    if required_entities is None and topics is None:
        return dense_topk(index.join(allowed.select("chunk_id", "retrieval_document_id"), "chunk_id"), queries, top_k, group="retrieval_document_id")
    nothing = F.array().cast("array<string>")
    marked = lambda mark, c: F.transform(F.coalesce(F.col(c), nothing), lambda x: F.concat(F.lit(mark), x))
    members = allowed.select("chunk_id", "retrieval_document_id",
                             F.concat(marked("entity:", "metadata.adc_ids"), marked("topic:", "metadata.literature_topics")).alias("labels"))
    asked = queries
    if required_entities is not None:
        asked = asked.join(required_entities.select("question_id", F.concat(F.lit("entity:"), "entity_id").alias("__entity")), "question_id", "left")
    else:
        asked = asked.withColumn("__entity", F.lit(None).cast("string"))
    if topics is not None:
        named = asked.select("question_id", "__entity").join(topics.select("question_id", F.concat(F.lit("topic:"), "topic").alias("__topic")), "question_id")
        wanted = named.select("__entity", "__topic").distinct()
        seen = members.select("labels", F.explode("labels").alias("__topic")).join(wanted, "__topic").filter(
            F.col("__entity").isNull() | F.expr("array_contains(labels, __entity)")).select("__entity", "__topic").distinct()
        met = named.alias("n").join(seen.alias("s"), (F.col("n.__topic") == F.col("s.__topic")) & F.col("n.__entity").eqNullSafe(F.col("s.__entity")), "left_semi")
        asked = asked.join(met.select("question_id", "__topic"), "question_id", "left")
    else:
        asked = asked.withColumn("__topic", F.lit(None).cast("string"))
    asked = asked.withColumn("needs", F.array_compact(F.array("__entity", "__topic")))
    return dense_topk(index.join(members, "chunk_id"), asked, top_k, group="retrieval_document_id", labels="labels")


def fuse(sparse: DataFrame, dense: DataFrame, *, top_k: int = 10, sparse_weight: float = 6.0, dense_weight: float = 1.0,
         key: str = "retrieval_document_id") -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of the sparse list, then of the dense list."""
    nothing = F.lit(None).cast("int")
    s = sparse.select("question_id", key, F.col("rank").alias("sparse_rank"), nothing.alias("dense_rank"))
    d = dense.select("question_id", key, nothing.alias("sparse_rank"), F.col("rank").alias("dense_rank"))
    both = s.unionByName(d).groupBy("question_id", key).agg(F.min("sparse_rank").alias("sparse_rank"), F.min("dense_rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(RRF_CONSTANT)) + F.col(r).cast("double")), F.lit(0.0))
    scored = both.withColumn("score", F.round(part(sparse_weight, "sparse_rank") + part(dense_weight, "dense_rank"), 9))
    order = [F.desc("score"), F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("dense_rank"), F.col(key)]
    return top_rows(scored, top_k, order)


def hybrid_search(chunks: DataFrame, index: DataFrame, questions: DataFrame, queries: DataFrame, *, top_k: int = 10,
                  candidate_k: int = 60, sparse_weight: float = 6.0, dense_weight: float = 1.0,
                  question_entities: DataFrame | None = None, **filters) -> DataFrame:
    sparse = sparse_search(chunks, questions, top_k=candidate_k, question_entities=question_entities, **filters)
    dense = dense_search(chunks, index, queries, top_k=candidate_k, **filters)
    return fuse(sparse, dense, top_k=top_k, sparse_weight=sparse_weight, dense_weight=dense_weight)


def with_chunk(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused rows name documents only; give each the first chunk of its document."""
    if "chunk_id" in results.columns:
        return results
    first = chunks.join(results.select("retrieval_document_id").distinct(), "retrieval_document_id", "left_semi").groupBy(
        "retrieval_document_id").agg(F.min("chunk_id").alias("chunk_id"))
    return results.join(first, "retrieval_document_id")


def search(mode: str, chunks: DataFrame, questions: DataFrame, *, index: DataFrame | None = None, dimension: int = 384,
           top_k: int = 10, **options) -> DataFrame:
    """``sparse``, ``dense`` or ``hybrid`` with the hashing embedder for the questions."""
    if mode == "sparse":
        return sparse_search(chunks, questions, top_k=top_k, **options)
    if mode not in {"dense", "hybrid"}:
        raise ValueError(f"unknown retrieval mode: {mode}")
    if index is None:
        raise RuntimeError("a vector index is needed")
    queries = questions.select("question_id", hashing_embedding(F.col("question"), dimension).alias("vector"))
    if mode == "dense":
        options.pop("question_entities", None)  # the boost belongs to the sparse list
        return dense_search(chunks, index, queries, top_k=top_k, **options)
    return hybrid_search(chunks, index, questions, queries, top_k=top_k, **options)


def build_vector_index(chunks: DataFrame, dimension: int = 384) -> DataFrame:
    """Vectors of title and content of every chunk."""
    return chunks.select("chunk_id", hashing_embedding(F.concat_ws("\n", "title", "content"), dimension).alias("vector"))


def check_index(index: DataFrame, manifest: dict[str, object], chunk_count: int, corpus_version: str) -> None:
    """An index must hold one vector per chunk of exactly the current corpus."""
    if index.count() != chunk_count:
        raise RuntimeError("vector and chunk counts differ")
    if manifest.get("retrieval_corpus_version") != corpus_version:
        raise RuntimeError("the index belongs to another corpus version")
