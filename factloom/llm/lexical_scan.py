"""Ranked lexical search by scanning the documents with an automaton of all item terms.

Terms are maximal runs of digits, letters and characters beyond ASCII; A-Z are lower-cased. A text is rewritten so that all between its terms is white space, and an
Aho-Corasick automaton of `` term `` patterns (a guard on both sides, so no part of a term can match) is run over it: what it puts out are
numbers of terms, counted as tf. Terms lead to the items that hold them. There is no index of the documents: one pass over the texts gives the number of
documents, of terms, and of documents for each term; a second one counts tf again, scores, and keeps the best rows of each item in each task.

Items are dealt into blocks of at most ``BLOCK_BYTES`` of terms and item numbers (measured; more only if one item alone is larger); terms, weights and item lists of
one block at a time are broadcast, and each block costs two passes over the texts. Sums are exact integers.

Cases: a null text has no terms and is no document; items without terms and documents without a score above 0 are not returned; rows with one
item_id (null too) are one item; rows with one doc_id are documents of their own; equal scores are in the order of doc_id, null last; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tokens import Texts, ranges, steps
from factloom.operators.stages import written

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BLOCK_BYTES = 8 << 20
#: Characters of one run of the automaton, and candidates that are held before the best are kept.
SLICE, HELD = 1 << 20, 1 << 16
#: Share of a document's length in its norm, in hundredths.
NORM = 75

_LOWER = np.full(256, 0x20, dtype=np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


class Block:
    """The terms of some items: ``items[begin[t]:begin[t + 1]]`` hold term t, each ``repeats`` times."""

    def __init__(self, terms: list[str], begin: np.ndarray, items: np.ndarray, repeats: np.ndarray, count: int):
        self.name = uuid.uuid4().hex
        self.terms, self.begin, self.items, self.repeats, self.count = terms, begin, items, repeats, count
        self.weights: np.ndarray | None = None
        self.documents = self.length = 0

    @classmethod
    def of(cls, rows: list[tuple[int, str, int]], count: int) -> Block:
        terms = sorted({t for _, t, _ in rows})
        number = {t: k for k, t in enumerate(terms)}
        held = sorted((number[t], item, n) for item, t, n in rows)
        begin = np.searchsorted(np.array([t for t, _, _ in held], dtype=np.int64), np.arange(len(terms) + 1))
        return cls(terms, begin, np.array([i for _, i, _ in held], dtype=np.int64), np.array([n for _, _, n in held], dtype=np.int64), count)

    def weighed(self, documents: int, length: int, holding: dict[int, int]) -> Block:
        """The block with the weights of its terms."""
        out = Block(self.terms, self.begin, self.items, self.repeats, self.count)
        out.documents, out.length = documents, length
        out.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(self.terms))], dtype=np.int64)
        return out

    @functools.cached_property
    def exact_in_doubles(self) -> bool:
        """No sum of an item reaches 2 ** 53: a term adds less than its weight times a million for each repeat."""
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.begin))
        return float(np.bincount(self.items, self.weights[of].astype(float) * self.repeats, self.count).max(initial=0)) * 1e6 < 2 ** 52

    def scores(self, terms: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """The score of one document for each item."""
        norm = 100 - NORM + NORM * n * self.documents // self.length
        part = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
        held = self.begin[terms + 1] - self.begin[terms]
        at = ranges(self.begin[terms], held)
        added = np.repeat(part, held) * self.repeats[at]
        if self.exact_in_doubles:
            return np.bincount(self.items[at], added, self.count).astype(np.int64)
        out = np.zeros(self.count, dtype=np.int64)
        np.add.at(out, self.items[at], added)
        return out


_SCANNERS: dict[str, object] = {}


def scanner(block: Block):
    """The automaton of a block; a worker keeps that of the last block."""
    if block.name not in _SCANNERS:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, term in enumerate(block.terms):
            automaton.add_word(f" {term} ", k)
        automaton.make_automaton()
        _SCANNERS.clear()
        _SCANNERS[block.name] = automaton
    return _SCANNERS[block.name]


def _slices(text: bytes) -> Iterator[str]:
    """Guarded parts of a rewritten text; a term is never cut."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield f" {text[at:end].decode()} "
        at = end


def occurrences(automaton, text: bytes, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a rewritten text and their tf."""
    if len(text) <= SLICE:
        return np.unique(np.fromiter(map(itemgetter(1), automaton.iter(f" {text.decode()} ")), dtype=np.int64), return_counts=True)
    counts = np.zeros(terms, dtype=np.int64)
    for part in _slices(text):
        found = map(itemgetter(1), automaton.iter(part))
        while len(some := np.fromiter(itertools.islice(found, SLICE), dtype=np.int64)):
            counts += np.bincount(some, minlength=terms)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


def _rewritten(column: pa.Array) -> Iterator[tuple[int, Texts, np.ndarray]]:
    """(first row, rewritten texts, terms of each) of parts of a column."""
    for row, _, texts in steps(column):
        plain = Texts(_LOWER[texts.buffer], texts.offsets)
        yield row, plain, np.diff(plain.words()[2])


def _counter(broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        automaton, holding = scanner(block), np.zeros(len(block.terms) + 2, dtype=np.int64)
        for batch in batches:
            for _, texts, sizes in _rewritten(batch.column("text")):
                holding[-2:] += (int((sizes > 0).sum()), int(sizes.sum()))
                data = texts.buffer.tobytes()
                for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
                    holding[occurrences(automaton, data[a:b], len(block.terms))[0]] += 1
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_pydict({"term": some, "n": holding[some]})

    return count


def _scorer(broadcast, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        automaton = scanner(block)
        least = np.ones(block.count, dtype=np.int64)  # a row must score as much to be among the best
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # item, score, doc_id is null, doc_id
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def kept():
            parts = [np.concatenate([b, *(np.full(len(h[0]), h[c]) if c > 1 else h[c] for h in held)]) for c, b in enumerate(best)]
            order = np.lexsort((parts[3], parts[2], -parts[1], parts[0]))
            item = parts[0][order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            full = place == k - 1
            least[item[full]] = parts[1][order][full]
            held.clear()
            return tuple(p[order][place < k] for p in parts)

        for batch in batches:
            ids = batch.column("doc_id")
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for row, texts, sizes in _rewritten(batch.column("text")):
                data = texts.buffer.tobytes()
                for r, (a, b, n) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), sizes.tolist(), strict=True), row):
                    terms, tf = occurrences(automaton, data[a:b], len(block.terms))
                    if len(terms):
                        scores = block.scores(terms, tf, n)
                        items = np.flatnonzero(scores >= least)
                        if len(items):
                            held.append((items, scores[items], int(nulls[r]), int(ids[r])))
                            size += len(items)
                            if size >= HELD:
                                best, size = kept(), 0
        best = kept()
        yield pa.RecordBatch.from_pydict({"item": best[0], "score": best[1], "doc_id": pa.array(best[3], mask=best[2].astype(bool))})

    return score


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of the items with terms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def dealt(terms: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The terms with the block of their item, and the number of blocks: as many as it takes to keep each within the limit."""
    size = F.octet_length("term") + 40
    total = terms.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    while True:
        rows = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        over = rows.groupBy("block").agg(F.sum(size).alias("bytes"), F.min("item_id").eqNullSafe(F.max("item_id")).alias("single")).where((F.col("bytes") > block_bytes) & ~F.col("single"))
        if not over.limit(1).count():
            return rows, blocks
        blocks *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    terms, blocks = dealt(written(item_terms(items)), block_bytes)
    out = None
    for number in range(blocks):
        rows = terms.where(F.col("block") == number).collect()  # at most block_bytes
        names = list(dict.fromkeys(r.item_id for r in rows))
        if not names and (out is not None or number + 1 < blocks):
            continue
        place = {name: i for i, name in enumerate(names)}
        block = Block.of([(place[r.item_id], r.term, r.repeats) for r in rows], len(names))
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {dict(items.dtypes)['item_id']}")
        if names:
            counted = texts.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(block)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row for each term
            holding = {r.term: r.n for r in counted}
            weighed = block.weighed(holding.get(len(block.terms), 0), holding.get(len(block.terms) + 1, 0), holding)
            found = texts.mapInArrow(_scorer(spark.sparkContext.broadcast(weighed), k), "item long, score long, doc_id long")
        else:
            found = spark.createDataFrame([], "item long, score long, doc_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(named), "item")
        best = best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
