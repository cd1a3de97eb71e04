"""Documents with similar n-gram sets: MinHash banding for candidates, full sets for the decision.

1. Each text becomes the set of its ``n``-word shingles (as 64-bit hashes), a digest of that set and one hash per band. Texts with equal
   sets are one class from here on; ``choose_bands`` picks bands and rows so that a pair at the threshold meets in a band with the wanted
   probability.
2. Classes that share a band hash are tied to the least of them; components of these ties are candidate groups.
3. Each group is cut into chunks of about ``CHUNK`` sets, and each pair of chunks is one small task's work: all its pairs are verified on
   the full sets as products of membership matrices. No pair leaves the task, only each set's number of linked documents and one tie to
   the least set of its part; components of these ties are the result's classes.

A pair of chunks is bounded, so a group of any size spreads over many tasks; its work is the square of its number of *different* sets.

Cases: a text of fewer than ``n`` words has one shingle of all its words; a null text or one without words has none, and is linked to
nothing; copies link to each other with similarity 1; rows with one doc_id count as documents of their own; a null doc_id stays null and
its class is named by the least doc_id beside it, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.tokens import Texts, _splitmix, byte_runs, run_hashes, steps
from factloom.llm.files import free_name
from factloom.operators.stages import written

CHUNK = 96
COLUMNS = 8_192


def choose_bands(threshold: float, recall: float, max_hashes: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall with at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        meets = threshold**rows
        bands = 1 if meets >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meets))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins (one more than texts)."""
    starts, ends, first = texts.words()
    words = byte_runs(texts.buffer, starts, ends)
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    edge = np.concatenate([[0], np.cumsum(grams)])
    text = np.repeat(np.arange(len(texts)), grams)
    begin = first[text] + np.arange(len(text)) - edge[text]
    hashes = run_hashes(words, begin, begin + np.minimum(n, counts[text]))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


SIGNED = "doc_id long, text_key long, set_key binary, bands array<long>"


def _signer(n: int, bands: int, rows: int):
    random = np.random.default_rng(2024)
    factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    offsets = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 1_000_000):
                hashes, edge = shingle_sets(texts, n)
                filled = np.flatnonzero(np.diff(edge))
                begins = edge[filled]
                banded = np.zeros((len(filled), bands), dtype=np.uint64)
                for band in range(bands if len(filled) else 0):
                    mixed = np.full(len(filled), band + 1, dtype=np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat(hashes * factors[k] + offsets[k] >> np.uint64(3), begins)
                        mixed = _splitmix(mixed ^ least)
                    banded[:, band] = mixed
                keys: list[bytes | None] = [None] * (end - row)
                lists: list[np.ndarray | None] = [None] * (end - row)
                if len(filled):
                    sums = np.stack([np.add.reduceat(_splitmix(hashes ^ np.uint64(s)), begins) for s in (1, 2)] + [np.diff(edge)[filled].astype(np.uint64)], axis=1)
                    for k, i in enumerate(filled.tolist()):
                        keys[i], lists[i] = sums[k].tobytes(), banded[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("text_key").slice(row, end - row), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "set_key", "bands"])

    return sign


def _setter(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 1_000_000):
                hashes, edge = shingle_sets(texts, n)
                data = [hashes[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                cut = [batch.column(c).slice(row, end - row) for c in ("node", "group_id", "copies", "chunks")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(data, pa.binary())], names=["node", "group_id", "copies", "chunks", "shingles"])

    return sets


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, summed over slices of the values that occur."""
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        block = np.zeros((len(sizes), min(COLUMNS, len(values) - begin)), dtype=np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        out += block[:len(left)] @ block[len(left):].T
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index of each one's component under a symmetric link matrix."""
    label = np.arange(len(links))
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = np.minimum(label, least)


VERIFIED = "node long, links long, tie long"


def _verifier(threshold: float):
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:3])
        chunk = table.column("chunk").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), chunk))
        table, chunk = table.take(pa.array(order)), chunk[order]
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        cut = int((chunk == i).sum()) if i != j else 0
        left, right = (sets[:cut], sets[cut:]) if i != j else (sets, sets)
        ls, rs = (sizes[:cut], sizes[cut:]) if i != j else (sizes, sizes)
        linked = np.zeros((len(sets), len(sets)), dtype=bool)
        if left and right:
            common = _shared(left, right).astype(np.float64)
            found = common >= threshold * (ls[:, None] + rs[None, :] - common) - 1e-9
            if i == j:
                linked = found & ~np.eye(len(sets), dtype=bool)
            else:
                linked[:cut, cut:] = found
                linked[cut:, :cut] = found.T
        return pa.table({"node": nodes, "links": (linked @ copies).astype(np.int64), "tie": nodes[_roots(linked)]})

    return verify


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def similar(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), class_id (the least doc_id of its class), n_links (other documents
    of at least the similarity) and kept (it is the first of its class by doc_id, or has no words)."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = written(texts.mapInArrow(_signer(n, bands, rows), SIGNED))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"), "text_key"))
    sets = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), first.alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()))
    keyed = sets.select("node", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "a")
    groups = components(keyed.join(heads, "band").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    verified = _verified(texts, sets.select("node", "first.*", "copies"), groups, n, threshold)
    labels = components(verified.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = sets.select("set_key", "node", "least", "first", "copies").join(labels, "node", "left").join(links, "node", "left")
    found = found.withColumn("label", F.coalesce("label", "node"))
    names = found.groupBy("label").agg(F.min("least").alias("class_id"), F.min("first").alias("head"))
    classes = found.join(names, "label").select("set_key", "class_id", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = signed.select("doc_id", "text_key", "set_key").join(classes, "set_key", "left")
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"), F.col("text_key"))
    alone = F.col("set_key").isNull()
    return joined.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (alone | (F.col("head") == own)).alias("kept"))


def _verified(texts: DataFrame, sets: DataFrame, groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, tie) from every chunk pair of every candidate group."""
    sized = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size")).select("label", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    members = groups.join(sized, "label").join(sets, "node").select("node", F.col("label").alias("group_id"), "chunks", "copies", "doc_key", "text_key")
    keyed = texts.withColumn("doc_key", F.coalesce("doc_id", F.lit(NO_ID))).drop("doc_id")
    rows = keyed.join(members, ["doc_key", "text_key"]).groupBy("doc_key", "text_key", "node", "group_id", "copies", "chunks").agg(F.any_value("text").alias("text"))
    shingled = rows.select("node", "group_id", "copies", "chunks", "text").mapInArrow(_setter(n), "node long, group_id long, copies long, chunks int, shingles binary")
    chunked = shingled.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("node", "group_id", "copies", "chunk", "shingles", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return written(spread.groupBy("group_id", "i", "j").applyInArrow(_verifier(threshold), VERIFIED))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The first document of each class by doc_id, and all without words; rows equal in doc_id and text count once. Columns stay."""
    keys = [free_name(k, docs.columns) for k in ("__doc_key", "__text_key")]
    keyed = docs.withColumn(keys[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(keys[1], F.xxhash64("text"))
    dropped = similar(docs, **parameters).where("NOT kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(keys[0]), F.col("text_key").alias(keys[1]))
    return keyed.join(dropped, keys, "left_anti").dropDuplicates(keys).drop(*keys)
