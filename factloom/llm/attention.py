"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded as shares of character classes, word lengths and
repetition and as hashed counts of word shapes and endings; a learned layer ``h = tanh(xW + b)`` encodes it further. Gated attention
``a = softmax(w . (tanh(hV) * sigmoid(hU)))`` weighs the passages, and the document's score is ``sigmoid(c . sum(a h) + d)``. Only
documents carry labels; the passages' weights are learned from them.

The model is fitted on all passages of at most ``max_documents`` labelled documents (chosen by a hash) and broadcast; its size is fixed. Scoring reads every passage of every text, in parts of bounded size.

Cases: a null or empty text is a bag of one passage without words and gets a score like any other; labels other than 0 and 1 and null
doc_ids are not learned from; a doc_id that is labelled twice is learned twice; with no labelled rows or one class only, every score is
the smoothed share of label 1; an empty table gives no rows; other columns are handed on untouched, and an existing column named like
an output is replaced unless another name is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factloom.llm.tokens import SPACE, Texts, run_hashes, byte_runs, steps

PASSAGE_WORDS = 96
HASHED = 32


def _classes() -> np.ndarray:
    """Classes of bytes: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 comma, 7 other ASCII mark, 8 symbol, 9 lead byte, 10 tail."""
    kind = np.full(256, 7, dtype=np.int64)
    kind[SPACE] = 0
    kind[0x0A] = 1
    kind[ord("a"):ord("z") + 1], kind[ord("A"):ord("Z") + 1], kind[ord("0"):ord("9") + 1] = 2, 3, 4
    kind[[ord(c) for c in ".!?"]], kind[ord(",")] = 5, 6
    kind[[ord(c) for c in "#*$%&|<>"]] = 8
    kind[0xC0:], kind[0x80:0xC0] = 9, 10
    return kind


KINDS = 11
KIND = _classes()
DENSE = KINDS + 8
FEATURES = DENSE + HASHED


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the index of the first passage of each text (one more than texts)."""
    buffer = texts.buffer
    starts, ends, first = texts.words()
    counts = np.diff(first)
    bags = np.maximum(1, -(-counts // PASSAGE_WORDS))
    edge = np.concatenate([[0], np.cumsum(bags)])
    n = int(edge[-1])
    text_of_word = np.repeat(np.arange(len(texts)), counts)
    passage = edge[text_of_word] + (np.arange(len(starts)) - first[text_of_word]) // PASSAGE_WORDS
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(starts):
        return out, edge
    # bytes from the start of a passage's first word to the start of the next one's, or the text's end
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    opens, at = starts[heads], passage[heads]
    closes = np.minimum(np.append(opens[1:], len(buffer)), texts.offsets[np.searchsorted(texts.offsets, opens, side="right")])
    size = np.maximum(closes - opens, 1).astype(np.float64)
    of_byte = np.repeat(np.arange(len(heads)), np.diff(np.append(opens, len(buffer))))
    shares = np.bincount(of_byte * KINDS + KIND[buffer[opens[0]:]], minlength=len(heads) * KINDS).reshape(len(heads), KINDS)
    out[at, :KINDS] = np.sqrt(shares / size[:, None])
    words = np.bincount(passage, minlength=n).astype(np.float64)[at]
    lengths = (ends - starts).astype(np.float64)
    total = np.bincount(passage, weights=lengths, minlength=n)[at]
    square = np.bincount(passage, weights=lengths * lengths, minlength=n)[at]
    mean = total / words
    hashes = byte_runs(buffer, starts, ends)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashes, text_of_word))
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text_of_word[order[1:]] == text_of_word[order[:-1]])
    pairs = np.zeros(len(starts), dtype=np.uint64)
    pairs[1:] = hashes[1:] * np.uint64(31) ^ hashes[:-1]
    order = np.lexsort((pairs, text_of_word))
    twice = np.zeros(len(starts), dtype=bool)
    twice[order[1:]] = (pairs[order[1:]] == pairs[order[:-1]]) & (text_of_word[order[1:]] == text_of_word[order[:-1]])
    marks = KIND[buffer[ends - 1]]
    capital = KIND[buffer[starts]] == 3
    share = lambda flag: np.bincount(passage, weights=flag, minlength=n)[at] / words
    out[at, KINDS:DENSE] = np.stack([
        np.log1p(words) / 5, mean / 10, np.sqrt(np.maximum(square / words - mean * mean, 0)) / 5, share(same), share(again), share(twice), share(marks == 8), share(capital)], axis=1)
    # hashed shapes: the classes of first and last byte and the length, and the last three bytes
    shape = (KIND[buffer[starts]] * KINDS + marks) * 16 + np.minimum(lengths, 15).astype(np.int64)
    tails = byte_runs(buffer, np.maximum(starts, ends - 3), ends, 1)
    half = HASHED // 2
    for column, key in ((DENSE, run_hashes(shape.astype(np.uint64), np.arange(len(shape)), np.arange(1, len(shape) + 1))), (DENSE + half, tails)):
        filled = np.bincount(passage * half + (key % np.uint64(half)).astype(np.int64), minlength=n * half).reshape(n, half)[at]
        out[at, column:column + half] = np.sqrt(filled / words[:, None])
    return out, edge


@dataclass
class Model:
    """Weights; ``prior`` alone scores when nothing could be learned."""

    prior: float
    weights: dict[str, np.ndarray] | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, features: np.ndarray, edge: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(edge) - 1, self.prior)
        x = np.clip((features - self.mean) / self.scale, -8, 8).astype(np.float32)
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, x, edge)["logit"], -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, edge: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    t = np.tanh(h @ p["V"])
    g = 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
    s = (t * g) @ p["w"]
    sizes = np.diff(edge)
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, edge[:-1]), sizes))
    a = e / np.repeat(np.add.reduceat(e, edge[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, edge[:-1])
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}


def _gradients(p, x, edge, y, weight, decay):
    f = _forward(p, x, edge)
    sizes = np.diff(edge)
    err = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight / weight.sum()
    dz = err[:, None] * p["c"]
    dz_rows = np.repeat(dz, sizes, axis=0)
    da = (dz_rows * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, edge[:-1]), sizes))
    du = ds[:, None] * p["w"]
    dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz_rows + dt @ p["V"].T + dg @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    grads = {"W": x.T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "d": err.sum()}
    return {k: v + decay * p[k] * (k not in "bd") for k, v in grads.items()}


def train(features: np.ndarray, edge: np.ndarray, labels: np.ndarray, hidden: int = 24, gates: int = 12, rounds: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam over shuffled batches of documents; both classes weigh alike, and the scores are set back half way to the labels' own balance."""
    ones = float(labels.sum())
    prior = (ones + 1) / (len(labels) + 2)
    if ones in (0.0, float(len(labels))):
        return Model(prior)
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = np.clip((features - mean) / scale, -8, 8).astype(np.float32)
    random = np.random.default_rng(seed)
    small = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": small(x.shape[1], hidden), "b": np.zeros(hidden), "V": small(hidden, gates), "U": small(hidden, gates), "w": small(gates), "c": small(hidden), "d": np.zeros(())}
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones)) * len(labels)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    sizes = np.diff(edge)
    for _ in range(rounds):
        order = random.permutation(len(labels))
        for some in np.array_split(order, max(1, len(order) // batch)):
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in some])
            part = np.concatenate([[0], np.cumsum(sizes[some])])
            step += 1
            for k, v in _gradients(p, x[rows], part, labels[some], weight[some], decay).items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    p["d"] = p["d"] + np.log(ones / (len(labels) - ones)) / 2
    return Model(prior, {k: v.astype(np.float32) for k, v in p.items()}, mean, scale)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in steps(batch.column("text"), 400_000):
            features, edge = passages(texts)
            parts = [np.ascontiguousarray(features[a:b], dtype="<f4").tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "quality": part.column("quality"), "bag": pa.array(parts, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 4_000, label: str = "quality") -> Model:
    """A model from a bounded sample of the labelled documents.

    ``max_documents`` labelled rows with the smallest hashes of their doc_id are taken, then as many of their documents, in the order of that hash and of
    the text's; equal rows count once. Each is encoded whole on the executors, and the driver receives their passages.
    """
    usable = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_documents)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    named = keyed.select("doc_id", "text_key").join(F.broadcast(sample), "doc_id").distinct()
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key", "quality").limit(max_documents)
    met = keyed.join(F.broadcast(chosen), ["doc_id", "text_key"]).select("doc_id", "text_key", "quality", "text")
    bags = met.mapInArrow(_bags, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, quality int, bag binary")
    once = bags.groupBy("doc_id", "text_key", "quality").agg(F.min("bag").alias("bag"))
    rows = sorted((int(r.quality), bytes(r.bag)) for r in once.select("quality", "bag").collect())  # max_documents at most
    if not rows:
        return Model(0.5)
    bags = [np.frombuffer(b, dtype="<f4").reshape(-1, FEATURES) for _, b in rows]
    edge = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags), edge, np.array([q for q, _ in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, name: str = "score", predicted: str = "predicted") -> DataFrame:
    """All rows and columns of the documents with score and predicted (1 if score >= threshold, else 0), named as asked."""
    kept = docs.drop(name, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 400_000):
                values = shared.value.score(*passages(texts)).astype(np.float64)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema).withColumn(predicted, (F.col(name) >= threshold).cast("int"))
