"""Repeated passages by an exact index of windows over all earlier text, in place of a relative Lempel-Ziv parse.

A phrase is a window of ``WINDOW`` words. The first place of each phrase, by (doc_id, start), is the reference. Every phrase is looked up,
and a word is removed exactly if some phrase that covers it also starts earlier. No greedy parse decides anything: its factors depend on where earlier
ones end, and a phrase across the boundary of two factors would need a lookup of its own. ``factors`` are only the runs of
phrases that continue one reference place word by word, named afterwards.

1. Anchors: of the ``GRAM``-word grams in a phrase the one of least hash; equal phrases have equal anchors at equal places, and only
   about one gram in eight is an anchor. Anchors that occur once rule out their phrases. Grams are dealt over blocks of the index; a task
   sends each gram once for each part of its input, so a very frequent gram brings a block one record for each part, not for each place.
2. Phrases at repeated anchors are dealt over the blocks in the same way; a block finds the first place of each and hands back runs of
   (start, count, reference place).
3. Runs meet their document again and are joined to factors.

The number of blocks follows the bytes of all texts, so a block stays bounded. Texts are shuffled once, for both joins.

Cases: a null text has no words; a text shorter than a phrase keeps all words; rows equal in doc_id and text are the same place and do
not remove each other; rows with one doc_id and other texts are parsed apart, equal starts do not remove each other; a null doc_id comes
before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import Texts, byte_runs, ranges, run_hashes, steps

WINDOW = 20
GRAM = 6
BLOCK_BYTES = 1 << 20
NO_ID = -(1 << 63)

GRAM_ROW = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("key", "<u4")])
HEAD = np.dtype([("doc", "<i8"), ("key", "<u4"), ("n", "<u4")])
ITEM = np.dtype([("first", "<u8"), ("second", "<u4"), ("at", "<u4")])
RUN = np.dtype([("at", "<u4"), ("n", "<u4"), ("ref_doc", "<i8"), ("ref_at", "<u4")])


class Parsed:
    """Words, phrases and anchors of some texts."""

    def __init__(self, texts: Texts, window: int):
        self.starts, self.ends, self.first = texts.words()
        counts = np.diff(self.first)
        self.words = [byte_runs(texts.buffer, self.starts, self.ends, s) for s in (0, 1)]
        gram = min(GRAM, window)
        phrases = np.maximum(counts - window + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), phrases)
        self.at = ranges(np.zeros(len(phrases), dtype=np.int64), phrases)
        self.begin = self.first[self.text] + self.at
        grams = max(0, len(self.starts) - gram + 1)
        places = np.arange(grams, dtype=np.int64)
        hashes = run_hashes(self.words[0], places, places + gram)
        least, where = hashes, places
        span = 1
        wanted = window - gram + 1
        while span < wanted:  # the leftmost least gram of each phrase, by doubling
            step = min(span, wanted - span)
            a, b = least[:len(least) - step], least[step:]
            left = a <= b
            least, where = np.where(left, a, b), np.where(left, where[:len(where) - step], where[step:])
            span += step
        self.anchor, self.anchor_at = least[self.begin], where[self.begin]

    def phrases(self, some: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        begin = self.begin[some]
        return run_hashes(self.words[0], begin, begin + window, 0), (run_hashes(self.words[1], begin, begin + window, 1) >> np.uint64(32)).astype(np.uint32)


def _keys(batch: pa.RecordBatch, row: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(row, end - row)
    return part.column("doc").to_numpy(zero_copy_only=False), part.column("key").to_numpy(zero_copy_only=False).astype(np.uint32)


def _ends(opens: np.ndarray, total: int) -> list[int]:
    """Where the parts end that begin at ``opens``."""
    return np.append(opens, total)[1:].tolist()


def _cut(values: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    values, block = values[order], block[order]
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(edges.tolist(), _ends(edges, len(block)), strict=True):
        yield int(block[a]), values[a:b]


def _blobs(*parts: dict[int, bytes]) -> pa.RecordBatch:
    blocks = sorted(set().union(*parts))
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(pa.array([p.get(b) for b in blocks], pa.binary()) for p in parts)], names=["block", "sent", "known", "heads"][:1 + len(parts)])


def _send_grams(window: int, blocks: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 4_000_000):
                doc, key = _keys(batch, row, end)
                parsed = Parsed(texts, window)
                anchors = np.flatnonzero(np.diff(parsed.anchor_at, prepend=-1))  # each place once; phrases come in order
                gram, text = parsed.anchor[anchors], parsed.text[anchors]
                order = np.lexsort((text, gram))
                gram, text = gram[order], text[order]
                opens = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
                rows = np.zeros(len(gram), dtype=GRAM_ROW)
                rows["gram"], rows["doc"], rows["key"] = gram, doc[text], key[text]
                several = np.repeat(np.diff(np.append(opens, len(gram))) > 1, np.diff(np.append(opens, len(gram))))
                fresh = np.ones(len(gram), dtype=bool)
                fresh[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                sent, known = rows[opens], rows[several & fresh]
                of = lambda r: (r["gram"] % np.uint64(blocks)).astype(np.int64)
                spread = (known["doc"].astype(np.uint64) % np.uint64(blocks)).astype(np.int64)
                yield _blobs({b: v.tobytes() for b, v in _cut(sent, of(sent))}, {b: v.tobytes() for b, v in _cut(known, spread)})

    return send


def _joined(table: pa.Table, column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x), dtype=kind)


def _by_document(rows: np.ndarray, column: str) -> pa.Table:
    """One row for each document with the bytes of its values."""
    order = np.lexsort((rows["key"], rows["doc"]))
    rows = rows[order]
    change = np.ones(len(rows), dtype=bool)
    change[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
    opens = np.flatnonzero(change)
    values = np.ascontiguousarray(rows[column])
    data = [values[a:b].tobytes() for a, b in zip(opens.tolist(), _ends(opens, len(rows)), strict=True)]
    return pa.table({"doc": rows["doc"][opens].astype(np.int64), "key": rows["key"][opens].astype(np.int64), "data": pa.array(data, pa.binary())})


def _repeated_grams(table: pa.Table) -> pa.Table:
    sent, known = _joined(table, "sent", GRAM_ROW), _joined(table, "known", GRAM_ROW)
    order = np.argsort(sent["gram"], kind="stable")
    sent = sent[order]
    same = sent["gram"][1:] == sent["gram"][:-1]
    repeated = np.zeros(len(sent), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    return _by_document(np.concatenate([sent[repeated], known]), "gram")


def _firsts(doc: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase the index of its first place, and whether it starts later than that."""
    order = np.lexsort((at, doc, second, first))
    f, s = first[order], second[order]
    change = np.ones(len(order), dtype=bool)
    change[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    head = np.empty(len(order), dtype=np.int64)
    head[order] = order[np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))]
    return head, (doc != doc[head]) | (at != at[head])


def _run_rows(doc, key, at, ref_doc, ref_at) -> np.ndarray:
    """Phrases with their reference places as rows (doc, key, run), runs as long as document and reference go on together."""
    order = np.lexsort((at, key, doc))
    doc, key, at, ref_doc, ref_at = (x[order] for x in (doc, key, at, ref_doc, ref_at))
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] != ref_at[:-1] + 1)
    begin = np.flatnonzero(opens)
    out = np.zeros(len(begin), dtype=[("doc", "<i8"), ("key", "<u4"), ("run", RUN)])
    out["doc"], out["key"] = doc[begin], key[begin]
    run = out["run"]
    run["at"], run["n"], run["ref_doc"], run["ref_at"] = at[begin], np.diff(np.append(begin, len(doc))), ref_doc[begin], ref_at[begin]
    return out


RUN_ROW = np.dtype([("doc", "<i8"), ("key", "<u4"), ("run", RUN)])


def _send_phrases(window: int, blocks: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 4_000_000):
                doc, key = _keys(batch, row, end)
                parsed = Parsed(texts, window)
                flags = batch.column("flags").slice(row, end - row).to_pylist()
                wanted = np.unique(np.concatenate([np.frombuffer(b"".join(x), dtype="<u8") for x in flags if x] or [np.zeros(0, np.uint64)]))
                some = np.flatnonzero(np.isin(parsed.anchor, wanted))
                first, second = parsed.phrases(some, window)
                text, at = parsed.text[some], parsed.at[some]
                head, later = _firsts(doc[text], at, first, second)
                where = np.flatnonzero(later)
                runs = _run_rows(doc[text[where]], key[text[where]], at[where], doc[text[head[where]]], at[head[where]])
                known = {b: v.tobytes() for b, v in _cut(runs, (runs["doc"].astype(np.uint64) % np.uint64(blocks)).astype(np.int64))}
                keep = np.flatnonzero(~later)  # the first place of each phrase here
                block = (parsed.anchor[some[keep]] % np.uint64(blocks)).astype(np.int64)
                order = np.lexsort((at[keep], text[keep], block))
                keep, block = keep[order], block[order]
                items = np.zeros(len(keep), dtype=ITEM)
                items["first"], items["second"], items["at"] = first[keep], second[keep], at[keep]
                change = np.ones(len(keep), dtype=bool)
                change[1:] = (block[1:] != block[:-1]) | (text[keep][1:] != text[keep][:-1])
                opens = np.flatnonzero(change)
                heads = np.zeros(len(opens), dtype=HEAD)
                heads["doc"], heads["key"], heads["n"] = doc[text[keep][opens]], key[text[keep][opens]], np.diff(np.append(opens, len(keep)))
                yield _blobs({b: v.tobytes() for b, v in _cut(items, block)}, known, {b: v.tobytes() for b, v in _cut(heads, block[opens])})

    return send


def _repeated_phrases(table: pa.Table) -> pa.Table:
    items, known, heads = _joined(table, "sent", ITEM), _joined(table, "known", RUN_ROW), _joined(table, "heads", HEAD)
    doc, key = np.repeat(heads["doc"], heads["n"]), np.repeat(heads["key"], heads["n"])
    at = items["at"].astype(np.int64)
    head, later = _firsts(doc, at, items["first"], items["second"])
    where = np.flatnonzero(later)
    return _by_document(np.concatenate([_run_rows(doc[where], key[where], at[where], doc[head[where]], at[head[where]]), known]), "run")


PARSED = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, length: long, ref_doc: long, ref_start: long>>"


def _factors(runs: np.ndarray, window: int) -> list[dict]:
    """Runs of one document, joined where both sides go on, as factors in words."""
    runs = np.sort(runs, order=["at", "ref_doc", "ref_at"])
    out: list[list[int]] = []
    for at, n, ref_doc, ref_at in runs.tolist():
        if out and out[-1][0] + out[-1][1] == at and out[-1][2] == ref_doc and out[-1][3] + out[-1][1] == ref_at:
            out[-1][1] += n
        elif not out or at + n > out[-1][0] + out[-1][1]:
            out.append([at, n, ref_doc, ref_at])
    return [{"start": a, "length": n + window - 1, "ref_doc": None if d == NO_ID else d, "ref_start": r} for a, n, d, r in out]


def _finish(window: int, with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 4_000_000):
                starts, ends, first = texts.words()
                counts = np.diff(first)
                lists = [np.frombuffer(b"".join(x), dtype=RUN) if x else np.zeros(0, RUN) for x in batch.column("runs").slice(row, end - row).to_pylist()]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                runs = np.concatenate(lists)
                begin = runs["at"].astype(np.int64) + np.repeat(first[:-1], sizes)
                cover = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + runs["n"].astype(np.int64) + window - 1, -1)
                kept = np.cumsum(cover)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(kept)])[first]
                lengths = (ends - starts)[kept] + 1
                data = np.append(texts.buffer, np.uint8(0x20))[ranges(starts[kept], lengths)]
                edge = np.concatenate([[0], np.cumsum(lengths)])
                data[edge[1:] - 1] = 0x20
                cuts = edge[left]
                view = memoryview(data.tobytes())
                parts = [view[a:max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(row, end - row), "n_words": counts, "n_removed": counts - np.diff(left),
                    "kept_sha256": [hashlib.sha256(p).hexdigest() for p in parts], "factors": pa.array([_factors(x, window) for x in lists], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_doc", "ref_start")])))}
                if with_text:
                    columns["kept_text"] = pa.array([str(p, "utf-8") for p in parts], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return finish


def parsed(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Words, removed words, digest of the kept words joined by one space, and factors of every document (and the kept text)."""
    low = F.lit(0xFFFFFFFF)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").bitwiseAND(low).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    document = "doc long, key long, data binary"
    gathered = lambda df, name: df.groupBy("doc", "key").agg(F.collect_list("data").alias(name))  # noqa: E731  pieces of one document
    grams = rows.mapInArrow(_send_grams(window, blocks), "block long, sent binary, known binary")
    flags = gathered(grams.groupBy("block").applyInArrow(_repeated_grams, document), "flags")
    marked = rows.join(flags, ["doc", "key"]).select("doc", "key", "text", "flags")
    phrases = marked.mapInArrow(_send_phrases(window, blocks), "block long, sent binary, known binary, heads binary")
    runs = gathered(phrases.groupBy("block").applyInArrow(_repeated_phrases, document), "runs")
    whole = rows.join(runs, ["doc", "key"], "left").select(F.expr(f"nullif(doc, {NO_ID + 1}L - 1L)").alias("doc_id"), "text", "runs")  # the same rows as in the first join, so one exchange
    return whole.mapInArrow(_finish(window, with_text), PARSED + (", kept_text string" if with_text else ""))
