"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload: the selector says how many ids the word holds and how wide
each is. A value of ``2 ** 60 - 1`` or more is coded as that marker, and stands in the block's list of escapes. A block holds whole
documents; after its header come doc ids, null flags and ids per document, the place of the first id of each 128th word, the words, the
escapes and a CRC. With these offsets any part of a block is decoded by itself, one numpy step for each selector.

Cases: a null or empty text has the end id alone; a null doc_id sorts first and comes back null; rows with one doc_id stay apart, in the
order of a hash of their texts; an empty table writes no file and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.files import new_folder, one_task_each, resolved, task_file
from factloom.llm.tokens import encoder, ranges, steps
from factloom.operators.stages import written

# Fixed values: (ids in a word, bits of each) of selectors 0 to 15 of Simple-8b.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MARK = np.uint64((1 << 60) - 1)
GROUP = 128
BLOCK_IDS = 1 << 18
HEADER = struct.Struct("<4sIQII")


def _run_starts(fits: np.ndarray, count: int) -> np.ndarray | slice:
    """Where ``count`` values in a row fit."""
    if fits.all():
        return slice(0, max(0, len(fits) - count + 1))
    places = np.flatnonzero(fits)
    if len(places) < count:
        return places[:0]
    return places[:len(places) - count + 1][places[count - 1:] - places[:len(places) - count + 1] == count - 1]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of unsigned 64-bit values; each word takes as many of the next values as one selector allows."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    escapes = values[values >= MARK]
    coded = np.minimum(values, MARK)
    chosen = np.full(n, 15, dtype=np.int8)
    for selector in range(14, -1, -1):  # wider first, so that what holds more values overwrites
        count, width = LAYOUT[selector]
        chosen[_run_starts(coded < np.uint64(1 << width), count)] = selector
    jump = np.array([c for c, _ in LAYOUT], dtype=np.int64)[chosen].tolist()
    begins, at = [], 0
    while at < n:
        begins.append(at)
        at += jump[at]
    begins = np.array(begins, dtype=np.int64)
    words = np.zeros(len(begins), dtype=np.uint64)
    selectors = chosen[begins]
    for selector, (count, width) in enumerate(LAYOUT):
        which = np.flatnonzero(selectors == selector)
        if len(which):
            word = np.full(len(which), selector << 60, dtype=np.uint64)
            for k in range(count if width else 0):
                word |= coded[begins[which] + k] << np.uint64(width * k)
            words[which] = word
    return words, escapes


def counts_of(words: np.ndarray) -> np.ndarray:
    return np.array([c for c, _ in LAYOUT], dtype=np.int64)[(words >> np.uint64(60)).astype(np.int64)]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values that ``pack`` was given."""
    counts = counts_of(words)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    selectors = words >> np.uint64(60)
    for selector, (count, width) in enumerate(LAYOUT):
        which = np.flatnonzero(selectors == selector)
        if width and len(which):
            mask = np.uint64((1 << width) - 1)
            for k in range(count):
                out[first[which] + k] = (words[which] >> np.uint64(width * k)) & mask
    if len(escapes):
        out[out == MARK] = escapes
    return out


def block(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes = pack(ids)
    of_word = counts_of(words)
    offsets = (np.cumsum(of_word) - of_word)[::GROUP]
    body = b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), nulls.astype("u1"), counts.astype("<u4"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8")))
    return HEADER.pack(b"S8B1", len(doc_ids), len(ids), len(words), len(escapes)) + body + struct.pack("<I", zlib.crc32(body))


def read_block(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(doc ids, null flags, ids of each document, all ids) of the next block; None at the end."""
    head = stream.read(HEADER.size)
    if not head:
        return None
    magic, docs, total, words, escapes = HEADER.unpack(head)
    groups = -(-words // GROUP)
    sizes = (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", groups), ("<u8", words), ("<u8", escapes))
    length = sum(np.dtype(kind).itemsize * n for kind, n in sizes)
    body = stream.read(length)
    if magic != b"S8B1" or len(body) < length or struct.unpack("<I", stream.read(4))[0] != zlib.crc32(body):
        raise ValueError("damaged block")
    parts, at = [], 0
    for kind, n in sizes:
        parts.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    ids = unpack(parts[4], parts[5])
    if len(ids) != total:
        raise ValueError("a block holds other ids than it says")
    return parts[0], parts[1], parts[2].astype(np.int64), ids


MANIFEST = "path string, first_doc long, n_docs long, n_ids long, n_bytes long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        path, stream, docs, total, first_doc = None, None, 0, 0, None
        held: list[tuple] = []

        def flush():
            nonlocal total, docs
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            stream.write(block(doc_ids, nulls, counts, ids))
            total, docs = total + len(ids), docs + len(doc_ids)
            held.clear()

        for batch in batches:
            keys = batch.column("doc_id")
            for row, end, texts in steps(batch.column("text")):
                if stream is None:
                    path = task_file(folder, ".s8b")
                    fs, place = resolved(path)
                    stream = fs.open_output_stream(place)
                    first_doc = keys[0].as_py()
                ids, first = encode(texts)
                counts = np.diff(first) + 1
                all_ids = np.full(len(ids) + len(texts), end_id, dtype=np.uint64)
                all_ids[ranges(first[:-1] + np.arange(len(texts)), counts - 1)] = ids
                part = keys.slice(row, end - row)
                doc_ids, nulls = part.fill_null(0).to_numpy(zero_copy_only=False), part.is_null().to_numpy(zero_copy_only=False)
                edge = np.concatenate([[0], np.cumsum(counts)])
                at = 0
                del ids
                while at < len(texts):  # whole documents, BLOCK_IDS ids or a little more
                    stop = min(len(texts), int(np.searchsorted(edge, edge[at] + BLOCK_IDS)))
                    stop = max(stop, at + 1)
                    held.append((doc_ids[at:stop], nulls[at:stop], counts[at:stop], all_ids[edge[at]:edge[stop]]))
                    if sum(len(x[3]) for x in held) >= BLOCK_IDS:
                        flush()
                    at = stop
        if stream is not None:
            if held:
                flush()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": pa.array([first_doc], pa.int64()), "n_docs": [docs], "n_ids": [total], "n_bytes": [size]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode the texts and write ids in ascending doc_id order; one row for each file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(dealt.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                fs, place = resolved(path)
                with fs.open_input_stream(place) as stream:
                    while (got := read_block(stream)) is not None:
                        doc_ids, nulls, counts, ids = got
                        data = memoryview(ids.astype("<u4").tobytes())
                        edge = np.concatenate([[0], np.cumsum(counts)])
                        parts = [data[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                        columns = {"doc_id": pa.array(doc_ids, mask=nulls.astype(bool)), "start": edge[:-1] + start, "n_tokens": counts, "ids_crc32": np.array([zlib.crc32(p) for p in parts], dtype=np.int64)}
                        if with_ids:
                            columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                        yield pa.RecordBatch.from_pydict(columns)
                        start += int(edge[-1])

    return read


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, place of the first id over all files, number and CRC of the ids (and the ids as little-endian bytes).

    Only one row for each file is ordered to find where a file starts.
    """
    order = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("file_start"))
    return one_task_each(placed, manifest.count(), "file_start").mapInArrow(_reader(with_ids), READ + (", ids binary" if with_ids else ""))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write the token files of the documents to a new shared folder and read them back."""
    return read_tokens(write_tokens(docs, new_folder(docs.sparkSession, "tokens"), tokenizer, end_id), with_ids)
