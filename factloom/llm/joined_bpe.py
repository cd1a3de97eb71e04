"""Byte-pair encoding by concatenation of encoded parts, and decoding.

What the pre-tokenizer leaves unsplit is one *run* of symbols. A long run is cut in halves until the parts hold at most ``LEAF`` symbols; the
parts are encoded each by itself, all of a step together, and then joined in pairs, level by level. Around a join the last ``w`` tokens of the
left side and the first ``w`` of the right side are encoded again, with ``w`` doubled until the first new token is the left side's own token and
the last one the right side's own (or the window has reached the end of that side). Every two neighbours of the result then stand side by side
in an encoding of a string that holds them both, and a row of tokens whose neighbours all agree is the encoding of the whole: the join is exact,
not likely to be so. Only the last symbol of a run carries the end-of-word mark, so a window that ends elsewhere is encoded without it.

Text between ASCII white space never interacts with its neighbours (nor do characters of different normal form), so it is encoded once for each
distinct piece of a step; pieces seen early stay known to the worker, up to ``KNOWN`` of them, which saves time only.

Texts of more than ``SPREAD`` bytes are cut into rows (groups of pieces, or parts of one run), which are encoded in parallel by different tasks and
joined per text by the same windows. Their branch reads the texts a second time and shuffles only those that are that long.

Cases: a null or empty text, or one of white space alone, has no ids and decodes to an empty text; strings of special tokens in a text become
those tokens, as in the library; rows with one doc_id (null too) stay apart; an empty table gives no rows; other columns are ignored; ids that the
vocabulary lacks are left out when decoding, as in the library.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import Texts, ranges, steps

LEAF = 64
SPREAD = 4 << 20
KNOWN = 100_000
#: Kinds of rows that a long text is cut into.
TEXT, WORD, INNER, LAST = "text", "word", "inner", "last"


def halves(run: str, leaf: int) -> list[str]:
    """The run in equal parts of at most ``leaf`` symbols, a power of two of them."""
    count = 1
    while -(-len(run) // count) > leaf:
        count *= 2
    edge = [len(run) * i // count for i in range(count + 1)]
    return [run[a:b] for a, b in zip(edge, edge[1:])]


class Codec:
    """Ids of texts and texts of ids under a BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF, known: int = KNOWN):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.leaf, self.limit = path, leaf, known
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.strings: list[str | None] = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.strings[i] = token
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.spaced = pa.array([f"{t} ".encode() if t is not None else b"" for t in self.strings], pa.large_binary())
        self.known: dict[bytes, bytes] = {}

    # --- parts of runs ---

    @functools.cached_property
    def models(self):
        """Encoders of symbols alone: inside a run, and up to its end."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        inner = Tokenizer(BPE(vocab=model["vocab"], merges=merges))
        return inner, Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else inner

    def _encoded(self, parts: list[str], last: list[bool]) -> list[list[int]]:
        """Ids of strings of symbols, each ending a run or not."""
        out: list[list[int]] = [[] for _ in parts]
        for ending, model in enumerate(self.models):
            which = [i for i, x in enumerate(last) if x == bool(ending)]
            for i, found in zip(which, model.encode_batch_fast([parts[i] for i in which], add_special_tokens=False) if which else ()):
                out[i] = found.ids
        return out

    def _symbols(self, ids: list[int], last: bool) -> str:
        """The symbols that tokens stand for; ``last``: the final one ends its run."""
        tokens = [self.strings[i] for i in ids]
        if last and self.suffix:
            tokens[-1] = tokens[-1].removesuffix(self.suffix)
        return "".join(tokens)

    def join(self, pairs: list[tuple[list[int], list[int], bool]]) -> list[list[int]]:
        """The encodings of left + right for pairs of encoded neighbours; the third value says that the right one ends its run."""
        out: list[list[int]] = [[] for _ in pairs]
        width, open_ = 1, list(range(len(pairs)))
        while open_:
            windows = [(pairs[i][0][-width:], pairs[i][1][:width], pairs[i][2] and width >= len(pairs[i][1])) for i in open_]
            again, still = self._encoded([self._symbols(a + b, end) for a, b, end in windows], [end for _, _, end in windows]), []
            for i, (a, b, _), new in zip(open_, windows, again, strict=True):
                left, right, _ = pairs[i]
                if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                    out[i] = left[:len(left) - len(a)] + new + right[len(b):]
                else:
                    still.append(i)
            width, open_ = 2 * width, still
        return out

    def tree(self, runs: list[list[list[int]]], last: list[bool]) -> list[list[int]]:
        """Join the encoded parts of each run in pairs, level by level, all runs together; ``last``: the final part ends the run."""
        runs = [list(parts) for parts in runs]
        while any(len(parts) > 1 for parts in runs):
            place = [(r, k) for r, parts in enumerate(runs) for k in range(0, len(parts) - 1, 2)]
            joined = self.join([(runs[r][k], runs[r][k + 1], last[r] and k + 2 == len(runs[r])) for r, k in place])
            odd = {r: parts[-1] for r, parts in enumerate(runs) if len(parts) % 2}
            level: list[list[list[int]]] = [[] for _ in runs]
            for (r, _), ids in zip(place, joined, strict=True):
                level[r].append(ids)
            for r, ids in odd.items():
                level[r].append(ids)
            runs = level
        return [parts[0] if parts else [] for parts in runs]

    def runs(self, runs: list[str]) -> list[list[int]]:
        """Ids of whole runs: parts encoded together, then joined."""
        self.models
        parts = [halves(r, self.leaf) for r in runs]
        flat = self._encoded([p for x in parts for p in x], [k == len(x) - 1 for x in parts for k in range(len(x))])
        at, grouped = 0, []
        for x in parts:
            grouped.append(flat[at:at + len(x)])
            at += len(x)
        return self.tree(grouped, [True] * len(runs))

    # --- pieces and texts ---

    def unsplit(self, text: str) -> Iterator[int | str]:
        """Special tokens (ids) and the runs of the text between them, in order."""
        import re

        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part]
            elif part:
                if self.tokenizer.normalizer:
                    part = self.tokenizer.normalizer.normalize_str(part)
                yield from (run for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)) if self.tokenizer.pre_tokenizer else (part,)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces: short ones as they are, runs of long ones through their parts."""
        found: dict[bytes, bytes] = {}
        short = [p for p in pieces if len(p) <= self.leaf]
        for p, e in zip(short, self.tokenizer.encode_batch_fast([p.decode() for p in short], add_special_tokens=False) if short else ()):
            found[p] = np.array(e.ids, dtype="<u4").tobytes()
        if long := [p for p in pieces if len(p) > self.leaf]:
            mixed = [list(self.unsplit(p.decode())) for p in long]
            ids = iter(self.runs([x for m in mixed for x in m if isinstance(x, str)]))
            for p, m in zip(long, mixed, strict=True):
                found[p] = np.array([i for x in m for i in (next(ids) if isinstance(x, str) else (x,))], dtype="<u4").tobytes()
        return found

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of the first id of each text (one more than texts)."""
        if not len(texts.buffer):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(len(texts.buffer), dtype=bool)
        cut[texts.words()[0]] = True
        cut[texts.offsets[:-1][texts.offsets[:-1] < len(cut)]] = True
        starts = np.flatnonzero(cut)  # a piece is a word with the white space behind it
        edges = np.append(starts, len(cut)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(texts.buffer))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = self._learn([p for p in distinct if p not in self.known])
        of = [self.known.get(p) if p in self.known else new[p] for p in distinct]
        for p in list(new)[:max(0, self.limit - len(self.known))]:
            if len(p) <= 4 * self.leaf:
                self.known[p] = new[p]
        sizes = np.array([len(x) // 4 for x in of], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        slot = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[slot]
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.frombuffer(b"".join(of), dtype="<u4")[ranges(begin[slot], counts)], total[np.searchsorted(starts, texts.offsets)]

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of rows of ids: the strings of the tokens with one space between them."""
        ids = ids.astype(np.int64)
        kept = (ids < len(self.strings))
        kept[kept] = np.array([t is not None for t in self.strings])[ids[kept]]
        got = pc.take(self.spaced, pa.array(np.where(kept, ids, 0)))
        edge = np.frombuffer(got.buffers()[1], dtype=np.int64)[got.offset:got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
        if not kept.all():
            return [" ".join(self.strings[i] for i in ids[a:b][kept[a:b]].tolist()) for a, b in zip(first[:-1], first[1:])]
        data = memoryview(got.buffers()[2]) if len(got) else memoryview(b"")
        return [bytes(data[a:max(a, b - 1)]).decode() for a, b in zip(edge[first[:-1]].tolist(), edge[first[1:]].tolist(), strict=True)]


@functools.cache
def codec(path: str, leaf: int = LEAF) -> Codec:
    """One codec for each worker process."""
    return Codec(path, leaf)


# --- Spark ----------------------------------------------------------------------------------------------------------

IDS = "doc_id long, ids binary"
ROWS = "row string, doc_id long, part long, kind string, content string"
PARTS = "row string, doc_id long, part long, kind string, ids binary"


def _column(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of ids as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B") if len(ids) else memoryview(b"")
    return pa.array([bytes(data[4 * a:4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())


def _in_place(path: str, leaf: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, leaf)
        for batch in batches:
            for row, end, texts in steps(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), _column(*coder(texts))], names=["doc_id", "ids"])

    return encode


def _cut(path: str, leaf: int, spread: int):
    """Rows of a long text: pieces in groups of about ``spread`` bytes; a piece beyond that as its runs, those beyond it again in parts."""

    def rows_of(coder: Codec, text: bytes) -> Iterator[tuple[str, str]]:
        one = Texts(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)], dtype=np.int64))
        starts, ends, _ = one.words()
        begin = 0
        for k in range(len(starts)):
            if ends[k] - starts[k] > spread:
                if starts[k] > begin:
                    yield TEXT, text[begin:starts[k]].decode()
                for x in coder.unsplit(text[starts[k]:ends[k]].decode()):
                    if not isinstance(x, str):
                        yield TEXT, coder.strings[x]
                    elif len(x) <= spread:
                        yield WORD, x
                    else:
                        *inner, final = halves(x, spread)
                        yield from ((INNER, p) for p in inner)
                        yield LAST, final
                begin = ends[k]
            elif ends[k] - begin > spread:
                yield TEXT, text[begin:starts[k]].decode()
                begin = starts[k]
        if begin < len(text):
            yield TEXT, text[begin:].decode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = codec(path, leaf), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                row += 1
                for part, (kind, content) in enumerate(rows_of(coder, text.as_buffer().to_pybytes())):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}:{row}"]), pa.array([doc_id], pa.int64()), pa.array([part], pa.int64()), pa.array([kind]), pa.array([content])],
                                                     names=["row", "doc_id", "part", "kind", "content"])

    return cut


def _encode_parts(path: str, leaf: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, leaf)
        coder.models
        for batch in batches:
            for one in range(len(batch)):
                row = batch.slice(one, 1)
                kind, content = row.column("kind")[0].as_py(), row.column("content")[0].as_py()
                if kind == TEXT:
                    ids = coder(Texts.of([content]))[0]
                elif kind == INNER:
                    parts = halves(content, coder.leaf)
                    ids = coder.tree([coder._encoded(parts, [False] * len(parts))], [False])[0]
                else:
                    ids = coder.runs([content])[0]
                columns = [row.column(c) for c in ("row", "doc_id", "part", "kind")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.array(ids, dtype="<u4").tobytes()], pa.binary())], names=["row", "doc_id", "part", "kind", "ids"])

    return encode


def _joined(path: str, leaf: int):
    def whole(parts: Iterable[tuple[str, bytes]], coder: Codec) -> bytes:
        out, run = [], []
        for kind, ids in parts:
            if kind in (INNER, LAST):
                run.append(np.frombuffer(ids, dtype="<u4").tolist())
                if kind == LAST:
                    out.append(np.array(coder.tree([run], [True])[0], dtype="<u4").tobytes())
                    run = []
            else:
                out.append(ids)
        return b"".join(out)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        coder = codec(path, leaf)
        coder.models
        ids = whole(zip(table.column("kind").to_pylist(), table.column("ids").to_pylist(), strict=True), coder)
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.binary())})

    return join


def encoded(docs: DataFrame, path: str, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    short = rows.where(size <= spread).mapInArrow(_in_place(path, leaf), IDS)
    parts = rows.where(size > spread).mapInArrow(_cut(path, leaf, spread), ROWS).repartition("row", "part")
    long = parts.mapInArrow(_encode_parts(path, leaf), PARTS).groupBy("row").applyInArrow(_joined(path, leaf), IDS)
    return short.unionByName(long)


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            row = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            edge = np.concatenate([[0], np.cumsum(sizes)])
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(edge, edge[row] + (1 << 19), side="right")) - 1)
                part = batch.slice(row, end - row)
                ids = np.frombuffer(b"".join(x or b"" for x in part.column(at).to_pylist()), dtype="<u4")
                decoded = pa.array(coder.texts(ids, edge[row:end + 1] - edge[row]), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])
                row = end

    return decode


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``: the text of their ids."""
    fields = ", ".join(f"{c} {t}" for c, t in coded.select("doc_id", "ids").dtypes)
    return coded.select("doc_id", "ids").mapInArrow(_decode(path), f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of each row."""
    return decoded(encoded(docs, path), path)
