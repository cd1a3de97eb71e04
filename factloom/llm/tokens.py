"""Words and token ids of many texts at once, as numpy columns.

A batch of texts is one UTF-8 buffer with offsets, as Arrow hands it over. Words are maximal runs of bytes other than
``0x20`` and ``0x09-0x0D``; hashes of words and of runs of words come from prefix sums, so nothing loops over words.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_table(seed: int) -> np.ndarray:
    return _splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))


#: Powers that are kept between steps; those of a longer text are made for it and given back.
KEPT_POWERS = 1 << 21
_POWERS: dict[int, np.ndarray] = {}
BASES = (0x9E6C63D0676A9A99, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n; as many as a step needs are kept."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = n if n > KEPT_POWERS else min(KEPT_POWERS, 1 << max(16, (n - 1).bit_length()))
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= KEPT_POWERS:
            _POWERS[base] = got
    return got[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]`` of 64-bit values."""
    base = BASES[seed & 1]
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return _splitmix((total[ends] - total[starts]) * _powers(_inverse(base), len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def byte_runs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    return run_hashes(_byte_table(seed)[buffer], starts, ends, seed)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Texts:
    """Some texts as one buffer; text i is ``buffer[offsets[i]:offsets[i + 1]]``. A null text is an empty one."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray):
        self.buffer, self.offsets = buffer, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts) -> Texts:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum([len(b) for b in data], out=offsets[1:])
        return cls(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of the first word of each text (one more than texts)."""
        inner = ~SPACE[self.buffer]
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        stops = inner.copy()
        stops[:-1] &= ~inner[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(self.buffer))]
        begins[cut] = inner[cut]
        stops[cut - 1] = inner[cut - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, self.offsets)


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of bounded parts of a string column; a text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, Texts(buffer[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``start, start + 1, ... start + count - 1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


# --- token ids ----------------------------------------------------------------------------------------------------


def _ends_plain(buffer: np.ndarray) -> np.ndarray:
    """For each byte: it ends a character that is certainly no white space, judged by its own bytes."""
    plain = (buffer >= 0x21) & (buffer <= 0x7E)
    tail = (buffer >= 0x80) & (buffer <= 0xBF)
    for back, lead in ((1, (buffer >= 0xC3) & (buffer <= 0xDF)), (2, (buffer == 0xE0) | ((buffer >= 0xE4) & (buffer <= 0xEF))), (3, (buffer >= 0xF0) & (buffer <= 0xF4))):
        if len(buffer) > back:
            plain[back:] |= tail[back:] & lead[:-back]
    return plain


def piece_starts(texts: Texts) -> np.ndarray:
    """Where texts may be cut without changing their ids: before white space that follows anything else.

    The pre-tokenizer's pattern lets a match begin with white space but never end with white space that is followed by
    something else, so no match reaches over such a place.
    """
    buffer = texts.buffer
    cut = SPACE[buffer]
    cut[1:] &= _ends_plain(buffer)[:-1]
    cut[texts.offsets[:-1][texts.offsets[:-1] < len(buffer)]] = True
    return np.flatnonzero(cut)


#: Bytes of pieces that are encoded as one string.
CHUNK_BYTES = 4_000
#: 1: part of a letter, 2: digit, 3: ASCII mark, 0: anything else. The two-byte characters under 0xC3 to 0xC9 are letters but for U+00D7 and U+00F7.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[0x21:0x7F] = 3
CLASS[0x30:0x3A] = 2
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 1
APOSTROPHE = 0x27


def _classes(buffer: np.ndarray) -> np.ndarray:
    kinds = CLASS[buffer]
    leads = np.flatnonzero((buffer[:-1] >= 0xC3) & (buffer[:-1] <= 0xC9))
    kinds[leads + 1] = 1
    signs = leads[(buffer[leads] == 0xC3) & ((buffer[leads + 1] == 0x97) | (buffer[leads + 1] == 0xB7))]
    kinds[signs] = kinds[signs + 1] = 0
    return kinds


def match_starts(texts: Texts) -> np.ndarray:
    """``piece_starts`` and the places between letters, digits and marks, where a match of the byte-level pattern ends as well.

    Only after an apostrophe may a match (``'s``) hold characters of two of these classes.
    """
    buffer = texts.buffer
    kinds = _classes(buffer)
    cut = np.zeros(len(buffer), dtype=bool)
    cut[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] != 0) & (kinds[:-1] != 0) & (buffer[:-1] != APOSTROPHE)
    cut[piece_starts(texts)] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of many texts under a byte-level BPE of the tokenizers library.

    Texts are cut into pieces (``match_starts``); equal pieces of a step are encoded once. The first ``limit`` pieces stay known to later
    steps; that saves time only. A piece that is one match of the library's own pattern goes straight to its merges; the others, and
    all pieces of a tokenizer with another pattern, go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character of a byte-level token stands for one byte
        saved = json.loads(self.tokenizer.to_str())
        cutter = saved["pre_tokenizer"] or {}
        self.plain = saved["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")  # no byte is written as a space
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = np.zeros(256, dtype="<u4")  # the character that stands for each byte
        self.letters[own] = own
        self.letters[[b for b in range(256) if b not in own]] = 256 + np.arange(256 - len(own))
        self.limit = limit
        self.known: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int64)

    @staticmethod
    def _many(tokenizer, data: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch_fast(data, add_special_tokens=False) if data else []
        return np.concatenate([np.zeros(0, np.int32), *(np.array(x.ids, dtype=np.int32) for x in found)])

    def _matches(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one match each: all ids, and the number of them for each piece."""
        edge = np.append(0, np.cumsum(lengths + 1))  # a delimiter before each piece
        text = np.full(int(edge[-1]), 0x20, dtype="<u4")
        text[ranges(edge[:-1] + 1, lengths)] = self.letters[data[ranges(starts, lengths)]]
        cuts = np.unique(edge[np.searchsorted(edge, np.append(np.arange(0, edge[-1], CHUNK_BYTES), edge[-1]))]).tolist()
        return self._counted(self._many(self.merges, [text[a:b].tobytes().decode("utf-32-le") for a, b in itertools.pairwise(cuts)]), lengths)

    def _counted(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the number of them for each piece; the lengths of the ids in bytes tell where each ends."""
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths), side="left") + 1
        return ids, np.diff(upto, prepend=0)

    def _others(self, pieces: list[bytes], joins: list[bool], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces; those that begin with ASCII white space and end otherwise are joined."""
        chunks: list[list[bytes]] = []
        size = 0
        for piece, joined in zip(pieces, joins, strict=True):
            if not chunks or not joined or size > CHUNK_BYTES:
                chunks.append([])
                size = 0
            chunks[-1].append(piece)
            size = size + len(piece) if joined else 1 << 30
        return self._counted(self._many(self.tokenizer, [b"".join(c).decode("utf-8") for c in chunks]), lengths)

    def _learn(self, distinct: list[bytes], edges: np.ndarray, data: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Encode new pieces, keep their ids and return them in the order of their slots."""
        first = data[edges[:-1]]
        odd = np.append(0, np.cumsum((_classes(data) == 0) | (data == APOSTROPHE)))
        spaced = (first == 0x20) & (np.diff(edges) > 1)
        one = (odd[edges[1:]] - odd[edges[:-1]] == spaced)[new] & self.plain
        joins = SPACE[first] & _ends_plain(data)[edges[1:] - 1]
        lengths = np.diff(edges)
        matches, others = new[one], new[~one]
        new = np.concatenate([matches, others])
        got = [self._matches(data, edges[matches], lengths[matches]), self._others([distinct[k] for k in others], joins[others].tolist(), lengths[others])]
        ids, counts = (np.concatenate(x) for x in zip(*got, strict=True))
        at = len(self.known)
        used = int(self.begin[at])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), dtype=np.int32)])
        if at + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(len(new) + 1, len(self.begin)), dtype=np.int64)])
        self.ids[used:used + len(ids)] = ids
        self.begin[at + 1:at + 1 + len(new)] = used + np.cumsum(counts)
        return new

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of the first id of each text (one more than texts)."""
        if not len(texts.buffer):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = match_starts(texts) if self.plain else piece_starts(texts)
        offsets = np.append(starts, len(texts.buffer)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts.buffer))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.array([self.known.get(piece, -1) for piece in distinct], dtype=np.int64)
        if len(new := np.flatnonzero(slots < 0)):
            edges = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64)[:len(distinct) + 1]
            new = self._learn(distinct, edges, np.frombuffer(coded.dictionary.buffers()[2], dtype=np.uint8)[:edges[-1]], new)
            at = len(self.known)
            slots[new] = np.arange(at, at + len(new))
            kept = new[:max(0, self.limit - at)].tolist()
            self.known.update(zip([distinct[k] for k in kept], range(at, at + len(kept)), strict=True))
        slot = slots[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.begin[slot + 1] - self.begin[slot]
        total = np.zeros(len(slot) + 1, dtype=np.int64)
        np.cumsum(counts, out=total[1:])
        return self.ids[ranges(self.begin[slot], counts)], total[np.searchsorted(starts, texts.offsets)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
