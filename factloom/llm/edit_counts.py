"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A text is cut into leaves of about ``LEAF_BYTES`` where no pre-token can reach over (before white space that follows something else), so the
ids of a text are those of its leaves, one after another. A document's tree is a row: the characters of each leaf, and the sums of token
counts of all nodes of a binary tree over the leaves, the root first. An edit replaces characters of the text. The leaves it touches, and
the ones beside them if the edit reaches their border, become the first of them; only their text is encoded again and only the sums above
them change.

An edit is (start, end, replacement) in characters of the text that earlier edits of the same document have left; they are applied in order.

Cases: a null text is empty, has one empty leaf and no tokens; edits that reach beyond the text end there, an end before the start inserts
at the start; null or empty edit lists change nothing; rows with one doc_id stay apart; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from factloom.llm.tokens import Encoder, Texts, encoder, piece_starts, steps

LEAF_BYTES = 512


def _tree(counts: list[int]) -> list[int]:
    """Sums of a binary tree over the counts: node 1 is the root, node k has children 2k and 2k + 1; entry 0 is the number of leaves' places."""
    width = 1 << max(0, (len(counts) - 1).bit_length())
    sums = [0] * width + counts + [0] * (width - len(counts))
    for k in range(width - 1, 0, -1):
        sums[k] = sums[2 * k] + sums[2 * k + 1]
    sums[0] = width
    return sums


def leaves(texts: Texts, leaf_bytes: int = LEAF_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Where leaves start, and the index of the first leaf of each text (one more than texts); an empty text has none."""
    starts = piece_starts(texts)
    text = np.searchsorted(texts.offsets, starts, side="right") - 1
    part = (starts - texts.offsets[text]) // leaf_bytes
    keep = np.ones(len(starts), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    starts = starts[keep]
    return starts, np.searchsorted(starts, texts.offsets)


def _plant(texts: Texts, encode: Encoder) -> list[tuple[list[int], list[int]]]:
    """(characters of each leaf, tree) of each text."""
    starts, first = leaves(texts)
    edges = np.append(starts, len(texts.buffer)).astype(np.int64)
    cut = Texts(texts.buffer, edges) if len(starts) else texts
    tokens = np.diff(encode(cut)[1]) if len(starts) else np.zeros(0, np.int64)
    heads = np.concatenate([[0], np.cumsum((texts.buffer & 0xC0) != 0x80)])
    chars = np.diff(heads[edges])
    return [(chars[a:b].tolist() or [0], _tree(tokens[a:b].tolist() or [0])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


class Document:
    """One text with its tree, under edits."""

    def __init__(self, text: str, chars: list[int], sums: list[int], encode: Encoder):
        self.text, self.chars, self.sums, self.encode = text, list(chars), list(sums), encode
        self.encoded = 0
        self.pieces: list[str] = []
        at = 0
        for n in self.chars:
            self.pieces.append(text[at:at + n])
            at += n

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _set(self, leaf: int, tokens: int) -> None:
        node = self.sums[0] + leaf
        change = tokens - self.sums[node]
        while node:
            self.sums[node] += change
            node >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        size = sum(self.chars)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        at, low, high, low_at = 0, None, None, 0
        for leaf, n in enumerate(self.chars):  # leaves that hold [start - 1, end + 1): those beside a border are its context
            if n and at < end + 1 and at + n > start - 1:
                if low is None:
                    low, low_at = leaf, at
                high = leaf
            at += n
        if low is None:
            low = high = 0
        region = "".join(self.pieces[low:high + 1])
        region = region[:start - low_at] + new + region[end - low_at:]
        for leaf in range(low, high + 1):
            self.pieces[leaf], self.chars[leaf] = ("", 0) if leaf > low else (region, len(region))
            if leaf > low:
                self._set(leaf, 0)
        if region:
            self.encoded += len(region)
            self._set(low, len(self.encode(Texts.of([region]))[0]))
        else:
            self._set(low, 0)

    def result(self) -> str:
        return "".join(self.pieces)


TREE = [StructField("leaf_chars", ArrayType(IntegerType())), StructField("token_sums", ArrayType(IntegerType())), StructField("n_tokens", LongType())]


def with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All rows and columns of the documents with leaf_chars, token_sums and n_tokens."""
    kept = docs.drop("leaf_chars", "token_sums", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for row, end, texts in steps(batch.column("text"), 4_000_000):
                trees = _plant(texts, encode)
                new = [pa.array([c for c, _ in trees], pa.list_(pa.int32())), pa.array([s for _, s in trees], pa.list_(pa.int32())), pa.array([s[1] for _, s in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns, *new], names=[*batch.schema.names, "leaf_chars", "token_sums", "n_tokens"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *TREE]))


EDITED = [StructField("edited_text", StringType()), StructField("n_tokens_after", LongType()), StructField("n_edits", LongType()), StructField("chars_encoded", LongType())]


def edited(trees: DataFrame, tokenizer: str, edits: str = "edits", with_text: bool = True) -> DataFrame:
    """Apply each row's list of edits (array of struct<start: int, end: int, new: string>) to its text and tree.

    Replaces text's tree columns by the new ones and adds n_tokens_after, n_edits, chars_encoded (characters encoded again) and, if wanted,
    edited_text.
    """
    fields = EDITED if with_text else EDITED[1:]
    kept = trees.drop(*[f.name for f in EDITED])
    rest = [f for f in kept.schema.fields if f.name != edits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            asked = batch.column(edits)
            changed: dict[str, list] = {"leaf_chars": [], "token_sums": [], "edited_text": [], "n_tokens_after": [], "n_edits": [], "chars_encoded": []}
            for i in range(len(batch)):
                todo = asked[i].as_py() or []
                chars, sums = batch.column("leaf_chars")[i], batch.column("token_sums")[i]
                text = batch.column("text")[i].as_py() if todo or with_text else None
                if todo:
                    document = Document(text or "", chars.as_py(), sums.as_py(), encode)
                    for e in todo:
                        document.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                    values = (document.chars, document.sums, document.result() if with_text else None, document.tokens, len(todo), document.encoded)
                else:
                    values = (chars.as_py(), sums.as_py(), text or "", sums[1].as_py(), 0, 0)
                for name, value in zip(changed, values, strict=True):
                    changed[name].append(value)
            kinds = {"leaf_chars": pa.list_(pa.int32()), "token_sums": pa.list_(pa.int32()), "edited_text": pa.string()}
            made = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in changed.items()}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in [*rest, *fields]], names=[f.name for f in [*rest, *fields]])

    return kept.mapInArrow(run, StructType([*rest, *fields]))


def redactions(text: str | Column, pattern: str = "(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9.-]+[A-Za-z]|[0-9][0-9.:/-]{6,}[0-9]", mark: str = "<removed>") -> Column:
    """Edits that replace e-mail addresses and long numbers, as places in the text that earlier edits have left, last one first."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, new: string>>)").alias("edits"))

    def step(state, piece):
        at = F.position(piece, text, state["at"])
        edit = F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.char_length(piece)).cast("int").alias("end"), F.lit(mark).alias("new"))
        return F.struct((at + F.char_length(piece)).cast("int").alias("at"), F.concat(F.array(edit), state["edits"]).alias("edits"))

    return F.aggregate(found, zero, step, lambda s: s["edits"])
