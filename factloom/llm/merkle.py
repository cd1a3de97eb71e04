"""A Merkle manifest of a dataset by time-forward processing.

Each row is a leaf; leaves of a source (ascending doc_id) form a tree of arity ``ARITY``, and the roots of the sources form one more tree. A node
is labelled (tree, last leaf below it, level): children come before their parent. Up: known nodes pass a task in the order of their labels; each sends its
digest to its parent through a priority queue ordered by label. When the time of a parent comes, its digests are on top of the queue, it is
computed and sends its own digest on. The queue is external: the ranges of labels are Spark's sorted shuffle, a task's heap holds only
messages that cross the present label (a few for each level), and what waits for a child in another range leaves the task and meets it in the next round, where
far fewer nodes are left. Down: the rounds run in reverse, labels descending; a node receives the end of its proof from its parent and sends
its children their siblings followed by that end, until every leaf has its proof.

A proof is a string of levels from leaf to root, each ended by a comma: the place of the node among its siblings (one digit), then the digests of
the siblings. ``folded`` recomputes a root from a digest and a proof, ``siblings`` gives the digests of the proof alone.

Cases: null fields hash as ``-``; a null source is a source of its own and comes first; null doc_ids come first in their source; rows with one doc_id are ordered by
their digest, wholly equal rows get equal digests and places of their own; a source with one row has its leaf as root, one source alone is the
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.stages import written

ARITY = 3
#: Nodes that one task of a round after the first takes; with no more than that left, one task ends the work.
ROUND_NODES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Kinds of rows: an end of a proof that enters a range, a parent with its children, a node that entered the range, one that left it, a root.
END, RUN, NODE, OUT, ROOT = range(5)
HEX = 64


def row_digest(*fields: Column) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // ARITY ** level)


def last_leaf(n: int, level: int, idx: int) -> int:
    return min((idx + 1) * ARITY ** level, n) - 1


# --- places of leaves -----------------------------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = np.arange(at, at + len(batch), dtype=np.int64)
        at += len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), pid, dtype=np.int32)), pa.array(rows)], names=[*batch.schema.names, "pid", "row"])


def placed(rows: DataFrame, keys: Sequence[str], few: int | None = None) -> DataFrame:
    """The rows with ``idx`` (place in their tree by ``keys``, nulls first) and ``n`` (rows of the tree).

    Rows are sorted by ranges of (tree, keys), so a large tree lies in many ranges; only one row for each tree and range is summed up.
    ``few``: the rows are one tree of so many rows, which fit in one task.
    """
    order = [F.col(c).asc_nulls_first() for c in ("tree", *keys)]
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    if few is not None:
        sorted_rows = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(_numbered, f"{fields}, pid int, row long")
        return sorted_rows.select(*rows.columns, F.col("row").alias("idx"), F.lit(few).cast("long").alias("n"))
    numbered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{fields}, pid int, row long"))
    ranges = numbered.groupBy("tree", "pid").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(F.col("tree").alias("in_tree"), F.col("pid").alias("in_pid"), (before - F.col("first")).alias("base"), F.sum("size").over(tree).alias("n"))
    met = numbered.join(starts, F.col("tree").eqNullSafe(F.col("in_tree")) & (F.col("pid") == F.col("in_pid")))
    return met.select(*rows.columns, (F.col("row") + F.col("base")).alias("idx"), "n")


# --- sweeps ---------------------------------------------------------------------------------------------------------

NODES = "tree string, n long, level int, idx long, last long, digest string, origin int, doc_id long, other string"
SWEPT = f"pid int, kind int, {NODES}"
_ARROW = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("last", pa.int64()),
                    ("digest", pa.string()), ("origin", pa.int32()), ("doc_id", pa.int64()), ("other", pa.string())])


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, roots and nodes that wait for others, of nodes in the order of their labels."""
    pid = TaskContext.get().partitionId()
    heap: list[tuple[int, int, int, str]] = []
    found: list[tuple] = []
    tree, n = None, 0

    def emit(kind: int, level: int, idx: int, digest: str) -> None:
        found.append((pid, kind, tree, n, level, idx, last_leaf(n, level, idx), digest, None, None, None))

    def known(level: int, idx: int, digest: str) -> None:
        if width(n, level) == 1:
            emit(ROOT, level, idx, digest)
        else:
            heappush(heap, (last_leaf(n, level + 1, idx // ARITY), level + 1, idx, digest))

    def settle(now: tuple[int, int] | None) -> None:
        """Compute the parents whose time is before ``now``."""
        while heap and (now is None or heap[0][:2] < now):
            time, children = heap[0][:2], []
            while heap and heap[0][:2] == time:
                children.append(heappop(heap)[2:])
            level, parent = time[1], children[0][0] // ARITY
            if len(children) == min(ARITY, width(n, level - 1) - ARITY * parent):
                digests = "".join(d for _, d in children)
                emit(RUN, level, parent, digests)
                known(level, parent, hashlib.sha256(digests.encode()).hexdigest())
            else:
                for idx, digest in children:
                    emit(OUT, level - 1, idx, digest)

    def flushed() -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW)], schema=_ARROW)
            found.clear()

    for batch in batches:
        tag = [pa.array(np.full(len(batch), x, dtype=np.int32)) for x in (pid, NODE)]
        yield pa.RecordBatch.from_arrays([*tag, *batch.columns], names=["pid", "kind", *batch.schema.names])
        columns = (batch.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "last", "digest"))
        for of, size, level, idx, last, digest in zip(*columns, strict=True):
            if of != tree or size != n:
                settle(None)
                tree, n = of, size
            settle((last, level))
            known(level, idx, digest)
        yield from flushed()
    settle(None)
    yield from flushed()


def swept(nodes: DataFrame, round_nodes: int = ROUND_NODES, ranges: int | None = None) -> list[tuple[DataFrame, bool]]:
    """The rounds of the upward sweep, written, and whether one task did them. ``ranges`` of the first round: as many as shuffles have, or one for few nodes."""
    rounds: list[tuple[DataFrame, bool]] = []
    # Given as a number, adaptive execution doesn't join the ranges by their bytes.
    ranges = ranges or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        order = [F.col("tree").asc_nulls_first(), F.col("last"), F.col("level")]
        if ranges == 1:
            dealt = nodes.repartition(1)
        else:
            dealt = nodes.repartitionByRange(ranges, *order)
        rounds.append((written(dealt.sortWithinPartitions(*order).mapInArrow(_up, SWEPT)), ranges == 1))
        waiting = rounds[-1][0].where(F.col("kind") == OUT)
        left = waiting.count()
        if not left:
            return rounds
        ranges = min(-(-left // round_nodes), max(1, ranges // 2))
        nodes = waiting.withColumn("origin", F.col("pid")).drop("pid", "kind")


PROVEN = f"{NODES}, proof string, top string"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes with the end of their proof and the root of their tree, labels descending."""
    heap: list[tuple[int, int, str, str]] = []
    at = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("pid", "tree", "kind", "n", "level", "idx", "last", "digest", "proof", "top"))
        ends, tops = [], []
        for pid, tree, kind, n, level, idx, last, digest, proof, top in zip(*columns, strict=True):
            if (pid, tree) != at:
                if heap:
                    raise ValueError("a proof has found no node")
                at = (pid, tree)
            if kind == END:
                heappush(heap, (-last, -level, proof, top))
                continue
            if not heap or heap[0][:2] != (-last, -level):
                raise ValueError("a node has got no proof")
            _, _, proof, top = heappop(heap)
            if kind == NODE:
                ends.append(proof)
                tops.append(top)
                continue
            for place in range(len(digest) // HEX):
                siblings = digest[:HEX * place] + digest[HEX * (place + 1):]
                heappush(heap, (-last_leaf(n, level - 1, ARITY * idx + place), 1 - level, f"{place}{siblings},{proof}", top))
        nodes = batch.filter(pc.equal(batch.column("kind"), NODE))
        for row in range(0, len(nodes), 2_000):
            part = nodes.slice(row, 2_000)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in list(_ARROW)[2:]), pa.array(ends[row:row + 2_000], pa.string()), pa.array(tops[row:row + 2_000], pa.string())],
                                             names=[*(f.name for f in list(_ARROW)[2:]), "proof", "top"])


def delivered(rounds: list[tuple[DataFrame, bool]], ends: DataFrame) -> DataFrame:
    """The leaves with their proofs; ``ends`` has (of, proof): what follows the proof up to the root of each tree."""
    below = None
    for swept_round, single in reversed(rounds):
        roots = swept_round.where(F.col("kind") == ROOT).join(ends.withColumnRenamed("proof", "rest"), F.col("tree").eqNullSafe(F.col("of")))
        rows = swept_round.where(F.col("kind").isin(RUN, NODE)).withColumns({"proof": F.lit(None).cast("string"), "top": F.lit(None).cast("string")})
        rows = rows.unionByName(roots.withColumns({"kind": F.lit(END), "proof": F.col("rest"), "top": F.col("digest")}).select(*rows.columns))
        if below is not None:
            rows = rows.unionByName(below.withColumns({"pid": F.col("origin"), "kind": F.lit(END)}).select(*rows.columns))
        order = [F.col("pid"), F.col("tree"), F.col("last").desc(), F.col("level").desc(), F.col("kind")]
        dealt = rows.repartition(1) if single else rows.repartition("pid")
        below = dealt.sortWithinPartitions(*order).mapInArrow(_down, PROVEN)
        below = written(below) if swept_round is not rounds[0][0] else below
    return below


def _leaves(rows: DataFrame) -> DataFrame:
    """Placed rows as nodes of level 0."""
    return rows.select("tree", "n", F.lit(0).alias("level"), "idx", F.col("idx").alias("last"), "digest", F.lit(None).cast("int").alias("origin"), "doc_id", "other")


def _roots(rounds: list[tuple[DataFrame, bool]]) -> DataFrame:
    out = rounds[0][0].where(F.col("kind") == ROOT)
    for more, _ in rounds[1:]:
        out = out.unionByName(more.where(F.col("kind") == ROOT))
    return out.select("tree", "digest")


def manifest(docs: DataFrame, other: Column | None = None, fields: Sequence[str] = FIELDS, round_nodes: int = ROUND_NODES) -> DataFrame:
    """doc_id, source, leaf, other, subroot, root and proof of each row; ``other`` is a column of docs that is carried along."""
    carried = F.lit(None).cast("string") if other is None else other.cast("string")
    digests = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(*map(F.col, fields)).alias("digest"), carried.alias("other"))
    rows = written(digests.withColumn("tie", F.monotonically_increasing_id()))  # equal rows are dealt apart
    rounds = swept(_leaves(placed(rows, ("doc_id", "digest", "tie"))), round_nodes)
    subroots = _roots(rounds).select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("other"))
    subroots = written(subroots)
    sources = subroots.count()
    few = sources if sources <= round_nodes else None
    above = swept(_leaves(placed(subroots, ("name",), few)), round_nodes, 1 if few is not None else None)
    top = _roots(above).first()  # one digest
    whole = F.lit(top.digest if top else None).cast("string")
    ends = delivered(above, _roots(above).select(F.col("tree").alias("of"), F.lit("").alias("proof")))
    leaves = delivered(rounds, written(ends.select(F.col("other").alias("of"), "proof")))
    return leaves.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "other", F.col("top").alias("subroot"), whole.alias("root"), "proof")


# --- proofs as columns ----------------------------------------------------------------------------------------------


def levels(proof: Column) -> Column:
    return F.filter(F.split(proof, ","), lambda x: x != "")


def siblings(proof: Column) -> Column:
    """The digests of a proof, from leaf to root, as one string."""
    return F.array_join(F.transform(levels(proof), lambda x: F.substr(x, F.lit(2))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    def up(digest: Column, level: Column) -> Column:
        at = F.substring(level, 1, 1).cast("int") * HEX
        return F.sha2(F.concat(F.substr(level, F.lit(2), at), digest, F.substr(level, at + 2)), 256)

    return F.aggregate(levels(proof), leaf, up)
