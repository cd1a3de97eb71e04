"""A stored inverted index of chunks: built once, kept current by content hash, searched without reading the corpus.

A folder holds immutable *parts* and a table of versions::

    postings/part=<id>/bucket=<b>   token, chunk_id, place, tokens   one row per occurrence, sorted by token and chunk
    lengths/part=<id>               chunk_id, tokens, content_hash
    dead/part=<id>                  chunk_id, dead_part   chunks of earlier parts that this part replaces or deletes
    versions                        one row per complete version: its parts, columns, buckets and corpus totals

Tokens are dealt to buckets by their hash, so a search opens only the folders of its own tokens. An update writes a part for added and changed
chunks and names the dead ones; readers leave those out with an anti join. A part counts only when a version lists it, so what a failed
update has left is never read. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.retrieval import COLUMN_WEIGHTS, index_tokens
from factloom.operators.sizes import broadcast_if_small
from factloom.operators.stages import written

BUCKETS = 64
#: A place is the number of the column, shifted by so many bits, plus the place in the column.
COLUMN_BITS = 26
#: Rows of one written file, about.
FILE_ROWS = 4_000_000
#: With so many tokens or fewer they are named in the scan's filter, so that row groups without them are skipped.
NAMED_TOKENS = 1_000

POSTINGS = "token string, chunk_id string, place int, tokens int, part string, bucket int"
LENGTHS = "chunk_id string, tokens int, content_hash string, part string"
DEAD = "chunk_id string, dead_part string, part string"
VERSIONS = "version long, parts array<string>, columns array<string>, buckets int, chunks long, tokens long"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class StoredIndex:
    """The newest complete version in a folder. ``refresh`` looks for a newer one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.refresh()

    def refresh(self) -> StoredIndex:
        try:
            self.version = self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions").orderBy(F.desc("version")).first()
        except AnalysisException:  # nothing has been written yet
            self.version = None
        return self

    # --- reading ---

    def _table(self, name: str, schema: str) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("part").isin(*self.version.parts))

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = broadcast_if_small(self._table("dead", DEAD).select("chunk_id", F.col("dead_part").alias("part")))
        return rows.join(dead, ["chunk_id", "part"], "left_anti")

    def lengths(self) -> DataFrame:
        """(chunk_id, tokens, content_hash, part) of the chunks of this version."""
        return self._live(self._table("lengths", LENGTHS))

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """Occurrences of this version; with ``tokens`` (token, ...) joined with them and read from their buckets alone."""
        rows = self._table("postings", POSTINGS)
        if tokens is not None and self.version is not None:
            places = [r[0] for r in tokens.select(bucket_of(F.col("token"), self.version.buckets)).distinct().collect()]  # at most one for each bucket
            rows = rows.where(F.col("bucket").isin(*places) if places else F.lit(False))
            few = [r[0] for r in tokens.select("token").distinct().limit(NAMED_TOKENS + 1).collect()]
            if 0 < len(few) <= NAMED_TOKENS:
                rows = rows.where(F.col("token").isin(*few))
        rows = self._live(rows)
        return rows if tokens is None else rows.join(broadcast_if_small(tokens), "token")

    def terms(self) -> DataFrame:
        """(token, documents, occurrences) over all chunks."""
        per = self.postings().groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))

    def stats(self) -> DataFrame:
        """One row: chunk_count and mean_tokens."""
        v = self.version
        mean = float(v.tokens) / v.chunks if v and v.chunks else None
        return self.spark.createDataFrame([(float(v.chunks) if v else 0.0, mean)], "chunk_count double, mean_tokens double")

    def _weight(self, place: Column, weights: dict[str, float]) -> Column:
        columns = self.version.columns if self.version else []
        return F.element_at(F.array(*[F.lit(float(weights.get(c, 0.0))) for c in columns] or [F.lit(0.0)]), F.shiftright(place, COLUMN_BITS) + 1)

    def hits(self, phrases: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
        """(chunk_id, tokens, phrase, f): weighted counts of phrases (tokens with one space between) by chunk.

        A phrase of several tokens is found where its tokens stand in a row in one column.
        """
        weights = COLUMN_WEIGHTS if weights is None else weights
        words = phrases.select("phrase", F.split("phrase", " ").alias("w")).distinct().select("phrase", F.size("w").alias("k"), F.posexplode("w").alias("j", "token"))
        rows = self.postings(written(words))
        key = ["chunk_id", "tokens", "phrase"]
        one = rows.where("k = 1").groupBy(*key).agg(F.sum(self._weight(F.col("place"), weights)).alias("f"))
        begins = rows.where("k > 1").groupBy(*key, "k", (F.col("place") - F.col("j")).alias("begin")).agg(F.count(F.lit(1)).alias("met")).where("met = k")
        return one.unionByName(begins.groupBy(*key).agg(F.sum(self._weight(F.col("begin"), weights)).alias("f")))

    # --- writing ---

    def update(self, chunks: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
        """Bring the index to the given chunks (all of them); returns (status, chunks) counters.

        Only chunks whose content hash is new are tokenised. Without a change no version is written. ``columns`` and ``buckets`` count for the
        first version; later ones keep them.
        """
        old = self.version
        columns = list(old.columns) if old else [c for c in (columns or COLUMN_WEIGHTS) if c in chunks.columns]
        buckets = old.buckets if old else buckets
        texts = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), *[F.col(c).cast("string").alias(c) for c in columns])
        hashed = texts.select("chunk_id", F.sha2(F.to_json(F.struct(*columns)), 256).alias("content_hash"))
        known = self.lengths().select("chunk_id", F.col("content_hash").alias("known_hash"), "part")
        status = (F.when(F.col("known_hash").isNull(), "added").when(F.col("content_hash").isNull(), "deleted")
                  .when(F.col("known_hash") != F.col("content_hash"), "updated").otherwise("unchanged"))
        diff = written(hashed.join(known, "chunk_id", "full_outer").select("chunk_id", "content_hash", "part", status.alias("status")))
        counters = diff.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))
        if old and not diff.where("status <> 'unchanged'").limit(1).count():
            return counters
        part, fresh = uuid.uuid4().hex, diff.where("status IN ('added', 'updated')")
        if not old:
            changed = texts.join(fresh.select("chunk_id", "content_hash"), "chunk_id")
        else:
            changed = texts.join(broadcast_if_small(fresh.select("chunk_id", "content_hash")), "chunk_id")
        diff.where("status IN ('updated', 'deleted')").select("chunk_id", F.col("part").alias("dead_part")).write.parquet(f"{self.root}/dead/part={part}")
        self._write(part, changed, columns, buckets)
        self._publish([*(old.parts if old else []), part], columns, buckets)
        return counters

    def _write(self, part: str, changed: DataFrame, columns: Sequence[str], buckets: int) -> None:
        arrays = [F.coalesce(index_tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]
        base = changed.select("chunk_id", "content_hash", *[a.alias(f"t{i}") for i, a in enumerate(arrays)])
        base = base.withColumn("tokens", sum((F.size(f"t{i}") for i in range(len(columns))), F.lit(0)))
        base.select("chunk_id", "tokens", "content_hash").write.parquet(f"{self.root}/lengths/part={part}")
        total = self.spark.read.schema(LENGTHS).parquet(f"{self.root}/lengths/part={part}").select(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        spread = max(1, -(-total // FILE_ROWS))  # a bucket with a frequent token is written by many tasks

        def numbered(i: int) -> Column:
            return F.transform(f"t{i}", lambda w, p: F.struct(w.alias("token"), (p + F.lit(i << COLUMN_BITS)).alias("place")))

        rows = base.select("chunk_id", "tokens", F.explode(F.concat(*[numbered(i) for i in range(len(columns))])).alias("o")).select("o.token", "chunk_id", "o.place", "tokens")
        rows = rows.withColumn("bucket", bucket_of(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(spread)))
        rows.sortWithinPartitions("bucket", "token", "chunk_id", "place").write.partitionBy("bucket").parquet(f"{self.root}/postings/part={part}")

    def _publish(self, parts: list[str], columns: Sequence[str], buckets: int) -> None:
        number = self.version.version + 1 if self.version else 1
        self.version = self.spark.createDataFrame([(number, parts, list(columns), buckets, 0, 0)], VERSIONS).first()
        total = self.lengths().agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        row = (number, parts, list(columns), buckets, total.chunks, total.tokens)
        self.spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        self.refresh()

    def compact(self) -> None:
        """Write the live rows of all parts as one part and a version that lists it alone."""
        part, v = uuid.uuid4().hex, self.version
        self.lengths().drop("part").write.parquet(f"{self.root}/lengths/part={part}")
        self.spark.createDataFrame([], "chunk_id string, dead_part string").write.parquet(f"{self.root}/dead/part={part}")
        rows = self.postings().drop("part").repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-v.tokens // FILE_ROWS)))))
        rows.sortWithinPartitions("bucket", "token", "chunk_id", "place").write.partitionBy("bucket").parquet(f"{self.root}/postings/part={part}")
        self._publish([part], v.columns, v.buckets)
