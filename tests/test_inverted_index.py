"""The stored index against tokenising the corpus again."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval as r
from factloom.operators.inverted_index import StoredIndex, bucket_of

WORDS = ["alpha", "Beta", "gamma", "8.0", "8", "0", "naïve", "delta", "trial-x", "的", "x"]
COLUMNS = "chunk_id string, retrieval_document_id string, title string, content string, entities string, source_type string"


def chunk_rows(n, seed):
    rng = random.Random(seed)
    text = lambda k: None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(k)))
    return [(f"c{i:03d}", f"d{i // 2}", text(4), text(30), text(3), "s") for i in range(n)]


QUESTIONS = [("q1", "alpha beta 8.0"), ("q2", "8.0 naive"), ("q3", "nothing known"), ("q4", "gamma"), ("q5", "")]


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id string, question string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def same_search(chunks, questions, index):
    columns = ("question_id", "chunk_id", "score", "rank")
    assert rows(r.sparse_search(chunks, questions, top_k=5, index=index).select(*columns)) == rows(r.sparse_search(chunks, questions, top_k=5).select(*columns))


def test_a_built_index_searches_like_the_corpus(spark, tmp_path, questions):
    chunks = spark.createDataFrame(chunk_rows(60, 1), COLUMNS)
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert rows(index.update(chunks, buckets=8)) == [("added", 60)]
    same_search(chunks, questions, index)
    assert index.version.chunks == 60


def test_an_update_equals_a_rebuild_and_compaction_changes_nothing(spark, tmp_path, questions):
    old = chunk_rows(60, 2)
    new = [row for row in old if row[0] not in ("c003", "c010")]
    new[5] = (*new[5][:3], "8.0 alpha alpha", *new[5][4:])
    new[7] = (*new[7][:3], None, *new[7][4:])
    new += [(f"n{i}", f"nd{i}", "Beta", "gamma 8.0 8.0", None, "s") for i in range(4)]
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame(old, COLUMNS), buckets=8)
    chunks = spark.createDataFrame(new, COLUMNS)
    assert rows(index.update(chunks)) == [("added", 4), ("deleted", 2), ("unchanged", 56), ("updated", 2)]
    rebuilt = StoredIndex(spark, str(tmp_path / "j"))
    rebuilt.update(chunks, buckets=8)
    assert rows(index.terms()) == rows(rebuilt.terms())
    assert (index.version.chunks, index.version.tokens) == (rebuilt.version.chunks, rebuilt.version.tokens)
    same_search(chunks, questions, index)
    index.compact()
    assert len(index.version.parts) == 1
    assert rows(index.terms()) == rows(rebuilt.terms())
    back = spark.createDataFrame(old, COLUMNS)  # a text that returns is indexed again
    index.update(back)
    same_search(back, questions, index)


def test_nothing_changed_writes_nothing(spark, tmp_path):
    chunks = spark.createDataFrame(chunk_rows(20, 3), COLUMNS)
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.update(chunks, buckets=4)
    before = sorted(glob.glob(f"{tmp_path}/i/**", recursive=True))
    assert rows(index.update(chunks)) == [("unchanged", 20)]
    assert sorted(glob.glob(f"{tmp_path}/i/**", recursive=True)) == before


def test_a_search_opens_only_the_buckets_of_its_tokens(spark, tmp_path):
    chunks = spark.createDataFrame(chunk_rows(40, 4), COLUMNS)
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.update(chunks, buckets=32)
    asked = spark.createDataFrame([("q", "gamma")], "question_id string, question string")
    bucket = spark.range(1).select(bucket_of(F.lit("gamma"), 32)).first()[0]
    other = [f for f in glob.glob(f"{tmp_path}/i/postings/part=*/bucket=*/*.parquet") if f"/bucket={bucket}/" not in f]
    assert other
    for path in other:  # a file that is opened would end the search
        folder, name = path.rsplit("/", 1)
        for broken in (path, f"{folder}/.{name}.crc"):
            with open(broken, "wb") as f:
                f.write(b"no parquet")
    assert r.sparse_search(chunks, asked, index=StoredIndex(spark, str(tmp_path / "i"))).count() > 0
    with pytest.raises(Exception):
        index.terms().count()


def test_a_part_without_a_version_is_not_read(spark, tmp_path, questions):
    chunks = spark.createDataFrame(chunk_rows(30, 5), COLUMNS)
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.update(chunks, buckets=4)
    changed = chunks.withColumn("content", F.lit("alpha"))
    index._publish = lambda *a: None  # the update is lost before its version
    index.update(changed)
    same_search(chunks, questions, StoredIndex(spark, str(tmp_path / "i")))


def test_an_empty_corpus(spark, tmp_path, questions):
    chunks = spark.createDataFrame(chunk_rows(3, 6), COLUMNS)
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert r.sparse_search(chunks.limit(0), questions, index=index).count() == 0
    index.update(chunks.limit(0), buckets=4)
    assert r.sparse_search(chunks.limit(0), questions, index=index).count() == 0
    index.update(chunks)
    same_search(chunks, questions, index)
