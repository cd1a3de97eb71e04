"""Benchmark decontamination with a hash set of the normalised n-grams of all test items.

Test items are few beside the documents: their distinct n-grams up to ``max_grams`` and ``MAX_BYTES`` go to every task as sets inside the plan,
hashes to look up each window of a document, words to verify a hit. So documents are scanned where they lie; only rows of hits and one row for
each document are grouped. With more n-grams or bytes than that, every window is exploded and joined with them instead; Spark then picks the join.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item of fewer words than a window is one window of its own length.

Cases: a null text or one without such words has no windows, as an item and as a document; a null item_id counts as an occurring item but
is left out of the digest; equal windows of several items count for each; rows with one doc_id stay apart; without items no document is
hit; an empty table gives no rows; other columns pass, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
MAX_GRAMS = 50_000
MAX_BYTES = 1 << 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null has none. A-Z separates nothing before or after lower-casing, so only words that hold it are changed."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    return F.transform(words, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row, however often later expressions use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def grams_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item_row, gram, length) of all distinct windows of the items."""
    rows = items.select("item_id", F.monotonically_increasing_id().alias("item_row"), "text")
    worded = _once(rows, "__words", words_of(F.col("text"))).where(F.size("__words") > 0)
    length = F.least(F.size("__words"), F.lit(window))
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - length + 1), lambda i: F.concat_ws(" ", F.slice("__words", i, length)))
    return worded.select("item_id", "item_row", length.alias("length"), F.explode(F.array_distinct(windows)).alias("gram"))


def occurring(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """All rows of the documents with ``__words`` and ``__hits``: array of (at, length, gram), one for each window that occurs in an item."""
    grams = grams_of(items, window)
    distinct = grams.select("gram", "length").distinct()
    sized = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)), F.array_sort(F.collect_set("length"))).first()
    within = sized[0] <= max_grams and sized[1] <= MAX_BYTES
    keyed = _once(docs.drop("__words", "__hits"), "__words", words_of(F.col("text")))
    lengths = sized[2]  # 1 to window
    if not lengths:
        return keyed.withColumn("__hits", F.expr("cast(array() as array<struct<at: int, length: int, gram: string>>)"))

    if within:
        some = distinct.collect()  # bounded by max_grams and MAX_BYTES
        parts = [_hits(length, [r.gram for r in some if r.length == length], docs) for length in lengths]
        return _once(keyed, "__hits", parts[0] if len(parts) == 1 else F.concat(*parts))
    rows = keyed.withColumn("__row", F.monotonically_increasing_id())
    windows = None
    for length in lengths:
        at = F.explode(F.sequence(F.lit(0), F.size("__words") - length)).alias("at")
        part = rows.where(F.size("__words") >= length).select("__row", "__words", at).select("__row", "at", F.lit(length).alias("length"), F.concat_ws(" ", F.slice("__words", F.col("at") + 1, length)).alias("gram"))
        windows = part if windows is None else windows.unionAll(part)
    hits = windows.join(distinct, ["gram", "length"]).groupBy("__row").agg(F.collect_list(F.struct("at", "length", "gram")).alias("__hits"))
    return rows.join(hits, "__row", "left").withColumn("__hits", F.coalesce("__hits", F.expr("cast(array() as array<struct<at: int, length: int, gram: string>>)"))).drop("__row")


def _hits(length: int, texts: list[str], docs: DataFrame) -> Column:
    """The windows of one length that are in the set.

    A window's first two words are looked up by their hash, and only where that is in the set its own words. Spark keeps long lists of literals
    as hash sets; words hold no quotes or backslashes, so they stand in the expression as they are.
    """
    first = min(2, length)
    known = docs.sparkSession.createDataFrame([(" ".join(t.split(" ")[:first]),) for t in texts], "gram string")
    keys = {r[0] for r in known.select(F.xxhash64(*[F.split("gram", " ")[k] for k in range(first)])).collect()}
    hashed = ", ".join(f"__words[i + {k}]" for k in range(first))
    numbers = ", ".join(f"{k}L" if k > -(1 << 63) else "(-9223372036854775807L - 1L)" for k in keys)
    words = ", ".join(f"'{t}'" for t in texts)
    gram = f"concat_ws(' ', slice(__words, i + 1, {length}))"
    return F.expr(f"""CASE WHEN size(__words) >= {length} THEN
        transform(filter(sequence(0, size(__words) - {length}), i -> xxhash64({hashed}) IN ({numbers}) AND {gram} IN ({words})),
                  i -> named_struct('at', i, 'length', {length}, 'gram', {gram}))
        ELSE cast(array() AS array<struct<at: int, length: int, gram: string>>) END""")


def covered(hits: Column) -> Column:
    """The number of words inside the windows (at, length): each adds what reaches beyond those before it."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["length"]).alias("end"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["at"]))).alias("n"), F.greatest(a["end"], h["end"]).alias("end"))
    return F.aggregate(ordered, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurring windows), n_items, items_sha256 and contaminated of each row of the documents."""
    marked = occurring(docs.select("doc_id", "text"), items, window, max_grams)
    rows = marked.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("__words").cast("long").alias("n_words"), covered(F.col("__hits")).cast("long").alias("n_hit"), F.transform("__hits", lambda h: h["gram"]).alias("grams"))
    each = rows.select("doc_id", "row", "n_words", "n_hit", F.explode_outer(F.array_distinct("grams")).alias("gram"))
    # Rows without a hit get a key of their own that is no gram, so that a shuffled join doesn't send them all to one task.
    each = each.withColumn("gram", F.coalesce("gram", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    of_items = grams_of(items, window).select("gram", "item_id", "item_row")
    found = each.join(of_items, "gram", "left").groupBy("row", "doc_id", "n_words", "n_hit").agg(F.countDistinct("item_row").alias("n_items"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("ids")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The documents in which no window of an item occurs; the columns stay as they are."""
    names = [c for c in docs.columns]
    return occurring(docs, items, window, max_grams).where(F.size("__hits") == 0).select(*[F.col(f"`{c}`") for c in names])


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The documents' normalised words outside of all occurring windows, as ``clean_text``; all other columns stay."""
    marked = occurring(docs, items, window, max_grams)
    inside = lambda i: F.exists("__hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["length"]))
    return marked.withColumn("clean_text", F.concat_ws(" ", F.filter("__words", lambda w, i: ~inside(i)))).drop("__words", "__hits")
