"""Alias dictionary, whole-phrase matching, links and mention evidence."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as tx
from factloom.functions.ids import evidence_mention_id
from factloom.operators.sizes import broadcast_if_small, is_small
from factloom.operators.stages import written

DICTIONARY_COLUMNS = ("entity_type", "entity_id", "canonical_name", "alias", "position")
#: Beginnings of aliases that may stand in a plan; phrases of more words are cut out of the text as a slice.
PLAN_KEYS, LONG_PHRASE = 50_000, 32
BREAK = "\x01"


def alias_dictionary(catalogue: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Dictionary rows with a normalised alias.

    ``catalogue(entity_id, name, aliases)`` with pipe-separated aliases gives entities of type ``adc``;
    ``references(entity_type, canonical_name, aliases ARRAY)`` gives targets and payloads, whose name is their id.
    ``position`` keeps the dictionary order for ties.
    """
    own = catalogue.select(
        F.lit("adc").alias("entity_type"), "entity_id", F.col("name").alias("canonical_name"),
        F.posexplode(F.concat(F.array("name"), F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"),
                                                        lambda a: a != ""))).alias("position", "raw"),
    )
    rows = own
    if references is not None:
        rows = own.unionByName(references.select(
            "entity_type", F.col("canonical_name").alias("entity_id"), "canonical_name",
            F.posexplode(F.array_distinct(F.concat(F.array("canonical_name"), "aliases"))).alias("position", "raw"),
        ))
    return (rows.withColumn("alias", tx.normalize_text(F.col("raw"))).filter("alias <> ''")
            .groupBy("entity_type", "entity_id", "canonical_name", "alias").agg(F.min("position").alias("position")))


def word_ngrams(tokens: Column, lengths: Sequence[int], starts: Sequence[Column]) -> Column:
    """Distinct word n-grams of the given lengths; those of each length begin at some of its ``starts`` (places from 0)."""
    def grams(n: int, at: Column) -> Column:
        def gram(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]) if n <= LONG_PHRASE else F.array_join(F.slice(tokens, i + 1, n), " ")

        return F.transform(F.filter(at, lambda i: i <= F.size(tokens) - n), gram)

    return F.array_distinct(F.concat(*[grams(n, at) for n, at in zip(lengths, starts, strict=True)]))


def _first_words(forms: DataFrame, first: int) -> list[int] | None:
    """Hashes of the first ``first`` words (one or two) of the forms that have so many (with one: only those); None if they are too many for a plan."""
    words = F.split("alias", " ")
    wanted = forms.filter(F.size(words) >= 2 if first == 2 else F.size(words) == 1)
    keys = wanted.select(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(first)]).alias("k")).distinct().limit(PLAN_KEYS + 1).collect()
    return [r.k for r in keys] if len(keys) <= PLAN_KEYS else None


def _places(tokens: str, first: int, keys: list[int] | None) -> Column:
    """The places of ``first`` words in a row (one or two), only those whose hash is among the ``keys`` if these are given."""
    every = f"sequence(0, size({tokens}) - {first})"
    if keys is not None:
        # Spark keeps a long list of literals as a hash set.
        hashed = ", ".join(f"get({tokens}, i + {k})" for k in range(first))
        numbers = ", ".join(f"{k}L" if k > -(1 << 63) else "(-9223372036854775807L - 1L)" for k in keys)
        every = f"filter({every}, i -> xxhash64({hashed}) IN ({numbers}))" if keys else "cast(array() AS array<int>)"
    return F.expr(f"CASE WHEN size({tokens}) >= {first} THEN {every} ELSE cast(array() AS array<int>) END")


def match_dictionary(documents: DataFrame, dictionary: DataFrame, *, key: str, text: str) -> DataFrame:
    """Whole-phrase matches: one row per document and entity with the longest matching alias.

    Documents are turned into the word n-grams the dictionary can contain, and joined on equality; no
    document-by-alias product is formed. Only n-grams whose first two words begin some alias are built, unless the dictionary has more
    than ``PLAN_KEYS`` of such beginnings. Ties between aliases of one length go to the first in dictionary order.
    """
    entity = ["entity_type", "entity_id"]
    # The aliases of an entity are numbered from worst to best, so that the best match is the largest of some numbers.
    order = Window.partitionBy(*entity).orderBy(F.length("alias"), -F.col("position"), "alias", "canonical_name")
    forms = written(dictionary.filter(F.col("alias").isNotNull()).select(*entity, "canonical_name", "alias", F.row_number().over(order).alias("__r")))
    lengths = sorted(r[0] for r in forms.select(F.size(F.split("alias", " "))).distinct().collect()) or [1]
    small = is_small(forms)
    keys = {first: _first_words(forms, first) if small else None for first in {min(n, 2) for n in lengths}}
    tokens = documents.select(key, F.split(tx.normalize_text(F.col(text)), " ").alias("__t"))
    placed = tokens.select(key, "__t", *[_places("__t", first, found).alias(f"__p{first}") for first, found in keys.items()])
    grams = placed.select(key, F.explode(word_ngrams(F.col("__t"), lengths, [F.col(f"__p{min(n, 2)}") for n in lengths])).alias("alias"))
    near = F.broadcast if small else lambda df: df
    best = grams.join(near(forms.drop("canonical_name")), "alias").groupBy(key, *entity).agg(F.max("__r").alias("__best"))
    named = forms.select(*[F.col(c).alias(f"__{c}") for c in entity], "canonical_name", F.col("alias").alias("matched_alias"), "__r")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in entity]
    return best.join(near(named), (F.col("__best") == F.col("__r")) & same[0] & same[1]).select(key, *entity, "canonical_name", "matched_alias")


def exact_canonical(names: DataFrame, dictionary: DataFrame, *, name: str, entity_type: str) -> DataFrame:
    """Entity whose normalised alias equals the normalised name; the first dictionary entry wins, else NULL."""
    forms = dictionary.filter(F.col("entity_type") == entity_type)
    first = forms.groupBy("alias").agg(
        F.min_by(F.struct("entity_id", "canonical_name"), F.struct("position", "entity_id")).alias("m"))
    keyed = names.withColumn("__n", tx.normalize_text(F.col(name)))
    return keyed.join(first, F.col("__n") == first["alias"], "left").select(
        *names.columns, F.col("m.entity_id").alias("entity_id"), F.col("m.canonical_name").alias("canonical_name"))


def with_sentences(documents: DataFrame, text: str, out: str = "__s") -> DataFrame:
    """Add the sentences of a text: as they are, and normalised as one string with a line for each, in which every line has a blank at both ends."""
    # \x01 stands for a break while all sentences are folded at once, then ` does: Java matches two ranges ([`-z0-9]) far faster than three.
    bare = F.replace(F.col(text), F.lit(BREAK), F.lit("\x02"))
    df = documents.withColumn(f"{out}_marked", F.concat(F.lit(BREAK), F.regexp_replace(bare, tx.SENTENCE_BREAK, BREAK), F.lit(BREAK)))
    folded = F.replace(F.replace(tx.fold(F.col(f"{out}_marked")), F.lit("`"), F.lit(" ")), F.lit(BREAK), F.lit("`"))
    lines = F.regexp_replace(F.regexp_replace(folded, "[^`-z0-9]+", " "), " ?` ?", " \n ")
    return df.withColumn(out, F.struct(F.split(text, tx.SENTENCE_BREAK).alias("s"), lines.alias("n"))).drop(f"{out}_marked")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _lines(texts: pa.Array, phrases: pa.Array) -> pa.Array:
    """For each phrase of a row the number of the first line that holds it between blanks, 0 if none does. A search ends at its hit."""
    def found(text: str | None, phrase: str) -> int:
        at = -1 if text is None else text.find(f" {phrase} ")
        return 0 if at < 0 else text.count("\n", 0, at)

    rows = zip(texts, phrases, strict=True)  # a row at a time becomes Python strings
    return pa.array([[found(text, phrase) for phrase in wanted.as_py()] for text, wanted in ((t.as_py(), w) for t, w in rows)], pa.list_(pa.int32()))


def _quote(sentences: Column, text: Column, line: Column, max_length: int) -> Column:
    return F.substring(F.coalesce(F.get(sentences["s"], line - 1), text), 1, max_length)


def excerpt(sentences: Column, text: Column, alias: Column, max_length: int = 600) -> Column:
    """First sentence that contains the alias as a whole phrase, else the head of the text; at most ``max_length``."""
    return _quote(sentences, text, F.get(_lines(sentences["n"], F.array(alias)), F.lit(0)), max_length)


def mention_links(documents: DataFrame, dictionary: DataFrame, *, record_type: str, source: str, key: str,
                  record_id: str, text: str, url: str, confidence: float, predicate: str = "mentions",
                  value: str | None = None, evidence_text: str | None = None) -> DataFrame:
    """Entity links and mention evidence of a record table.

    Without ``evidence_text`` the excerpt around the alias is quoted; without ``value`` the canonical name is stored.
    """
    matches = match_dictionary(documents, dictionary, key=key, text=text)
    if evidence_text is None:
        # The matches of a document are gathered (one per dictionary entity at most), so every text moves once.
        gathered = matches.groupBy(key).agg(F.collect_list(F.struct("entity_type", "entity_id", "canonical_name", "matched_alias")).alias("__m"))
        joined = with_sentences(gathered.join(documents, key), text).withColumn("__l", _lines(F.col("__s.n"), F.transform("__m", lambda m: m["matched_alias"])))
        quoted = F.zip_with("__m", "__l", lambda m, line: F.struct(m.alias("m"), _quote(F.col("__s"), F.col(text), line, 600).alias("quote")))
        joined = joined.withColumn("__q", F.explode(quoted)).select(*documents.columns, "__q.m.*", F.col("__q.quote").alias("__quote"))
    else:
        joined = matches.join(documents, key).withColumn("__quote", F.substring(evidence_text, 1, 600))
    quote = F.col("__quote")
    return joined.select(
        evidence_mention_id(F.lit(source), F.col(record_id), "entity_type", "entity_id", F.lit(predicate))
        .alias("evidence_id"),
        "entity_type", "entity_id", F.lit(record_type).alias("source_record_type"),
        F.col(record_id).cast("string").alias("source_record_id"), "matched_alias", F.lit(source).alias("source"),
        F.lit(predicate).alias("predicate"),
        (F.col("canonical_name") if value is None else F.col(value)).alias("value"), quote.alias("evidence_text"),
        F.col(url).alias("source_url"), F.lit(float(confidence)).alias("confidence"),
    )


def attribute_evidence(records: DataFrame, *, source: str, record_id: str, entity_id: str, columns: dict[str, str],
                       url: str, confidence: float = 0.98) -> DataFrame:
    """One evidence row per non-empty attribute, from ``{predicate: column}``."""
    items = F.filter(
        F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(c).cast("string").alias("value"))
                  for p, c in columns.items()]),
        lambda i: F.coalesce(i["value"], F.lit("")) != "")
    exploded = records.select(record_id, entity_id, url, F.explode(items).alias("i"))
    return exploded.select(
        evidence_mention_id(F.lit(source), record_id, entity_id, "i.predicate").alias("evidence_id"),
        F.col(entity_id).alias("subject_id"), F.lit(source).alias("source"),
        F.col(record_id).cast("string").alias("source_record_id"), "i.predicate", "i.value",
        F.concat_ws(": ", "i.predicate", "i.value").alias("evidence_text"), F.col(url).alias("source_url"),
        F.lit(confidence).alias("confidence"))


def resolve_in_questions(questions: DataFrame, forms: DataFrame, *, key: str, question: str) -> DataFrame:
    """Entities named in each question, numbered by first position, longer forms first.

    ``forms(entity_id, entity_name, form)`` holds names and aliases; a form needs three characters and may match
    inside words. The substrings of the question that have the length of some form are joined on equality, so no
    question-by-form pair is formed unless it matches.
    """
    folded = forms.select("entity_id", "entity_name", tx.strip(tx.fold(F.col("form"))).alias("form")).filter(
        F.length("form") >= 3).distinct()
    lengths = sorted(r[0] for r in folded.select(F.length("form")).distinct().collect())
    q = questions.select(key, tx.fold(F.col(question)).alias("__q"))

    def pieces(n: int) -> Column:
        last = F.length("__q") - n + 1
        cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
            F.substring(F.col("__q"), i, F.lit(n)).alias("form"), i.alias("at")))
        return F.when(last >= 1, cut).otherwise(F.array().cast("array<struct<form:string,at:int>>"))

    cut = q.select(key, F.explode(F.concat(*[pieces(n) for n in lengths or [3]])).alias("p"))
    hits = cut.select(key, "p.form", "p.at").join(broadcast_if_small(folded), "form")
    first = F.min(F.struct(F.col("at"), (-F.length("form")).alias("shorter"))).alias("first")
    per_entity = hits.groupBy(key, "entity_id", "entity_name").agg(first)
    order = Window.partitionBy(key).orderBy("first.at", "first.shorter", "entity_id")
    return per_entity.withColumn("position", F.row_number().over(order)).select(
        key, "entity_id", "entity_name", "position")
