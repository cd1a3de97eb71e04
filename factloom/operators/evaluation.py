"""Retrieval metrics, benchmark scoring, paired comparison and question-set checks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import stats, text as tx
from factloom.functions.ids import table_digest
from factloom.operators.relational import ratio

PAIRED_METRICS = ("route", "status", "answer", "evidence", "refusal")


def require_same_ids(left: DataFrame, right: DataFrame, key: str = "question_id") -> None:
    """Both frames must hold exactly the same ids, each once."""
    l, r = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "l"), (right, "r")))
    bad = l.join(r, key, "full_outer").filter("l IS NULL OR r IS NULL OR l > 1 OR r > 1").limit(3).collect()
    if bad:
        raise ValueError(f"question ids must match exactly; see {[row[key] for row in bad]}")


# ---------------------------------------------------------------- retrieval metrics


def ir_metrics(questions: DataFrame, results: DataFrame, relevant: DataFrame, max_k: int = 10,
               cutoffs: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Reciprocal rank, nDCG and hit rates per question.

    ``results(question_id, document_id, rank)`` and ``relevant(question_id, document_id)``. A document counts once, with
    its best rank; gains are binary; the ideal list has ``min(relevant, max_k)`` entries.
    """
    ranked = results.groupBy("question_id", "document_id").agg(F.min("rank").alias("rank")).filter(F.col("rank") <= max_k)
    wanted = relevant.select("question_id", "document_id").distinct()
    gain = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1))
    hits = ranked.join(wanted, ["question_id", "document_id"], "left_semi").groupBy("question_id").agg(
        F.min("rank").alias("first_rank"), F.sum(gain).alias("dcg"))
    sizes = wanted.groupBy("question_id").agg(F.count(F.lit(1)).alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(max_k))), F.lit(0.0),
                        lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))
    j = questions.join(sizes, "question_id", "left").join(hits, "question_id", "left")
    return j.select(
        *questions.columns, F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        *[F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0)).alias(f"hit_at_{k}") for k in cutoffs if k <= max_k])


def mean_by_category(rows: DataFrame, metrics: Sequence[str], category: str = "category", digits: int = 4) -> DataFrame:
    """Means per category and over all rows (category ``overall``)."""
    rolled = rows.rollup(category).agg(F.count(F.lit(1)).alias("questions"),
                                       *[F.round(F.avg(m), digits).alias(m) for m in metrics], F.grouping(category).alias("__all"))
    return rolled.withColumn(category, F.when(F.col("__all") == 1, "overall").otherwise(F.col(category))).drop("__all")


# ---------------------------------------------------------------- benchmark scoring


def same_text(left: Column, right: Column) -> Column:
    return F.lower(tx.strip(left)) == F.lower(tx.strip(right))


def bare_id(value: Column) -> Column:
    """Document id without case, blanks and the publication namespace."""
    return F.regexp_replace(F.lower(tx.strip(value)), "^pubmed:", "")


def value_matches(actual: Column, expected: Column, expected_is_list: Column, allowed: Column) -> Column:
    """Compare a claimed value list with an expected value.

    Lists must be equal item by item, without case. A single expected value, or one of its allowed forms, must be in the
    claimed list.
    """
    fold = lambda items: F.transform(items, lambda v: F.lower(tx.strip(v)))
    any_of = F.arrays_overlap(fold(actual), fold(F.concat(expected, allowed)))
    return F.when(expected_is_list, fold(actual) == fold(expected)).otherwise(F.coalesce(any_of, F.lit(False)))


def answer_credit() -> Column:
    """Share of the expected cells that some claim answers; see :func:`score_answers` for the columns."""
    claims, cells = F.col("claims"), F.col("expected_cells")

    def cell_hit(cell: Column) -> Column:
        return F.exists(claims, lambda c: (cell["subject_id"].isNull() | (c["subject_id"] == cell["subject_id"]))
                        & c["predicate"].endswith(F.concat(F.lit("."), cell["field"]))
                        & value_matches(c["values"], cell["values"], cell["is_list"], F.col("allowed")))

    hits = F.size(F.filter(cells, cell_hit)).cast("double")
    cited = F.exists("cited", lambda a: F.exists("accepted_documents", lambda e: bare_id(a) == bare_id(e)))
    refused = F.col("status") == "refused"
    return (F.when(F.col("kind") == "refusal", refused.cast("double"))
            .when(F.col("kind") == "evidence_document", cited.cast("double"))
            .when(F.col("kind").isin("structured", "comparison", "trial_record") & (F.size(cells) > 0),
                  hits / F.size(cells).cast("double"))
            .otherwise(F.lit(0.0)))


def score_answers(gold: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row of metrics per question.

    ``gold``: question_id, category, expected_route, expected_status[], kind, expected_cells[(subject_id, field, values[],
    is_list)], allowed[], accepted_documents[], evidence_ids[], allow_partial, should_refuse.
    ``outputs``: question_id, status, route, claims[(subject_id, predicate, values[])], cited[].
    """
    require_same_ids(gold, outputs)
    j = gold.join(outputs, "question_id")
    credit = answer_credit()
    full = (credit >= 1.0).cast("double")
    evidence = (F.size("evidence_ids") == 0) | F.exists("cited", lambda a: F.exists("evidence_ids", lambda e: bare_id(a) == bare_id(e)))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return j.select(
        "question_id", "category", number(F.col("route") == F.col("expected_route")).alias("route"),
        number(F.array_contains("expected_status", F.col("status"))).alias("status"),
        F.when(F.col("allow_partial"), credit).otherwise(full).alias("answer_field"), full.alias("answer"),
        number(evidence).alias("evidence"),
        number((F.col("status") == "refused") == F.col("should_refuse")).alias("refusal"))


def score_report(scores: DataFrame) -> DataFrame:
    return mean_by_category(scores, ["route", "status", "answer_field", "answer", "evidence", "refusal"], digits=6)


# ---------------------------------------------------------------- paired comparison


def paired_counts(pairs: DataFrame, groups: Sequence[str], system: str = "system", baseline: str = "baseline") -> DataFrame:
    """Counts of a paired binary outcome: both, one only, rates and their difference."""
    s, b = F.col(system), F.col(baseline)
    n = F.count(F.lit(1))
    rate = lambda c: F.round(c.cast("double") / n.cast("double"), 6)
    return pairs.groupBy(*groups).agg(
        n.alias("question_count"), F.count_if(s).alias("system_success"), F.count_if(b).alias("baseline_success"),
        F.count_if(s & b).alias("both_success"), F.count_if(s & ~b).alias("system_only"), F.count_if(~s & b).alias("baseline_only"),
        rate(F.count_if(s)).alias("system_rate"), rate(F.count_if(b)).alias("baseline_rate"),
        rate(F.count_if(s & ~b) - F.count_if(~s & b)).alias("difference"))


def with_exact_test(counts: DataFrame) -> DataFrame:
    discordant = F.col("system_only") + F.col("baseline_only")
    return counts.withColumn("discordant", discordant).withColumn(
        "p_value", F.round(stats.exact_mcnemar("system_only", "discordant"), 6))


def bootstrap_positions(confidence: float, iterations: int) -> tuple[int, int]:
    """Places, from 0, of the two bounds in the sorted differences of all iterations."""
    if not 0 < confidence < 1 or iterations < 1:
        raise ValueError("invalid confidence or iterations")
    alpha = (1 - confidence) / 2
    place = lambda x: max(0, min(iterations - 1, x))
    return place(math.floor(alpha * iterations)), place(math.ceil((1 - alpha) * iterations) - 1)


#: Quadruples of draws that one row makes, and that are held at a time.
DRAW_ROW, DRAW_BLOCK = 1 << 20, 1 << 15

_MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_STEPS = [(int(abs(math.sin(i + 1)) * 2**32), (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16) for i in range(64)]


def _md5_words(parts: Sequence[bytes | np.ndarray]) -> list[np.ndarray]:
    """The four words of the MD5 of many messages of one length: a part is a byte string, or an array with one byte of every message."""
    message = [x for part in parts for x in ([np.uint32(c) for c in part] if isinstance(part, bytes) else [part])]
    size = len(message)
    message += [np.uint32(c) for c in b"\x80" + bytes((55 - size) % 64) + (8 * size).to_bytes(8, "little")]
    shape = np.broadcast_shapes(*[x.shape for x in message])
    state = [np.full(shape, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    new, left = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for start in range(0, len(message), 64):
        words = [message[i] | message[i + 1] << np.uint32(8) | message[i + 2] << np.uint32(16) | message[i + 3] << np.uint32(24) for i in range(start, start + 64, 4)]
        a, b, c, d = (x.copy() for x in state)
        for i, (add, at) in enumerate(_MD5_STEPS):
            _md5_mix(i // 16, b, c, d, new)
            new += a
            new += words[at] + np.uint32(add)
            np.left_shift(new, np.uint32(_MD5_SHIFTS[i]), out=left)
            new >>= np.uint32(32 - _MD5_SHIFTS[i])
            new |= left
            new += b
            a, d, c, b, new = d, c, b, new, a
        for total, x in zip(state, (a, b, c, d), strict=True):
            total += x
    return state


def _md5_mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if turn == 3:
        np.invert(d, out=out)
        out |= b
        out ^= c
        return
    kept, one, other = ((d, c, b), (c, b, d), (b, c, d))[turn]
    np.bitwise_xor(one, kept if turn < 2 else other, out=out)
    if turn < 2:
        out &= other
    out ^= kept


def _by_length(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """``(digits, from, to)`` of the numbers ``low <= x < high``, cut where they get one more decimal digit."""
    while low < high:
        digits = len(str(low))
        yield digits, low, min(high, 10**digits)
        low = 10**digits


def _digits(numbers: np.ndarray, digits: int) -> list[np.ndarray]:
    return [(numbers // 10**k % 10 + 48).astype(np.uint32) for k in reversed(range(digits))]


def _draw_sums(name: str, n: int, plus: int, minus: int, i: int, i_end: int, j: int, j_end: int) -> np.ndarray:
    """Sum of the draws of each iteration ``i .. i_end`` over the quadruples ``j .. j_end``: 1 for the first ``plus`` pairs, -1 for the next ``minus``."""
    sums = np.zeros(i_end - i, dtype=np.int64)
    first, second = -(-(plus << 32) // n), -(-((plus + minus) << 32) // n)  # the words below fall to the first pairs
    below = lambda words, bound: (words < np.uint32(bound) if bound < 1 << 32 else np.ones_like(words, dtype=bool)).sum(axis=1)
    for i_digits, i0, i1 in _by_length(i, i_end):
        for j_digits, low, high in _by_length(j, j_end):
            for j0 in range(low, high, DRAW_BLOCK):
                js = np.arange(j0, min(high, j0 + DRAW_BLOCK), dtype=np.int64)
                many = max(1, DRAW_BLOCK // len(js))
                for at in range(i0, i1, many):
                    block = np.arange(at, min(i1, at + many), dtype=np.int64)
                    words = _md5_words([f"{name}:".encode(), *_digits(block[:, None], i_digits), b":", *_digits(js[None, :], j_digits)])
                    for k, word in enumerate(words):
                        drawn = word[:, :max(0, min(len(js), -(-(n - k) // 4) - j0))].byteswap()
                        sums[at - i:at - i + len(block)] += 2 * below(drawn, first) - below(drawn, second)
    return sums


def _draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            with np.errstate(over="ignore"):  # 32-bit sums wrap
                sums = _draw_sums(r.name, r.n, r.p, r.m, r.i, r.i_end, r.j, r.j_end) if r.n else np.zeros(r.i_end - r.i, dtype=np.int64)
            yield pd.DataFrame({"__name": r.name, "__n": r.n, "__i": np.arange(r.i, r.i_end), "d": sums})


def bootstrap_interval(counts: DataFrame, groups: Sequence[str], *, confidence: float = 0.95, iterations: int = 10_000,
                       seed: int = 0) -> DataFrame:
    """Percentile interval of the rate difference over resampled pairs.

    A draw only needs the cell it falls in, so pairs are numbered by cell: system only, baseline only, the rest. The four draws
    ``4 j .. 4 j + 3`` of an iteration are the four 32-bit words of the MD5 of ``seed:groups:iteration:j``, scaled to the number of
    pairs, so any engine can repeat them. The grid of iterations and quadruples is cut into rows of about ``DRAW_ROW`` digests, spread over
    the tasks and added up; a task takes the digests of ``DRAW_BLOCK`` messages at a time, as arrays.
    """
    low, high = bootstrap_positions(confidence, iterations)
    n, plus, minus = (F.col(c).cast("bigint") for c in ("question_count", "system_only", "baseline_only"))
    name = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups])
    base = counts.select(n.alias("n"), plus.alias("p"), minus.alias("m"), name.alias("name"), F.floor((n + 3) / 4).cast("bigint").alias("quads"))
    some = F.floor(F.lit(DRAW_ROW) / F.greatest("quads", F.lit(1))).cast("bigint")  # iterations of one row
    base = base.withColumn("some", F.greatest(F.lit(1).cast("bigint"), F.least(some, F.lit(max(1, iterations // 64)).cast("bigint"))))
    zero = F.lit(0).cast("bigint")
    base = base.select("*", F.explode(F.sequence(zero, F.lit(iterations - 1).cast("bigint"), F.col("some"))).alias("i"))
    base = base.select("*", F.explode(F.sequence(zero, F.greatest(F.col("quads") - 1, zero), F.lit(DRAW_ROW).cast("bigint"))).alias("j"))
    cells = base.select("name", "n", "p", "m", "i", F.least(F.col("i") + F.col("some"), F.lit(iterations)).alias("i_end"),
                        "j", F.least(F.col("j") + DRAW_ROW, "quads").alias("j_end"))
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number: the rows are small, their work is not
    drawn = cells.repartition(tasks, "name", "n", "i", "j").mapInPandas(_draws, "__name string, __n long, __i long, d long")
    sums = drawn.groupBy("__name", "__n", "__i").agg(F.sum("d").alias("d")).groupBy("__name", "__n", "d").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__name").orderBy("d"))
    bound = lambda place: F.min(F.when(F.col("upto") > place, F.col("d")))
    found = sums.withColumn("upto", upto).groupBy("__name", "__n").agg(bound(low).alias("l"), bound(high).alias("h"))
    share = lambda c: F.round(F.col(c).cast("double") / F.col("__n").cast("double"), 6)
    return counts.withColumn("__name", name).join(found, "__name").select(*counts.columns, share("l").alias("ci_lower"), share("h").alias("ci_upper"))


def confusion(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of ``left->right`` pairs; NULL reads ``None``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return pairs.groupBy(F.concat_ws("->", name(left), name(right)).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def changed_outputs(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "question_id") -> DataFrame:
    """Questions whose outputs differ between two arms (NULL equals NULL)."""
    require_same_ids(left, right, key)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), key).filter(~same).select(key)


def arm_diagnostics(outputs: DataFrame, questions: DataFrame) -> DataFrame:
    """Route and status match rates, displays with invalid citations or unsupported claims, errors; one row.

    Outputs without a route do not count in the route rate.
    """
    require_same_ids(outputs, questions)
    j = outputs.join(questions.select("question_id", "expected_route", "expected_status"), "question_id")
    shown = F.col("status").isin("answered", "partial")
    return j.agg(
        F.round(F.avg(F.when(F.col("route").isNotNull(), (F.col("route") == F.col("expected_route")).cast("double"))), 4).alias("route_match_rate"),
        F.round(F.avg(F.array_contains("expected_status", F.col("status")).cast("double")), 4).alias("status_match_rate"),
        F.count_if(shown & ~F.coalesce("citation_valid", F.lit(True))).alias("invalid_citation_displays"),
        F.coalesce(F.sum("unsupported_claims"), F.lit(0)).alias("unsupported_claim_displays"),
        F.count_if(F.col("status") == "error").alias("errors"))


def split_audit(outputs: DataFrame, questions: DataFrame) -> DataFrame:
    """Route and status matches per split; a missing route is a mismatch."""
    require_same_ids(questions, outputs)
    j = questions.join(outputs, "question_id")
    route = F.coalesce(F.col("route") == F.col("expected_route"), F.lit(False))
    return j.groupBy("split").agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(route).alias("route_match_count"),
        F.count_if(~route).alias("route_mismatch_count"), F.count_if(F.col("route").isNull()).alias("route_missing_count"),
        ratio(F.count_if(route), F.count(F.lit(1))).alias("route_match_rate"),
        F.count_if(F.array_contains("expected_status", F.col("status"))).alias("status_match_count"),
        F.count_if(F.col("status") == "error").alias("error_count"))


def generation_metrics(rows: DataFrame) -> DataFrame:
    """Answer, refusal and citation rates with zero-safe division, one row.

    ``rows``: should_refuse, status, citation_valid, gold_citation_hit, key_fact_recall.
    """
    refuse, answerable = F.col("should_refuse"), ~F.col("should_refuse")
    said_no, answered = F.col("status") == "refused", answerable & (F.col("status") == "answered")
    c = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(answerable).alias("answerable"), F.count_if(refuse).alias("expected"),
        F.count_if(said_no).alias("predicted"), F.count_if(refuse & said_no).alias("correct"), F.count_if(answered).alias("answered"),
        F.count_if(answerable & F.col("citation_valid")).alias("valid"), F.count_if(answerable & F.col("gold_citation_hit")).alias("gold"),
        F.count_if(answered & F.col("citation_valid") & F.col("gold_citation_hit")).alias("grounded"),
        F.count_if(F.col("status") == "error").alias("errors"), F.avg(F.when(answerable, F.col("key_fact_recall"))).alias("recall"))
    r = lambda a, b: ratio(F.col(a) if isinstance(a, str) else a, F.col(b))
    return c.select(
        r("answered", "answerable").alias("answer_success_rate"), r("correct", "predicted").alias("refusal_precision"),
        r("correct", "expected").alias("refusal_recall"), r(F.col("predicted") - F.col("correct"), "answerable").alias("false_refusal_rate"),
        r("valid", "answered").alias("citation_validity_rate"), r("gold", "answerable").alias("gold_citation_hit_rate"),
        r("grounded", "answerable").alias("grounded_answer_rate"),
        F.coalesce(F.round("recall", 4), F.lit(0.0)).alias("key_fact_recall"), r("errors", "n").alias("error_rate"))


# ---------------------------------------------------------------- question sets


def overlapping_questions(holdout: DataFrame, exposed: DataFrame) -> DataFrame:
    """Held-out questions whose id or wording occurs in the exposed set.

    The exposed side is reduced to distinct keys with a count before the join, so copies of one text do not multiply.
    """
    # Long texts are compared by the hash of their key, so the shuffles carry 64 characters per row.
    key = tx.question_key(F.col("question"))
    h = holdout.select("question_id", F.sha2(key, 256).alias("k"))
    e = exposed.select(F.col("question_id").alias("eid"), F.nullif(key, F.lit("")).alias("k")).filter("k IS NOT NULL").select(
        "eid", F.sha2("k", 256).alias("k"))
    wordings = e.groupBy("k").agg(F.count(F.lit(1)).alias("exposed_count"), F.min("eid").alias("first_exposed_id"))
    by_text = h.join(wordings, "k").select("question_id", F.lit("wording").alias("kind"), "exposed_count", "first_exposed_id")
    ids = exposed.groupBy("question_id").agg(F.count(F.lit(1)).alias("exposed_count"))
    by_id = h.join(ids, "question_id").select("question_id", F.lit("id").alias("kind"), "exposed_count", F.col("question_id").alias("first_exposed_id"))
    return by_text.unionByName(by_id)


def question_file_issues(lines: DataFrame) -> DataFrame:
    """Issues of a JSON-lines question file given as ``(line, value)``: broken JSON, ids and texts."""
    parsed = F.try_parse_json("value")
    d = lines.filter(tx.strip(F.col("value")) != "").select("line", parsed.alias("v"), F.get_json_object("value", "$").alias("obj"), "value")
    is_object = F.substring(tx.strip(F.col("value")), 1, 1) == "{"
    get = lambda path: F.try_variant_get(F.col("v"), path, "string")
    d = d.select("line", F.col("v").isNotNull().alias("ok"), is_object.alias("is_object"),
                 F.when(is_object, get("$.question_id")).alias("qid"), F.when(is_object, get("$.question")).alias("q"))
    seen = d.filter("ok AND is_object AND qid <> ''").groupBy("qid").agg(F.min("line").alias("first_line"))
    d = d.join(seen, "qid", "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("ok"), "invalid_json"), F.when(F.col("ok") & ~F.col("is_object"), "row_must_be_object"),
        F.when(F.col("ok") & F.col("is_object") & (tx.strip(F.coalesce("qid", F.lit(""))) == ""), "missing_question_id"),
        F.when(F.col("ok") & F.col("is_object") & (F.col("line") > F.col("first_line")), "duplicate_question_id"),
        F.when(F.col("ok") & F.col("is_object") & tx.is_damaged(F.col("q")), "invalid_question_text")))
    return d.select("line", F.explode(reasons).alias("reason"))


def benchmark_violations(rows: DataFrame, *, splits: Sequence[str], categories: Sequence[str], statuses: Sequence[str],
                         kinds: Sequence[str], routes: Sequence[str]) -> DataFrame:
    """Structural faults of benchmark rows as ``(question_id, reason)``."""
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    no = lambda c: F.coalesce(c, F.lit(True))
    source_ok = lambda s: (F.coalesce(s["source_type"], F.lit("")) != "") & (F.coalesce(s["source_record_id"], F.lit("")) != "") & (
        F.coalesce(s["source_url"], F.lit("")) != "") & (F.coalesce(s["field"], F.lit("")) != "")
    faults = F.array_compact(F.array(
        F.when(blank("question_id"), "missing_question_id"), F.when(no(~F.col("split").isin(*splits)), "invalid_split"),
        F.when(no(~F.col("category").isin(*categories)), "invalid_category"), F.when(blank("question"), "empty_question"),
        F.when(no(~F.col("expected_route").isin(*routes)), "invalid_route"),
        F.when(no((F.size("expected_status") <= 0) | ~F.forall("expected_status", lambda s: s.isin(*statuses))), "invalid_status"),
        F.when(no(F.col("should_refuse") != (F.col("expected_route") == "refusal")), "refusal_mismatch"),
        F.when(no(~F.col("kind").isin(*kinds)), "invalid_answer_kind"),
        F.when(no(~F.forall("evidence_sources", source_ok)), "incomplete_source"), F.when(blank("primary_metric"), "missing_metric")))
    found = rows.select("question_id", F.explode(faults).alias("reason"))
    twice = rows.groupBy("question_id").count().filter("count > 1").select("question_id", F.lit("duplicate_question_id").alias("reason"))
    return found.unionByName(twice)


def question_set_manifest(questions: DataFrame) -> DataFrame:
    """Counts per split and category and one version of the set, as ``(item, value)``."""
    count = lambda c: questions.groupBy(F.concat_ws(":", F.lit(c), F.col(c)).alias("item")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    version = table_digest(questions, ["question_id", "question"], "questions_")
    head = version.select(F.explode(F.array(
        F.struct(F.lit("question_count").alias("item"), F.col("row_count").cast("string").alias("value")),
        F.struct(F.lit("version").alias("item"), F.col("version").alias("value")))).alias("x")).select("x.*")
    return head.unionByName(count("split")).unionByName(count("category"))
