"""Deterministic identities built from SHA-256 digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\u001f"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by the unit separator; NULL counts as the empty string."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256)


def prefixed_id(prefix: str, length: int, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(*parts), 1, length))


def snapshot_id(source: Column | str, source_record_id: Column | str, content_hash: Column | str) -> Column:
    return prefixed_id("snap_", 32, source, source_record_id, content_hash)


def evidence_mention_id(*parts: Column | str) -> Column:
    return prefixed_id("ev_", 24, *parts)


# Control characters whose escape has a letter among its hexadecimal digits; Spark writes it in upper case.
_LETTERED = [chr(c) for c in range(32) if f"{c:02x}" != f"{c:02X}" and chr(c) not in "\n\r\f"]


def json_string(value: Column) -> Column:
    """Canonical JSON text of one string: quotes, backslashes and control characters escaped, other text kept."""
    def text(x: Column) -> Column:
        listed = F.to_json(F.array(x))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    def one(c: Column) -> Column:
        escape = F.concat(F.lit("\\u00"), F.lower(F.hex(c)))
        bare = text(c)
        return F.when(c.isin(*_LETTERED), escape).otherwise(F.substr(bare, F.lit(2), F.length(bare) - 2))

    by_character = F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), ""), F.lit('"'))
    return F.when(value.rlike("[" + "".join(f"\\x{ord(c):02X}" for c in _LETTERED) + "]"), by_character).when(value.isNotNull(), text(value))


# Strings, numbers, and all between them.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|[^"\d-]+'
# Marks of string and number values while a value passes through VARIANT.
_TEXT, _NUMBER = "\u0001t", "\u0001n"


def json_number(token: Column) -> Column:
    """Canonical text of a JSON number: whole numbers as they are, others as the shortest decimal that reads back the same."""
    whole = F.when(token == "-0", F.lit("0")).otherwise(token)
    x = token.cast("double")
    shown = F.abs(x).cast("string")
    mantissa, power = F.regexp_replace(F.split(shown, "E")[0], r"\.0$", ""), F.coalesce(F.get(F.split(shown, "E"), F.lit(1)).cast("int"), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(shown.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    short = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    size = F.abs(x)
    text = F.when(size == 0, F.lit("0.0")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
    return F.when(token.rlike(r"^-?\d+$"), whole).otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), text))


def _json_text(token: Column) -> Column:
    """The string that a JSON string stands for."""
    bare = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))).otherwise(bare)


def canonical_json(text: Column, strip=None) -> Column:
    """Canonical text of any JSON value: keys sorted at every depth, no space between tokens, strings and numbers in one form.

    Text that is no JSON, or an object that names a key twice, gives null. ``strip`` is applied to string values. Objects are sorted by Spark's
    VARIANT type; strings and numbers pass it as marked strings, so that ``8`` and ``8.0`` stay apart.
    """
    def is_key(tokens: Column, i: Column) -> Column:
        return F.coalesce(F.get(tokens, i + 1).rlike(r"^\s*:"), F.lit(False))

    def rewritten(value: Column, change) -> Column:
        """The value with ``change(tokens, token, place)`` for each token; the tokens are cut once."""
        cut = F.array(F.regexp_extract_all(value, F.lit(_JSON_TOKEN), F.lit(0)))
        return F.get(F.transform(cut, lambda tokens: F.array_join(F.transform(tokens, lambda t, i: change(tokens, t, i)), "")), F.lit(0))

    def marked(tokens: Column, t: Column, i: Column) -> Column:
        value = _json_text(t) if strip is None else strip(_json_text(t))
        return (F.when(t.startswith('"') & ~is_key(tokens, i), json_string(F.concat(F.lit(_TEXT), value)))
                .when(t.rlike(r"^-?\d"), F.concat(F.lit('"\\u0001n'), json_number(t), F.lit('"'))).otherwise(t))

    def plain(tokens: Column, t: Column, i: Column) -> Column:
        value = _json_text(t)
        rest = F.substr(value, F.lit(3))
        return (F.when(~t.startswith('"'), t).when(is_key(tokens, i), F.when(F.contains(t, F.lit("\\u")), json_string(value)).otherwise(t))
                .when(value.startswith(_NUMBER), rest).otherwise(json_string(rest)))

    ordered = F.to_json(F.try_parse_json(rewritten(text, marked)))
    # The parser stops behind the first value; only a text that is one value is one element both alone and before another.
    elements = lambda ending: F.size(F.try_parse_json(F.concat(F.lit("["), text, F.lit(ending))).cast("array<variant>"))
    return F.when((elements("]") == 1) & (elements(",0]") == 2), rewritten(ordered, plain))


def value_hash(value_json: Column | str) -> Column:
    return F.sha2(_col(value_json), 256)


def value_locator(predicate: Column | str, value_json: Column | str) -> Column:
    return F.concat(_col(predicate), F.lit("["), F.substring(F.sha2(_col(value_json), 256), 1, 12), F.lit("]"))


# ---------------------------------------------------------------- table versions


def table_digest(df: DataFrame, columns: Iterable[str], prefix: str = "data_") -> DataFrame:
    """One-row version of a whole table that does not depend on row order.

    Each row is hashed; the eight 32-bit words of the row hashes are added up and the row count and the sums are
    hashed again. Sums combine on the map side, so no task ever sees more than one row at a time, and a version of an
    appended table can be derived from the old sums.
    """
    row_hash = digest(*columns)
    words = [
        F.sum(F.conv(F.substring(F.col("__h"), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}")
        for i in range(8)
    ]
    sums = df.select(row_hash.alias("__h")).agg(F.count(F.lit(1)).alias("row_count"), *words)
    parts = [F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(8)]
    return sums.select(
        "row_count",
        F.concat(
            F.lit(prefix), F.sha2(F.concat_ws(UNIT_SEPARATOR, F.col("row_count").cast("string"), *parts), 256)
        ).alias("version"),
    )
