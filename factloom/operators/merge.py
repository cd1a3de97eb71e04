"""Upserts and publication of table versions.

Tables are immutable versions: a merge reads version *n* and yields the rows of version *n + 1*.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.relational import latest_per_key

# Texts that mean "not known" and never replace a stored value.
UNKNOWN = {"target": ("unknown", "Unknown", ""), "linker_type": ("unknown",), "development_status": ("unknown",)}


def merge_catalogue(old: DataFrame, new: DataFrame, key: str, *, overwrite: Sequence[str] = (),
                    unknown: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Insert new keys and update known ones.

    ``overwrite`` columns take the new value, columns in ``unknown`` keep the old value when the new one is listed there,
    all others keep the old value when the new one is NULL. Keys that only the old version has are kept.
    """
    unknown = UNKNOWN if unknown is None else unknown
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def merged(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in overwrite:
            kept = now
        elif c in unknown:
            kept = F.when(now.isin(*unknown[c]), was).otherwise(now)
        else:
            kept = F.coalesce(now, was)
        return F.when(F.col("__new").isNull(), was).when(F.col("__old").isNull(), now).otherwise(kept).alias(c)

    return both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *[merged(c) for c in old.columns if c != key])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], fold_case: Sequence[str] = ()) -> DataFrame:
    """Append rows with unseen keys; ``fold_case`` keys compare without case. Among equal new rows the smallest stays."""
    form = lambda df: df.select("*", *[(F.lower(k) if k in fold_case else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)])
    names = [f"__k{i}" for i in range(len(keys))]
    first = form(new).groupBy(*names).agg(F.min(F.struct(*new.columns)).alias("r"))
    fresh = first.join(form(old), names, "left_anti")
    return old.unionByName(fresh.select("r.*").select(*old.columns))


def last_write_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the new version replace rows with the same key."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return latest_per_key(both, list(keys), ["__v"]).drop("__v").select(*old.columns)


def append_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append immutable snapshots; a known ``(source, source_record_id, content_hash)`` is ignored."""
    return insert_or_ignore(old, new, ["source", "source_record_id", "content_hash"])


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Drop the rows that meet the condition and add the new ones (relinking)."""
    return old.filter(~F.coalesce(condition, F.lit(False))).unionByName(new)


def update_keeping(old: DataFrame, new: DataFrame, key: str, immutable: Sequence[str]) -> DataFrame:
    """Upsert in which the ``immutable`` columns of known keys never change."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in immutable or c == key
                      else F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c)
    return both.select(*[pick(c) for c in old.columns])


def merge_external_record(external: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Conservative merge of a third-party record into its catalogue row: a value is taken only where one is given;
    aliases are the sorted union of both sides and the brand name. Array columns ``aliases`` and ``synonyms``."""
    e = external.alias("e").join(catalogue.alias("c"), key)
    names = F.array_sort(F.array_distinct(F.array_union(F.array_union(F.col("c.aliases"), F.col("e.synonyms")),
                                                        F.array_compact(F.array(F.nullif(F.col("e.brand_name"), F.lit("")))))))
    take = {"target": "target", "antibody": "antibody_name", "linker_name": "linker_name", "payload_name": "payload_name",
            "indication": "representative_indication", "company": "organization"}
    merged = {mine: F.coalesce(F.nullif(F.col(f"e.{theirs}"), F.lit("")), F.col(f"c.{mine}")) for mine, theirs in take.items()}
    merged |= {"aliases": names, "dar": F.coalesce(F.col("e.dar"), F.col("c.dar")),
               "development_status": F.col("e.development_status"), "source_url": F.col("e.detail_url"),
               "data_review_status": F.lit("needs_review")}
    return e.select(*[merged[c].alias(c) if c in merged else F.col(f"c.{c}").alias(c) for c in catalogue.columns])


def redact_paths(df: DataFrame, column: str, table: str) -> DataFrame:
    """Replace stored file paths by ``raw/<table>/<file name>``."""
    name = F.element_at(F.split(F.col(column), r"[\\/]"), -1)
    return df.withColumn(column, F.when(F.coalesce(F.col(column), F.lit("")) == "", F.col(column)).otherwise(
        F.concat(F.lit(f"raw/{table}/"), name)))


# ---------------------------------------------------------------- versions


def publish_version(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], manifest: dict[str, str]) -> str:
    """Write all tables under ``root/version=<version>`` and flip ``CURRENT`` last.

    Readers follow ``CURRENT``, so they see either the old or the new set. Nothing is published when a write fails or the
    version exists already. ``CURRENT`` and the manifest go through the Hadoop file system of ``root``.
    """
    base = f"{root.rstrip('/')}/version={version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    _write_text(spark, f"{base}/MANIFEST.json", json.dumps({**manifest, "tables": sorted(tables)}, sort_keys=True))
    _write_text(spark, f"{root.rstrip('/')}/CURRENT.next", version)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = (hadoop.Path(f"{root.rstrip('/')}/{name}") for name in ("CURRENT", "CURRENT.next"))
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE  # one step: readers meet the old pointer or the new one
    context = hadoop.FileContext.getFileContext(new.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, old, options)
    return base


def current_version(spark: SparkSession, root: str) -> str:
    return spark.read.text(f"{root.rstrip('/')}/CURRENT", wholetext=True).first()[0].strip()


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={current_version(spark, root)}/{name}")


def _fs(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _write_text(spark: SparkSession, location: str, text: str) -> None:
    fs, path = _fs(spark, location)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
