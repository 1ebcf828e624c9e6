"""Loading rules between an old and a new version of a table, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_latest_by_key(parts: Sequence[DataFrame], keys: Sequence[str], *, seq: str | None = None) -> DataFrame:
    """Upsert: the last loaded row per natural key wins (by part order, then ``seq``). One map-side combined
    aggregate; keys are spread, so no key's versions have to fit a sort."""
    stacked = None
    for i, p in enumerate(parts):
        d = p.withColumn("_part", F.lit(i))
        stacked = d if stacked is None else stacked.unionByName(d, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in (*keys, "_part")]
    order = F.struct("_part", *([seq] if seq else []))
    return stacked.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_ignore_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], *, seq: str) -> DataFrame:
    """First row per key wins: existing rows stay, of several new rows the first by ``seq`` enters."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return old.unionByName(first.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_dates(df: DataFrame, *, date: str, source: str, modified: str) -> DataFrame:
    """A newer file replaces every date it holds: per date only the rows of the newest file remain."""
    newest = df.groupBy(date).agg(F.max_by(source, F.struct(modified, source)).alias(source))
    return df.join(newest, [date, source], "left_semi")


def append_only_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows the new version changed or dropped (multiset difference); empty when it only appends."""
    return old.exceptAll(new.select(*old.columns))


def write_dates(df: DataFrame, path: str, date: str) -> None:
    """Replace exactly the dates present in ``df`` (dynamic partition overwrite)."""
    df.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write a result and refuse a target that already exists."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def upsert_path(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Merge ``new`` over the table at ``path`` into a new folder and read it back (the old one stays until the
    caller switches, so a failed job leaves a whole table)."""
    merge_latest_by_key([spark.read.parquet(path), new], keys).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)
