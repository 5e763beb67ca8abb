"""Reading, aligning, merging and rewriting Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet_union(
    spark: SparkSession, paths: Sequence[str], *, date_from: str | None = None, date_column: str = "event_date"
) -> DataFrame:
    """One scan over all part folders of a table; columns a part lacks read as NULL."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    if date_from and date_column not in df.columns:
        df = df.withColumn(date_column, F.to_date(date_from))
    return df


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns that exist; text that is no number becomes NULL."""
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def resolve_column(df: DataFrame, *candidates: str) -> str:
    """The first candidate present in ``df``, whatever its case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {list(candidates)} found; available columns: {sorted(df.columns)}")


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Select ``target <- first matching candidate`` for every entry of ``wanted``."""
    return df.select(*[F.col(resolve_column(df, *names)).alias(out) for out, names in wanted.items()])


def rename_legacy(df: DataFrame, renames: Mapping[str, str], *, backfill: Mapping[str, Column] | None = None) -> DataFrame:
    """Rename old columns. Where both spellings exist the new one wins unless it is NULL."""
    present = {old: new for old, new in renames.items() if old in df.columns}
    both = {new: old for old, new in present.items() if new in df.columns}
    merged = [
        F.coalesce(F.col(c), F.col(both[c])).alias(c) if c in both else F.col(c).alias(present.get(c, c))
        for c in df.columns
        if not (c in present and present[c] in both)
    ]
    out = df.select(*merged)
    for name, value in (backfill or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    return out


def retain(df: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """Rows newer than the retention period that ends at ``as_of``."""
    return df.where(F.col(at) > as_of - F.make_dt_interval(F.lit(days)))


def without_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``existing``."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def conflicting_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that carry more than one distinct row, with the number of such rows."""
    return df.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def deduplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact copies collapsed to one row; a NULL key or two different rows per key raise."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"dedupe columns {missing} are missing; available: {sorted(df.columns)}")
    if not df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).isEmpty():
        raise ValueError(f"NULL in dedupe key {list(keys)}")
    if not conflicting_keys(df, keys).isEmpty():
        raise ValueError(f"different rows share a dedupe key {list(keys)}")
    return df.distinct()


def insert_only_merge(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append so that every key of ``new`` is stored exactly once.

    Running it again on its own result inserts nothing.
    """
    return without_existing(deduplicated(new, keys), existing, keys)


def compact_clustered(
    df: DataFrame, path: str, cluster_by: Sequence[str], *, rows_per_file: int = 5_000_000, spread: Iterable[str] = ()
) -> int:
    """Rewrite a table as sorted, range-clustered files and return the number of ranges.

    ``spread`` columns continue the range key, so one value of the cluster columns that
    holds a large share of the rows is still cut into several files.
    """
    ranges = max(1, -(-df.count() // rows_per_file))
    order = [*cluster_by, *spread]
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    return ranges


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with both counts (empty when equal)."""
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
        .where("left_count <> right_count")
    )
