"""Operators on keyed rows: first or latest per key, upserts and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in `order`.

    Spark turns the row_number filter into a per-task limit before the shuffle (WindowGroupLimit), so a key that
    holds much of the table sends one row per task, not all of them. `order` must break every tie that matters.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_n_per_key(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n latest rows per key with their position `_rn` (1 = latest)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def key_report(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row telling whether `keys` identify the rows: rows, distinct keys, rows with a null key."""
    any_null = " OR ".join(f"{k} IS NULL" for k in keys)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        F.coalesce(F.sum(F.expr(f"CASE WHEN {any_null} THEN n ELSE 0 END")), F.lit(0)).alias("null_keys"),
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("primary_key"),
        "row_count",
        "key_count",
        "null_keys",
        F.expr("row_count = key_count AND null_keys = 0").alias("is_valid"),
    )


def _hashes_identify(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no key is null and no two rows have the same 64-bit hash of the key: then the keys identify the rows."""
    any_null = " OR ".join(f"{k} IS NULL" for k in keys)
    hashes = df.select(F.expr(f"CASE WHEN {any_null} THEN null ELSE xxhash64({', '.join(keys)}) END").alias("h"))
    repeated = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR h IS NULL")
    return repeated.isEmpty()


def assert_keyed(df: DataFrame, keys: Sequence[str]) -> None:
    """Hashes settle it with eight bytes a row to shuffle; only if two are equal are the keys themselves compared."""
    if _hashes_identify(df, keys):
        return
    report = key_report(df, "table", keys).head()
    if not report["is_valid"]:
        raise ValueError(
            f"({', '.join(keys)}) is no primary key: {report['row_count']} rows, {report['key_count']} keys, "
            f"{report['null_keys']} rows with a null key"
        )


def keyed_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`new` rows replace `old` rows of the same key; all other old rows stay."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
