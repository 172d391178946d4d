"""Published tables: versions side by side in one folder, and a pointer file that names the good one.

A version is written aside and checked first; publishing swaps the pointer, which is one rename. A build that dies anywhere
before that leaves the last good version as it was, and a reader that has begun goes on reading its own version: the one
before the newest is kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.keyed import assert_keyed
from shelfwise.sources import store

POINTER = "_current.json"
#: Versions that stay: the published one and those before it.
KEPT = 2


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that have been published and are kept, the newest first."""
    text = store.read_text(spark, f"{path}/{POINTER}")
    return json.loads(text) if text else []


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The published version; None if nothing was published yet."""
    versions = published(spark, path)
    return spark.read.parquet(f"{path}/{versions[0]}") if versions else None


@dataclass(frozen=True)
class Staged:
    """A version that is written and checked, and that nobody reads yet."""

    spark: SparkSession
    path: str
    version: str

    @cached_property
    def _frame(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}")

    def read(self) -> DataFrame:
        """The version as a frame. Its files do not change any more, so their folders are listed once."""
        return self._frame

    def publish(self) -> DataFrame:
        """Point readers at this version and remove those that are no longer kept."""
        known = [self.version, *published(self.spark, self.path)]
        store.replace_text(self.spark, f"{self.path}/{POINTER}", json.dumps(known[:KEPT]))
        for old in known[KEPT:]:
            store.remove(self.spark, f"{self.path}/{old}")
        return self.read()


def stage(df: DataFrame, path: str, keys: Sequence[str] = (), partition_by: Sequence[str] = ()) -> Staged:
    """Write a version of a table aside, once, and check its key on what was written."""
    staged = Staged(df.sparkSession, path, f"v-{uuid.uuid4().hex}")
    rows = df.hint("rebalance", *partition_by) if partition_by else df  # few files a folder, large folders split
    rows.write.partitionBy(*partition_by).parquet(f"{path}/{staged.version}")
    if keys:
        try:
            assert_keyed(staged.read(), keys)
        except ValueError:
            store.remove(staged.spark, f"{path}/{staged.version}")
            raise
    return staged


def keyed_snapshot(df: DataFrame, keys: Sequence[str], path: str, skip_if_present: bool = False) -> DataFrame:
    """Publish df as the table at path if `keys` identify its rows; returned as read back. With skip_if_present a table
    that is published already stays and df is not worked out."""
    if skip_if_present:
        present = current(df.sparkSession, path)
        if present is not None:
            return present
    return stage(df, path, keys).publish()


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove what builds that died have left behind; only while no build is running. Returns the names."""
    known = set(published(spark, path))
    left = [name for name in store.folders(spark, path) if name.startswith("v-") and name not in known]
    for name in left:
        store.remove(spark, f"{path}/{name}")
    return left
