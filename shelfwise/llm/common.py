"""What the operators share: session set-up, table reads and Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.session import shared_dir, tune

#: Rows of one Arrow batch: bounds what a Python worker holds of ordinary documents at once.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators; tells Python workers where this package lies."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back with a stated schema: cuts the lineage, survives lost
    executors, and is computed once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text of an Arrow string column, one at a time."""
    binary = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return (value.as_py() for value in binary)


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def crc_of(column: Column | str) -> Column:
    """crc32 of a value's text form; a null counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
