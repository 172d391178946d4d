"""File sources and sinks: binary files, the raw landing folder and the relational load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from shelfwise.operators.governance import assert_no_pii
from shelfwise.sources import store
from shelfwise.sources.star import SALES_COLUMNS

RAW_SCHEMA = ", ".join(f"{c} string" for c in SALES_COLUMNS)


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Whole files as bytes with their names; decode and parse downstream, on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "path", "content")


def append_raw(raw: DataFrame, landing: str) -> None:
    """Land a raw batch. The landing folder only ever grows: a stream reads it."""
    raw.write.mode("append").option("compression", "zstd").parquet(landing)


def append_written(spark: SparkSession, folder: str, landing: str) -> None:
    """Land a raw batch that lies in a folder as raw files already: they are moved, not written again. A folder that is not
    there is a batch without rows."""
    store.make(spark, landing)
    batch = uuid.uuid4().hex
    for name in store.files(spark, folder):
        store.move(spark, f"{folder}/{name}", f"{landing}/{batch}-{name}")


def raw_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing)


# The relational column type of each Spark type; anything else is text.
SQL_TYPES = {
    "string": "text", "boolean": "boolean", "double": "double precision", "float": "real", "bigint": "bigint",
    "int": "integer", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date", "smallint": "smallint",
    "tinyint": "smallint",
}


def sql_columns(schema: StructType) -> str:
    """Column list of a CREATE TABLE for a frame's schema."""

    def sql_type(data_type) -> str:
        if isinstance(data_type, DecimalType):
            return f"numeric({data_type.precision},{data_type.scale})"
        return SQL_TYPES.get(data_type.simpleString(), "text")

    return ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in schema.fields)


def write_relational(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Load a serving table over JDBC straight from the executors; the database's dialect picks the column types."""
    assert_no_pii(df)
    df.write.mode("overwrite").jdbc(url, table, properties=properties)
