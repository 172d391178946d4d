"""Shared by the tests, the check script and the bench: a local session and a frame comparison."""

from __future__ import annotations

import os
import tempfile

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.local.dir", f"{scratch}/local")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables_equal(con: duckdb.DuckDBPyConnection, got: pa.Table, sql: str) -> str | None:
    """None if the table holds the rows of the SQL in any order, else what differs."""
    con.register("got", got)
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    types = {t: {row[0]: row[1] for row in con.execute(f"DESCRIBE {t}").fetchall()} for t in ("got", "want")}
    columns = sorted(types["got"])
    if types["got"] != types["want"]:
        return f"columns {sorted(set(types['got'].items()) ^ set(types['want'].items()))}"
    texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    rows = {t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("got", "want")}
    extra = con.execute(f"SELECT {texts} FROM got EXCEPT ALL SELECT {texts} FROM want ORDER BY ALL LIMIT 1").fetchall()
    missing = con.execute(f"SELECT {texts} FROM want EXCEPT ALL SELECT {texts} FROM got ORDER BY ALL LIMIT 1").fetchall()
    if rows["got"] == rows["want"] and not extra and not missing:
        return None
    return f"rows {rows}; only in result {dict(zip(columns, extra[0])) if extra else None}; only in oracle {dict(zip(columns, missing[0])) if missing else None}"
