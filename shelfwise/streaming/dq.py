"""Structured Streaming: the quality pipeline over the raw landing folder, and the micro-batch cycle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import ratio
from shelfwise.operators.governance import assert_no_pii
from shelfwise.operators.keyed import assert_keyed
from shelfwise.operators.quality import SALES, TYPES, typed_sales
from shelfwise.plans import gold
from shelfwise.session import shared_dir, written
from shelfwise.sources import store as files
from shelfwise.sources.files import raw_stream
from shelfwise.sources.star import SALES_COLUMNS

#: What silver and gold are partitioned by, and what a refresh works out anew: month, day, quarter or year. A store keeps one.
PERIOD = "month"
#: The types of silver, as quality.typed_sales makes them.
SILVER_SCHEMA = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in SALES_COLUMNS)

#: The columns of a rejected row: the feed's text, why and when.
REJECTED = ", ".join(f"{c}: string" for c in (*SALES_COLUMNS, "reject_reason")) + ", quarantined_at: timestamp"


def _period(column: str, by: str) -> Column:
    return F.trunc(column, by).cast("date") if by != "day" else F.to_date(column)


def _checked(batch: DataFrame, by: str) -> DataFrame:
    """Every row of a batch typed: kept ones (1) with their period, rejected ones (0) also as text in one column."""
    text = F.struct(*SALES_COLUMNS, SALES.reason().alias("reject_reason"), F.current_timestamp().alias("quarantined_at"))
    whole = batch.withColumn("kept", SALES.passed().cast("int")).withColumn("rejected", F.when(F.col("kept") == 0, text))
    return typed_sales(whole).withColumn("period", F.when(F.col("kept") == 1, _period("order_ts", by)))


def _write_batch(batch: DataFrame, batch_id: int, store: str, by: str = PERIOD) -> None:
    """The tables of one batch, its files read once: silver and quarantine are the two halves of one table, rules are counted on
    the way, and the index comes from what was written. A batch that is run again overwrites its own part only.

    Each task writes its rows by period as they lie: nothing is shuffled.
    """
    spark, counted = batch.sparkSession, Observation()
    rows = _checked(SALES.observe(batch, counted), by)
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kept", "period").parquet(f"{store}/checked/batch_id={batch_id}")
    index = _silver_store(spark, store).filter(F.col("batch_id") == batch_id).select("sale_id", "period")
    index.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/sale_periods/batch_id={batch_id}")
    found = counted.get
    counts = [(rule, found["checked"], found[rule]) for rule in SALES.rules]
    per_rule = spark.createDataFrame(counts, "rule string, checked bigint, failed bigint")
    per_rule.coalesce(1).write.mode("overwrite").parquet(f"{store}/rule_counts/batch_id={batch_id}")


def rule_counts(spark: SparkSession, store: str) -> DataFrame:
    """Rows checked and failed per rule and batch."""
    return spark.read.parquet(f"{store}/rule_counts")


def rule_totals(spark: SparkSession, store: str) -> DataFrame:
    """Rows checked, failed and percent failed per rule over all batches."""
    sums = rule_counts(spark, store).groupBy("rule").agg(F.sum("checked").alias("checked"), F.sum("failed").alias("failed"))
    return sums.withColumn("failed_pct", F.expr(ratio("100 * failed", "checked", 2)))


def run_quality(spark: SparkSession, landing: str, store: str, files_per_batch: int | None = None, by: str = PERIOD) -> dict[str, int]:
    """Bring what has landed since the last run into silver, quarantine and rule counts, in one pass over the files;
    returns rows checked and failures per rule of this run.

    With the store's checkpoint kept, a run is incremental; with a fresh store it is a full refresh.
    """
    batches: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, store, by)
        batches.append(batch_id)

    query = (
        raw_stream(spark, landing, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{store}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not batches:
        return {}
    own = rule_counts(spark, store).filter(F.col("batch_id").isin(batches)).groupBy("rule")
    sums = own.agg(F.sum("checked").alias("checked"), F.sum("failed").alias("failed")).collect()
    return {"checked": sums[0]["checked"], **{row["rule"]: row["failed"] for row in sums}}


def _silver_store(spark: SparkSession, store: str) -> DataFrame:
    checked = spark.read.schema(f"{SILVER_SCHEMA}, batch_id bigint, kept int, period date").parquet(f"{store}/checked")
    return checked.filter("kept = 1").drop("kept")


def read_silver(spark: SparkSession, store: str) -> DataFrame:
    return _silver_store(spark, store).drop("batch_id", "period")


def silver_of(spark: SparkSession, store: str, periods: Sequence[date]) -> DataFrame:
    """Silver rows of some periods: only their folders are read."""
    return _silver_store(spark, store).filter(F.col("period").isin(list(periods))).drop("batch_id")


def read_quarantine(spark: SparkSession, store: str) -> DataFrame:
    checked = spark.read.schema(f"rejected struct<{REJECTED}>, batch_id bigint, kept int, period date").parquet(f"{store}/checked")
    return checked.filter("kept = 0").select("rejected.*")


def _batches_to_refresh(spark: SparkSession, store: str) -> list[int]:
    """Batches that are in silver and not yet in gold, also those of a cycle that died in between."""
    if not files.exists(spark, f"{store}/rule_counts"):
        return []
    seen = {row.batch_id for row in rule_counts(spark, store).select("batch_id").distinct().collect()}
    if files.exists(spark, f"{store}/refreshed"):
        seen -= {row.batch_id for row in spark.read.schema("batch_id bigint").parquet(f"{store}/refreshed").collect()}
    return sorted(seen)


def _touched(spark: SparkSession, store: str, batches: list[int]) -> list[date]:
    """The periods whose gold rows the batches may change: those of their rows, and the others of sales they send again. These
    are found in the index of sales and periods, so silver itself is not read; sales only meet if there are other periods."""
    known = spark.read.schema("sale_id string, period date, batch_id bigint").parquet(f"{store}/sale_periods")
    fresh = known.filter(F.col("batch_id").isin(batches))
    own = [row.period for row in fresh.select("period").distinct().collect()]  # one value a period
    others = known.filter(~F.col("period").isin(own))
    if not own or others.isEmpty():
        return sorted(own)
    again = fresh.select(F.col("sale_id").alias("fresh_id"))
    met = others.join(again, F.col("sale_id").eqNullSafe(F.col("fresh_id")), "left_semi").select("period").distinct()
    return sorted(own + [row.period for row in met.collect()])


#: What the rows of a sale are compared by first; only rows that agree in these are compared whole.
FIRST = ("order_ts", "product_id")
#: A bitmap marks so many rows of a file in 4 KB, and the bitmaps of so many are sent to the tasks at once (16 MB).
MARKED, BITMAPS = 32768, 4096


def _placed(spark: SparkSession, store: str, periods: Sequence[date]) -> DataFrame:
    """Silver rows of some periods with their place: the hash of their file's path and their number in it."""
    checked = spark.read.schema(f"{SILVER_SCHEMA}, kept int, period date").parquet(f"{store}/checked")
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return checked.select("*", *place).filter((F.col("kept") == 1) & F.col("period").isin(list(periods))).drop("kept")


def _sifted(spark: SparkSession, store: str, periods: Sequence[date], by: str) -> DataFrame:
    """Which rows of some periods are the first of their sale: by file and block of rows a bitmap of those that are (won) and of
    those that share the first place (tied). What the rows are first compared by and where they lie is all that is shuffled.

    A sale with rows in several periods counts in the first of them. Such sales are noted with their periods, as the first may
    not be among those of a later refresh.
    """
    rows = _placed(spark, store, periods)
    if files.exists(spark, f"{store}/several_periods"):
        several = spark.read.schema("sale_id string, period date, upto bigint").parquet(f"{store}/several_periods")
        first = several.groupBy(F.col("sale_id").alias("several_id")).agg(F.min("period").alias("first"))
        rows = rows.join(first, F.col("sale_id").eqNullSafe(F.col("several_id")), "left")
        rows = rows.filter(F.col("first").isNull() | (F.col("first") >= F.col("period")) | F.col("first").isin(list(periods)))
    of_sale = Window.partitionBy("sale_id").orderBy(*FIRST)
    compared = rows.select("sale_id", *FIRST, "file", "row").withColumns(
        {"rank": F.rank().over(of_sale), "equal": F.count(F.lit(1)).over(of_sale), "first_ts": F.first("order_ts").over(of_sale)}
    )
    compared = compared.withColumns({"period": _period("order_ts", by), "first": _period("first_ts", by)})
    at, leads = F.expr(f"row % {MARKED}"), F.col("rank") == 1
    noted = F.array(F.struct("sale_id", "period"), F.struct("sale_id", F.col("first").alias("period")))
    marks = compared.groupBy("period", "file", F.expr(f"row div {MARKED}").alias("block")).agg(
        F.bitmap_construct_agg(F.when(leads & (F.col("equal") == 1), at)).alias("won"),
        F.bitmap_construct_agg(F.when(leads & (F.col("equal") > 1), at)).alias("tied"),
        F.flatten(F.collect_list(F.when(F.col("first") != F.col("period"), noted))).alias("several"),
    )
    return written(marks, "marks")


def _marked(rows: DataFrame, sifted: DataFrame, kind: str) -> DataFrame:
    """The rows that are marked. The bitmaps are sent to the rows, which stay where they lie."""
    marks = sifted.filter(f"bitmap_count({kind}) > 0").select("file", "block", F.col(kind).alias("marks"))
    byte = f"conv(hex(substring(marks, cast(row % {MARKED} div 8 AS int) + 1, 1)), 16, 10)"
    found = rows.withColumn("block", F.expr(f"row div {MARKED}")).join(F.broadcast(marks), ["file", "block"])
    return found.filter(f"getbit(cast({byte} AS bigint), cast(row % 8 AS int)) = 1").drop("block", "marks")


def _groups(sifted: DataFrame) -> list[list[date]]:
    """The periods in groups whose rows need no more than BITMAPS bitmaps of a kind; a period is not divided."""
    groups: list[list[date]] = []
    room = 0
    for row in sorted(sifted.groupBy("period").agg(F.count(F.lit(1)).alias("blocks")).collect()):  # one row a period
        if not groups or row.blocks > room:
            groups, room = [*groups, []], BITMAPS
        groups[-1].append(row.period)
        room -= row.blocks
    return groups


def _curated(spark: SparkSession, store: str, sifted: DataFrame, periods: Sequence[date]) -> DataFrame:
    """Curated sales of some periods with their period: rows that are the first of their sale are taken from where they lie, and
    only those that share the first place meet whole."""
    rows, marks = _placed(spark, store, periods), sifted.filter(F.col("period").isin(list(periods)))
    first, tied = gold.derived(_marked(rows, marks, "won")), gold.curated_from(_marked(rows, marks, "tied"))
    return first.unionByName(tied).select(*gold.SERVING_INPUTS, "period")


def _swap(spark: SparkSession, aside: str, path: str, periods: Sequence[date]) -> None:
    """Put the period folders written aside in place of a table's; a period that has lost its last sale goes."""
    fresh = set(files.folders(spark, aside))
    for name in (f"period={period}" for period in periods):
        files.remove(spark, f"{path}/{name}")
        if name in fresh:
            files.move(spark, f"{aside}/{name}", f"{path}/{name}")


def _replace(df: DataFrame, path: str, periods: Sequence[date], by: str) -> None:
    """Write df in place of what the table holds of some periods; the files of other periods are not touched."""
    rows = df.withColumn("period", _period("sales_date", by))
    writer = rows.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(path)
    # A period that has lost its last sale has no rows to overwrite it with.
    for period in set(periods) - {row.period for row in rows.select("period").distinct().collect()}:
        files.remove(df.sparkSession, f"{path}/period={period}")


def refresh(spark: SparkSession, store: str, by: str = PERIOD) -> list[date]:
    """Bring gold up to date with silver by working out only the periods that new batches touch; returns these.

    Reads the index of sales and periods and the touched periods' folders of silver. A refresh that dies is repeated by the
    next one, which finds its batches still open. Periods are replaced one table after the other.
    """
    batches = _batches_to_refresh(spark, store)
    if not batches:
        return []
    periods = _touched(spark, store, batches)
    if periods:
        aside = shared_dir(spark, "curated")
        sifted = _sifted(spark, store, periods, by)
        several = sifted.select(F.explode("several").alias("s")).select("s.*").distinct()
        several.write.mode("overwrite").parquet(f"{store}/several_periods/upto={batches[-1]}")
        for group in _groups(sifted):
            _curated(spark, store, sifted, group).write.mode("append").option("compression", "zstd").partitionBy("period").parquet(aside)
        curated = assert_no_pii(spark.read.parquet(aside).select(*gold.SERVING_INPUTS))
        assert_keyed(curated, gold.SERVING_KEYS["gold_sales_serving"])
        tables = {}
        for name, rolled in (("gold_region_daily", gold.region_daily), ("gold_national_daily", gold.national_daily)):
            tables[name] = written(rolled(curated), name)
            assert_keyed(tables[name], gold.SERVING_KEYS[name])
        _swap(spark, aside, f"{store}/gold_sales_serving", periods)
        for name, df in tables.items():
            _replace(df, f"{store}/{name}", periods, by)
    spark.createDataFrame([(b,) for b in batches], "batch_id bigint").write.mode("append").parquet(f"{store}/refreshed")
    return periods


GOLD = ("gold_region_daily", "gold_national_daily", "gold_sales_serving")


def read_gold(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A gold table of the cycle."""
    return spark.read.parquet(f"{store}/{name}").drop("period")


def run_cycle(spark: SparkSession, landing: str, store: str, by: str = PERIOD) -> dict[str, DataFrame]:
    """One micro-batch cycle: new raw files through the quality stream, then the touched periods of the gold tables."""
    run_quality(spark, landing, store, by=by)
    refresh(spark, store, by)
    return {name: read_gold(spark, store, name) for name in GOLD}
