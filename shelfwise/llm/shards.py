"""Sharding by sampled splitters, in DataFrame operations only.

Records are put in the order of their key (doc_id, then the text's checksum and size, then a row number fixed by a written
table). A sample of keys, weighted by size, gives quantile boundaries; records are range-partitioned by them, ranges that
turn out overfull get further boundaries from a second sample, and exact sums of the ranges say where each begins. A record
goes to the shard in whose equal share of all bytes its middle byte lies, so shards differ by less than the largest record
on either side, whatever the sample was: the sample only decides how evenly the work is dealt.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.common import crc_of, stored

KEY = ("doc_id", "text_crc32", "size", "row")
KEY_TYPE = "struct<doc_id:bigint,text_crc32:bigint,size:bigint,row:bigint>"
#: Ranges aimed at, and sampled keys for each of them.
RANGES, PER_RANGE = 1024, 32
#: A range of more than this many times the mean rows or bytes is subdivided.
OVERFULL = 2.0
SEED = 77


def _uniform(seed: int) -> Column:
    """A number from 0 to 1 that depends on the row alone."""
    return F.shiftrightunsigned(F.xxhash64("row", F.lit(seed)), 11) / float(1 << 53)


def _range_of(bounds: list) -> Column:
    """How many of the sorted boundaries are at or below the key: a binary search."""
    if not bounds:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps(bounds)), f"array<{KEY_TYPE}>")
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    key = F.struct(*KEY)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) <= key), at + step).otherwise(at),
    )


def _every(sample: DataFrame, n: int) -> list:
    """Every n-th key of a bounded sample, within each range."""
    order = Window.partitionBy("range").orderBy(*KEY)
    rows = sample.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") % n == 0).select(*KEY).collect()
    return [row.asDict() for row in rows]


def _sorted(bounds: list) -> list:
    first = lambda b: [(v is not None, v or 0) for v in (b[k] for k in KEY)]  # noqa: E731  nulls first, as Spark orders
    return sorted(bounds, key=first)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, row) of every record, written once so that row stays what it is."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return stored(
        docs.select(
            F.col("doc_id").cast("long"), size.alias("size"), crc_of("text").alias("text_crc32"), F.monotonically_increasing_id().alias("row")
        ),
        "sizes",
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs (doc_id, text): shards 0 to shards - 1 of nearly equal bytes.

    size: UTF-8 bytes of the text (null: none) plus 16. slot: place within the shard, gapless from 0, in the order of the
    key; a null doc_id comes first. Repeated rows each take a slot. A record larger than a shard's share leaves its
    neighbours emptier. Other columns are not read; an empty table gives an empty result.
    """
    rows = sizes(docs)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    wanted = ranges * PER_RANGE
    weight = F.col("size") / (2.0 * total) + 1 / (2.0 * count)
    bounds = _sorted(_every(rows.where(_uniform(SEED) < weight * wanted).withColumn("range", F.lit(0)), PER_RANGE))
    full = rows.withColumn("range", _range_of(bounds)).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    times = F.greatest(F.col("n") * ranges / count, F.col("bytes") * ranges / total)
    over = full.where((times > OVERFULL) & (F.col("n") > 1)).select("range", (times * PER_RANGE / F.col("n")).alias("rate"))
    more = rows.withColumn("range", _range_of(bounds)).join(F.broadcast(over), "range").where(_uniform(SEED + 1) < F.col("rate"))
    bounds = _sorted(bounds + _every(more, PER_RANGE))

    dealt = rows.withColumn("range", _range_of(bounds))
    sums = dealt.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select(
        "range",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
    )
    order = Window.partitionBy("range").orderBy(*KEY)
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        dealt.withColumn("__end", running)
        .withColumn("__rank", F.row_number().over(order))
        .join(F.broadcast(starts), "range")
        .withColumn("place", F.col("rows_before") + F.col("__rank") - 1)
        .withColumn("shard", F.expr(f"CAST((2 * (bytes_before + __end) - size) * {shards} DIV (2 * {total}) AS INT)"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    placed = stored(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The records as Parquet files below path/shard=N, in the order of slot within a shard.

    Columns of docs named shard or slot are replaced. Every row is written once, repeated rows and null doc_ids too; copies of
    a row are interchangeable, so they are numbered and meet their places by number. An empty table writes no shard.
    """
    key = ("doc_id", "text_crc32", "size")
    copies = Window.partitionBy(*key).orderBy("shard", "slot")
    placed = shard_by_bytes(docs, shards)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(
        F.struct(*(c for c in docs.columns if c not in ("shard", "slot"))).alias("__row"),
        F.col("doc_id").cast("long").alias("doc_id"), crc_of("text").alias("text_crc32"), size.alias("size"),
    )
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("__row"))))
    placed = placed.withColumn("__copy", F.row_number().over(copies))
    same = F.lit(True)
    for c in (*key, "__copy"):
        same &= F.col("r." + c).eqNullSafe(F.col("p." + c))
    joined = rows.alias("r").join(placed.alias("p"), same).select("__row.*", "shard", "slot")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: The same in DuckDB: checksums byte by byte, then running sums in the order of the key. Repeated rows are interchangeable.
ORACLE = """
WITH crc_table AS (
    SELECT list(list_reduce(list_concat([i], range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM (SELECT unnest(range(256)) AS i)
), cut AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
    FROM documents
), sized AS (
    SELECT doc_id, CAST(size AS BIGINT) AS size,
        xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes),
            lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
    FROM cut, crc_table
), placed AS (
    SELECT *, sum(size) OVER key AS ending, row_number() OVER key AS place, sum(size) OVER () AS total
    FROM sized
    WINDOW key AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), sharded AS (
    SELECT *, CAST((2 * ending - size) * 40 // (2 * total) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""
