"""Balanced contiguous shards from global byte prefix sums (DataFrame functions only).

The rows are laid out in the order of doc_id over range partitions. Each
partition's total is one row of a small table; a running sum over those totals
gives every partition its global start, and a running sum inside the partition
gives every row its own. The line of all bytes is then cut at equal targets, so
shards are contiguous in doc_id and their sizes differ from the target by less
than the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

ROW_OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each of docs.

    A null text has no bytes (size is the overhead alone, text_crc32 is 0). Rows
    with equal doc_id lie next to each other; if their texts are equal too they
    are interchangeable. No rows give no rows. Only 24 bytes a row are moved, the
    texts stay where they are.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # The partition number is an input of the sums, so it is pinned by a checkpoint.
    laid = durable(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.partitionBy()
    # One row for each partition, never more than n.
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
        F.sum("bytes").over(all_parts).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        laid.join(F.broadcast(starts), "part")
        .withColumn("start", F.col("byte0") + F.sum("size").over(upto) - F.col("size"))
        .withColumn("place", F.col("row0") + F.row_number().over(inside) - 1)
        # A row belongs to the target its middle byte falls into.
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (2 * start + size) * {n_shards} div (2 * total)) as int)"))
        .select(*order, "place", "shard")
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


#: The check sum is folded over the bytes with the usual table of 256 entries, built from its rule.
OP3_SQL = """
WITH RECURSIVE rule(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM rule WHERE k < 8
),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM rule WHERE k = 8),
rows0 AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
),
sums AS (
  SELECT doc_id, size,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(strlen(h) // 2), lambda k:
        (16 * (position(h[2 * k + 1] IN '0123456789ABCDEF') - 1) + position(h[2 * k + 2] IN '0123456789ABCDEF') - 1)::BIGINT)),
      lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1]))) AS text_crc32
  FROM rows0, tab
),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place, sum(size) OVER () AS total
  FROM sums
),
cut AS (SELECT *, least(23, (2 * start + size) * 24 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
