"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned in id order, each partition adds up its bytes and rows, the running totals
of the partitions give every row its global byte offset, and the offsets are cut at equal targets.
Only slim rows move (id, size, checksum); one total per partition reaches the driver's plan.

Defined cases: a null text has no bytes and checksum 0; every row has one byte besides its text, so
empty texts are spread as well; null ids come first; repeated rows get slots of their own; an empty
table gives an empty result.  Equal texts are rows like any others: they may lie in different shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowloom.llm.common import cut_lineage, shuffle_width, table


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows of the partition before each row."""
    seen_bytes = seen_rows = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        ends = np.cumsum(sizes) + seen_bytes
        rows = np.arange(seen_rows, seen_rows + len(sizes), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends - sizes), pa.array(rows)], names=[*batch.schema.names, "__before", "__row"]
        )
        if len(sizes):
            seen_bytes, seen_rows = int(ends[-1]), seen_rows + len(sizes)


def shard_by_bytes(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of ``df``."""
    text = F.col(text_col)
    slim = df.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    order = ["__id", "text_crc32", "size"]
    ranged = slim.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, StructField("__before", LongType()), StructField("__row", LongType())])
    rows = cut_lineage(ranged.mapInArrow(_running, schema).withColumn("__part", F.spark_partition_id()))
    totals = rows.groupBy("__part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    # One row per partition of the range exchange: its number is set by the plan, not by the data.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(
        totals.select(
            "__part",
            F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("__b0"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"),
            F.sum("b").over(Window.partitionBy(F.lit(0))).alias("__all"),
        )
    )
    middle = F.col("__b0") + F.col("__before") + F.col("size") / 2
    placed = (
        rows.join(parts, "__part")
        .withColumn("__index", F.col("__n0") + F.col("__row"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.col("__all"))).cast("int"))
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("__index").alias("__first")))  # n_shards rows
    return placed.join(first, "shard").select(
        F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__index") - F.col("__first")).alias("slot")
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum is bit-serial over a 256-entry table made from the polynomial; the rest is windows.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || [0 FOR x IN range(8)],
             lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), k AS (
  SELECT doc_id, size,
    xor(list_reduce([4294967295] || [('0x' || substr(h, 2 * x - 1, 2))::BIGINT FOR x IN range(1, strlen(h) // 2 + 1)],
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, t
), w AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS rn
  FROM k
), s AS (
  SELECT *, least(15, floor((upto - size / 2.0) * 16 / total))::INTEGER AS shard FROM w
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       rn - min(rn) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
