"""A two-bit Bloom filter made of DataFrame operations only.

Each key sets ``hashes`` slots out of ``2 ** log2_slots``.  The first pass counts the keys of every
slot, with map-side combining, and keeps the slots that at least two keys set.  Those slots are packed
into bitmaps of 32,768 bits, so the filter has at most ``2 ** log2_slots / 8`` bytes whatever the
input: that bound is what allows the broadcast.  The second pass tests the rows.  A key that occurs
twice always passes; a key that occurs once passes only by collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one bitmap of Spark's bitmap functions.
_CHUNK = 32_768


def _slot(key: Column, i: int, log2_slots: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << log2_slots).cast("long"))


def repeated_filter(keys: DataFrame, key: str, log2_slots: int, hashes: int) -> DataFrame:
    """First pass: (chunk, bits) rows over the slots that two or more rows of ``keys`` set."""
    slots = keys.select(F.explode(F.array(*[_slot(F.col(key), i, log2_slots) for i in range(hashes)])).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.floor(F.col("slot") / _CHUNK).alias("chunk")).agg(
        F.expr(f"bitmap_construct_agg(slot % {_CHUNK})").alias("bits")
    )


def flag_repeated(df: DataFrame, key: str, bitmaps: DataFrame, log2_slots: int, hashes: int, flag: str) -> DataFrame:
    """Second pass: add ``flag``, true where all slots of the row's key are in the filter."""
    passed = F.lit(True)
    for i in range(hashes):
        chunk, bits, slot = f"__chunk{i}", f"__bits{i}", f"__slot{i}"
        side = F.broadcast(bitmaps.select(F.col("chunk").alias(chunk), F.col("bits").alias(bits)))
        df = df.withColumn(slot, _slot(F.col(key), i, log2_slots))
        df = df.join(side, F.floor(F.col(slot) / _CHUNK) == F.col(chunk), "left")
        at = F.col(slot) % _CHUNK
        byte = F.expr(f"cast(conv(hex(substring({bits}, cast({slot} % {_CHUNK} div 8 as int) + 1, 1)), 16, 10) as int)")
        hit = F.when(F.col(bits).isNull(), False).otherwise(
            F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
        )
        passed = passed & hit
    return df.withColumn(flag, passed).drop(*[f"__{n}{i}" for i in range(hashes) for n in ("chunk", "bits", "slot")])


def presence_filter(keys: DataFrame, key: str, log2_slots: int, hashes: int) -> DataFrame:
    """(chunk, bits) rows over the slots that any row of ``keys`` sets; same size bound as above."""
    slots = keys.select(F.explode(F.array(*[_slot(F.col(key), i, log2_slots) for i in range(hashes)])).alias("slot"))
    return slots.groupBy(F.floor(F.col("slot") / _CHUNK).alias("chunk")).agg(
        F.expr(f"bitmap_construct_agg(slot % {_CHUNK})").alias("bits")
    )


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart where ids may repeat: the id and a hash of the text."""
    return [F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash")]


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, log2_slots: int = 26, hashes: int = 2) -> DataFrame:
    """``df`` without the rows whose (id, text hash) is in ``gone`` (columns ``__id``, ``__hash``).

    Rows outside the filter of ``gone`` pass straight through; only the others are shuffled to the
    anti join, so the texts that stay are mostly not moved.
    """
    both = lambda d: d.withColumn("__key", F.xxhash64("__id", "__hash"))
    bitmaps = presence_filter(both(gone).select("__key"), "__key", log2_slots, hashes)
    keyed = both(df.select("*", *row_key(id_col, text_col)))
    flagged = flag_repeated(keyed, "__key", bitmaps, log2_slots, hashes, "__maybe")
    there = gone.select(F.col("__id").alias("__gid"), F.col("__hash").alias("__ghash"))
    maybe = flagged.filter("__maybe").join(
        there, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__hash") == F.col("__ghash")), "left_anti"
    )
    columns = [f"`{c}`" for c in df.columns]
    return flagged.filter(~F.col("__maybe")).select(*columns).unionByName(maybe.select(*columns))
