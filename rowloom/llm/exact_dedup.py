"""Exact deduplication by two-pass Bloom filtering, with DataFrame operations only.

Two texts are equal when they agree after every run of ASCII white space is replaced by one space.
The first pass builds a filter of the digests that may occur twice; only rows that pass it are
shuffled, all others go straight to the output.  Grouping the suspects is exact, so a false positive
of the filter costs one shuffled row and never changes a result.

Defined cases: a null text counts as empty; empty texts are equal to each other; of equal texts the
row with the smallest id stays, a null id losing to any other; of rows that share that id as well one
stays.  An empty table gives an empty result.  All other columns pass through untouched, whatever
their names, since working columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bloom import flag_repeated, repeated_filter
from rowloom.llm.common import SPACE, cut_lineage, table

#: The filter has 16 slots or more a row, so a row without a copy is suspected in some 1 % of the cases, up to
#: 2 ** 30 slots: 128 MB, the bound on what is broadcast.  Beyond 67 million rows the share of suspects grows.
SLOTS_A_ROW, MOST_LOG2_SLOTS, HASHES = 16, 30, 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lowercase hex."""
    return F.sha2(normalised(text), 256)


def filter_size(rows: int) -> int:
    """Base-2 logarithm of the filter's slots for a counted number of rows."""
    return min(MOST_LOG2_SLOTS, max(16, (SLOTS_A_ROW * rows - 1).bit_length()))


def _split(keyed: DataFrame, log2_slots: int | None, hashes: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone for certain, and rows that may have a copy, of rows with ``__sha``.

    The filter is written once, so both parts use it without making it again.
    """
    size = log2_slots if log2_slots is not None else filter_size(keyed.count())
    bitmaps = cut_lineage(repeated_filter(keyed.select("__sha"), "__sha", size, hashes))
    flagged = flag_repeated(keyed, "__sha", bitmaps, size, hashes, "__maybe")
    return flagged.filter(~F.col("__maybe")).drop("__maybe"), flagged.filter("__maybe").drop("__maybe")


def mark_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_slots: int | None = None, hashes: int = HASHES
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    The texts are read once: ids and digests are written, and all later passes work on those.
    Copies are pre-aggregated by (digest, id) before digests meet, so a digest that a third of all
    rows share arrives as partial counts.
    """
    slim = cut_lineage(df.select(F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("__sha")))
    alone, maybe = _split(slim, log2_slots, hashes)
    # Both sides of the join are tables, so adaptive execution can split the rows of a hot digest.
    rows = cut_lineage(maybe.groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("__n")))
    groups = cut_lineage(rows.groupBy("__sha").agg(F.min("__id").alias("__keep"), F.sum("__n").alias("__size")))
    joined = rows.join(groups, "__sha").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    out = lambda d, keep, size, kept: d.select(
        F.col("__id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"),
        kept.alias("kept"), F.col("__sha").alias("text_sha256"),
    )
    return out(alone, F.col("__id"), F.lit(1), F.lit(True)).unionByName(
        out(joined, F.col("__keep"), F.col("__size"), F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1))
    )


def drop_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_slots: int | None = None, hashes: int = HASHES
) -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``."""
    alone, maybe = _split(df.withColumn("__sha", digest(F.col(text_col))), log2_slots, hashes)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(F.col(text_col)))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = maybe.groupBy("__sha").agg(F.min_by(row, order).alias("__row"))
    return alone.select(*[f"`{c}`" for c in df.columns]).unionByName(kept.select("__row.*"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1
)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
       text_sha256
FROM n JOIN g USING (text_sha256)
"""
