"""Give the rows of a table that have marks a new text, and pass the others straight through."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowloom.llm.bloom import flag_repeated, presence_filter, row_key
from rowloom.llm.common import tidy


def rewrite(df: DataFrame, marks: DataFrame, change, id_col: str, text_col: str, log2_slots: int = 26, hashes: int = 2) -> DataFrame:
    """``df`` with changed texts and the column ``removed_chars``.

    A column of ``df`` with that name is replaced.  ``marks`` has one row (``__id``, ``__hash``, ``marks`` an array) for each document to change;
    ``change(text, marks)`` gives its new text.  Only rows that pass a Bloom filter of the marks are
    shuffled.
    """
    df = df.drop("removed_chars")
    key = F.xxhash64("__id", "__hash")
    bitmaps = presence_filter(marks.select(key.alias("__key")), "__key", log2_slots, hashes)
    keyed = df.select("*", *row_key(id_col, text_col)).withColumn("__key", key)
    flagged = flag_repeated(keyed, "__key", bitmaps, log2_slots, hashes, "__maybe")
    there = marks.select(F.col("__id").alias("__gid"), F.col("__hash").alias("__ghash"), F.col("marks").alias("__marks"))
    met = F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__hash") == F.col("__ghash"))
    columns = [f"`{c}`" for c in df.columns]
    plain = flagged.filter(~F.col("__maybe")).select(*columns, F.lit(0).cast("long").alias("removed_chars"))
    maybe = flagged.filter("__maybe").join(there, met, "left").select(*columns, "__marks")
    names, at = [*df.columns, "removed_chars"], df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts, marked = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [change(t, m) if m else t for t, m in zip(texts, marked, strict=True)]
            lost = [len(t or "") - len(n or "") for t, n in zip(texts, new, strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.int64())], names=names)

    schema = StructType([*df.schema.fields, StructField("removed_chars", LongType())])
    return plain.unionByName(maybe.mapInArrow(tidy(run), schema))
