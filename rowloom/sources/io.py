"""Files: writing, pruned reads, stacking with upcast and gap fill, sections, information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rowloom.functions.types import common_type


def save(df: DataFrame, path: str, compression: str = "zstd", section: str | None = None, append: bool = False, partition_by: tuple = ()) -> None:
    """Write Parquet; a section is a partition value, so appended sections can be read apart."""
    if section is not None:
        df, partition_by = df.withColumn("section", F.lit(section)), ("section", *partition_by)
    df.write.mode("append" if append else "overwrite").option("compression", compression).partitionBy(*partition_by).parquet(path)


def info(spark: SparkSession, path: str) -> DataFrame:
    """Column names and types of a file, from its footer alone."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.read.parquet(path).schema.fields]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")


def load(
    spark: SparkSession, path: str, include: list[str] | None = None, where: Column | None = None, sections: list[str] | None = None, folders: list[str] | None = None
) -> DataFrame:
    """Read some columns and rows; both reach the scan.

    A column named ``folder/name`` lies in that folder; with ``folders`` only the columns of these are read, and with
    ``include`` too only those that both name.
    """
    df = spark.read.parquet(path)
    if sections is not None:
        df = df.filter(F.col("section").isin(sections))
    if where is not None:
        df = df.filter(where)
    if folders is not None:
        include = [c for c in include or df.columns if c.startswith(tuple(f.rstrip("/") + "/" for f in folders))]
        return df.select(*[F.col(f"`{c}`") for c in include])
    return df.select(*include) if include else df


def stack(frames: list[DataFrame], source: str | None = None) -> DataFrame:
    """One below the other: common types, NULL where a frame lacks a column; ``source`` numbers the frames."""
    kinds: dict[str, list] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    types = {name: common_type(found) for name, found in kinds.items()}
    out = None
    for i, df in enumerate(frames):
        made = df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()])
        made = made.withColumn(source, F.lit(i)) if source else made
        out = made if out is None else out.unionByName(made)
    return out


def stackable(frames: list[DataFrame]) -> bool:
    """Whether all shared columns have a common type other than text forced onto numbers."""
    for name in {c for df in frames for c in df.columns}:
        kinds = [df.schema[name].dataType for df in frames if name in df.columns]
        if any(isinstance(k, StringType) for k in kinds) and not all(isinstance(k, StringType) for k in kinds):
            return False
        try:
            common_type(kinds)
        except TypeError:
            return False
    return True


def load_many(spark: SparkSession, paths: list[str], **how) -> list[DataFrame]:
    return [load(spark, p, **how) for p in paths]


def stack_or_many(spark: SparkSession, paths: list[str], **how) -> DataFrame | list[DataFrame]:
    frames = load_many(spark, paths, **how)
    return stack(frames) if stackable(frames) else frames


def concatenate(spark: SparkSession, paths: list[str], output: str) -> None:
    """Many files into one with a section for each."""
    frames = [spark.read.parquet(p).withColumn("section", F.lit(str(i))) for i, p in enumerate(paths)]
    stack(frames).write.mode("overwrite").partitionBy("section").parquet(output)


def unpack_records(df: DataFrame, record: str) -> DataFrame:
    """A struct column to columns."""
    return df.select(f"{record}.*")


def compress(x: Column, level: int = 3) -> Column:
    """zstd of a binary value; Spark has no function for it."""

    @F.pandas_udf("binary")
    def run(values):
        import pandas as pd
        import zstandard

        made = zstandard.ZstdCompressor(level=level)
        return pd.Series([None if v is None else made.compress(bytes(v)) for v in values])

    return run(x)


def decompress(x: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values):
        import pandas as pd
        import zstandard

        made = zstandard.ZstdDecompressor()
        return pd.Series([None if v is None else made.decompress(bytes(v)) for v in values])

    return run(x)
