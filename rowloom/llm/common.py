"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``; a folder of our own is set
    only where none is named, as in tests.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rowloom-checkpoint-"))
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of written-out steps removed: Spark removes them when the JVM collects their owners."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty string.

    ``lower`` does the same on texts without other letters and is much faster there.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: How to forget the tables that an operator keeps in a worker from task to task, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_between_tasks(owner: str, forget: Callable[[], None]) -> None:
    _KEPT[owner] = forget


def forget_others(owner: str) -> None:
    """A worker that turns to another operator gives up what the last one kept."""
    others = [n for n in _KEPT if n != owner]
    for name in others:
        _KEPT.pop(name)()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def tidy(run, owner: str = ""):
    """A function for ``mapInArrow`` that gives its memory back at the end: workers live on idle.

    ``owner`` names the operator whose kept tables the task needs; those of others go when it starts.
    """

    @functools.wraps(run)
    def wrapped(batches):
        forget_others(owner)
        yield from run(batches)
        give_back()

    return wrapped
