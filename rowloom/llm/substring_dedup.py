"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; its value at the end of each word depends on the last 16
bytes only.  A chunk ends at a word whose (mixed) hash is the smallest among itself and its
``REACH`` neighbours on each side, so chunks have more than ``REACH`` words, twice as many on average,
and their borders inside a passage are the same wherever the passage stands: insertions before it do
not shift them.  Chunks are compared by a 128-bit digest.  Of equal chunks the first one stays, in the
order of document id and position; runs of repeated chunks of ``min_words`` words or more are removed
from the others.

Defined cases: a null text stays null; texts without words have no chunks; a text of few words is one
chunk; rows that repeat id and text are one document and are treated alike; null ids come last; an exact
copy of at least ``min_words`` words loses all its words; an empty table gives an empty result; other
columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.bloom import flag_repeated, presence_filter, row_key
from rowloom.llm.common import cut_lineage, table, tidy
from rowloom.llm.rewrite import rewrite

REACH, MIN_WORDS = 3, 15
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash over 16 bytes at each byte: the sum of gear[byte k back] << k."""
    h = _GEAR[data]
    for back in (1, 2, 4, 8):
        h[back:] += h[:-back] << np.uint32(back)  # numpy computes the right side first
    return h


def chunks(text: str | None, reach: int = REACH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes, and for each chunk its first byte, its end and its number of words."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    gap = np.r_[True, _SPACE[data], True]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    n = len(starts)
    if not n:
        return raw, starts, ends, starts
    v = gear_hashes(data)[ends - 1] * np.uint32(2654435761)
    least = np.ones(n, bool)
    for d in range(1, min(reach, n - 1) + 1):
        least[d:] &= v[d:] < v[:-d]
        least[:-d] &= v[:-d] <= v[d:]
    least[:reach] = least[max(0, n - reach) :] = False  # both sides must be inside the text
    last = np.r_[np.flatnonzero(least), n - 1]
    first = np.r_[0, last[:-1] + 1]
    return raw, starts[first], ends[last], last - first + 1


def chunk_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: document, number, bytes, words and digest (d1, d2)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, hashes, texts = b.column("__id"), b.column("__hash"), b.column("__text").to_pylist()
            for from_row in range(0, len(texts), 256):
                part = [chunks(t) for t in texts[from_row : from_row + 256]]
                counts = [len(p[1]) for p in part]
                digests = [xxhash.xxh3_128_digest(raw[s:e]) for raw, ss, ee, _ in part for s, e in zip(ss.tolist(), ee.tolist(), strict=True)]
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(np.arange(from_row, from_row + len(part)), counts))
                number = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                whole = [np.concatenate([p[k] for p in part]).astype(np.int32) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), pa.array(number), *map(pa.array, whole), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                    names=["__id", "__hash", "number", "start", "end", "words", "d1", "d2"])

    rows = df.select(*row_key(id_col, text_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(tidy(run), f"__id {kind}, __hash long, number int, start int, end int, words int, d1 long, d2 long")


def repeated_runs(df: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash and the byte spans (start, end) of the repeated runs of each document that has any."""
    rows = cut_lineage(chunk_table(df, id_col, text_col))
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash", "number")
    firsts = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    firsts = cut_lineage(firsts.filter("n > 1").select("d1", "d2", "first"))
    # Only chunks that may be repeated go on to the join.
    key = F.xxhash64("d1", "d2")
    bitmaps = presence_filter(firsts.select(key.alias("__key")), "__key", 26, 2)
    maybe = flag_repeated(rows.withColumn("__key", key), "__key", bitmaps, 26, 2, "__maybe").filter("__maybe")
    again = maybe.join(firsts, ["d1", "d2"]).filter(place != F.col("first"))
    again = again.select("__id", "__hash", "number", "start", "end", "words").dropDuplicates(["__id", "__hash", "number"])
    order = Window.partitionBy("__id", "__hash").orderBy("number")
    runs = again.withColumn("run", F.col("number") - F.row_number().over(order))
    spans = runs.groupBy("__id", "__hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"))
    long = spans.filter(F.col("words") >= min_words)
    return long.groupBy("__id", "__hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks"))


def _cut(text: str, spans: list) -> str:
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeated runs cut out of its texts, and ``removed_chars``."""
    spans = cut_lineage(repeated_runs(df, min_words, id_col, text_col))
    return rewrite(df, spans, _cut, id_col, text_col)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, removed_chars, has_repeat and the text that is left, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "removed_chars", (F.col("removed_chars") > 0).alias("has_repeat"), "text")
