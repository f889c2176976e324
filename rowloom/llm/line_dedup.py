"""Line deduplication by pairwise alignment.

Two documents overlap where they share a run of lines of at least ``MIN_CHARS`` characters.  The shortest such runs that start
or end at each line are a document's keys, rarer than its lines; any longer shared run is made up of shared keys.  The
first holder of a key is the document with the smallest id that has it, and each later document is paired with the first
holders of its keys.  That covers every shared run however common it is, with at most as many pairs as keys.

The full line lists of a pair are aligned by patience diff: lines that are unique in both documents, the longest sequence
of them that increases in both, extended to equal neighbours, and the same again between them.  Aligned blocks of
``MIN_CHARS`` characters or more are deleted from the later document; what is left of it is aligned again, so
blocks in another order are found too, until nothing is.  Shared keys that lie on repeated lines alone, where there is nothing
unique to start from, are deleted as well.  So a line goes exactly if it lies in a run of at least ``MIN_CHARS`` characters
that some earlier document has too.

Lines are compared by a 64-bit hash of their text without surrounding white space; blank lines count for
nothing and don't interrupt a run.

Defined cases: null and blank texts share nothing; rows that repeat id and text are one document; null
ids come last; a line that repeats inside one document only stays; an exact copy loses all its lines
if they make up ``MIN_CHARS``; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bloom import flag_repeated, presence_filter, row_key
from rowloom.llm.common import cut_lineage, table, tidy
from rowloom.llm.rewrite import rewrite

MIN_CHARS = 40


def _lines(text: str | None) -> list[str]:
    return [x for x in map(str.strip, (text or "").split("\n")) if x]


def windows(size: np.ndarray, min_chars: int) -> np.ndarray:
    """(first, last) of the shortest runs of ``min_chars`` that start or end at each line."""
    upto, n = np.r_[0, np.cumsum(size)], np.arange(len(size))
    last = np.searchsorted(upto, upto[:-1] + min_chars) - 1
    first = np.searchsorted(upto, upto[1:] - min_chars, side="right") - 1
    found = np.r_[np.c_[n, last][last < len(size)], np.c_[first, n][first >= 0]]
    return np.unique(found, axis=0)


def keys(line: np.ndarray, size: np.ndarray, min_chars: int) -> dict[tuple[int, int], int]:
    """The hash of each window's lines."""
    raw = line.tobytes()
    return {(a, z): xxhash.xxh64_intdigest(raw[8 * a : 8 * z + 8]) for a, z in windows(size, min_chars).tolist()}


def line_table(df: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash, and the hashes (line) and lengths (size) of the lines and the keys of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = []
            for text in b.column("__text").to_pylist():
                lines = _lines(text)
                line = np.array([xxhash.xxh64_intdigest(x.encode()) for x in lines], np.uint64)
                size = np.array([len(x) for x in lines], np.int32)
                found = np.array(sorted(set(keys(line, size, min_chars).values())), np.uint64)
                made.append((line.view(np.int64), size, found.view(np.int64)))

            def lists(i, kind):
                ends = np.r_[0, np.cumsum([len(m[i]) for m in made])].astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *(m[i] for m in made)])))

            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), b.column("__hash"), lists(0, np.int64), lists(1, np.int32), lists(2, np.int64)], names=["__id", "__hash", "line", "size", "keys"])

    rows = df.select(*row_key(id_col, text_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(tidy(run), f"__id {kind}, __hash long, line array<long>, size array<int>, keys array<long>")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of pairs, given by their first, that increases in the second as well."""
    tails: list[int] = []
    best: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back[i] = best[k - 1] if k else -1
        tails[k : k + 1], best[k : k + 1] = [y], [i]
    chain, i = [], best[-1] if best else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (later, earlier) positions of equal lines; None in ``a`` equals nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a, seen_b = {}, {}
        for seen, lines, lo, hi in ((seen_a, a, a0, a1), (seen_b, b, b0, b1)):
            for i in range(lo, hi):
                seen[lines[i]] = -1 if lines[i] in seen else i
        anchors = [(i, seen_b[x]) for x, i in seen_a.items() if i >= 0 and x is not None and seen_b.get(x, -1) >= 0]
        chain = _increasing(sorted(anchors))
        if not chain:
            continue
        x, y = a0, b0
        for i, j in [*chain, (a1, b1)]:
            if i < a1:
                out.append((i, j))
            todo.append((x, i, y, j))  # grows into equal neighbours from both ends
            x, y = i + 1, j + 1
    return sorted(out)


def common_blocks(later: np.ndarray, size: np.ndarray, earlier: np.ndarray, earlier_size: np.ndarray, min_chars: int) -> set[int]:
    """Lines of ``later`` in runs of at least ``min_chars`` characters that ``earlier`` has too."""
    rest, other, gone = later.tolist(), earlier.tolist(), set()
    while True:
        found, block, before = set(), [], None
        for x, y in [*patience(rest, other), (-2, -2)]:
            if before != (x - 1, y - 1):
                if sum(size[i] for i in block) >= min_chars:
                    found.update(block)
                block = []
            block.append(x)
            before = x, y
        if not found:
            break
        gone |= found
        for x in found:
            rest[x] = None
    shared = set(keys(earlier, earlier_size, min_chars).values())
    for (a, z), key in keys(later, size, min_chars).items():
        if key in shared:
            gone.update(range(a, z + 1))
    return gone


def _align(min_chars: int):
    def run(batches):
        for b in batches:
            columns = [[np.asarray(x) for x in b.column(c).to_pylist()] for c in ("line", "size", "e_line", "e_size")]
            gone = [sorted(common_blocks(line.astype(np.int64), size, e_line.astype(np.int64), e_size, min_chars)) for line, size, e_line, e_size in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__hash"), pa.array(gone, pa.list_(pa.int32()))], names=["__id", "__hash", "gone"])

    return run


def common_lines(df: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash and the numbers of the lines to delete (``marks``, blank ones not counted) of each document that has any."""
    rows = cut_lineage(line_table(df, min_chars, id_col, text_col))
    doc = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    held = rows.select(doc.alias("doc"), F.explode("keys").alias("key"))
    firsts = held.groupBy("key").agg(F.min("doc").alias("holder"), F.max("doc").alias("last"))
    firsts = cut_lineage(firsts.filter("holder != last").select("key", "holder"))
    maybe = flag_repeated(held, "key", presence_filter(firsts, "key", 26, 2), 26, 2, "__maybe").filter("__maybe").drop("__maybe")
    number = lambda c: F.xxhash64(f"{c}.__id", f"{c}.__hash")
    met = maybe.join(firsts, "key").filter(F.col("doc") > F.col("holder"))
    pairs = cut_lineage(met.select(number("doc").alias("d"), number("holder").alias("e")).distinct())
    # The line lists of documents in pairs, one for rows that repeat id and text.
    ends = pairs.select(F.col("d").alias("n")).unionByName(pairs.select(F.col("e").alias("n"))).distinct()
    lists = rows.select("__id", "__hash", "line", "size", F.xxhash64("__id", "__hash").alias("n"))
    lists = cut_lineage(lists.join(ends, "n", "left_semi").dropDuplicates(["n"]))
    later, earlier = lists.withColumnRenamed("n", "d"), lists.select(F.col("n").alias("e"), F.col("line").alias("e_line"), F.col("size").alias("e_size"))
    both = pairs.join(later, "d").join(earlier, "e").select("__id", "__hash", "line", "size", "e_line", "e_size")
    kind = df.schema[id_col].dataType.simpleString()
    gone = both.mapInArrow(tidy(_align(min_chars)), f"__id {kind}, __hash long, gone array<int>")
    lines = gone.select("__id", "__hash", F.explode("gone").alias("x"))
    return lines.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("x")).alias("marks"))


def _delete(text: str, lines: list) -> str:
    gone, kept, n = set(lines), [], 0
    for x in text.split("\n"):
        blank = not x.strip()
        if blank or n not in gone:
            kept.append(x)
        n += not blank
    return "\n".join(kept)


def remove_common_lines(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the aligned common blocks of later documents, and ``removed_chars``."""
    marks = cut_lineage(common_lines(df, min_chars, id_col, text_col))
    return rewrite(df, marks, _delete, id_col, text_col)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, removed_chars and the text that is left, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_common_lines(docs).select("doc_id", "removed_chars", "text")
