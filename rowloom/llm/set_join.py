"""Texts of similar shingle sets: SimHash fingerprints compared in exact buckets, every pair checked.

A text is the set of its shingles' 64-bit hashes; texts of one set are one node from there on, with a 256-bit SimHash
fingerprint of the set.  Two sets of Jaccard similarity ``least`` or more share ``least`` of each set, so under any
common order of the shingles they share one of the first ``n - ceil(least * n) + 1`` of each.  Those prefixes are the buckets:

1. Shingles are ordered by the class of their count in a table of ``SLOTS`` slots, rare ones first, then
   by hash.  Slots are shared, so counts are too high for some; that costs time and never a pair.
2. Postings that meet no other node go; the others meet in buckets, one for each shingle.
3. First every node is compared with its ``NEAR`` neighbours by size in each bucket.  Bit-sliced comparison gives the pairs
   within the radius.  Those that also pass the bound on the parity bits of the sets (two sets differ in at least as many
   shingles as parity bits) are checked on the whole sets.
4. Then every pair of a bucket whose ends the checked links leave in different components is compared and
   checked, so nothing rests on unchecked links, and a large group of copies isn't compared pair by pair.

The radius leaves at least five standard deviations above the distance that sets of similarity ``least`` have on average, also
for sets of a few shingles, so a pair is missed with a probability below 1e-6.

A bucket of over ``BUCKET`` rows is cut into parts that are compared two by two.  The second round's cost is the
number of pairs of a bucket that lie in different components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bitslice import pairs_within, rows_within
from rowloom.llm.bloom import flag_repeated, presence_filter, row_key
from rowloom.llm.common import cut_lineage, free_shuffles, shuffle_width, tidy
from rowloom.llm.graph import components

#: Slots of the shingle counts, by the upper bits of the hash.
LOG2_SLOTS = 22
SLOTS = 1 << LOG2_SLOTS
_CHUNK = 16_384
#: Bits of a fingerprint, and parity bits of a set.
BITS, PARITY = 256, 512
#: Neighbours in a bucket that the first round compares, and rows of a bucket from which it is compared by itself.
NEAR, LARGE = 4, 48
#: Rows of a bucket that one group compares; larger buckets are cut.
BUCKET = 8192
#: Rows that are held for comparison, in whole groups.
_ROWS = 65_536
#: Against rounding, on the side of more pairs.
_EPS = 1e-9


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - LOG2_SLOTS)).astype(np.int64)


def radius(least: float, bits: int = BITS) -> int:
    """Distance that fingerprints of sets of similarity ``least`` stay within."""
    p = min(0.5, 1.3 * math.acos(2 * least / (1 + least)) / math.pi)
    return min(bits, math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p))))


def parity(shingles: np.ndarray) -> bytes:
    return np.packbits(np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def _set(text: str | None, shingle_hashes, k: int) -> np.ndarray:
    return np.unique(np.concatenate([*shingle_hashes(text, k), np.zeros(0, np.uint64)]))


def _node(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def shingle_sets(df: DataFrame, shingle_hashes, fingerprint, k: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """__id, __hash, node and name (of the set), size, bits and parity bits (odd) of every row, written out; and the count classes.

    The class of a slot is twice the logarithm of the number of shingles in it: 4 MB whatever the input.
    """

    def run(batches):
        count, id_type = np.zeros(SLOTS, np.uint32), None
        for b in batches:
            id_type = b.column("__id").type
            names, sizes, bits, odd = [], [], [], []
            for text in b.column("__text").to_pylist():
                s = _set(text, shingle_hashes, k)
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                bits.append(fingerprint(s, BITS))
                odd.append(parity(s))
                np.add.at(count, _slot(s), 1)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), b.column("__hash"), pa.array([_node(x) for x in names], pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(bits, pa.binary()), pa.array(odd, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=columns)
        if id_type is not None:
            chunks = [(c, x) for c, x in enumerate(count.reshape(-1, _CHUNK)) if x.any()]
            n = len(chunks)
            packed = [zstandard.compress(x.tobytes(), 1) for _, x in chunks]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())),
                 pa.array([c for c, _ in chunks], pa.int32()), pa.array(packed, pa.binary())], names=columns)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[c] = total.get(c, 0) + np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.int64)
        for c, x in total.items():
            made = (2 * np.log2(np.maximum(x, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["chunk", "n"])

    columns = ["__id", "__hash", "node", "name", "size", "bits", "odd", "chunk", "n"]
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(*row_key(id_col, text_col), F.col(text_col).alias("__text"))
    made = cut_lineage(rows.mapInArrow(tidy(run), f"__id {kind}, __hash long, node long, name binary, size int, bits binary, odd binary, chunk int, n binary"))
    summed = made.filter("chunk IS NOT NULL").select("chunk", "n").repartition(shuffle_width(df.sparkSession), "chunk").mapInArrow(tidy(add), "chunk int, n binary")
    classes = np.zeros((SLOTS // _CHUNK, _CHUNK), np.uint8)
    for r in summed.collect():
        classes[r["chunk"]] = np.frombuffer(r["n"], np.uint8)
    return made.filter("chunk IS NULL").select(*columns[:7]), classes.reshape(-1)


def _prefixes(classes, shingle_hashes, k: int, least: float):
    def run(batches):
        rare, done = classes.value, set()
        for b in batches:
            keys, nodes = [], []
            for text in b.column("__text").to_pylist():
                s = _set(text, shingle_hashes, k)
                node = _node(xxhash.xxh3_128_digest(s.tobytes()))
                if node in done:
                    continue
                done.add(node)
                length = len(s) - math.ceil(least * len(s) - _EPS) + 1 if len(s) else 0
                keys.append(s[np.argsort(rare[_slot(s)], kind="stable")[:length]])  # sets are sorted by hash
                nodes.append(np.full(len(keys[-1]), node))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def _met(batches):
    """Postings of keys with more than one node, from rows sorted by key and node."""
    last = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # a row that waits for the next one
    for b in batches:
        if not b.num_rows:
            continue
        key, node = np.r_[last[0], b.column("key").to_numpy()], np.r_[last[1], b.column("node").to_numpy()]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, joined = key[new], node[new], last[2]
        same = key[1:] == key[:-1]
        on = np.r_[joined, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][on[:-1]]), pa.array(node[:-1][on[:-1]])], names=["key", "node"])
        last = key[-1:], node[-1:], bool(on[-1])
    if last[2]:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "node"])


def postings(df: DataFrame, rows: DataFrame, classes: np.ndarray, shingle_hashes, k: int, least: float, text_col: str) -> DataFrame:
    """key, node, size, bits: prefix shingles that several nodes have; written out."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    made = df.select(F.col(text_col).alias("__text")).mapInArrow(tidy(_prefixes(shared, shingle_hashes, k, least)), "key long, node long")
    dealt = made.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "node")
    met = cut_lineage(dealt.mapInArrow(tidy(_met), "key long, node long"))
    free_shuffles(spark)
    return met


def _pairs(least: float, thin: bool):
    """Pairs (a, b) within the radius whose sizes and roots allow a link; with ``thin`` among neighbours only."""
    within, apart = radius(least), (1 - least) / (1 + least)

    def compare(group, node, root, size, bits, odd):
        def batch(a, b):
            on = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - _EPS)
            a, b = a[on], b[on]
            on = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64) <= (size[a] + size[b]) * apart + _EPS
            a, b = node[a[on]], node[b[on]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def by_offset(rows, most):
            """Groups side by side, each row with the rows after it."""
            g = group[rows]
            ends = np.searchsorted(g, g, side="right")
            for i, j, _ in pairs_within(bits[rows], np.minimum(ends - 1 - np.arange(len(g)), most), within):
                yield batch(rows[i], rows[j])

        if thin:
            yield from by_offset(np.lexsort((size, group)), NEAR)
            return
        many = np.bincount(group - group[0])[group - group[0]]
        yield from by_offset(np.flatnonzero(many < LARGE), LARGE)
        large = np.flatnonzero(many >= LARGE)
        for rows in np.split(large, np.flatnonzero(np.diff(group[large])) + 1) if len(large) else []:
            _, of, members = np.unique(root[rows], return_inverse=True, return_counts=True)
            rows = rows[np.lexsort((of, members[of]))]  # the largest component comes last and asks nothing of itself
            for i, j in rows_within(bits[rows], len(rows) - int(members.max()), within):
                yield batch(rows[i], rows[j])

    def run(batches):
        held: list = []
        count, before, number = 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(c).to_numpy() for c in ("key", "part", "other")], axis=1)
            number += before is not None and bool((ids[0] != before).any())
            group = number + np.r_[0, np.cumsum((ids[1:] != ids[:-1]).any(axis=1))]
            number, before = int(group[-1]), ids[-1]
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            odd = np.frombuffer(b"".join(b.column("odd").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            held.append((group, b.column("node").to_numpy(), b.column("root").to_numpy(), b.column("size").to_numpy().astype(np.int64), bits, odd))
            count += b.num_rows
            if count >= _ROWS:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(every[0], every[0][-1]))
                held, count = [[x[cut:] for x in every]], count - cut
                if cut:
                    yield from compare(*(x[:cut] for x in every))
        if held:
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def candidates(met: DataFrame, nodes: DataFrame, least: float, thin: bool, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of nodes that may reach ``least``; ``met`` has key, node and root, ``nodes`` size and bits."""
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(sizes.filter(F.col("n") > bucket).select("key", F.ceil(F.col("n") * 2 / bucket).alias("parts")))
    rows = met.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    zero = F.array(F.lit(0).cast("long"))
    every = F.when(F.col("parts").isNull(), zero).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("their", F.col("mine") if thin else F.explode(every)).select(
        "key", F.least("mine", "their").alias("part"), F.greatest("mine", "their").alias("other"), "node", "root")
    dealt = rows.join(nodes, "node").repartition(shuffle_width(met.sparkSession), "key", "part", "other").sortWithinPartitions("key", "part", "other")
    return dealt.mapInArrow(tidy(_pairs(least, thin)), "a long, b long").distinct()


def checked(found: DataFrame, df: DataFrame, rows: DataFrame, shingle_hashes, k: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs of ``found`` whose sets reach ``least``; written out."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [_set(t, shingle_hashes, k) for t in b.column("__text").to_pylist()]
                offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "set"])

    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    first = F.min(F.struct("__id", "__hash")).alias("first")
    wanted = rows.join(ends, "node").groupBy("node").agg(first).select("node", F.xxhash64("first.__id", "first.__hash").alias("__key"))
    wanted = cut_lineage(wanted)
    texts = df.select(*row_key(id_col, text_col), F.col(text_col).alias("__text")).select(F.xxhash64("__id", "__hash").alias("__key"), "__text")
    maybe = flag_repeated(texts, "__key", presence_filter(wanted, "__key", 26, 2), 26, 2, "__maybe").filter("__maybe").drop("__maybe")
    # Rows that repeat id and text are one; two keys of one hash would only be compared in vain.
    sets = cut_lineage(maybe.join(wanted, "__key").dropDuplicates(["node"]).select("node", "__text").mapInArrow(tidy(run), "node long, set array<long>"))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    met = F.size(F.array_intersect("x", "y"))
    joined = found.join(left, "a").join(right, "b")
    out = cut_lineage(joined.filter(met >= least * (F.size("x") + F.size("y") - met)).select("a", "b"))
    free_shuffles(df.sparkSession)
    return out


def similar_groups(df: DataFrame, shingle_hashes, fingerprint, k: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash and best (none, __id, __hash of the smallest id of the component) for every row."""
    rows, classes = shingle_sets(df, shingle_hashes, fingerprint, k, id_col, text_col)
    nodes = rows.select("node", "size", "bits", "odd").dropDuplicates(["node"])
    met = postings(df, rows, classes, shingle_hashes, k, least, text_col)
    check = lambda found: checked(found, df, rows, shingle_hashes, k, least, id_col, text_col)
    found = cut_lineage(candidates(met.withColumn("root", F.col("node")), nodes, least, True))
    links = check(found)
    roots = components(links)
    apart = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A bucket whose nodes are all joined has nothing left to compare.
    several = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    rest = candidates(apart.join(several, "key"), nodes, least, False).join(found, ["a", "b"], "left_anti")
    more = check(cut_lineage(rest))
    roots = components(links.unionByName(more))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")).alias("first")
    placed = rows.groupBy("node", "name").agg(first).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    return rows.select("__id", "__hash", "node").join(placed.join(best, "root").select("node", "best"), "node")
