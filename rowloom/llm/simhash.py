"""Near-duplicate detection by SimHash, compared in bit-sliced blocks.

``drop_near_duplicates`` compares fingerprints of shingle sets in the same way and then checks pairs exactly, see
:mod:`rowloom.llm.set_join`.

Every text gets a fingerprint: bit b is 1 if over half of its shingle hashes have bit b set.  Equal
fingerprints are merged first, so a group of copies is one row from there on.  Rows then meet in
buckets under several keys made of fingerprint bits, which are exact: the bits are cut into ``radius + 2``
blocks and every choice of two blocks is a key; fingerprints at most ``radius`` bits apart agree on two
blocks at least.

Buckets are compared by :func:`rowloom.llm.bitslice.pairs_within` and give a minimum spanning forest
of their links, never all pairs.  A bucket of over ``BUCKET`` rows is cut into parts, and each two of
them are compared in a group of their own, so no task takes a whole hot bucket.  Components come from
:func:`rowloom.llm.graph.components`.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; rows with a null id get a component and
never name it unless all its ids are null; rows that repeat id and text are one document; an empty table
gives an empty result; other columns pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bitslice import forest, pairs_within
from rowloom.llm.bloom import row_key, without_rows
from rowloom.llm.common import cut_lineage, shuffle_width, table, tidy
from rowloom.llm.graph import components
from rowloom.llm.set_join import similar_groups

#: Rows of a bucket that one group compares; larger buckets are cut.
BUCKET = 8192
#: Rows that are compared at once, in whole groups.
_CHUNK = 65_536
#: Shingles whose bits are counted at once.
_BLOCK = 32_768


def _shingles(text: bytes, k: int) -> Iterator[bytes]:
    w = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if len(w) < k:
        return iter([b" ".join(w)] if w else [])
    return map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of the shingles, in blocks."""
    digest, made = xxhash.xxh64_intdigest, _shingles((text or "").encode(), k)
    while block := [digest(s, 42) for s in itertools.islice(made, _BLOCK)]:
        yield np.array(block, np.uint64)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64-bit hash of a shingle: the hash itself, then rounds of a 64-bit finaliser."""
    if not j:
        return h
    h = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, k: int, bits: int) -> bytes:
    """The fingerprint in little-endian bytes."""
    ones, n = np.zeros(bits, np.int64), 0
    for h in shingle_hashes(text, k):
        words = np.stack([_mixed(h, j) for j in range(bits // 64)], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def set_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of a set of shingles, each counted once."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        words = np.stack([_mixed(hashes[at : at + _BLOCK], j) for j in range(bits // 64)], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprints(df: DataFrame, k: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash (of the text), fp and low (the lowest 64 bits of fp, signed) of every row; written out, since much is made of it."""

    def run(batches):
        for b in batches:
            made = [fingerprint(t, k, bits) for t in b.column("__text").to_pylist()]
            low = pa.array([int.from_bytes(fp[:8], "little", signed=True) for fp in made], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), b.column("__hash"), pa.array(made, pa.binary()), low], names=["__id", "__hash", "fp", "low"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(*row_key(id_col, text_col), F.col(text_col).alias("__text"))
    return cut_lineage(rows.mapInArrow(tidy(run), f"__id {kind}, __hash long, fp binary, low long"))


def pigeonhole_keys(bits: int, radius: int) -> list[np.ndarray]:
    blocks = np.array_split(np.arange(bits), radius + 2)
    return [np.concatenate(c) for c in itertools.combinations(blocks, 2)]


def _spread(nodes: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """A row (key, node, fp) for each fingerprint and key."""

    def run(batches):
        for b in batches:
            raw = b.column("fp")
            if not len(raw):
                continue
            fp = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(raw), -1)
            bits = np.unpackbits(fp, axis=1, bitorder="little")
            for t, chosen in enumerate(keys):
                key = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key * len(keys) + t), b.column("node"), raw], names=["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(tidy(run), "key long, node long, fp binary")


def _links(radius: int):
    def compare(group: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, group[1:] != group[:-1]]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(group)][np.cumsum(new) - 1]
        kept = [np.zeros(0, np.int64)] * 3
        found, held = [], 0

        def prune():
            nonlocal kept, found, held
            a, b, d = (np.concatenate(x) for x in zip(kept, *found, strict=True))
            chosen = forest(len(group), a, b, d)
            kept, found, held = [a[chosen], b[chosen], d[chosen]], [], 0

        for pair in pairs_within(fp, ends - 1 - np.arange(len(group)), radius):
            found.append(pair)
            held += len(pair[0])
            if held > 1_000_000:
                prune()
        prune()
        a, b, d = kept
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(d)], names=["a", "b", "d"])

    def run(batches):
        held: list = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            group = np.concatenate([x[0] for x in held])
            node, fp = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            cut = len(group) if last else int(np.searchsorted(group, group[-1]))
            held, count = ([(group[cut:], node[cut:], fp[cut:])], len(group) - cut) if cut < len(group) else ([], 0)
            if cut:
                yield compare(group[:cut], node[:cut], fp[:cut])

        before, number = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(c).to_numpy() for c in ("key", "part", "other")], axis=1)
            new = (ids[1:] != ids[:-1]).any(axis=1)
            number += before is not None and bool((ids[0] != before).any())
            group = number + np.r_[0, np.cumsum(new)]
            number, before = int(group[-1]), ids[-1]
            fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            held.append((group, b.column("node").to_numpy(), fp))
            count += b.num_rows
            if count >= _CHUNK:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def links(nodes: DataFrame, keys: list[np.ndarray], radius: int, bucket: int = BUCKET) -> DataFrame:
    """a, b, d: links between fingerprints at most ``radius`` bits apart, a forest for each bucket."""
    rows = _spread(nodes, keys)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(sizes.filter(F.col("n") > bucket).select("key", F.ceil(F.col("n") * 2 / bucket).alias("parts")))
    rows = rows.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    every = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("their", F.explode(every)).select(
        "key", F.least("mine", "their").alias("part"), F.greatest("mine", "their").alias("other"), "node", "fp")
    dealt = rows.repartition(shuffle_width(nodes.sparkSession), "key", "part", "other")
    return dealt.sortWithinPartitions("key", "part", "other", "node").mapInArrow(tidy(_links(radius)), "a long, b long, d long")


def near_components(df: DataFrame, k: int = 3, bits: int = 64, radius: int = 3, keys: list[np.ndarray] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __hash, fp, low, node, root and best (with the smallest id of the component) for every row."""
    rows = fingerprints(df, k, bits, id_col, text_col)
    # 64-bit fingerprints are their own numbers; wider ones go by a 64-bit hash.
    number = F.col("low") if bits == 64 else F.xxhash64("fp")
    rows = rows.withColumn("node", number)
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")).alias("first")
    nodes = cut_lineage(rows.groupBy("node", "fp").agg(first))
    found = links(nodes, keys or pigeonhole_keys(bits, radius), radius).select("a", "b").distinct()
    roots = components(found)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    of = placed.join(best, "root").select("node", "root", "best")
    return rows.join(of, "node")


def drop_near_duplicates(df: DataFrame, k: int = 5, min_similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, without all but the smallest id of each near-duplicate component.

    Texts are linked where the Jaccard similarity of their shingle sets reaches ``min_similarity``.  Pairs come from bit-sliced
    comparison of 256-bit SimHash fingerprints of these sets, in the buckets of :mod:`rowloom.llm.set_join`, and
    every pair is checked exactly before links are thinned.
    """
    rows = similar_groups(df, shingle_hashes, set_fingerprint, k, min_similarity, id_col, text_col)
    mine = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    gone = cut_lineage(rows.filter(mine != F.col("best")).select("__id", "__hash").distinct())
    return without_rows(df, gone, id_col, text_col)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_components(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("low"), 16, "0")).alias("fingerprint"), F.col("best.__id").alias("component_id"))
