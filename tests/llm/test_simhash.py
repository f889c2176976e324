import random

import numpy as np
import xxhash

from rowloom.llm import simhash
from rowloom.llm.bitslice import forest, pairs_within


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints, radius=3):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    docs = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 300]))]
        docs.append(" ".join(words))
        for _ in range(5):
            edited = list(words)
            edited[rng.randrange(len(edited))] = "Edit"
            docs.append("  ".join(edited))
    return [*docs, *docs[:9], None, "", " \n", "one", "ÉA b C", "x" * 300_000, "a b " * 40_000]


def test_query_against_brute_force(spark):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    parts = brute_components(prints)
    got = {r["__id"]: (r["fp"], r["best"]["__id"]) for r in simhash.near_components(df).collect()}
    assert {i: int.from_bytes(fp, "little") for i, (fp, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == parts


def test_query_writes_fingerprints_from_the_highest_bit(spark, tmp_path):
    """On bytes, which are no UTF-8, Spark's reverse moves characters."""
    texts = [*corpus(), *(f"one{i} two three" for i in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    parts = brute_components(prints)
    rows = simhash.op1_simhash(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert len(rows) == len(texts)
    assert got == {i: (f"{fp:016x}", parts[i]) for i, fp in prints.items()}


def test_large_buckets_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 8, dtype=np.uint8)
    rows = []
    for node in range(120):
        fp = base.copy()
        for bit in rng.integers(50, 64, 4):
            fp[bit // 8] ^= np.uint8(1 << (bit % 8))
        rows.append((node, bytearray(fp.tobytes())))
    nodes = spark.createDataFrame(rows, "node long, fp binary").dropDuplicates(["fp"])
    keys = simhash.pigeonhole_keys(64, 3)
    prints = {r.node: int.from_bytes(r.fp, "little") for r in nodes.collect()}
    for bucket in (16, 10_000):
        found = {(r.a, r.b) for r in simhash.links(nodes, keys, 3, bucket).collect()}
        assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in found)
        root = brute_components(prints)
        linked = {i: i for i in prints}
        for _ in prints:
            for a, b in found:
                linked[a] = linked[b] = min(linked[a], linked[b])
        assert linked == root


def test_pairs_within_equals_brute_force():
    rng = np.random.default_rng(0)
    fp = np.repeat(rng.integers(0, 256, (60, 16), dtype=np.uint8), 4, axis=0)
    for i in range(len(fp)):
        for b in rng.integers(0, 128, rng.integers(0, 5)):
            fp[i, b // 8] ^= np.uint8(1 << (b % 8))
    sizes = [1, 5, 100, 2, 132]
    later = np.concatenate([np.arange(n)[::-1] for n in sizes])
    start = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    for radius in (0, 1, 3, 5, 12):
        got = {(a, b, c) for i, j, d in pairs_within(fp, later, radius) for a, b, c in zip(i, j, d)}
        want = {
            (i, j, d)
            for i in range(len(fp)) for j in range(i + 1, len(fp))
            if start[i] == start[j] and (d := int(np.unpackbits(fp[i] ^ fp[j]).sum())) <= radius
        }
        assert got == want


def test_forest_spans():
    a, b, w = np.array([0, 1, 2, 3, 0]), np.array([1, 2, 0, 4, 2]), np.array([3, 1, 2, 5, 9])
    assert sorted(forest(5, a, b, w).tolist()) == [1, 2, 3]


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows, groups = [], []
    for _ in range(25):
        base = fresh(200)
        group = [len(rows)]
        rows.append(base)
        for _ in range(3):
            edited = list(base)
            edited[rng.randrange(200)] = "changed"
            group.append(len(rows))
            rows.append(edited)
        groups.append(group)
    clean = [len(rows) + i for i in range(40)]
    rows += [fresh(150) for _ in clean]
    df = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(rows)], "doc_id long, text string, key string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {g[0] for g in groups} | set(clean)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_components(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).columns == ["doc_id", "text"]


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r["__id"] or -1, r["best"]["__id"]) for r in simhash.near_components(df).collect()), key=str)
    assert got == [(-1, 4), (-1, None), (4, 4), (4, 4)]


def brute_kept(texts, k=5, least=0.8):
    """Ids that are the smallest of their component, all pairs compared on their shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            met = len(x & y)
            if met >= least * (len(x) + len(y) - met) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}


def test_pairs_in_a_family_of_templates_are_all_checked(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        lines = [[f"t{rng.randrange(10**6)}" for _ in range(10)] for _ in range(60)]
        for _ in range(60):
            own = {i: [f"t{rng.randrange(10**6)}" for _ in range(10)] for i in rng.sample(range(60), 7)}
            first = [w for i, line in enumerate(lines) for w in own.get(i, line)]
            texts.append(" ".join(first))
            if rng.random() < 0.4:  # a partner at about 0.8 or a bit more
                for at in rng.sample(range(len(first)), rng.randrange(10, 16)):
                    first[at] = "changed"
                texts.append(" ".join(first))
    want = brute_kept(texts)
    assert len(texts) - len(want) > 20 and len(want) > 150
    assert kept_ids(spark, texts) == want


def test_texts_that_differ_outside_a_repeated_line_stay(spark):
    rng = random.Random(12)
    line = " ".join(f"r{i}" for i in range(9)) + " "
    texts = [line * 400 + " ".join(f"b{rng.randrange(10**7)}" for _ in range(300)) for _ in range(4)]
    assert len({simhash.fingerprint(t, 5, 256) for t in texts}) < len(texts)
    assert kept_ids(spark, texts) == brute_kept(texts) == set(range(4))


def test_short_and_repetitive_texts_are_all_found(spark):
    rng = random.Random(13)
    texts = []
    for i in range(60):
        words = [f"s{i}x{n}" for n in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]  # 4 of 5 shingles
        words = [f"p{i}x{n}" for n in range(30)]
        texts += [" ".join(words), " ".join(words + words[:15] * rng.choice([5, 10]) + words[:4])]
    want = brute_kept(texts)
    assert len(want) <= len(texts) - 60
    assert kept_ids(spark, texts) == want
