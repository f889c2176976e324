import math
import random
import re
import zlib

import numpy as np
import pytest

from rowloom.llm import lm_scoring as lm
from rowloom.llm import pitman_yor as py


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    counts, held = {}, {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out[i] = (held[i], len(ws), sum(w in counts for w in ws), n, base)
    return out


def corpus(n, seed):
    """Two alternating vocabularies, so the context tells."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        side = i % 2
        rows.append((i, " ".join(f"{'ab'[side]}{min(int(rng.expovariate(0.08)), 90)}{'xy'[side]}" for _ in range(rng.randrange(0, 60)))))
    return rows


def plain_sampler(rows, seed, sweeps=60, burn_in=20):
    """Scores by one-by-one Gibbs sampling of the same model, in plain Python."""
    rng, held = random.Random(seed), {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    d, strength = py.DISCOUNT, py.STRENGTH
    pairs = lambda t: list(zip([0, *tokens(t)], tokens(t)))
    customers = [p for i, t in rows if not held[i] for p in pairs(t)]
    vocabulary = len({w for _, w in customers})
    leaf, root = {}, {}  # table sizes of (context, word) and of word
    in_context, t_context, in_root, t_root = {}, {}, 0, 0

    def p_root(w):
        sizes = root.get(w, [])
        return (sum(sizes) - d[1] * len(sizes) + (strength[1] + d[1] * t_root) / (vocabulary + 1)) / (strength[1] + in_root)

    def p_leaf(u, w):
        sizes = leaf.get((u, w), [])
        return (sum(sizes) - d[0] * len(sizes) + (strength[0] + d[0] * t_context.get(u, 0)) * p_root(w)) / (strength[0] + in_context.get(u, 0))

    def pick(weights):
        x = rng.random() * sum(weights)
        for k, y in enumerate(weights):
            x -= y
            if x < 0:
                return k
        return len(weights) - 1

    def sit(u, w):
        nonlocal in_root, t_root
        sizes = leaf.setdefault((u, w), [])
        k = pick([s - d[0] for s in sizes] + [(strength[0] + d[0] * t_context.get(u, 0)) * p_root(w)])
        in_context[u] = in_context.get(u, 0) + 1
        if k < len(sizes):
            sizes[k] += 1
            return
        sizes.append(1)
        t_context[u] = t_context.get(u, 0) + 1
        above = root.setdefault(w, [])
        k = pick([s - d[1] for s in above] + [(strength[1] + d[1] * t_root) / (vocabulary + 1)])
        in_root += 1
        if k < len(above):
            above[k] += 1
        else:
            above.append(1)
            t_root += 1

    def rise(u, w):
        nonlocal in_root, t_root
        sizes = leaf[u, w]
        k = pick(sizes)
        sizes[k] -= 1
        in_context[u] -= 1
        if not sizes[k]:
            sizes.pop(k)
            t_context[u] -= 1
            above = root[w]
            k = pick(above)
            above[k] -= 1
            in_root -= 1
            if not above[k]:
                above.pop(k)
                t_root -= 1

    for u, w in customers:
        sit(u, w)
    wanted = {p for _, t in rows for p in pairs(t)}
    total = dict.fromkeys(wanted, 0.0)
    for s in range(sweeps):
        for u, w in customers:
            rise(u, w)
            sit(u, w)
        if s >= burn_in:
            for p in wanted:
                total[p] += p_leaf(*p) / (sweeps - burn_in)
    return {i: sum(math.log10(total[p]) for p in pairs(t)) for i, t in rows}


def test_contract_fields_and_gain(spark):
    rows = corpus(300, 1) + [(900, None), (901, ""), (902, " \n"), (903, "É É B b"), (904, "z" * 100_000), (905, "a1x " * 40_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, tokens int").repartition(6)
    got = {r.doc_id: r for r in lm.score(df, bucket_bytes=30_000).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (held, n, known, train, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    unseen = [r for i, r in got.items() if r.held_out and i < 300]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.1 * sum(r.n_tokens for r in unseen)


def test_scores_agree_with_a_plain_sampler(spark):
    rng = random.Random(9)  # "of" makes up a fifth, so its pairs are dealt over all buckets
    rows = [(i, " ".join(y for w in t.split() for y in ([w, "of"] if rng.random() < 0.3 else [w]))) for i, t in corpus(80, 7)]
    want = plain_sampler(rows, 1)
    again = plain_sampler(rows, 2)
    error = max(abs(want[i] - again[i]) for i in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 30, 1_200):  # one bucket, and several with tokens dealt over all of them
        got = {r.doc_id: r.score for r in lm.score(df, bucket_bytes=size).collect()}
        assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.008)
        assert max(abs(got[i] - want[i]) for i in want) < max(4 * error, 1.5)


def test_predictive_probabilities_sum_to_one():
    """In three contexts over all words of a parent whose probabilities sum to one, and with tables elsewhere."""
    rng = np.random.default_rng(8)
    words, contexts = 500, 3
    context, parent = np.repeat(np.arange(contexts), words), rng.dirichlet(np.ones(words))
    n = np.where(rng.random(len(context)) < 0.2, rng.zipf(1.6, len(context)), 0).clip(max=20_000).astype(float)
    n[context == 2] = 0
    customers = np.bincount(context, weights=n)
    p = py.sample_contexts(py.Seating(n, py.DISCOUNT[0], rng), context, n, np.tile(parent, contexts), np.zeros(contexts), customers, 6, 3)
    assert np.bincount(context, weights=p) == pytest.approx(1.0, abs=1e-9)
    half = np.arange(len(n)) % 2 == 0  # the same contexts, dealt over two tasks
    parts = [py.Seating(n[x], py.DISCOUNT[0], rng) for x in (half, ~half)]
    tables = [np.bincount(context[x], weights=s.tables, minlength=contexts) for x, s in zip((half, ~half), parts)]
    total = 0
    for x, s, other in zip((half, ~half), parts, tables[::-1]):
        total = total + np.bincount(context[x], weights=py.sample_contexts(s, context[x], n[x], np.tile(parent, contexts)[x], other, customers, 1, 1), minlength=contexts)
    assert total == pytest.approx(1.0, abs=0.1)  # each half saw the other's tables of one sweep before


def _exact_tables(n, d, a):
    """The mean number of tables of n customers, from generalised Stirling numbers."""
    log = np.full((n + 1, n + 1), -np.inf)
    log[1, 1] = 0.0
    for k in range(1, n):
        t = np.arange(1, k + 1)
        log[k + 1, 1 : k + 1] = np.logaddexp(log[k, 1 : k + 1] + np.log(k - d * t), log[k, :k])
        log[k + 1, k + 1] = log[k, k]
    p = log[n, 1:] + np.arange(1, n + 1) * math.log(a)
    p = np.exp(p - p.max())
    return float((p * np.arange(1, n + 1)).sum() / p.sum())


@pytest.mark.parametrize(("n", "a", "room"), [(2, 0.5, 0.02), (7, 2.0, 0.02), (16, 1.0, 0.03), (60, 1.5, 0.06), (400, 3.0, 0.06), (400, 40.0, 0.06)])
def test_tables_have_their_exact_mean(n, a, room):
    rng = np.random.default_rng(n)
    seats = py.Seating(np.full(6000, float(n)), py.DISCOUNT[0], rng)
    got = []
    for s in range(40):
        seats.sweep(np.full(6000, a))
        got.append(seats.tables.mean())
    assert np.mean(got[15:]) == pytest.approx(_exact_tables(n, py.DISCOUNT[0], a), rel=room)


def test_a_large_entry_mixes_as_one_by_one_sampling_does():
    """100,000 customers: as many tables as in the limit 1 + Poisson(opening / discount)."""
    seats = py.Seating(np.full(500, 100_000.0), py.DISCOUNT[0], np.random.default_rng(4))
    got = []
    for s in range(30):
        seats.sweep(np.full(500, 2.0))
        got.append(seats.tables.mean())
    assert np.mean(got[10:]) == pytest.approx(1 + 2.0 / py.DISCOUNT[0], rel=0.08)


def test_seating_keeps_customers_and_tables():
    rng = np.random.default_rng(2)
    n = np.r_[np.ones(50), rng.integers(2, 9, 400), rng.integers(9, 5000, 60), np.zeros(5)].astype(float)
    seats = py.Seating(n, py.DISCOUNT[0], rng)
    for _ in range(10):
        seats.sweep(np.full(len(n), 0.7))
        assert (np.bincount(seats.owner, weights=seats.size) == seats.n).all()
        assert (np.bincount(seats.owner) == seats.tables[seats.entry]).all() and seats.size.min() > 0
        assert (seats.tables[n == 1] == 1).all() and (seats.tables[n == 0] == 0).all()
        other = py.Seating(n, py.DISCOUNT[0], rng)
        other.resume(*seats.state())
        assert (other.tables == seats.tables).all()


def test_same_scores_for_any_number_of_partitions(spark):
    df = spark.createDataFrame(corpus(120, 5), "doc_id long, text string")
    made, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width, parts in ((4, 1), (9, 7), (200, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            made.append({r.doc_id: r.score for r in lm.score(df.repartition(parts), bucket_bytes=8_000).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == pytest.approx(made[1], rel=1e-6) and made[0] == pytest.approx(made[2], rel=1e-6)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = lm.score(df).collect()
    assert len(got) == 3 and all(r.n_tokens == 3 for r in got)
    assert lm.score(df.limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    r = lm.score(only_held).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)
