import random

import numpy as np
import xxhash

from rowloom.llm import substring_dedup as sd


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(n)]


def test_gear_hash_rolls():
    data = np.frombuffer(b"the quick brown fox jumps over it", np.uint8)
    for i, h in enumerate(sd.gear_hashes(data)):
        rolled = 0
        for b in data[max(0, i - 15) : i + 1]:
            rolled = (rolled << 1) + int(sd._GEAR[b])
        assert int(h) == rolled % (1 << 32)


def brute(docs, min_words):
    """The same rule with dictionaries: docs in id order."""
    first, cut = {}, {}
    for i, text in docs:
        raw, starts, ends, counts = sd.chunks(text)
        again = []
        for k, (s, e) in enumerate(zip(starts, ends)):
            d = xxhash.xxh3_128_digest(raw[s:e])
            again.append(first.setdefault(d, (i, k)) != (i, k))
        spans, k = [], 0
        while k < len(again):
            if again[k]:
                j = k
                while j + 1 < len(again) and again[j + 1]:
                    j += 1
                if counts[k : j + 1].sum() >= min_words:
                    spans.append((starts[k], ends[j]))
                k = j
            k += 1
        out, at = b"", 0
        for s, e in spans:
            out, at = out + raw[at:s], e
        cut[i] = (out + raw[at:]).decode()
    return cut


def test_equals_brute_force_and_catches_passages(spark):
    rng = random.Random(4)
    shared = [words(rng, 60) for _ in range(8)]
    rows = []
    for i in range(160):
        body = words(rng, rng.randrange(5, 300))
        if i % 3 == 0:
            body[len(body) // 2 : 0] = rng.choice(shared)
        rows.append((i, " ".join(body)))
    rows += [(200, ""), (201, " \n"), (202, "é" * 9000), (203, rows[7][1]), (204, "ü ß " * 3000)]
    want = brute(rows, sd.MIN_WORDS)
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "m") for i, t in rows] + [(300, None, "m")], "doc_id long, text string, marks string").repartition(5)
    got = {r.doc_id: r for r in sd.remove_repeats(df).collect()}
    assert {i: r.text for i, r in got.items() if i != 300} == want
    assert got[300].text is None and got[0].marks == "m"
    hit = [i for i in range(160) if i % 3 == 0]
    assert sum(got[i].removed_chars > 150 for i in hit) >= len(hit) - 8
    assert not any(got[i].removed_chars for i in range(160) if i % 3)
    assert sd.remove_repeats(df.limit(0)).count() == 0
