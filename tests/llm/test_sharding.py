import random
import zlib

from rowloom.llm.sharding import shard_by_bytes


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(80)) for i in range(500)] + [(500, None), (501, ""), (None, "n"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = shard_by_bytes(df, 16).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t in rows)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16))
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    totals = [sum(r["size"] for r in by[s]) for s in range(16)]
    assert max(totals) - min(totals) <= 2 * max(size(t) for _, t in rows)
    order = [r.doc_id for s in range(16) for r in sorted(by[s], key=lambda r: r.slot)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_one_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 100_000), (2, "a"), (3, "b")], "doc_id long, text string")
    assert {r.doc_id: r.shard for r in shard_by_bytes(df, 4).collect()} == {1: 1, 2: 3, 3: 3}
    assert shard_by_bytes(df.limit(0), 4).count() == 0
