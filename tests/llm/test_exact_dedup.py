import hashlib
import random
import re

from rowloom.llm import exact_dedup as ed


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    out = {}
    for n, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in set(ids):
            for copy in range(ids.count(i)):
                out.setdefault((i, keep, len(ids), i == keep and copy == 0, hashlib.sha256(n.encode()).hexdigest()), 0)
                out[i, keep, len(ids), i == keep and copy == 0, hashlib.sha256(n.encode()).hexdigest()] += 1
    return out


ROWS = [
    (1, "a  b"), (2, "a\tb"), (3, "a b"), (3, "a b"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "x" * 200_000), (9, "x" * 200_000),
    (None, "a b"), (None, "only null"), (None, "only null"), (10, "é\n\n"), (11, "é "), (12, "alone"),
]


def counted(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_marks_equal_brute_force(spark):
    rows = ROWS + [(100 + i, f"text {random.Random(i).randrange(60)}") for i in range(200)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, kept string").repartition(6)
    assert counted(ed.mark_duplicates(df).collect()) == brute(rows)
    # A filter so small that everything is suspect gives the same.
    assert counted(ed.mark_duplicates(df, log2_slots=5).collect()) == brute(rows)


def test_drop_keeps_the_smallest_and_all_columns(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in ROWS], "doc_id long, text string, keep_id long").repartition(3)
    kept = ed.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 7, 8, 10, 12]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ed.mark_duplicates(empty).count() == 0 and ed.drop_duplicates(empty).count() == 0
