import random

import numpy as np

from rowloom.llm import line_dedup as ld


def brute(docs, min_chars):
    """Every line in a run of at least ``min_chars`` characters that any earlier document has, found line by line."""
    split = {i: [x for x in map(str.strip, (t or "").split("\n")) if x] for i, t in docs}
    out = {}
    for i, t in docs:
        mine, gone = split[i], set()
        for j in split:
            if j >= i:
                continue
            other = split[j]
            for a in range(len(mine)):
                for b in range(len(other)):
                    if mine[a] != other[b] or a and b and mine[a - 1] == other[b - 1]:
                        continue
                    n = 0
                    while a + n < len(mine) and b + n < len(other) and mine[a + n] == other[b + n]:
                        n += 1
                    if sum(map(len, mine[a : a + n])) >= min_chars:
                        gone |= set(range(a, a + n))
        kept, n = [], 0
        for x in (t or "").split("\n"):
            if not x.strip() or n not in gone:
                kept.append(x)
            n += bool(x.strip())
        out[i] = "\n".join(kept)
    return out


def test_patience():
    # later: A B C X, earlier: A B C, with C twice in the earlier one
    assert ld.patience(list("ABCX"), list("..ABCC")) == [(0, 2), (1, 3), (2, 4)]
    assert ld.patience(list("AB"), list("BA")) in ([(0, 1)], [(1, 0)])
    assert ld.patience([None, "A", None], ["A", "B"]) == [(1, 0)]
    assert ld.patience(list("abXcd"), list("abYcd")) == [(0, 0), (1, 1), (3, 3), (4, 4)]


def test_windows_make_up_every_run():
    rng = random.Random(5)
    for _ in range(300):
        size = np.array([rng.randrange(1, 45) for _ in range(rng.randrange(1, 9))])
        made = ld.windows(size, 40).tolist()
        assert all(size[a : z + 1].sum() >= 40 for a, z in made)
        assert {x for a, z in made for x in range(a, z + 1)} == (set(range(len(size))) if size.sum() >= 40 else set())


def test_a_block_whose_lines_have_different_first_holders(spark):
    a, b = "a" * 25, "b" * 25
    rows = [(1, a), (2, f"{a}\n{b}\nown line of the second"), (3, f"{a}\n{b}\nown line of the third")]
    got = {r.doc_id: r.text for r in ld.remove_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: rows[1][1], 3: "own line of the third"}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"t{rng.randrange(5000)}" for _ in range(rng.randrange(1, 12)))
    common = [line() for _ in range(12)] + ["short", "of 20 characters ok."]
    rows = []
    for i in range(120):
        body = [line() for _ in range(rng.randrange(1, 20))]
        if i % 2:
            for _ in range(2):  # two blocks, in either order
                k = rng.randrange(11)
                body[rng.randrange(len(body)) : 0] = common[k : k + rng.randrange(1, 4)]
        if i % 5 == 0:
            body[1:1] = ["", "  "]
        body.append("the one very common line, long enough to be deleted everywhere")
        rows.append((i, "\n".join(body)))
    rows += [(200, ""), (201, "\n\n"), (202, rows[3][1]), (203, "x" * 50_000), (204, "same\n" * 300), (205, "same\n" * 310), (206, "same\nother\n" * 40)]
    want = brute(rows, ld.MIN_CHARS)
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(300, None, "k"), rows[0] + ("k",)], "doc_id long, text string, line string").repartition(5)
    got = {r.doc_id: r for r in ld.remove_common_lines(df).collect()}
    assert {i: r.text for i, r in got.items() if i != 300} == want
    assert got[300].text is None and got[0].line == "k"
    assert ld.remove_common_lines(df.limit(0)).count() == 0
