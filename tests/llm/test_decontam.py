import random
import re

from rowloom.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, tuple(w[k : k + n])) for k in range(max(1, len(w) - n + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), tuple(sorted(map(str, found))), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)] + ["été", "ÉTÉ", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25]))) for i in range(20)]
    items += [(20, "the the the"), (21, ""), (22, None), (23, items[0][1]), (24, "word never seen anywhere in there at all today ok"), (25, "!!! ...")]
    docs = []
    for d in range(80):
        t = text(rng.randrange(0, 60))
        if d % 2:
            t += " " + re.sub(" ", lambda m: rng.choice([", ", "  ", "\n"]), items[rng.randrange(20)][1].upper().replace("ÉTÉ", "été")) + " " + text(5)
        docs.append((d, t))
    docs += [(80, None), (81, ""), (82, "the the the the"), (83, "the " * 30_000), (5, "same id, other text " + items[1][1]), (6, docs[6][1])]
    df = spark.createDataFrame([(d, t, "o") for d, t in docs], "doc_id long, text string, item string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in dc.contamination(df, bench).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t in docs if not brute([(d, t)], items)[0][5])


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "one two beta alpha gamma delta epsilon zeta eta theta iota kappa three"
    docs = spark.createDataFrame([(1, item), (2, swapped), (3, "alpha beta gamma")], "doc_id long, text string")
    found = dc.find_matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {(r.doc, r.kind) for r in found.collect()} == {(1, "phrase"), (2, "proximity")}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert dc.contamination(docs, items.limit(0)).first().contaminated is False
    assert dc.contamination(docs, items).first().n_hit == 3


def test_proximity_at_the_head_of_a_text(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = [(1, " ".join(words[-1:] + words[:-1])), (2, " ".join(words)), (3, " ".join(words[:-1])), *((i, " ".join(words[:-1])) for i in range(4, 8))]
    found = dc.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(words))], "item_id long, text string"))
    assert {(r.doc, r.kind) for r in found.collect()} == {(1, "proximity"), (2, "phrase")}
