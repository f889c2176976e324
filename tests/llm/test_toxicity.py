import random

import numpy as np
import pytest

from rowloom.llm import toxicity

BAD = ["blockhead", "nitwit", "achquatsch", "achkram"]


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        low = rng.random() < 0.2
        toxic = rng.random() < 0.2
        if low:
            words += ["$$$", "click"] * 3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "e", "."])
        rows.append((i, " ".join(words), int(not low), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, p_low string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 500], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [r for r in rows if r[0] >= 500]
    right = sum(got[i].rejected == bool(x) for i, _, _, x in held)
    assert right >= 0.97 * len(held)
    assert sum((got[i].p_low_quality > 0.5) == (not q) for i, _, q, _ in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def test_later_models_are_fed_out_of_fold_odds():
    rows = corpus(300, 2)
    sets = [np.frombuffer(toxicity._features(t), np.uint32) for _, t, _, _ in rows]
    labels = np.array([[int(not q), x] for _, _, q, x in rows])
    chain = toxicity.Chain(sets, labels)
    assert [len(m.dense_weight) for m in chain.models] == [0, 1]
    fold = np.arange(len(sets)) % toxicity.FOLDS
    names, seen = np.unique(np.concatenate(sets), return_counts=True)
    names = names[seen >= 4]
    at = [np.searchsorted(names, s[np.isin(s, names)]) for s, f in zip(sets, fold) if f]
    rest = toxicity.LinearModel(at, names, np.zeros((len(at), 0)), labels[fold > 0, 0].astype(float))
    assert chain.out_of_fold[0, 0] == pytest.approx(rest.logit(sets[0].tolist(), np.zeros(0)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a word"), (3, "z" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(docs, chain).filter("rejected").count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).filter("rejected").count() == 0
    assert toxicity.score(docs.limit(0), chain).count() == 0
