import hashlib
import random
import re

import sentencepiece

import corpus_pipeline
from rowloom.llm import sentencepiece_fst, toxicity


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(4000)}" for _ in range(n)]
    docs, labels = [], []
    item = fresh(14)
    for i in range(260):
        words = fresh(rng.randrange(60, 120))
        toxic = i % 6 == 0
        if toxic:
            words[5] = rng.choice(["blockhead", "nitwit"])
        labels.append((i, int(i % 5 > 0), int(toxic)))
        docs.append([i, " ".join(words)])
    docs[31][1] = docs[1][1].replace(" ", "\n")  # an exact copy
    near = docs[2][1].split(" ")
    near[len(near) // 2] = "edited"
    docs[32][1] = " ".join(near)  # a near copy
    docs[33][1] = " ".join([*docs[33][1].split(" ")[:20], *item[2:12], *docs[33][1].split(" ")[20:]])  # a benchmark passage
    docs += [[300, None], [301, ""]]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "qq " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rejected = {i for i, _, x in labels if x}
    kept, seen, shingles = [], set(), []
    for i, t in docs:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        key = hashlib.sha256(text.encode()).digest()
        if i in rejected or key in seen:
            continue
        seen.add(key)
        w = text.split(" ")
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        if any(len(s & o) >= 0.8 * len(s | o) for o in shingles):
            continue
        shingles.append(s)
        if any(tuple(w[k : k + 10]) == tuple(item[j : j + 10]) for k in range(len(w)) for j in range(5)):
            continue
        kept.append(i)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    assert all(r.ids == (None if r.text is None else lib.encode(r.text)) for r in out)
    assert {31, 32, 33}.isdisjoint(r.doc_id for r in out)

    # Each stage but the last keeps the columns of its input.
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        current = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert current.columns == table.columns
    assert toxicity.CATEGORIES[-1] == "toxic"
