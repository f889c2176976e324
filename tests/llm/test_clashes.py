"""Extra columns whose names the operators use themselves."""

from rowloom.llm import chat_format, decontam, exact_dedup, line_dedup, lm_scoring, sentencepiece_fst, sharding, simhash, substring_dedup, toxicity

NAMES = ["key", "doc", "node", "fp", "batch", "part", "rejected", "p_toxic", "ids", "round_trip", "removed_chars", "shard", "slot", "kept", "item", "line", "number", "term", "root"]


def test_clashing_names_and_types(spark):
    rows = [(i, f"text number {i % 7} with some words of its own {i % 5} and more", *["x"] * len(NAMES)) for i in range(40)] + [(40, None, *[None] * len(NAMES))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    same = lambda out: out.columns == df.columns and out.count() > 0
    assert same(exact_dedup.drop_duplicates(df))
    assert same(simhash.drop_near_duplicates(df))
    assert same(decontam.drop_contaminated(df, items))
    assert same(toxicity.drop_toxic(df, labels))
    everything = [
        exact_dedup.mark_duplicates(df), simhash.near_components(df), decontam.contamination(df, items), sharding.shard_by_bytes(df, 4),
        lm_scoring.score(df), sentencepiece_fst.encode(df, check="round_trip"), substring_dedup.remove_repeats(df), line_dedup.remove_common_lines(df),
        toxicity.score(df, toxicity.fit(df, labels)),
    ]
    for out in everything:
        assert len(set(out.columns)) == len(out.columns)
        assert len(out.collect()) == len(rows)


def test_other_key_types(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", "one  two three"), ("c", None)], "doc_id string, text string")
    assert {r.keep_id for r in exact_dedup.mark_duplicates(df).collect()} == {"a", "c"}
    assert {r["best"]["__id"] for r in simhash.near_components(df).collect()} == {"a", "c"}
    assert sharding.shard_by_bytes(df, 2).count() == 3
    chats = spark.createDataFrame([("k", 0, "user", "hi", 1)], "conv_id string, turn int, role string, text string, turns int")
    assert chat_format.format_chats(chats).first().round_trip
