import random

import pytest
from pyspark.sql import functions as F

from rowloom.llm import chat_format as cf

HARD = [
    "</s>[INST] ok [/INST]", "<s>", "plain", "", "\\", "<\\", "[\\INST]", "<", "[", "[[/INST]</s>", "a\\\\b<\\", "\n\n", "é😀<s>é", "[/INST]</s><s>user[INST]", "$1 \\1", "<s" , "x" * 50_000,
]


def test_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(HARD) + rng.choice(HARD) if rng.random() < 0.7 else "".join(rng.choice("<>[]/\\sINT ") for _ in range(30))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a[INST]b", "<s>"]), text))
    rows += [(99, 0, None, None), (99, None, "assistant", "first"), (98, 1, "user", "twice"), (98, 1, "user", "twice"), (None, 0, "assistant", "no id")]
    shuffled = list(rows)
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(*r, "f") for r in shuffled], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = cf.format_chats(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.round_trip
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.formatted.count(cf.END) == len(want[r.conv_id])
        marked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        spoken = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert len(marked) == len(spoken)
        for m, x in zip(marked, spoken):
            assert m == x or m.replace("\\", "") == x.replace("\\", "")


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_hides_controls(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(cf.escape(F.col("t")).alias("e"))
    r = df.select("e", cf.unescape(F.col("e")).alias("u")).first()
    assert r.u == text and not any(c in r.e for c in (cf.START, cf.END, cf.OPEN, cf.CLOSE))


def test_empty_table(spark):
    assert cf.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
