import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from rowloom.llm import sentencepiece_fst as fst

LIB = sentencepiece.SentencePieceProcessor(model_file=fst.MODEL)
CASES = [
    "", " ", "  a", "a  ", "plain words, here.", "é ü ß 中國 😀 Ωmega", "tab\there\nline\r\n", "<s> </s> <unk> <0x0A>",
    "under▁score", "x" * 5000, " " * 300, "ABC" * 700 + "🙂" * 50, "\u0000\u0001", "é combining",
]


def test_equals_the_library():
    own, rng = fst.Transducer(fst.read_model(fst.MODEL)), random.Random(1)
    pieces = list(own.id_of)
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(6))).replace("▁", " ") for _ in range(8000)]
    letters = "abcdeinorstu  .,'-_0123{}\n中é😀"
    made += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(8000)]
    for text in CASES + made:
        ids = own.encode(text).tolist()
        assert ids == LIB.encode(text), text
        assert own.decode(ids) == LIB.decode(ids), text


def test_unigram_takes_the_shortest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("ba", -4.0, 1)]
    own = fst.Transducer({"bpe": False, "prefix": True, "fallback": False, "pieces": pieces})
    assert [pieces[i][0] for i in own.encode("abab")] == ["▁a", "b", "ab"]
    assert [pieces[i][0] for i in own.encode("xa")] == ["▁", "<unk>", "a"]


def _variant(path, rule, squeeze, prefix, unigram):
    """The public model with another normaliser, or its pieces under a unigram model."""
    made, norm = proto.ModelProto(), proto.ModelProto()
    with open(fst.MODEL, "rb") as f:
        made.ParseFromString(f.read())
    if rule:
        norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        made.normalizer_spec.precompiled_charsmap = norm.normalizer_spec.precompiled_charsmap
    made.normalizer_spec.remove_extra_whitespaces, made.normalizer_spec.add_dummy_prefix = squeeze, prefix
    if unigram:
        made.trainer_spec.model_type = fst._UNIGRAM
        rng = random.Random(4)
        for p in made.pieces:  # scores without ties
            p.score = -rng.uniform(2, 4) - 1.5 * len(p.piece) ** 0.5 if p.type == fst._NORMAL else p.score
    path.write_bytes(made.SerializeToString())
    return str(path)


@pytest.mark.parametrize(("rule", "squeeze", "prefix", "unigram"), [
    ("nmt_nfkc", True, True, False), ("nmt_nfkc_cf", True, True, True), ("nfkc", False, True, False), (None, True, False, False), (None, False, True, True),
])
def test_normalisers_equal_the_library(tmp_path, rule, squeeze, prefix, unigram):
    path = _variant(tmp_path / "m.model", rule, squeeze, prefix, unigram)
    own, lib, rng = fst.Transducer(fst.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    letters = "abcdeinorstu    ABCÉß\u00a0\u3000\u200b\t\n\u0301\u0308\u0001ﬁ①㍿Ａｶﾞ中é😀ﷺ▁가\u1100\u1161"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for text in CASES + made:
        ids, other = own.encode(text).tolist(), lib.encode(text)
        if unigram and ids != other:  # paths of equal weight: the library adds in single precision over the whole text
            assert sum(own.pieces[i][1] for i in ids) == pytest.approx(sum(own.pieces[i][1] for i in other), rel=1e-5), text
        else:
            assert ids == other, text
        assert own.decode(ids) == lib.decode(ids), text


def test_frames(spark):
    rows = [(i, t, "k") for i, t in enumerate(CASES)] + [(99, None, None), (3, CASES[3], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = fst.encode(df, check="back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == (None if r.text is None else LIB.encode(r.text))
        assert r.back == (None if r.text is None else "▁" not in r.text)
    coded = fst.encode(df).drop("text")
    back = {r.doc_id: r.text for r in fst.decode(coded).collect()}
    assert all(back[i] == (t if t is None else t.replace("▁", " ")) for i, t, _ in rows)
    assert fst.encode(df.limit(0)).count() == 0
