"""The codec against the library, for the BPE model and for a unigram model of the same pieces."""

import pytest
from pyspark.sql import functions as F

from lobspark.llm import sentencepiece_codec as sc

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["Hello  world, ünï 漢字 🙂 x", "a" * 300, " lead and trail ", "tab\tand\nline  " * 40, "", "the quick brown fox " * 90, "word " * 30 + "▁ ▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=sc.read_model(sc.MODEL))


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces scored as a unigram model: nothing is trained, only the model's type is set."""
    proto = sc._proto(sc.read_model(sc.MODEL))
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -8.0 - (int(-p.score) % 64) / 16 if p.score > -1e6 else -16.0
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_giant_texts_match_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[5], TEXTS[5]])]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for giant in (40, 1 << 20):
        got = sc.round_trip(d, giant_chars=giant).collect()
        assert len(got) == len(rows)
        for r in got:
            t = rows[r["doc_id"]][1]
            assert r["ids"] == (None if t is None else library.encode(t)) and r["exact"]
    assert sc.round_trip(d.where("false")).count() == 0


def test_giant_text_that_ends_in_one_space_at_the_cut(spark, library):
    rows = ["aaa " + "b" * 70_000 + " ", "c" * 70_000 + " ", "c" * 70_000 + "  ", "word " * 20_000, "d" * 70_000 + "▁ ▁ word"]
    assert sc.split("aaa bbb ", 5) == ["aaa bbb "] and sc.split("word▁ ▁ word", 3) == ["word▁ ▁ word"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in sc.round_trip(d).collect():
        assert r["ids"] == library.encode(rows[r["doc_id"]]) and r["exact"]


def test_scan_matches_the_library(unigram):
    model = sc.read_model(unigram)
    sp, scan = sentencepiece.SentencePieceProcessor(model_proto=model), sc.MaxPlusScan(model)
    for t in TEXTS:
        assert scan.encode(t, size=16) == sp.encode(t) == scan.encode(t, size=10_000)


def test_combination_is_associative(unigram):
    scan = sc.MaxPlusScan(sc.read_model(unigram))
    a, b, c = (scan.transfer(*p) for p in scan.chunks(scan.normal("some text that is long enough to be cut in three pieces or more"), 16)[:3])
    left, right = scan.combine(scan.combine(a, b), c), scan.combine(a, scan.combine(b, c))
    assert ((left == right) | (abs(left - right) < 1e-9)).all()


def test_distributed_scan(spark, unigram):
    sp = sentencepiece.SentencePieceProcessor(model_proto=sc.read_model(unigram))
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sc.encode(d, model_path=unigram, giant_chars=30).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: sp.encode(t) for i, t in enumerate(TEXTS)}


def test_models_that_cannot_be_cut_are_refused():
    proto = sc._proto(sc.read_model(sc.MODEL))
    proto.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError):
        sc.check_cuts(proto.SerializeToString())
    assert sc.split("aaa bbb  ccc", 2) == ["aaa", " bbb", "  ccc"]
    assert F.lit(1) is not None
