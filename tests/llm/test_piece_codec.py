"""Piece encoding against the library, and back."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from strata.llm import piece_codec as P
from tests.llm.helpers import ODD, PROSE, documents

STRANGE = ["Hello  world", "a\nb", " lead", "tab\tx", "▁x", "é ﬁ 日本語 \u3000 z", "  ", "end  ", "   a      b                 c", "<s> </s> <0x41>", "\n\n  \n a", PROSE]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    return [x or "" for x in ODD] + STRANGE + ["".join(rng.choice("abcdehilorstn  \né日🙂.,1") for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def ids(coded):
    return [np.frombuffer(x, "<u4").tolist() for x in coded]


def test_bpe_ids_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    coder = P.PieceCodec(P.default_model())
    coded = coder.encode(texts())
    assert ids(coded) == library.encode(texts())
    assert [coder.decode(x) for x in coded] == [t.replace("▁", " ") for t in texts()]


def test_unigram_scores_are_the_librarys():
    model = pb.ModelProto()
    model.ParseFromString(open(P.default_model(), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -2.0 - (hash_of(p.piece) % 10_000) / 1000.0
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    coder = P.PieceCodec(proto=model.SerializeToString())
    some = [t for t in texts(2) if t.isascii() and "\n" not in t and "\t" not in t and "\x1c" not in t][:200]
    score = lambda xs: sum(model.pieces[i].score for i in xs)  # noqa: E731  ties may be cut in either way
    for got, want in zip(ids(coder.encode(some)), library.encode(some)):
        assert score(got) == pytest.approx(score(want), abs=1e-3)


def hash_of(text):
    return int.from_bytes(text.encode()[-8:], "little") * 2654435761 % 2**32


def test_caches_may_be_full(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 5)
    monkeypatch.setattr(P, "CACHE_PAIRS", 5)
    coder = P.PieceCodec(P.default_model())
    assert [coder.decode(coder.encode([t])[0]) for t in texts()] == [t.replace("▁", " ") for t in texts()]


def test_ids_of_a_table_are_the_librarys_whatever_the_chunks(spark):
    some = texts(3, 60)
    library = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    for chunk in (100, 5_000, 1 << 20):
        got = {r.doc_id: r.ids for r in P.encode(documents(spark, some), chunk=chunk).collect()}
        assert [got[i] for i in range(len(some))] == library.encode(some), chunk


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, None), (4, None), (4, "a b")], "doc_id long, text string").coalesce(1).checkpoint()
    assert sorted((str(r.doc_id), r.n_ids, r.same) for r in P.encode(docs).collect()) == [("4", 0, True), ("4", 0, True), ("4", 2, True), ("None", 2, True)]


def test_table_round_trip(spark):
    docs = documents(spark, [*ODD, PROSE, PROSE]).withColumnRenamed("lang", "ids")
    coded = P.encode(docs)
    back = P.decode(coded, out="back").select("doc_id", "back", "same").collect()
    want = [x or "" for x in ODD] + [PROSE] * 2
    assert {r.doc_id: (r.back, r.same) for r in back} == {i: (t, True) for i, t in enumerate(want)}
    assert P.encode(documents(spark, [])).count() == 0
