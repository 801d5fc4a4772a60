"""Operator 13 against the library itself."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from reportmill.llm import tokencount
from reportmill.llm.tokencount import Shortcut, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def held():
    with open(MODEL, "rb") as f:
        return f.read()


def library(texts):
    return [len(x) for x in SentencePieceProcessor(model_file=MODEL).encode(texts)]


def odd_texts(n):
    r = random.Random(5)
    some = ["the", " and", " Straße", "ing", ",", ".", "...", "»,", "²", "\n", "\t", "  ", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "日本語", "Ж", "é", "ﬁ", "é", "\0", "\U0001f600", "0", "12", "x" * 9]
    return ["".join(r.choice(some) for _ in range(r.randrange(40))) for _ in range(n)]


def test_against_the_library(held):
    texts = ["", None, " ", "    ", "a", "▁", "\n", *odd_texts(3000)]
    assert Shortcut(held).count(texts) == library([t or "" for t in texts])


def test_windows_and_long_pretokens(held, monkeypatch):
    """Texts of many windows, without any space, and more pre-tokens than a worker remembers."""
    monkeypatch.setattr(tokencount, "WINDOW", 50)
    monkeypatch.setattr(tokencount, "REMEMBERED", 20)
    texts = [" ".join(odd_texts(60)), "".join(odd_texts(300)).replace(" ", ""), "ab" * 5000, " " * 3000, "日本" * 2000]
    assert Shortcut(held).count(texts) == library(texts)


def test_what_is_proved_is_not_merged(held, monkeypatch):
    s = Shortcut(held)
    given = []
    monkeypatch.setattr(s, "merged", lambda parts, f=s.merged: given.extend(parts) or f(parts))
    assert s.count(["the house, and the garden.", "the house"]) == library(["the house, and the garden.", "the house"])
    assert not {" the", " house", " and", " garden"} & set(given)
    assert all(len(SentencePieceProcessor(model_proto=held).encode(x[1:])) == 1 for x in list(s.one)[::50] if x[0] == " " and len(x) > 1 and x[1] != " ")


def test_models_without_a_proof(held):
    for change in ("whitespace", "own"):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(held)
        if change == "whitespace":
            spec.normalizer_spec.remove_extra_whitespaces = True
        else:
            spec.pieces[500].type = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
        with pytest.raises(ValueError):
            Shortcut(spec.SerializeToString())


def test_table(spark):
    texts = [None, "", "a b", "a b", "word " * 5000, "é" * 9, *odd_texts(50)]
    rows = [(i if i != 1 else None, t, "x", 7) for i, t in enumerate(texts)] + [(3, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long").repartition(3)
    got = sorted(map(tuple, token_counts(docs, MODEL).collect()), key=str)
    n = library([t or "" for _, t, _, _ in rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 4096) for (i, t, _, _), k in zip(rows, n, strict=True)), key=str)
    assert token_counts(docs, MODEL, 2, ("doc_id", "lang")).columns == ["doc_id", "lang", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, MODEL, columns=("doc_id", "n_tokens"))
