"""Operator 4: held-out accuracy, mixtures and the edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from reportmill.llm.fuzzy_lines import line_dedup
from reportmill.llm.langid import identify, mixtures

SCHEMA = "doc_id long, text string, lang string, source string, _text string"
ENDINGS = {"aa": ("ing", "the", "tion"), "bb": ("ung", "sch", "keit"), "cc": ("eux", "ait", "ois"), "zz": ("ção", "ões", "nho")}


def word(r, lang):
    return "".join(r.choice("abcdefgilmnoprstu") for _ in range(r.randint(1, 4))) + r.choice(ENDINGS[lang])


def corpus(n=500):
    r = random.Random(9)
    out = []
    for i in range(n):
        lang = r.choice(sorted(ENDINGS))
        out.append((i, " ".join(word(r, lang) for _ in range(r.randint(3, 120))), lang, "s", "x"))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    data = corpus()
    hidden = [(i, t, lang if not held(i) else "wrong", s, x) for i, t, lang, s, x in data]  # held-out labels are never read
    got = {x.doc_id: x for x in identify(spark.createDataFrame(hidden, SCHEMA).repartition(3)).collect()}
    out = [got[i].lang_pred == lang for i, _, lang, _, _ in data if held(i)]
    assert len(out) > 80 and np.mean(out) > 0.97
    assert all(0 <= x.score <= 1 and abs(sum(x.langs.values()) - 1) < 1e-3 for x in got.values())


def test_mixture(spark):
    r = random.Random(3)
    both = " ".join([word(r, "aa") for _ in range(150)] + [word(r, "bb") for _ in range(250)])
    rows = [*corpus(), (10_000, both, None, "s", "x"), (10_001, " ".join(word(r, "cc") for _ in range(300)), None, None, None)]
    got = {x.doc_id: x for x in identify(spark.createDataFrame(rows, SCHEMA)).filter("doc_id >= 10000").collect()}
    assert set(got[10_000].langs) == {"aa", "bb"} and got[10_000].lang_pred == "bb"
    assert 0.5 < got[10_000].score < 0.75
    assert set(got[10_001].langs) == {"cc"}


def test_undecided_and_empty(spark):
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [*corpus(60), (901, None, None, None, None), (902, "", "aa", None, None), (903, "12 34 -- !", "aa", None, None), (None, "tion ing the", None, None, None), (904, "漢字", None, None, None), (905, "、。", None, None, None)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[901] == got[902] == got[903] == got[905] == ("und", 0.0)
    assert got[None][0] == "aa" and got[904][0] != "und"
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", "x")], SCHEMA)
    assert [(x.lang_pred, x.score) for x in identify(unlabelled).collect()] == [("und", 0.0)]
    twice = identify(spark.createDataFrame(corpus(60) + corpus(60), SCHEMA), ("doc_id", "source", "_text")).drop("langs").distinct().count()
    assert twice == 60


def test_expectation_maximisation_raises_the_likelihood():
    r = np.random.default_rng(1)
    likely = r.random((400, 3)).astype(np.float32)
    likely[:250, 0] = 1.0
    share = mixtures(likely, np.array([0, 200]), np.array([200, 200]), steps=40)
    flat = np.full(3, 1 / 3)
    for k, s in enumerate(share):
        p = likely[200 * k : 200 * k + 200]
        assert np.log(p @ s).sum() >= np.log(p @ flat).sum() - 1e-3


def test_columns_that_would_be_there_twice(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1)], "doc_id long, text string, lang string, lang_pred string, kept int")
    with pytest.raises(ValueError, match="lang_pred"):
        identify(docs, ("doc_id", "lang_pred"))
    with pytest.raises(ValueError, match="kept"):
        line_dedup(docs, columns=("doc_id", "kept"))
    assert identify(docs).count() == 1  # other columns may have any names


def plain_mixture(likely, steps=6, penalty=1.0):
    """One document's EM and backward selection, word by word: shares by language."""
    n, languages = len(likely), len(likely[0])

    def fit(share):
        for _ in range(steps):
            total = [0.0] * languages
            for word in likely:
                q = [p * s for p, s in zip(word, share, strict=True)]
                total = [t + x / max(sum(q), 1e-30) for t, x in zip(total, q, strict=True)]
            share = [t / n for t in total]
        return share, sum(math.log(max(sum(p * s for p, s in zip(word, share, strict=True)), 1e-30)) for word in likely)

    share, value = fit([1 / languages] * languages)
    while sum(s > 0 for s in share) > 1:
        least = min((i for i, s in enumerate(share) if s > 0), key=lambda i: share[i])
        less = [0 if i == least else s for i, s in enumerate(share)]
        new, reached = fit([s / sum(less) for s in less])
        if reached + penalty + math.log(n) < value:
            break
        share, value = new, reached
    return share


def test_mixtures_are_those_of_a_loop():
    """Documents of one to forty words, together and alone; two languages that are the same leave in their order."""
    r = np.random.default_rng(4)
    sizes = np.array([1, 2, 5, 40, 17, 3])
    likely = r.random((sizes.sum(), 4)).astype(np.float32) ** 4
    likely[8:48, 1] = 1  # the document of forty words is of language 1
    likely[:, 3] = likely[:, 2]
    likely /= likely.max(axis=1, keepdims=True)
    first = np.cumsum(sizes) - sizes
    got = mixtures(likely, first, sizes)
    for i, (lo, n) in enumerate(zip(first, sizes, strict=True)):
        want = plain_mixture(likely[lo : lo + n].astype(float).tolist())
        assert np.allclose(got[i], want, atol=2e-3)
        assert np.allclose(got[i], mixtures(likely[lo : lo + n], np.array([0]), np.array([n]))[0], atol=1e-5)
    assert got[3].argmax() == 1
