"""Operator 9: ids as the tokenizer gives them, gapless sequences, and as few as best fit makes."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reportmill.llm import packing
from reportmill.llm.packing import best_fit, encoder, pack, slots

SCHEMA = "doc_id long, text string, rank string, bucket string"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def one_by_one(lengths, size):
    """Best-fit decreasing, item by item: the number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(size - n)
        else:
            rooms[rooms.index(fit)] -= n
    return len(rooms)


def test_plan_is_best_fit():
    r = random.Random(6)
    for _ in range(60):
        size = r.choice([8, 50, 100])
        lengths = [r.randint(1, r.choice([size, size // 2])) for _ in range(r.randint(1, 300))]
        groups = best_fit(Counter(lengths), size)
        assert all(sum(n * k for n, k in items) <= size for _, items in groups)
        held = Counter()
        for many, items in groups:
            for n, k in items:
                held[n] += many * k
        assert held == Counter(lengths)
        assert sum(many for many, _ in groups) == one_by_one(lengths, size)
        assert slots(groups).shape[1] == 5
    assert best_fit({}, 10) == []


def test_both_encoders_agree():
    r = random.Random(3)
    slow, fast = Tokenizer.from_file(JSON), encoder(JSON, RANKS)
    chars = [chr(c) for c in range(0x250)] + list("  \n\n\t'sS'lL12.,") * 20
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "漢字 und ñ", "it's  we'll\r\n\r\n x", "\x1c \x1f\x85\xa0  ", " " * 50 + "x"]
    for text in texts:
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sent", [packing.SENT, 0])
def test_documents(spark, monkeypatch, sent):
    r = random.Random(4)
    words = ["the", "schön", "año", "naïve", "\n", "x1", "..", "漢"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 7, 40, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 4096), (503, "word " * 9000), (7, rows[7][1]), (None, "no id")]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(packing, "SENT", sent)
    got = pack(df, JSON, RANKS).collect()
    slow = Tokenizer.from_file(JSON)
    want, lengths = Counter(), []
    for i, text in rows:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        n = len(ids) % 2048 or 2048
        edges = [0, *range(n, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    assert all(zlib.crc32(bytes(x.ids)) == x.ids_crc32 for x in got)
    sequences = defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == one_by_one(lengths, 2048)


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), JSON, RANKS).count() == 0
