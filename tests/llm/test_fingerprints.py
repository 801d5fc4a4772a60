"""Operator 6 against a plain statement of it."""

import hashlib
import math
import random

import numpy as np
import pytest

from reportmill.llm.ctph import LETTERS, RUN, block_sizes, fingerprint_documents, fingerprints, likeness

SCHEMA = "doc_id long, text string, ord string, bucket string, tail string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_cuts(data, mask):
    """Ends of chunks before the last one, from the rolling hash of each seven bytes."""
    out = []
    for i in range(6, len(data)):
        h = sum(data[i - j] * pow(0x01000193, j + 1, 1 << 32) for j in range(7)) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        h ^= h >> 12
        if h & mask == mask:
            out.append(i + 1)
    return out


def test_boundaries():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcdefgh ") for _ in range(n)) for n in (0, 1, 6, 7, 300, 999, 5000)]
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    size, one, two = fingerprints(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, s, a, b in zip(texts, size, one, two, strict=True):
        assert s == 1 << max(2, math.ceil(math.log2(max(len(text), 1) / 50)))
        for signature, mask in ((a, s - 1), (b, 2 * s - 1)):
            cuts = plain_cuts(text, int(mask))[:63]
            assert len(signature) == len(cuts) + (len(text) > (cuts[-1] if cuts else 0))
    assert block_sizes(np.array([0, 200, 201, 10**6])).tolist() == [4, 4, 8, 32768]


def test_likeness_is_edit_distance():
    r = random.Random(5)
    word = lambda n: bytes(r.choice(LETTERS[:5].tobytes()) for _ in range(n))
    pairs = [(word(r.randint(0, 64)), word(r.randint(0, 64))) for _ in range(200)] + [(b"", b""), (b"AB", b"")]
    for (a, b), got in zip(pairs, likeness(*map(list, zip(*pairs, strict=True))), strict=True):
        want = 1 - distance(a, b) / max(len(a), len(b), 1)
        common = any(a[i : i + 4] in b for i in range(len(a) - 3))
        assert got == pytest.approx(want if common or min(len(a), len(b)) < 8 else 0.0)


def test_documents(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé漢😀") for _ in range(r.randint(1, 8)))
    rows = [(3 * i, " ".join(word() for _ in range(r.choice([0, 3, 50, 400])))) for i in range(70)]
    rows += [(1000, None), (1001, rows[5][1]), (1002, rows[6][1] + " more")]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA).repartition(4)
    got = {x.doc_id: x for x in fingerprint_documents(df).collect()}
    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if edited == text:
            assert x.fingerprint == x.edited_fingerprint and x.near_edited == 1
    assert got[1001].fingerprint == got[15].fingerprint and got[1002].near_edited > 0


def test_one_empty_and_repeated(spark):
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    x = fingerprint_documents(spark.createDataFrame([(4, "hello there " * 30, "", "", "")], SCHEMA)).first()
    assert x.near_next == 1.0 and x.n_chars == 360
    rows = [(1, "a b c", "", "", ""), (1, "a b c", "", "", ""), (None, "x y", "", "", ""), (None, None, "", "", "")]
    assert sorted((x.doc_id is None, x.n_chars) for x in fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()) == [(False, 5), (False, 5), (True, 0), (True, 3)]


def plain_likeness(a, b):
    n, m = len(a), len(b)
    if min(n, m) >= 2 * RUN and not any(a[i : i + RUN] in b for i in range(n - RUN + 1)):
        return 0.0
    return 1 - distance(a, b) / max(n, m, 1)


def plain_compare(f, g):
    """Of two shown fingerprints: at the same block size both signatures, at twice the size those of that size."""
    (s, a1, a2), (t, b1, b2) = ((int(x), y, z) for x, y, z in (v.split(":") for v in (f, g)))
    pairs = [(a1, b1), (a2, b2)] if s == t else [(a1, b2)] if s == 2 * t else [(a2, b1)] if t == 2 * s else []
    return max([0.0, *(plain_likeness(a, b) for a, b in pairs)])


def test_documents_end_to_end(spark):
    """Edited texts, and the likeness to them and to the next documents, against plain loops over all documents."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdé𝒳") for _ in range(r.randint(1, 7)))
    texts = [" ".join(word() for _ in range(r.choice([0, 3, 80, 400]))) for _ in range(25)]
    texts += [texts[2], texts[2] + " and more", texts[3], None, "", "x" * 3000]
    df = spark.createDataFrame([(7 * i, t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {x.doc_id // 7: x for x in fingerprint_documents(df).collect()}
    texts = [t or "" for t in texts]
    own = {i: got[i].fingerprint for i in got}
    for i, t in enumerate(texts):
        after = (i + 1) % len(texts)
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x.near_edited == pytest.approx(plain_compare(x.fingerprint, x.edited_fingerprint))
        assert x.near_next == pytest.approx(plain_compare(x.fingerprint, own[after]))
    assert all((own[i] == own[j]) or texts[i] != texts[j] for i in own for j in own)
    assert sum(x.near_edited > 0 for x in got.values()) > 5
