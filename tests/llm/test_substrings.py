"""Operators 3 and 8 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from reportmill.llm.pfp_dedup import sorted_strings, suffix_dedup, window_ranks
from reportmill.llm.rlz_dedup import substring_dedup

SCHEMA = "doc_id long, text string, ord string, votes string"


def by_words(rows, window):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if first.setdefault(key, i) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def by_bytes(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(b[k : k + window])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed=1, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéßfgh") for _ in range(r.randint(1, 7)))
    hot = " ".join(word() for _ in range(40))
    passages = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        parts.insert(r.randint(0, 3), hot if i % 3 == 0 else r.choice(passages))
        if i % 7 == 0:
            parts.append(r.choice(passages) + "\n" + r.choice(passages))
        text = r.choice([" ", "\n", "\t  "]).join(parts)
        rows.append((i * 3, text if i % 11 else r.choice(rows)[1] if rows else text))
    rows += [(1001, None), (1002, ""), (1003, "ab" * 400), (1004, "x " * 300), (1005, "nul\0byte " * 60), (1006, "  \n "), (1007, "z" * 300_000 + " " + hot)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(*x, "a", None) for x in rows], SCHEMA).repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in substring_dedup(df, hot=hot).collect()}
    assert got == by_words(rows, 13)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_bytes(spark, hot):
    rows = corpus(2)
    df = spark.createDataFrame([(*x, "a", None) for x in rows], SCHEMA).repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in suffix_dedup(df, hot=hot).collect()}
    assert got == by_bytes(rows, 100)


def test_spans_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "", ""), (1, text, "", ""), (2, "a " + text + " b", "", ""), (None, text, "", "")]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_removed, [(s.start, s.end) for s in x.spans]) for x in got) == [
        (False, 1, 0, []), (False, 1, 0, []), (False, 2, 20, [(1, 21)]), (True, 0, 20, [(0, 20)]),
    ]
    long = "abcdefghij" * 3 + text + text
    rows = [(1, long, "", ""), (1, long, "", ""), (None, long, "", "")]
    got = sorted((x.doc_id is None, x.n_removed, x.n_bytes) for x in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[0] == got[1] and got[2][1] == got[2][2]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(df).count() == 0 and suffix_dedup(df).count() == 0


def test_arrays_of_dictionary_and_parse():
    """Sorted suffixes and continuations with what neighbours share, and windows that are equal where both agree."""
    r = random.Random(6)
    parts = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(6, 16))) for _ in range(300)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    trigger = np.array([r.randrange(0, 3) for _ in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    rank, common = sorted_strings(data, first[:-1] + trigger, np.diff(first) - trigger, 1, 6)
    order = np.argsort(rank)
    after = [(p[t:] + bytes(6))[:6] for p, t in zip(parts, trigger, strict=True)]
    assert [after[k] for k in order] == sorted(after)
    assert all(after[a][:c] == after[b][:c] and (c >= 6 or after[a][c] != after[b][c]) for a, b, c in zip(order, order[1:], common[1:], strict=False))
    got = window_ranks(data, first, trigger, 6)
    want = [(t - o, p[o : o + 6]) for p, t in zip(parts, trigger.tolist(), strict=True) for o in range(len(p) - 5)]
    inside = [k for k, (left, _) in enumerate(want) if left >= 0]
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in inside[:200] for b in inside[:200])
