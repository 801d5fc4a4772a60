"""Which windows of W units (words or bytes) also start earlier in the corpus: the plan that two operators share.

1. Every window has one trigger: a gram inside it that its rolling hash picks (Rule.modulus). Neighbouring windows with the
   same trigger form a phrase, so a text parses into phrases that overlap by W - 1 units and any window lies in one
   phrase only. Equal windows have equal triggers, wherever they are.
2. Phrases go, as hashes, to the bucket of their trigger. There the first occurrence of each phrase in corpus order
   is found; all windows of its later occurrences are repeats. A map task first combines its own phrases, so a
   phrase that a third of all documents share reaches a bucket once a task.
3. Different phrases with one trigger may share some windows. Their first occurrences send their text to the bucket,
   which compares window by window. A trigger with very many different phrases (Rule.hot) is compared by window hashes
   dealt out by window instead, with the same result, so that no bucket holds a hot trigger whole.

Decisions are rows (ord, v): v holds a phrase's number in its document (plus the text's checksum, so that rows that
share an id stay apart) and a range of windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ROUTED, U64, by_route, dealt, gather, grouped, lists, mix, order_key, partitions, planes, powers, prefix_sums,
    records, routed, slices, span_hash, utf8, word_hashes, words, written,
)

ENTRY = np.dtype([("a", "<u8"), ("p", "<u8"), ("d", "<i8"), ("r", "<u4")])
DECISION = np.dtype([("d", "<i8"), ("v", "<i8")])
HEAD = np.dtype([("d", "<i8"), ("s", "<u8"), ("r", "<u4"), ("n", "<u4"), ("t", "<u4")])
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("d", "<i8"), ("s", "<u8"), ("r", "<u4"), ("o", "<u4")])
FULL, BY_TEXT, BY_WINDOW = 0xFFFF, 0xFFFF0000, 0xFFFF0001
DECISIONS = "ord long, v long"


@dataclass(frozen=True)
class Rule:
    """unit: 'word' or 'byte'. within: an earlier place in the same document counts too.
    modulus: a window's trigger is its first gram whose rolling hash it divides, if there is one; for 0 and elsewhere the
    gram of least hash. classes(units, first, trigger, window) numbers the windows of phrases that begin at first (and the
    last ends at first[-1]) and have their trigger so many units on, one phrase after the other, so that equal windows
    have equal numbers. hot: a trigger with more different phrases is compared by window hashes."""

    unit: str
    window: int
    gram: int
    within: bool
    classes: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
    hot: int = 20_000
    modulus: int = 0


def units(rule: Rule, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end byte of each unit, and the first unit of each row."""
    if rule.unit == "byte":
        at = np.arange(len(data) + 1)
        return data, at[:-1], at[1:], offsets
    start, end, first = words(data, offsets)
    return word_hashes(data, start, end), start, end, first


def as_hash(u: np.ndarray) -> np.ndarray:
    return mix((u.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)) if u.dtype == np.uint8 else u


def cuts(first: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Blocks of whole rows; a longer row is cut at multiples of the block from its own start, wherever it lies."""
    edges, at = [0], 0
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - at > block:
            edges += [a] if a > at else []
            edges += list(range(a + block, b, block))
            at = edges[-1]
    edges.append(int(first[-1]))
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def phrases(rule: Rule, u: np.ndarray, first: np.ndarray, block: int = 1 << 17) -> dict[str, np.ndarray]:
    """Of each phrase: its row (doc), number in the row (i), first and last window (lo, hi), trigger (a), how far on it is (t) and content (p)."""
    w, g = rule.window, rule.gram
    valid = np.zeros(len(u) + 2, np.int8)
    long = np.flatnonzero(np.diff(first) >= w)
    valid[first[long] + 1] += 1
    valid[first[long + 1] - w + 2] -= 1
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)  # with one place before the first
    found = []
    for at, to in cuts(first, block):
        to = min(to, len(u) - w + 1)
        ok = valid[at + 1 : to + 1]
        if not ok.any():
            continue
        part = as_hash(u[at : to + w - 1])
        c = prefix_sums(part)
        n = len(part) - g + 1
        h = mix((c[g:] - c[:-g]) * powers(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        m = (h & ~U64((1 << 18) - 1)) | np.arange(n, dtype=U64)
        size, span = 1, w - g + 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if span > size:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        trigger = (m & U64((1 << 18) - 1)).astype(np.int64)
        if rule.modulus:
            hit = np.where(h % U64(rule.modulus) == 0, np.arange(n), 1 << 30)
            hit = np.minimum.accumulate(hit[::-1])[::-1][: len(trigger)]
            trigger = np.where(hit < np.arange(len(trigger)) + span, hit, trigger)
        same = np.zeros(len(ok) + 1, bool)
        same[1:-1] = (trigger[1:] == trigger[:-1]) & ok[1:] & ok[:-1]
        lo, hi = np.flatnonzero(ok & ~same[:-1]), np.flatnonzero(ok & ~same[1:])
        a = trigger[lo]
        p = span_hash(c, lo, hi + w) ^ mix(((hi - lo).astype(U64) << U64(20)) + (a - lo).astype(U64))
        found.append((lo + at, hi + at, h[a], mix(p), a - lo))
    lo, hi, a, p, t = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, U64, U64, np.int64))
    doc = np.searchsorted(first, lo, "right") - 1
    return {"doc": doc, "i": np.arange(len(doc)) - np.searchsorted(doc, doc), "lo": lo, "hi": hi, "a": a, "p": p, "t": t}


def parsed(rule: Rule, batch: pa.RecordBatch, text: int) -> tuple[dict[str, np.ndarray], tuple]:
    data, offsets = utf8(batch.column(text))
    unit = units(rule, data, offsets)
    ph = phrases(rule, unit[0], unit[3])
    check = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.uint32)
    ph["r"] = ph["i"].astype(np.uint32) + check[ph["doc"]]
    if not rule.within:  # equal phrases of one document share the first one's decision
        order = np.lexsort((ph["p"], ph["a"], ph["doc"]))
        x = [ph[k][order] for k in ("doc", "a", "p")]
        new = np.ones(len(order), bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in x], axis=0)
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        ph["r"][order] = ph["r"][order][head]
    return ph, (data, offsets, *unit)


def vote(d: np.ndarray, r: np.ndarray, what: int | np.ndarray) -> np.ndarray:
    out = np.empty(len(d), DECISION)
    out["d"], out["v"] = d, ((r.astype(U64) << U64(32)) | np.asarray(what, U64)).view(np.int64)
    return out


def first_of_each(e: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by trigger, phrase and place; those that come first for their phrase, and the repeats."""
    e = e[np.lexsort((e["d"], e["p"], e["a"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["p"][1:] != e["p"][:-1])
    head = e[np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))]
    repeat = e["d"] > head["d"]
    if within:
        repeat |= (e["d"] == head["d"]) & (e["r"] != head["r"])
    return e, new, repeat


def by_bucket(route: np.ndarray, e: np.ndarray, kind: int, out: list) -> None:
    for r, at in zip(*grouped(route), strict=True):
        out.append((int(r), kind, planes(e[at])))


def to_triggers(rule: Rule, buckets: int) -> Callable:
    """Rows (ord, text, ...) to phrase entries (kind 0) by trigger, and what is already decided (kind 1)."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        e, new, repeat = first_of_each(np.concatenate(held), rule.within)
        out: list = []
        send = e[new]
        send = send[np.argsort(send["d"], kind="stable")]
        by_bucket((send["a"] >> U64(20)) % U64(buckets), send, 0, out)
        done = np.unique(vote(e["d"][repeat], e["r"][repeat], FULL))
        by_bucket(done["d"] % buckets, done, 1, out)
        return routed(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, 1):
            ph, _ = parsed(rule, batch, 1)
            e = np.empty(len(ph["doc"]), ENTRY)
            e["a"], e["p"], e["d"], e["r"] = ph["a"], ph["p"], batch.column(0).to_numpy()[ph["doc"]], ph["r"]
            held.append(e)
            n += len(e)
            if n > 600_000:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def decisions(rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(rows["d"])), pa.array(np.ascontiguousarray(rows["v"]))], ["ord", "v"])


def at_triggers(rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_route(batches):
            for blob in held.get(1, ()):
                yield decisions(records(blob, DECISION))
            if 0 not in held:
                continue
            e, new, repeat = first_of_each(np.concatenate([records(b, ENTRY) for b in held[0]]), False)
            yield decisions(np.unique(vote(e["d"][repeat], e["r"][repeat], FULL)))
            trigger = np.ones(len(e), bool)
            trigger[1:] = e["a"][1:] != e["a"][:-1]
            number = np.cumsum(trigger) - 1
            different = np.bincount(number[new], minlength=number[-1] + 1)[number]
            ask = ~repeat & (different > 1)
            how = np.where(different[ask] > rule.hot, BY_WINDOW, BY_TEXT)
            yield decisions(np.unique(vote(e["d"][ask], e["r"][ask], how)))

    return run


def placed(ph: dict, votes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (phrase, 32-bit range or request) for the decisions of each row."""
    v, offsets = lists(votes)
    v = v.view(U64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(U64)
    key = (ph["doc"].astype(U64) << U64(32)) | ph["r"].astype(U64)
    order = np.argsort(key, kind="stable")
    want = (doc << U64(32)) | (v >> U64(32))
    lo, hi = np.searchsorted(key[order], want), np.searchsorted(key[order], want, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return order[at], np.repeat(v & U64(0xFFFFFFFF), n)


def to_compare(rule: Rule, buckets: int) -> Callable:
    """Rows (ord, text, votes) to the phrases that were asked for: text by trigger (kind 0), windows by hash (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ph, (data, _, u, start, end, _) = parsed(rule, batch, 1)
            at, how = placed(ph, batch.column(2))
            at, one = np.unique(at, return_index=True)
            how = how[one]
            d = batch.column(0).to_numpy()[ph["doc"]]
            first = np.searchsorted(ph["doc"], ph["doc"])
            place = ph["lo"] - ph["lo"][first] if len(first) else ph["lo"]
            if not rule.within:  # of equal phrases in a document one is enough
                _, one = np.unique(np.stack([ph["doc"][at], ph["r"][at]]), axis=1, return_index=True) if len(at) else (0, np.zeros(0, int))
                at, how = at[one], how[one]
            out: list = []
            text = at[how == BY_TEXT]
            for r, part in zip(*grouped((ph["a"][text] >> U64(20)) % U64(buckets)), strict=True):
                part = text[part]
                bytes_, ends = gather(data, start[ph["lo"][part]], end[ph["hi"][part] + rule.window - 1])
                head = np.empty(len(part), HEAD)
                head["d"], head["s"], head["r"], head["n"], head["t"] = d[part], place[part], ph["r"][part], np.diff(ends, prepend=0), ph["t"][part]
                out.append((int(r), 0, len(part).to_bytes(4, "little") + planes(head) + bytes_.tobytes()))
            if len(hot := at[how == BY_WINDOW]):
                n = ph["hi"][hot] - ph["lo"][hot] + 1
                o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = np.repeat(hot, n)
                s = ph["lo"][k] + o
                c, c2 = prefix_sums(as_hash(u)), prefix_sums(mix(as_hash(u) + U64(77)))
                x = np.empty(len(k), WINDOW)
                x["h1"], x["h2"] = mix(span_hash(c, s, s + rule.window)), mix(span_hash(c2, s, s + rule.window))
                x["d"], x["s"], x["r"], x["o"] = d[k], place[k] + o, ph["r"][k], o
                x, repeat = seen_before(rule, x, np.lexsort((x["s"], x["d"], x["h2"], x["h1"])), ("h1", "h2"))
                done = ranges(x["d"][repeat], x["r"][repeat], x["o"][repeat])
                by_bucket(done["d"] % buckets, done, 1, out)
                x = x[~repeat]
                by_bucket((x["h1"] >> U64(20)) % U64(buckets), x, 2, out)
            yield routed(out)

    return run


def seen_before(rule: Rule, x: np.ndarray, order: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """In the order by class and place: the windows that are not the first of their class."""
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = np.any([x[k][1:] != x[k][:-1] for k in by], axis=0)
    head = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
    repeat = x["d"] > head["d"]
    if rule.within:
        repeat |= (x["d"] == head["d"]) & (x["s"] > head["s"])
    return x, repeat


def ranges(d: np.ndarray, r: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Decisions for windows o of phrases (d, r), neighbours joined."""
    order = np.lexsort((o, r, d))
    d, r, o = d[order], r[order], o[order].astype(np.int64)
    new = np.ones(len(d) + 1, bool)
    new[1:-1] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (o[1:] > o[:-1] + 1)
    lo, hi = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
    return vote(d[lo], r[lo], (o[lo].astype(U64) << U64(16)) | o[hi].astype(U64))


def at_compare(rule: Rule) -> Callable:
    small = np.dtype([("c", "<u8"), ("d", "<i8"), ("s", "<u8"), ("r", "<u4"), ("o", "<u4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_route(batches):
            for blob in held.get(1, ()):
                yield decisions(records(blob, DECISION))
            if 2 in held:
                x = np.concatenate([records(b, WINDOW) for b in held[2]])
                x, repeat = seen_before(rule, x, np.lexsort((x["s"], x["d"], x["h2"], x["h1"])), ("h1", "h2"))
                yield decisions(ranges(x["d"][repeat], x["r"][repeat], x["o"][repeat]))
            if 0 in held:
                heads, texts = [], []
                for b in held[0]:
                    n = 4 + HEAD.itemsize * int.from_bytes(b[:4], "little")
                    heads.append(records(b[4:n], HEAD))
                    texts.append(b[n:])
                head = np.concatenate(heads)
                data = np.frombuffer(b"".join(texts), np.uint8)
                u, _, _, first = units(rule, data, np.concatenate([[0], np.cumsum(head["n"].astype(np.int64))]))
                n = np.maximum(np.diff(first) - rule.window + 1, 0)
                o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = np.repeat(np.arange(len(head)), n)
                x = np.empty(len(k), small)
                x["c"] = rule.classes(u, first, head["t"].astype(np.int64), rule.window)
                x["d"], x["s"], x["r"], x["o"] = head["d"][k], head["s"][k] + o.astype(U64), head["r"][k], o
                x, repeat = seen_before(rule, x, np.lexsort((x["s"], x["d"], x["c"])), ("c",))
                yield decisions(ranges(x["d"][repeat], x["r"][repeat], x["o"][repeat]))

    return run


def repeated(rule: Rule, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with ord and votes: the decisions on each row, for cover()."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("ord", order_key(F.col("doc_id"), F.col("text")))
    known = written(dealt(docs.select("ord", "text").mapInArrow(to_triggers(rule, buckets), ROUTED)).mapInArrow(at_triggers(rule), DECISIONS), "phrases")
    asked = F.shiftright("v", 16).bitwiseAND(0xFFFF) == 0xFFFF
    ask = known.filter(asked).groupBy("ord").agg(F.collect_list("v").alias("votes"))
    again = docs.join(ask, "ord").select("ord", "text", "votes").mapInArrow(to_compare(rule, buckets), ROUTED)
    final = known.filter(~asked).unionByName(dealt(again).mapInArrow(at_compare(rule), DECISIONS))
    return docs.join(final.groupBy("ord").agg(F.collect_list("v").alias("votes")), "ord", "left").select("doc_id", "text", "votes")


def cover(rule: Rule, batch: pa.RecordBatch) -> tuple[np.ndarray, tuple]:
    """Whether each unit of the rows (doc_id, text, votes) is covered by a repeated window; and the parsed units."""
    ph, unit = parsed(rule, batch, 1)
    at, what = placed(ph, batch.column(2))
    lo, hi = (what >> U64(16)).astype(np.int64), (what & U64(0xFFFF)).astype(np.int64)
    lo, hi = ph["lo"][at] + lo, np.minimum(ph["lo"][at] + hi, ph["hi"][at])
    change = np.zeros(len(unit[2]) + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + rule.window, -1)
    return np.cumsum(change)[:-1] > 0, unit
