"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is a weighted set: its shingles of five words, weighted by how often they occur or by any function of that.
An element's region is the strip of the plane below its weight, over all ranks. A hash throws darts at the plane, one a
unit square on average and the same ones for every document; a document keeps those that fall below its weights and
below the rank bound that lets about `darts` of them through, and of those that fall to a coordinate the one of least
rank. Two signatures agree in a coordinate with the probability of their weighted Jaccard similarity, and cost one pass
over the darts instead of one per coordinate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, mix, order_key, prefix_sums, slices, span_hash, utf8, word_hashes, words, written
from .components import linked_groups, settled

Weigh = Callable[[np.ndarray], np.ndarray]
SIGNED = "ord long, doc_id long, sha long, c1 long, c2 long, bands array<long>"
SETS = "c1 long, c2 long, items binary, weights binary, mark binary, bands binary"
#: P(a square has more than n darts) for a mean of one, as thresholds of a 64-bit hash.
POISSON = np.array([min((1 << 64) - 1, int(sum(np.exp(-1.0) / factorial(j) for j in range(n + 1)) * 2.0**64)) for n in range(16)], np.float64).astype(U64)
#: An element is stored as so many bytes of its hash.
WIDE = 6


def counted(n: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs n times: n."""
    return n.astype(np.float64)


def elements(data: np.ndarray, offsets: np.ndarray, size: int, weigh: Weigh = counted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of the rows: row, hash and weight, by row and hash. Then two hashes of each row's words.

    A row of fewer words than a shingle has them all as its one shingle; a row without words has none.
    """
    start, end, first = words(data, offsets)
    h = word_hashes(data, start, end)
    n = np.diff(first)
    c, d = prefix_sums(h), prefix_sums(mix(h + U64(0x51)))
    c1, c2 = mix(span_hash(c, first[:-1], first[1:]) ^ n.astype(U64)), mix(span_hash(d, first[:-1], first[1:]) + n.astype(U64))
    k = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), k)
    at = np.repeat(first[:-1] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    shingle = mix(span_hash(c, at, np.minimum(at + size, first[row + 1])))
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1]))) if len(row) else row
    return row[new], shingle[new], weigh(np.diff(np.append(new, len(row)))), c1, c2


def throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coordinates: int, darts: float) -> np.ndarray:
    """The signature of each row: the least rank of its darts in each coordinate, as a 64-bit number.

    The plane is cut into unit squares of weight x rank; a square's darts come from a hash of element and square. Rows
    throw `darts` darts on average; those with an empty coordinate throw again over twice the ranks, and so on.
    """
    out = np.full(rows * coordinates, ~U64(0))
    total = np.bincount(row, weight, minlength=rows)
    low, high = np.zeros(rows), darts / np.maximum(total, 1e-300)
    layers = np.ceil(weight).astype(np.int64)
    live = total > 0
    while live.any():
        on = np.flatnonzero(live[row])
        a = np.floor(low[row[on]]).astype(np.int64)
        squares = layers[on] * (np.ceil(high[row[on]]).astype(np.int64) - a)
        ends = np.cumsum(squares)
        for lo, hi in batched(ends, 1 << 19):
            part, s = on[lo:hi], squares[lo:hi]
            which = np.repeat(part, s)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
            layer, rank = nth % layers[which], np.repeat(a[lo:hi], s) + nth // layers[which]
            seed = mix(element[which] + rank.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + layer.astype(U64) * U64(0x9E3779B97F4A7C15))
            n = np.searchsorted(POISSON, seed, "right")
            which, layer, rank, seed = (np.repeat(x, n) for x in (which, layer, rank, seed))
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(seed ^ (nth.astype(U64) + U64(1)) * U64(0x165667B19E3779F9))
            # 40 bits place the dart along its square's ranks, the rest choose its coordinate, another hash its weight
            place = rank + (dart >> U64(24)).astype(np.float64) * 2.0**-40
            heavy = layer + (mix(dart + U64(0x27D4EB2F165667C5)) >> U64(11)).astype(np.float64) * 2.0**-53
            r = row[which]
            hit = (place >= low[r]) & (place < high[r]) & (heavy < weight[which])
            dart, rank, r = dart[hit], rank[hit], r[hit]
            np.minimum.at(out, r * coordinates + ((dart & U64(0xFFFFFF)) % U64(coordinates)).astype(np.int64), (rank.astype(U64) << U64(40)) | (dart >> U64(24)))
        live &= (out.reshape(rows, coordinates) == ~U64(0)).any(axis=1)
        low, high = np.where(live, high, low), np.where(live, 2 * high, high)
    return out.reshape(rows, coordinates)


def batched(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose running sums are `ends`, of about `limit` together."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def banded(signature: np.ndarray, bands: int) -> np.ndarray:
    rows, coordinates = signature.shape
    part = signature.reshape(rows, bands, coordinates // bands)
    key = np.zeros((rows, bands), U64) + mix(np.arange(1, bands + 1, dtype=U64))
    for i in range(part.shape[2]):
        key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key


def marks_of(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a number."""
    four = (mix(signature.copy()) >> U64(60)).astype(np.uint8)
    out = np.zeros((len(four), -(-four.shape[1] // 16) * 8), np.uint8)
    out[:, : -(-four.shape[1] // 2)] = four[:, ::2]
    out[:, : four.shape[1] // 2] |= four[:, 1::2] << np.uint8(4)
    return out.view(U64)


class Sets:
    """Stored sets, compared by their marks first: a Judge for settled().

    Pairs of the similarity `threshold` have marks near enough but for 4 standard deviations (1 in 30,000), more similar
    ones ever more surely. Of the buckets that two sets share, they count in the first band's.
    """

    def __init__(self, rows: pa.Table, coordinates: int, threshold: float):
        p = (1 - threshold) * 15 / 16
        self.most, self.threshold = coordinates * p + 4 * sqrt(coordinates * p * (1 - p)), threshold
        self.mark, self.bands = (np.frombuffer(b"".join(rows.column(c).to_pylist()), U64).reshape(rows.num_rows, -1) for c in ("mark", "bands"))
        self.items, self.weights = rows.column("items"), rows.column("weights")

    def may(self, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = self.mark[x] ^ self.mark[y]
        d |= d >> U64(1)
        d |= d >> U64(2)
        near = np.bitwise_count(d & U64(0x1111111111111111)).sum(axis=1) <= self.most
        at = np.flatnonzero(near)
        x, y = x[at], y[at]
        first = (self.bands[x] == self.bands[y]).argmax(axis=1)
        near[at] = self.bands[x, first] == key[at].view(U64)
        return near

    def links(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        alike = [jaccard(*(c[k].as_py() for k in pair for c in (self.items, self.weights))) for pair in zip(x.tolist(), y.tolist(), strict=True)]
        return np.array(alike) >= self.threshold - 1e-12


def signed(docs: DataFrame, size: int, bands: int, band_rows: int, weigh: Weigh) -> DataFrame:
    """ord, doc_id, sha, a 128-bit hash of the word sequence and the band keys of each row (ord, text, doc_id, sha); no
    bands without words."""
    coordinates = bands * band_rows
    darts = coordinates * (log(coordinates) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, element, weight, c1, c2 = elements(*utf8(batch.column(1)), size, weigh)
            n = batch.num_rows
            keys = banded(throw(row, element, weight, n, coordinates, darts), bands).view(np.int64)
            worded = np.bincount(row, minlength=n) > 0
            offsets = np.concatenate([[0], np.cumsum(worded * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[worded].ravel()))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], ["ord", "doc_id", "sha", "c1", "c2", "bands"])

    return docs.select("ord", "text", "doc_id", "sha").mapInArrow(run, SIGNED)


def element_sets(docs: DataFrame, size: int, bands: int, band_rows: int, weigh: Weigh) -> DataFrame:
    """c1, c2, the elements of each row (ord, text) in ascending order, their weights (none if all are 1), its mark and
    band keys."""
    coordinates = bands * band_rows
    darts = coordinates * (log(coordinates) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, element, weight, c1, c2 = elements(*utf8(batch.column(1)), size, weigh)
            n = batch.num_rows
            signature = throw(row, element, weight, n, coordinates, darts)
            marks, keys = ([x.tobytes() for x in m] for m in (marks_of(signature), banded(signature, bands)))
            cut = np.searchsorted(row, np.arange(n + 1))
            stored = np.ascontiguousarray(element.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDE])
            items = [stored[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            weights = [b"" if (w := weight[a:b]).size and (w == 1).all() else w.tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            columns = [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), *(pa.array(x, pa.binary()) for x in (items, weights, marks, keys))]
            yield pa.record_batch(columns, ["c1", "c2", "items", "weights", "mark", "bands"])

    return docs.select("ord", "text").mapInArrow(run, SETS)


def jaccard(x: bytes, wx: bytes, y: bytes, wy: bytes) -> float:
    """The weighted Jaccard similarity of two stored sets."""
    a, b = (np.frombuffer(s, f"V{WIDE}") for s in (x, y))
    a, b = (np.concatenate([np.zeros((len(s), 8 - WIDE), np.uint8), s.view(np.uint8).reshape(-1, WIDE)], axis=1).view(">u8")[:, 0] for s in (a, b))
    v, w = (np.frombuffer(s) if s else np.ones(n) for s, n in ((wx, len(a)), (wy, len(b))))
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    same = np.flatnonzero(a[at] == b) if len(a) else np.zeros(0, np.int64)
    common = np.minimum(v[at[same]], w[same]).sum()
    return common / max(v.sum() + w.sum() - common, 1e-300)


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([jaccard(*(v.as_py() for v in s)) for s in zip(*(batch.column(i) for i in (2, 3, 4, 5)), strict=True)], np.float64)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "similarity"])
            yield out.filter(pa.array(found >= threshold - 1e-12, pa.bool_()))

    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x"), F.col("weights").alias("wx")), "a")
    both = x.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y"), F.col("weights").alias("wy")), "b")
    # a set can only reach the threshold with one of nearly as many elements where all weights are 1
    close = F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y")) - 1e-9
    return both.filter((F.length("wx") > 0) | (F.length("wy") > 0) | close).select("a", "b", "x", "wx", "y", "wy").mapInArrow(run, "a long, b long, similarity double")


def identified() -> list[Column]:
    """ord and sha: what tells rows apart, their place in the order of doc_id and a hash of their text."""
    text = F.col("text").cast("string")
    return [order_key(F.col("doc_id"), text).alias("ord"), F.xxhash64(text).alias("sha")]


def placed_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 30, band_rows: int = 6, weigh: Weigh = counted) -> DataFrame:
    """doc_id, ord, sha, place, class_id, group_id of each row of docs(doc_id, text); ord and sha as in identified().

    place: the row's doc_id; rows without one come last, at a hash of their text beyond all ids. Where rows share a
    doc_id but not their words, one text keeps the id as its place and the others get such a hash too, so no text is
    taken for another. class_id: the smallest place of the same words in the same order (c1 and c2, a 128-bit hash).
    group_id: the smallest place of the connected group of classes linked by a similarity of `threshold` or more.
    Rows without words (null, empty) are alone but for others of their doc_id. Other columns are ignored.

    The members of a band's bucket are candidates; linked_groups() compares them without making all pairs, and marks
    rule out pairs that are too far apart. At the threshold a pair shares no bucket once in 9,000.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *identified())
    rows = written(signed(docs, size, bands, band_rows, weigh), "signatures")
    texts = rows.groupBy("ord").agg(F.min(F.struct("c1", "c2")).alias("low"), F.max(F.struct("c1", "c2")).alias("high"))
    shared = written(texts.filter("low <> high").select("ord", "low"), "shared-ids")
    place = F.col("ord")
    if not shared.isEmpty():
        late = F.shiftrightunsigned(F.xxhash64("c1", "c2"), 2).bitwiseOR(F.lit(1 << 62))
        rows = rows.join(shared, "ord", "left")
        place = F.when(F.col("low").isNotNull() & (F.struct("c1", "c2") != F.col("low")), late).otherwise(place)
    rows = rows.withColumn("place", place).withColumn("alone", F.when(F.size("bands") == 0, F.col("place")))
    classes = rows.groupBy("c1", "c2", "alone").agg(F.min("place").alias("node"), F.min("ord").alias("ord"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    keys = classes.select("node", F.explode("bands").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = written(keys.join(several, "key").select("key", "node"), "buckets")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "ord", "c1", "c2")
    held = element_sets(docs.join(wanted.select("ord").distinct(), "ord", "left_semi"), size, bands, band_rows, weigh)
    sets = written(held.join(wanted.select("node", "c1", "c2"), ["c1", "c2"]).dropDuplicates(["node"]).drop("c1", "c2"), "sets")

    groups = linked_groups(members, lambda pairs: similar(pairs, sets, threshold), lambda open_: settled(open_, sets, lambda rows: Sets(rows, bands * band_rows, threshold)))
    forget(members, sets)
    named = classes.join(groups, "node", "left").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("alone").alias("single"), F.col("node").alias("class_id"), F.coalesce("component", "node").alias("group_id"))
    same = (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & F.col("alone").eqNullSafe(F.col("single"))
    return rows.drop("bands").join(named, same).select("doc_id", "ord", "sha", "place", "class_id", "group_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, group_id of placed_groups() and group_size, the rows of the group, for each row of docs."""
    out = placed_groups(docs, **options)
    sizes = out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return out.join(sizes, "group_id").select("doc_id", "class_id", "group_id", "group_size")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each group of placed_groups(): the first by place, of different texts of one
    group and place the one of smallest hash, of rows that repeat an id and text any one. All columns stay, whatever
    their names; an empty table stays empty."""
    groups = placed_groups(docs, **options).filter(F.col("place") == F.col("group_id"))
    first = groups.groupBy("group_id").agg(F.min(F.struct("ord", "sha")).alias("one")).select("one.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *identified())
    return rows.join(first, ["ord", "sha"], "left_semi").dropDuplicates(["ord", "sha"]).select("row.*")
