"""Language identification by multilingual mixture inference.

Each language has byte-trigram likelihoods, learned from labelled documents. The words of a document come from a mixture
of languages; expectation-maximisation estimates its proportions. Languages leave one by one, the least likely first, as
long as the penalised likelihood does not fall; what remains is the document's language set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

GRAMS = 1 << 15
UND = "und"
#: Bytes as the model sees them: ASCII letters in lower case, other bytes below 128 as a space, the rest unchanged.
SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_and_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram around each byte of a word, where each word begins among them, and the row of each word."""
    x = np.full(len(data) + 2, 32, np.uint8)
    x[1:-1] = SEEN[data]
    before, here, after = x[:-2].astype(np.uint32), x[1:-1], x[2:].astype(np.uint32)
    start, end = offsets[:-1], offsets[1:]
    full = end > start
    before[start[full]] = 32
    after[end[full] - 1] = 32
    inside = np.flatnonzero(here != 32)
    code = (before[inside] << np.uint32(16)) | (here[inside].astype(np.uint32) << np.uint32(8)) | after[inside]
    gram = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    first = np.flatnonzero(before[inside] == 32)
    row = np.searchsorted(offsets, inside[first], "right") - 1
    return gram, first, row


def train(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram bucket, from all rows (text, lang) with a lang that are not held out.

    The driver gets at most GRAMS counts a language; the documents are counted where they are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0):
            gram, first, row = words_and_grams(*utf8(batch.column(0)))
            of = row[np.cumsum(np.bincount(first, minlength=len(gram))) - 1] if len(gram) else row
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            n = np.bincount(code[of] * GRAMS + gram, minlength=len(names) * GRAMS).reshape(-1, GRAMS)
            for name, counts in zip(names, n, strict=True):
                total[name] = total.get(name, 0) + counts
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((GRAMS, len(names)), smoothing)
    if names:
        at = {n: i for i, n in enumerate(names)}
        table[counts.column("gram").to_numpy(), [at[n] for n in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
        table = np.log(table / table.sum(axis=0))
    return names, table.astype(np.float32)


def mixtures(likely: np.ndarray, first: np.ndarray, size: np.ndarray, steps: int = 6, penalty: float = 1.0) -> np.ndarray:
    """Proportions (rows x languages) from the likelihoods of words (scaled so that each word's best is 1).

    first: where each row's words begin; every row has one at least.
    """
    rows, languages = len(size), likely.shape[1]
    share = np.full((rows, languages), 1 / languages, np.float32)
    cost = (penalty + np.log(size)).astype(np.float64)

    def fit(at: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for the rows `at` from these shares; a share of 0 stays 0."""
        words = np.repeat(first[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
        p, begin = likely if len(words) == len(likely) else likely[words], np.cumsum(size[at]) - size[at]
        for _ in range(steps):
            q = p * np.repeat(share, size[at], axis=0)
            q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-30)
            share = np.add.reduceat(q, begin, axis=0) / size[at][:, None]
        mixed = (p * np.repeat(share, size[at], axis=0)).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(mixed, 1e-30)).astype(np.float64), begin)

    at = np.arange(rows)
    share, value = fit(at, share)
    while len(at) and languages > 1:
        at = at[(share[at] > 0).sum(axis=1) > 1]
        if not len(at):
            break
        less = share[at].copy()
        least = np.where(less > 0, less, np.inf).argmin(axis=1)
        less[np.arange(len(at)), least] = 0
        less /= less.sum(axis=1, keepdims=True)
        new, reached = fit(at, less)
        better = reached + cost[at] >= value[at]
        share[at[better]], value[at[better]] = new[better], reached[better]
        at = at[better]
    return share


def identify(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of each row of docs(doc_id, text, lang) with lang_pred, score and langs (language: proportion).

    Learns from the rows with a lang whose crc32(doc_id as text) mod 4 is not 2. lang_pred has the largest proportion,
    ties to the first by code point; score is that proportion. A text that is null or has no letter gets und, score 0
    and no langs, and so does every text where nothing is labelled. A null doc_id counts as an empty text of an id.
    """
    if clash := {"lang_pred", "score", "langs"} & set(columns):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    names, table = train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = docs.sparkSession.sparkContext.broadcast((names, table))  # GRAMS floats a language
    wanted = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("rest"))
    schema = f"rest {wanted.schema['rest'].dataType.simpleString()}, lang_pred string, score double, langs map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in slices(batches, 0, 1 << 20):
            data, offsets = utf8(batch.column(0))
            letters = np.concatenate([[0], np.cumsum((SEEN[data] >= 97) & (SEEN[data] <= 122))])
            lettered = np.diff(letters[offsets]) > 0
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                lettered[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode())
            best, score, langs = np.full(len(lettered), -1), np.zeros(len(lettered)), [None] * len(lettered)
            gram, first, row = words_and_grams(data, offsets)
            if len(first) and names:
                value = np.add.reduceat(table[gram], first, axis=0)
                likely = np.exp(value - value.max(axis=1, keepdims=True))
                rows, begin, size = np.unique(row, return_index=True, return_counts=True)
                share = mixtures(likely, begin, size)
                best[rows], score[rows] = share.argmax(axis=1), share.max(axis=1)
                for r, s in zip(rows, share, strict=True):
                    langs[r] = [(names[i], float(s[i])) for i in np.flatnonzero(s > 0)]
            known = lettered & (best >= 0)
            out = [names[b] if k else UND for b, k in zip(best, known, strict=True)]
            shown = [x if k else [] for x, k in zip(langs, known, strict=True)]
            columns = [batch.column(1), pa.array(out, pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0)), pa.array(shown, pa.map_(pa.string(), pa.float64()))]
            yield pa.record_batch(columns, ["rest", "lang_pred", "score", "langs"])

    return wanted.mapInArrow(run, schema).select("rest.*", "lang_pred", "score", "langs")
