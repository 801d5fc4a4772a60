"""Token counts without encoding: most pre-tokens are one token, which is proved beforehand from the vocabulary.

A byte-pair model merges two neighbours only into a string of its vocabulary. Where no such string has the characters a
and b side by side, no merge ever joins an a to the b after it, and the text can be cut between them: the parts are
encoded alone, with the same tokens. Shortcut proves which pairs those are, and which strings encode alone as one token.
Tasks cut texts before the spaces that follow another character, count the pre-tokens that are one token straight away,
and give only the rest to the library, cut further where that is proved to be safe, each different one once.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
WORD_END = re.compile(r"(?<=[^ ]) ")
LETTER, MARKS = "A-Za-zÀ-ɏ", string.punctuation + "\t\n\r"
#: Characters of a text that are cut at once (and pre-tokens that are held), and merged pre-tokens that a worker remembers.
WINDOW, REMEMBERED = 1 << 20, 1 << 19
#: Longer pre-tokens are cut wherever a pair of characters is proved to be apart, and not at spaces and marks alone.
SHORT = 64
_kept: dict = {}


class Shortcut:
    """What a sentencepiece BPE model's file proves about its vocabulary.

    one: strings (with spaces for the space mark) that encode alone as one token. joined: pairs of characters that some
    string of the vocabulary has side by side. Models whose normaliser changes texts, that drop spaces, or that match
    strings of their own before merging aren't covered and are an error.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        n, t = spec.normalizer_spec, spec.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        own = any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        if t.model_type != t.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or own:
            raise ValueError("whole tokens are proved for BPE models that leave the text as it is, without strings of their own")
        self.prefix = " " if n.add_dummy_prefix else ""
        self.processor = SentencePieceProcessor(model_proto=model)
        strings = [p.piece for p in spec.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)]
        self.joined = {s[i : i + 2].replace(SPACE, " ") for s in strings for i in range(len(s) - 1)}
        self.cut_at_spaces = not any(b == " " and a != " " for a, b in self.joined)
        #: Marks that no string of the vocabulary has behind a letter: texts are cut there as well.
        self.behind = "".join(m for m in MARKS if not any(b == m and re.match(f"[{LETTER}]", a) for a, b in self.joined))
        kept = f"[^ {LETTER}{re.escape(self.behind)}][^ {LETTER}]*+"
        self.pretoken = re.compile(f" *+[^ {LETTER}]*+(?:[{LETTER}]++(?:{kept})?+)*+")
        #: A character that no string of the vocabulary has beside another: what follows it is encoded as if alone.
        self.apart = next(c for c in map(chr, (*range(32), *range(0xE000, 0xF8FF))) if not any(c in pair for pair in self.joined))
        self.before = len(self.processor.encode(self.apart))
        self.one = {s for s, k in self.merged([s.replace(SPACE, " ") for s in strings]).items() if k == 1}
        self.known = self.proved()

    def proved(self) -> dict[str, int]:
        return dict.fromkeys(self.one, 1) | {"": 0}

    def merged(self, parts: list[str]) -> dict[str, int]:
        """The library's number of tokens of each part, as inside a text."""
        ids = self.processor.encode([self.apart + s for s in parts], num_threads=1)
        return {s: len(x) - self.before for s, x in zip(parts, ids, strict=True)}

    def safe_parts(self, s: str) -> list[str]:
        """s cut wherever a pair of characters is in no string of the vocabulary."""
        cuts = [i for i, pair in enumerate(map(add, s, s[1:]), 1) if pair not in self.joined]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)] if cuts else [s]

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of the text, a window of it at a time."""
        text = (self.prefix + text).replace(SPACE, " ")
        if not self.cut_at_spaces:
            yield [text]
            return
        at = 0
        while at < len(text):
            found = WORD_END.search(text, at + WINDOW)
            end = found.start() if found else len(text)
            yield self.pretoken.findall(text, at, end)
            at = end

    def learn(self, new: set[str]) -> None:
        """Adds the numbers of tokens of pre-tokens that aren't in self.known: the proved ones are there from the beginning."""
        cut = {s: self.safe_parts(s) for s in new if len(s) > SHORT}
        parts = {p for ps in cut.values() for p in ps}
        self.known |= self.merged(list(((new - cut.keys()) | parts) - self.known.keys()))
        for s, ps in cut.items():
            self.known[s] = sum(map(self.known.__getitem__, ps))

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        totals, held, size = [0] * len(texts), [], 0

        def add_up() -> None:
            if len(self.known) > len(self.one) + REMEMBERED:
                self.known = self.proved()
            self.learn(set().union(*(tokens for _, tokens in held)) - self.known.keys())
            for i, tokens in held:
                totals[i] += sum(map(self.known.__getitem__, tokens))
            held.clear()

        for i, text in enumerate(texts):
            for tokens in self.pretokens(text) if text else ():
                held.append((i, tokens))
                size += len(tokens)
                if size > WINDOW:
                    add_up()
                    size = 0
        add_up()
        return totals


def shortcut(model: bytes) -> Shortcut:
    if _kept.get("model") != model:
        _kept.update(model=model, shortcut=Shortcut(model))
    return _kept["shortcut"]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of docs and n_bytes long (of the text in UTF-8), n_tokens long, over_limit (more tokens than `limit`).

    `model` is a sentencepiece model's file on the driver, which ships its bytes to the tasks; n_tokens is the length of
    encode(text), without begin and end. A null or empty text has no bytes and no tokens. Special strings, spaces in a
    row, line breaks and NUL count as the library's default has it. Each row counts for itself, whatever its doc_id,
    repeated ones too; an empty table gives no rows; columns of docs that are not named in `columns` are ignored.
    Rows never leave their task: a long text is cut in windows of a megabyte, at proved places.
    """
    if clash := {"n_bytes", "n_tokens", "over_limit"} & set(columns):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    with open(model, "rb") as f:
        held = f.read()
    shortcut(held)  # an error of the model is the driver's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shortcut(held)
        for batch in slices(batches, 0, 8 << 20):
            tokens = pa.array(s.count(batch.column(0).to_pylist()), pa.int64())
            yield pa.record_batch([*batch.columns[1:], tokens], [*batch.schema.names[1:], "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(text.alias("_text"), *columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
