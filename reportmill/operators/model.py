"""A model in the workers: started once in each, asked in batches, many questions in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From a batch of prompts to their answers, as many and in the same order.
Asked = Callable[[list[str]], list[str | None]]
_running: dict[str, object] = {}


@dataclass(frozen=True)
class Model:
    """start() gives the model; a worker calls it once for a name, whatever plans and tasks come after."""

    name: str
    start: Callable[[], Callable]
    batch: int = 64

    def running(self) -> Callable:
        if self.name not in _running:
            _running[self.name] = self.start()
        return _running[self.name]


def in_batches(rows: list, ask: Callable[[list], list], size: int) -> Iterator[tuple[object, str | None]]:
    """What the model gives for each row, and the error where it fails; a batch that fails is asked row by row."""
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        try:
            out = list(ask(part))
            if len(out) != len(part):
                raise ValueError(f"{len(out)} answers to {len(part)} prompts")
            yield from ((x, None) for x in out)
        except Exception as e:
            if len(part) == 1:
                yield None, f"{type(e).__name__}: {e}"
            else:
                yield from in_batches(part, ask, 1)


def answered(df: DataFrame, prompt: Column, model: Model, out: str = "answer") -> DataFrame:
    """df with `out`, the model's answer to the prompt, and `out`_error where it failed on it. Null prompts aren't asked."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = model.running()
        for prompts in batches:
            held = pd.DataFrame({"text": [None] * len(prompts), "error": None}, dtype=object)
            at = [i for i, p in enumerate(prompts) if p is not None]
            for i, (text, error) in zip(at, in_batches([prompts.iloc[i] for i in at], ask, model.batch), strict=True):
                held.iloc[i] = [text, error]
            yield held

    return df.withColumn("_answer", run(prompt)).select(*df.columns, F.col("_answer.text").alias(out), F.col("_answer.error").alias(f"{out}_error"))


def scored(df: DataFrame, query: Column, text: Column, model: Model, out: str = "score") -> DataFrame:
    """df with `out`, the model's score of each (query, text); null where one of them is null or the model fails."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask = model.running()
        for queries, texts in batches:
            pairs = [(q, t) for q, t in zip(queries, texts, strict=True)]
            at = [i for i, (q, t) in enumerate(pairs) if q is not None and t is not None]
            held = [None] * len(pairs)
            for i, (score, _) in zip(at, in_batches([pairs[i] for i in at], ask, model.batch), strict=True):
                held[i] = score
            yield pd.Series(held, dtype="float64")

    return df.withColumn(out, run(query, text))
