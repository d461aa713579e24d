"""What a caller may plug in: language models, extractors, embedders. By default there is no language model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what divides the parts of a prompt.
SEPARATOR = "\n\n---\n\n"


class LanguageModel(Protocol):
    """Runs in the tasks, on batches of texts; must be picklable."""

    name: str

    def complete(self, prompts: list[str]) -> list[str]: ...

    def extract_entities(self, texts: list[str]) -> list[str]: ...

    def summarize(self, texts: list[str]) -> list[str]: ...


class NoModel:
    """The default: every method is an error that says what to do."""

    name = "none"

    def _none(self, what: str):
        raise RuntimeError(f"{what} needs a language model and none is configured")

    def complete(self, prompts: list[str]) -> list[str]:
        self._none("complete")

    def extract_entities(self, texts: list[str]) -> list[str]:
        self._none("extract_entities")

    def summarize(self, texts: list[str]) -> list[str]:
        self._none("summarize")


def model_column(model: LanguageModel, method: str, text: Column) -> Column:
    """A column made by a model, batch by batch; nulls stay null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            here = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if here.any():
                out[here] = getattr(model, method)(s[here].tolist())
            yield out

    return run(text)


def entities_or_empty(answer: str | None) -> dict:
    """A model's answer as entities, relations and graph; an answer that is no such JSON gives none of them."""
    empty = {"entities": [], "relationships": [], "contextGraph": {}}
    try:
        got = json.loads(answer or "")
    except ValueError:
        return empty
    return empty | {k: v for k, v in got.items() if k in empty} if isinstance(got, dict) else empty


def joined_context(texts: Column) -> Column:
    return F.array_join(texts, SEPARATOR)


Embedder = Callable[[int], Callable[[Column], Column]]
