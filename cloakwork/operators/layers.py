"""Detection layers as plug-ins: what a layer is, kinds of layers, and the registry that a plan is built from.

Layers are asked in the order of their priorities, lower first, and their spans stand in an array in this order; of spans that begin alike
with one score, the earlier layer's comes first in the merges. A layer that is switched off or not available is left out of the
plan; one that fails on a text finds nothing in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS, no_spans
from . import detect


class Layer(Protocol):
    """What the registry takes: a name of its own, a priority, whether it can be used, and its spans.

    ``find`` gives docs (doc_id, text, …) with one more column ``column`` of spans; it changes neither rows nor other columns.
    """

    name: str
    priority: int

    def available(self, docs: DataFrame) -> bool: ...

    def find(self, docs: DataFrame, column: str) -> DataFrame: ...


@dataclass(frozen=True)
class PatternLayer:
    """Patterns as column expressions; a pattern that doesn't compile finds nothing."""

    patterns: tuple[detect.Pattern, ...] = detect.SEEDED + detect.USER
    name: str = "regex"
    priority: int = 30

    def available(self, docs: DataFrame) -> bool:
        return True

    def find(self, docs: DataFrame, column: str) -> DataFrame:
        return docs.withColumn(column, detect.regex_spans(F.col("text"), self.patterns))


@dataclass(frozen=True)
class ColumnLayer:
    """Spans that the documents bring along in a column; without the column it isn't available."""

    column: str
    name: str
    priority: int

    def available(self, docs: DataFrame) -> bool:
        return self.column in docs.columns

    def find(self, docs: DataFrame, column: str) -> DataFrame:
        return docs.withColumn(column, F.col(self.column))


@dataclass(frozen=True)
class FindingsLayer:
    """A model's findings as rows (doc_id, start, end, label, score) of one of ``detect.LAYERS``; without a table it isn't available."""

    found: DataFrame | None
    layer: str
    priority: int
    words: dict[str, list[str]] | None = None

    @property
    def name(self) -> str:
        return self.layer

    def available(self, docs: DataFrame) -> bool:
        return self.found is not None and {"doc_id", "start", "end", "label", "score"} <= set(self.found.columns)

    def find(self, docs: DataFrame, column: str) -> DataFrame:
        held = docs.withColumnRenamed("spans", "_held") if "spans" in docs.columns else docs
        found = detect.external_spans(held, self.found, self.layer, words=self.words).withColumnRenamed("spans", column)
        return found.withColumnRenamed("_held", "spans") if "spans" in docs.columns else found


#: (texts, languages) -> for each text a list of (start, end, pii_type, score).
Finder = Callable[[list[str], list[str]], list[list[tuple[int, int, str, float]]]]


@dataclass(frozen=True)
class ArrowLayer:
    """A detector in Python, asked about batches of texts in Arrow.

    If it raises, or gives a list of another length, the texts of the batch are asked one by one, and those on which it still fails
    have no spans. Spans that aren't within their text are dropped. Null texts aren't asked; texts in which ``guard``, a Java
    pattern, finds nothing don't leave the JVM. ``ready`` tells whether model and libraries are there; it is asked once on the driver.
    """

    detector: Finder
    name: str
    priority: int
    guard: str | None = None
    ready: Callable[[], bool] = lambda: True
    language: str = "it"

    def available(self, docs: DataFrame) -> bool:
        try:
            return bool(self.ready())
        except Exception:  # noqa: BLE001  a model that can't even be asked isn't there
            return False

    def find(self, docs: DataFrame, column: str) -> DataFrame:
        asked = F.col("text") if self.guard is None else F.when(F.col("text").rlike(self.guard), F.col("text"))
        language = F.coalesce("language", F.lit(self.language)) if "language" in docs.columns else F.lit(self.language)
        found = F.when(asked.isNotNull(), _arrow_spans(self.detector, self.name)(asked, language)).otherwise(no_spans())
        return docs.withColumn(column, found)


def _arrow_spans(detector: Finder, name: str) -> Callable[[Column, Column], Column]:
    def whole(texts: list[str], languages: list[str]) -> list:
        found = [list(x) for x in detector(texts, languages)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [[_span(text, *s, name) for s in spans if 0 <= s[0] < s[1] <= len(text)] for text, spans in zip(texts, found)]

    def tried(texts: list[str], languages: list[str]) -> list:
        try:
            return whole(texts, languages)
        except Exception:  # noqa: BLE001  a layer never ends a job
            return [[]] if len(texts) == 1 else [tried([t], [l])[0] for t, l in zip(texts, languages)]

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [[] for _ in range(len(texts))]
            for i, spans in zip(at, tried([texts.iloc[i] for i in at], [languages.iloc[i] for i in at]) if at else []):
                out[i] = spans
            yield pd.Series(out)

    return find


def _span(text: str, start: int, end: int, pii_type: str, score: float, source: str) -> dict:
    return {"start": int(start), "end": int(end), "pii_type": pii_type, "text": text[start:end], "score": float(score), "source": source}


@dataclass
class Layers:
    """The registry: layers by name. ``settings``: {"name": {"enabled": bool}}; a layer that isn't named there is on."""

    settings: dict = field(default_factory=dict)
    _layers: dict[str, Layer] = field(default_factory=dict)

    @staticmethod
    def of(layers: Iterable[Layer], settings: dict | None = None) -> Layers:
        made = Layers(settings or {})
        for layer in layers:
            made.register(layer)
        return made

    def register(self, layer: Layer) -> None:
        """Adds a layer; ValueError if the name is taken."""
        if layer.name in self._layers:
            raise ValueError(f"a layer {layer.name!r} is registered")
        self._layers[layer.name] = layer

    def by_name(self, name: str) -> Layer | None:
        return self._layers.get(name)

    def ordered(self, docs: DataFrame) -> list[Layer]:
        """The layers that are on and available for ``docs``, by priority, then as they were registered."""
        on = [x for x in self._layers.values() if self.settings.get(x.name, {}).get("enabled", True)]
        return sorted((x for x in on if x.available(docs)), key=lambda x: x.priority)

    def find(self, docs: DataFrame, column: str = "spans") -> DataFrame:
        """docs with the spans of all layers, one layer after the other."""
        used = self.ordered(docs)
        names = [f"_layer_{i}" for i in range(len(used))]
        found = docs
        for layer, name in zip(used, names):
            found = layer.find(found, name)
        return found.withColumn(column, F.concat(no_spans(), *[F.coalesce(n, no_spans()) for n in names])).drop(*names)
