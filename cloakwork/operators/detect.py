"""Detection layers: patterns, and spans that models outside Spark have found."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS, bound, cut, no_spans, paged, pattern_spans, span, stepwise
from ..functions.text import UNICODE, literal_map
from ..sources import seeds

FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s"}


@dataclass(frozen=True)
class Pattern:
    pii_type: str
    pattern: str
    flags: str = ""
    group: int = 0

    @property
    def inline_flags(self) -> str:
        """Flags are separated by commas; a name that isn't known counts as none."""
        return "".join(sorted({FLAGS[f.strip().upper()] for f in self.flags.split(",") if f.strip().upper() in FLAGS}))

    @property
    def compiled(self) -> re.Pattern | None:
        """None for a pattern that doesn't compile or hasn't the group: it finds nothing."""
        try:
            found = re.compile((f"(?{self.inline_flags})" if self.inline_flags else "") + self.pattern)
        except re.error:
            return None
        return found if 0 <= self.group <= found.groups else None

    @property
    def java(self) -> str:
        return UNICODE + (f"(?{self.inline_flags})" if self.inline_flags else "") + self.pattern

    @property
    def group_ends_match(self) -> bool:
        """Whether only zero-width assertions can follow the group, so that JVM functions give its place."""
        if self.group == 0:
            return True
        if self.group != 1 or self.compiled is None or self.compiled.groups != 1:
            return False
        open_at = re.search(r"(?<!\\)\((?!\?)", self.pattern)
        depth, i, in_class = 0, open_at.start() if open_at else 0, False
        while i < len(self.pattern):
            c = self.pattern[i]
            if c == "\\":
                i += 2
                continue
            if in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c in "()":
                depth += 1 if c == "(" else -1
                if depth == 0:
                    break
            i += 1
        return re.fullmatch(r"(?:\\b|\\B|\$|\(\?!(?:[^()\\]|\\.)*\))*", self.pattern[i + 1 :]) is not None


SEEDED = tuple(Pattern(*p) for p in seeds.PATTERNS)
USER = tuple(Pattern(*p) for p in seeds.USER_PATTERNS)


def _python_spans(patterns: list[Pattern]) -> Callable[[Column], Column]:
    """The exact fallback for groups inside a match: Python's re over Arrow batches."""
    compiled = [(p.pii_type, p.compiled, p.group) for p in patterns]

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([
                [dict(start=m.start(g), end=m.end(g), pii_type=t, text=m.group(g), score=1.0, source="regex") for t, p, g in compiled for m in p.finditer(text or "") if m.group(g)]
                for text in texts
            ])

    return find


def regex_spans(text: Column, patterns: Iterable[Pattern] = SEEDED + USER) -> Column:
    """All spans of all patterns, pattern by pattern; JVM functions, and Arrow only where a group lies inside its match.

    A null text has no spans. Patterns that don't compile are left out.
    """
    usable = [p for p in patterns if p.compiled is not None]
    native = [p for p in usable if p.group_ends_match]
    other = [p for p in usable if not p.group_ends_match]
    found = [pattern_spans(text, [(p.pii_type, p.java, p.group) for p in native])] if native else []
    if other:
        # The guard keeps texts without a match from going to Python.
        guard = text.rlike("|".join(f"(?:{p.java})" for p in other))
        found.append(F.when(guard, _python_spans(other)(F.when(guard, text))).otherwise(no_spans()))
    return F.coalesce(F.concat(no_spans(), *found), no_spans())


def boosted(spans: Column, text: Column, words: dict[str, list[str]] | None = None, window: int = 60, raised: float = 0.90, least: float = 0.65) -> Column:
    """Analyzer spans: a context word before the span raises its score; low scores then go."""
    words = seeds.CONTEXT_WORDS if words is None else words
    known = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if words else None

    def lifted(s: Column, pages: Column) -> Column:
        if not words:
            return s
        before = F.lower(cut(pages, F.greatest(s["start"] - window, F.lit(0)), s["start"]))
        near = F.exists(F.coalesce(F.try_element_at(known, s["pii_type"]), F.array().cast("array<string>")), lambda w: F.contains(before, w))
        return span(s["start"], s["end"], s["pii_type"], s["text"], F.when(near, F.greatest(s["score"], F.lit(raised))).otherwise(s["score"]), s["source"])

    raised_ = bound(paged(text), lambda pages: F.transform(spans, lambda s: lifted(s, pages)))
    return F.when(F.size(spans) > 0, F.filter(raised_, lambda s: s["score"] >= least)).otherwise(spans)


LAYERS = {
    "analyzer": (seeds.ANALYZER_LABELS, 0.65, False),
    "filter": (seeds.FILTER_LABELS, 0.70, False),
    # Labels that the classifier isn't known to give are secrets; the ones mapped to nothing are noise.
    "classifier": (seeds.CLASSIFIER_LABELS, 0.70, True),
}


def labelled_spans(found: DataFrame, layer: str, low_scores: bool = False) -> DataFrame:
    """(…, label, score) rows of a model with pii_type instead of label, without unmapped labels and, unless they are
    asked for, low scores."""
    labels, least, unknown_is_secret = LAYERS[layer]
    mapped = F.try_element_at(literal_map({k: v or "" for k, v in labels.items()}), F.col("label"))
    if unknown_is_secret:
        mapped = F.coalesce(mapped, F.lit("SECRET"))
    kept = found if low_scores else found.where(F.col("score") >= least)
    return kept.withColumn("pii_type", mapped).where("pii_type <> ''").drop("label")


def external_spans(docs: DataFrame, found: DataFrame, layer: str, key: str = "doc_id", least_chars: int = 200, words: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with a column ``spans`` of a model's findings: (key, start, end, label, score) rows.

    A context word before a span of the analyzer (``words``, by type) raises its score before low scores go. The classifier isn't asked about texts under ``least_chars`` characters. An unavailable layer is an empty
    ``found``.
    """
    rows = labelled_spans(found, layer, low_scores=layer == "analyzer").select(F.col(key).alias("_key"), "start", "end", "pii_type", "score")
    grouped = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("score")).alias("minus"), "end", "pii_type"))).alias("_found"))
    joined = docs.join(grouped, docs[key] == grouped["_key"], "left")
    one = lambda s, pages: span(s["start"], s["end"], s["pii_type"], cut(pages, s["start"], s["end"]), -s["minus"], F.lit(layer))
    made = F.when(F.col("_found").isNotNull(), bound(paged(F.col("text")), lambda pages: F.transform("_found", lambda s: one(s, pages)))).otherwise(no_spans())
    if layer == "analyzer":
        made = boosted(made, F.col("text"), words)
    if layer == "classifier":
        made = F.when(F.length("text") >= least_chars, made).otherwise(no_spans())
    return joined.withColumn("spans", F.coalesce(made, no_spans())).drop("_key", "_found")


def collapsed_tags(tokens: Column, digits: int | None = 4) -> Column:
    """BIOES tags of tokens, in order, to spans: structs of start, end, label and mean score.

    tokens: structs of start, end, tag ("B-x", "I-x", "E-x", "S-x" or "O") and score. B and S begin a span and close an
    open one, I and E extend an open span of their label, E and S close it; an I or E without one is dropped and
    closes what is open. Zero-width tokens don't count. The mean is rounded to ``digits``.
    """
    empty = "array<struct<start:int,end:int,label:string,total:double,n:int>>"

    def one(t: Column) -> Column:
        return F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), F.substr(t["tag"], F.lit(3), F.length(t["tag"])).alias("label"), t["score"].cast("double").alias("total"), F.lit(1).alias("n"))

    def step(state: Column, t: Column) -> Column:
        kind, label = F.substr(t["tag"], F.lit(1), F.lit(1)), F.substr(t["tag"], F.lit(3), F.length(t["tag"]))
        open_, done = state["open"], state["done"]
        current = F.try_element_at(open_, F.lit(1))
        follows = (F.size(open_) > 0) & (current["label"] == label)
        longer = F.array(F.struct(current["start"].alias("start"), t["end"].cast("int").alias("end"), label.alias("label"), (current["total"] + t["score"]).alias("total"), (current["n"] + 1).alias("n")))
        none, flushed = F.array().cast(empty), F.concat(done, open_)
        make = lambda o, d: F.struct(o.alias("open"), d.alias("done"))
        return (
            F.when(kind == "B", make(F.array(one(t)), flushed))
            .when(kind == "S", make(none, F.concat(flushed, F.array(one(t)))))
            .when((kind == "I") & follows, make(longer, done))
            .when((kind == "E") & follows, make(none, F.concat(done, longer)))
            .otherwise(make(none, flushed))
        )

    start = F.struct(F.array().cast(empty).alias("open"), F.array().cast(empty).alias("done"))
    folded = F.aggregate(F.filter(tokens, lambda t: t["end"] > t["start"]), start, step, lambda s: F.concat(s["done"], s["open"]))
    mean = lambda s: s["total"] / s["n"] if digits is None else F.round(s["total"] / s["n"], digits)
    return F.transform(folded, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), mean(s).alias("score")))


#: A line with its end, as Python's ``splitlines`` has it.
LINE = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+"
#: The filter model reads so many tokens of a line.
MOST_TOKENS = 512


def line_starts(text: Column) -> Column:
    """Where each line of a text begins, in code points."""
    lines = F.regexp_extract_all(text, F.lit(LINE), 0)
    return stepwise(lines, F.lit(0), lambda at, line: (at + F.length(line), F.array(at)), "int")


def decoded_tags(tokens: Column, tags: list[str], most: int = MOST_TOKENS) -> Column:
    """The first ``most`` tokens (start, end, logits) with their tag and its probability: the largest logit, of equal ones the first, and softmax."""

    def one(t: Column) -> Column:
        largest = F.array_max(t["logits"])
        total = F.aggregate(t["logits"], F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - largest))
        tag = F.element_at(F.array(*map(F.lit, tags)), F.array_position(t["logits"], largest).cast("int"))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), tag.alias("tag"), (1 / total).alias("score"))

    return F.transform(F.slice(tokens, 1, most), one)


def filter_findings(docs: DataFrame, logits: DataFrame, tags: list[str], least: float = 0.70) -> DataFrame:
    """(doc_id, start, end, label, score): what a tagging model that has read documents line by line has found.

    ``logits``: doc_id, line (from 0, all lines count), tokens (array of structs start, end, logits; places within the line).
    ``tags``: the tag of each logit ("O", "B-x" ...). Spans with a mean probability under ``least`` go; scores are rounded after that.
    Lines that a document doesn't have are ignored. ``layers.FindingsLayer`` takes the result.
    """
    starts = docs.select("doc_id", F.posexplode(line_starts(F.col("text"))).alias("line", "_start"))
    found = logits.select("doc_id", "line", F.explode(collapsed_tags(decoded_tags(F.col("tokens"), tags), None)).alias("s")).where(F.col("s.score") >= least)
    place = lambda c: (F.col("_start") + F.col(f"s.{c}")).cast("int").alias(c)
    return found.join(starts, ["doc_id", "line"]).select("doc_id", place("start"), place("end"), "s.label", F.round("s.score", 4).alias("score"))
