"""Spans of a text as arrays of structs, and the interval algebra on them.

A span is start, end (half-open, in code points), pii_type, text, score and source. All functions take and
return columns; a document's spans never leave its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,pii_type:string,text:string,score:double,source:string>"
SPANS = f"array<{SPAN}>"
#: Spans of one type that are closer than this are one.
GAP = 5
#: Characters of a page, and items of a block of a walk.
PAGE_BITS = 10
PAGE = 1 << PAGE_BITS
BLOCK = 64


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, pii_type: Column, text: Column, score: Column, source: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        pii_type.alias("pii_type"),
        text.alias("text"),
        score.cast("double").alias("score"),
        source.alias("source"),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it occurs there or within a lambda.

    The last step of an empty fold; unlike ``transform``, it doesn't copy what it gives.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def paged(text: Column) -> Column:
    """The text in pages of ``PAGE`` characters, cut in one pass. A character far within a string is found only by
    counting from its start, so pieces are cut out of pages."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), 0)


def cut(pages: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a ``paged`` text, which count from 0."""

    def piece(at: Column) -> Column:
        first, last = at["first"], at["last"]
        page = lambda i: F.coalesce(F.try_element_at(pages, i + 1), F.lit(""))
        # ``slice`` copies the list of pages, so it is left to pieces of many pages.
        covering = F.when(first == last, page(first)).when(first + 1 == last, F.concat(page(first), page(last))).otherwise(F.array_join(F.slice(pages, first + 1, last - first + 1), ""))
        return F.substr(covering, at["from"], at["length"])

    def place(at: Column) -> Column:
        first = F.shiftright(at["start"], PAGE_BITS)
        return F.struct(
            first.alias("first"),
            F.shiftright(F.greatest(at["end"] - 1, at["start"]), PAGE_BITS).alias("last"),
            (at["start"] % PAGE + 1).alias("from"),
            (at["end"] - at["start"]).alias("length"),
        )

    return bound(bound(F.struct(start.alias("start"), end.alias("end")), place), piece)


def _blocks(xs: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(size)), lambda at: F.slice(xs, at + 1, F.lit(size)))


def stepwise(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, finish: Callable[[Column], Column] | None = None) -> Column:
    """What a walk along ``items`` gives out: ``step(carry, item)`` is the next carry and an array of ``kind``; ``finish`` adds a last array.

    A fold that appends to its result copies it at every step. Here steps append to the result of a block of ``BLOCK`` items only,
    and whole blocks are appended to the list of blocks.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(state: Column, item: Column) -> Column:
        after, out = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], out).alias("out"))

    def outer(state: Column, block: Column) -> Column:
        start = F.struct(state["carry"].alias("carry"), none.alias("out"))
        return F.aggregate(block, start, inner, lambda w: F.struct(w["carry"].alias("carry"), F.concat(state["out"], F.array(w["out"])).alias("out")))

    def walk(xs: Column) -> Column:
        blocks = F.flatten(F.transform(_blocks(xs, BLOCK * BLOCK), lambda large: _blocks(large, BLOCK)))
        start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, start, outer, lambda s: F.flatten(F.concat(s["out"], F.array(finish(s["carry"]))) if finish else s["out"]))

    return bound(items, walk)


def changed(s: Column, **fields: Column) -> Column:
    """The span with some fields replaced."""
    old = {name: s[name] for name in ("start", "end", "pii_type", "text", "score", "source")}
    return span(*(old | fields).values())


def pattern_matches(text: Column, pii_type: str, pattern: str, group: int) -> Column:
    """What a Java pattern finds in a text, and the text between; null if it finds nothing. ``group`` ends where its match ends."""
    literal = F.lit(pattern)
    matches = F.regexp_extract_all(text, literal, 0)
    groups = F.regexp_extract_all(text, literal, group) if group else F.lit(None).cast("array<string>")
    return F.when(text.rlike(pattern), F.struct(F.lit(pii_type).alias("pii_type"), F.split(text, pattern, -1).alias("gaps"), matches.alias("matches"), groups.alias("groups")))


def match_spans(found: Column) -> Column:
    """The spans of ``pattern_matches``.

    The end of a match is the length of all gaps and matches up to it, so one running offset over the
    gaps and matches is enough; the group's length then gives its start.
    """
    both = F.filter(F.arrays_zip(found["gaps"].alias("gap"), found["matches"].alias("match"), F.coalesce(found["groups"], found["matches"]).alias("group")), lambda x: x["match"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = (at + F.length(x["gap"]) + F.length(x["match"])).cast("int")
        one = bound(end, lambda e: F.array(span(e - F.length(x["group"]), e, found["pii_type"], x["group"], F.lit(1.0), F.lit("regex"))))
        return end, F.when(x["group"] == "", no_spans()).otherwise(one)

    return stepwise(both, F.lit(0), step, SPAN)


def pattern_spans(text: Column, patterns: list[tuple[str, str, int]]) -> Column:
    """The spans of (pii_type, Java pattern, group) triples, pattern by pattern."""
    found = F.array(*[pattern_matches(text, *p) for p in patterns])
    return F.flatten(F.transform(F.filter(found, lambda m: m.isNotNull()), match_spans))


def ordered(spans: Column, order: Column | None = None) -> Column:
    """By start, then higher score; ties by the spans' position in the array, then by end."""
    key = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["score"]).alias("b"), i.alias("c"), s.alias("span")))
    return F.transform(F.array_sort(key), lambda k: k["span"])


def resolve_overlaps(spans: Column) -> Column:
    """Of spans that overlap the last one kept, which stays: regex before others, then the wider, then the higher score."""

    def step(last: Column, new: Column) -> tuple[Column, Column]:
        same = (new["start"] == last["start"]) & (new["end"] == last["end"])
        covers = (new["start"] <= last["start"]) & (last["end"] <= new["end"])
        inside = (last["start"] <= new["start"]) & (new["end"] <= last["end"])
        new_regex, last_regex = new["source"] == "regex", last["source"] == "regex"
        apart = new["start"] >= last["end"]
        wins = (
            F.when(apart | (new_regex & ~last_regex), True)
            .when(last_regex & ~new_regex, False)
            .when(same, new["score"] > last["score"])
            .when(covers, True)
            .otherwise(~inside & (new["score"] > last["score"]))
        )
        return F.when(last.isNull() | wins, new).otherwise(last), F.when(last.isNotNull() & apart, F.array(last)).otherwise(no_spans())

    return F.when(F.size(spans) > 1, stepwise(ordered(spans), F.lit(None).cast(SPAN), step, SPAN, F.array)).otherwise(spans)


def merge_adjacent(spans: Column, text: Column) -> Column:
    """Joins neighbours of one type with a gap of 1 to 5 characters and no newline between them.

    A joined span has the higher score and no source. ``spans`` are disjoint and in order. A run of neighbours is
    carried as its first span, the texts since and its score, so its text is put together once.
    """
    # What lies between a span and the one before it, where it is short enough to matter.
    item = f"struct<span:{SPAN},gap:string>"
    run = f"struct<first:{SPAN},last:int,texts:array<string>,score:double>"

    def joined(run: Column) -> Column:
        whole = span(run["first"]["start"], run["last"], run["first"]["pii_type"], F.array_join(run["texts"], ""), run["score"], F.lit(""))
        return F.array(F.when(F.size(run["texts"]) == 1, run["first"]).otherwise(whole))

    def step(run: Column, x: Column) -> tuple[Column, Column]:
        new = x["span"]
        close = run.isNotNull() & (run["first"]["pii_type"] == new["pii_type"]) & x["gap"].isNotNull() & ~F.contains(x["gap"], F.lit("\n"))
        alone = F.struct(new.alias("first"), new["end"].alias("last"), F.array(new["text"]).alias("texts"), new["score"].alias("score"))
        longer = F.struct(run["first"].alias("first"), new["end"].alias("last"), F.concat(run["texts"], F.array(x["gap"], new["text"])).alias("texts"), F.greatest(run["score"], new["score"]).alias("score"))
        return F.when(close, longer).otherwise(alone), F.when(run.isNotNull() & ~close, joined(run)).otherwise(no_spans())

    def with_gaps(pages: Column, xs: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(xs, F.greatest(i, F.lit(1)))["end"])
            return F.struct(s.alias("span"), F.when((s["start"] > before) & (s["start"] - before <= GAP), cut(pages, before, s["start"])).alias("gap"))

        return F.transform(xs, one).cast(f"array<{item}>")

    walked = lambda xs: stepwise(bound(paged(text), lambda pages: with_gaps(pages, xs)), F.lit(None).cast(run), step, SPAN, joined)
    return F.when(F.size(spans) > 1, bound(spans, walked)).otherwise(spans)


def merge(spans: Column, text: Column) -> Column:
    return merge_adjacent(resolve_overlaps(spans), text)


def rebuild(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """The text with each of its disjoint, ordered spans replaced by ``replacement(span, index)``."""

    def pieces(xs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(xs, lambda s: s["end"]))
        gaps = lambda pages: bound(ends, lambda e: F.transform(xs, lambda s, i: cut(pages, F.element_at(e, i + 1), s["start"])))
        return F.zip_with(bound(paged(text), gaps), F.transform(xs, replacement), lambda gap, new: F.concat(gap, new))

    # The rest is cut once.
    tail = F.substr(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(bound(spans, pieces), ""), tail)).otherwise(text)
