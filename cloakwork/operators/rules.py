"""What happens to spans between the two merges: reclassification, denylist, word boundaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import PAGE, bound, changed, cut, paged
from ..functions.text import UNICODE, strip
from ..sources import seeds

DISCARD = "\x00"


@dataclass(frozen=True)
class Rule:
    from_type: str
    to_type: str | None
    context_pattern: str | None = None
    entity_pattern: str | None = None
    context_window: int = 60

    @property
    def usable(self) -> bool:
        try:
            return any(p and re.compile(p) for p in (self.context_pattern, self.entity_pattern))
        except re.error:
            return False


SEEDED = tuple(Rule(*r) for r in seeds.RULES)
DENYLIST = {"PERSON": (frozenset(seeds.DENIED_WORDS), tuple(seeds.DENIED_PHRASES))}

# Titles and kinship words, and the characters that count as part of a word or of a secret.
TITLES = r"(?i)(?:Dr\.?|Dott\.?(?:ssa)?|Avv\.?|Ing\.?|Prof\.?|Sig\.?(?:ra)?|Arch\.?|Rag\.?|Geom\.?)\s+$"
KINSHIP = (
    r"(?i)^(?:(?:mio|mia|suo|sua|il|la|lo|i|gli|le)\s+)?"
    r"(?:moglie|marito|figlio|figlia|sorella|fratello|padre|madre|nonno|nonna|nipote|zio|zia|cugino|cugina|compagno|compagna|genero|nuora|cognato|cognata)\s+"
)
WORD = "A-Za-z0-9_"
SECRET_MARKS = r"!@#$%^&*()+=\[\]{}|;:<>?/\\~`"
SECRET_TYPES = ("SECRET", "PASSWORD")
TITLE_WINDOW = 15
WINDOW = 64


def reclassify(spans: Column, text: Column, rules: tuple[Rule, ...] = SEEDED) -> Column:
    """The first rule of the span's type whose patterns are all found gives its new type; no type discards it.

    The context pattern is looked for in the ``context_window`` characters before the span, the entity pattern in
    its text; a missing pattern isn't looked for. Rules without a pattern, or with a bad one, do nothing.
    """
    rules = [r for r in rules if r.usable]
    if not rules:
        return spans

    def new_type(s: Column, pages: Column) -> Column:
        result = None
        before = {n: cut(pages, F.greatest(s["start"] - n, F.lit(0)), s["start"]) for n in {r.context_window for r in rules if r.context_pattern}}
        for r in rules:
            holds = s["pii_type"] == r.from_type
            if r.context_pattern:
                holds &= before[r.context_window].rlike(UNICODE + r.context_pattern)
            if r.entity_pattern:
                holds &= s["text"].rlike(UNICODE + r.entity_pattern)
            target = F.lit(DISCARD if r.to_type is None else r.to_type)
            result = F.when(holds, target) if result is None else result.when(holds, target)
        return result.otherwise(s["pii_type"])

    retyped = bound(paged(text), lambda pages: F.transform(spans, lambda s: changed(s, pii_type=new_type(s, pages))))
    return F.when(F.size(spans) > 0, F.filter(retyped, lambda s: s["pii_type"] != DISCARD)).otherwise(spans)


def allowed(spans: Column, denylist: dict = DENYLIST) -> Column:
    """Without persons that go over a line end, single denied words, and spans that contain a denied phrase."""

    def denied(s: Column) -> Column:
        result = (s["pii_type"] == "PERSON") & s["text"].rlike("[\n\r]")
        lower = strip(F.lower(s["text"]))
        for pii_type, (words, phrases) in denylist.items():
            hit = F.lit(False)
            if words:
                bare = F.regexp_replace(lower, "[.,:;]+$", "")
                hit |= ~lower.rlike(UNICODE + r"\s") & bare.isin(sorted(words))
            for phrase in phrases:
                hit |= F.contains(lower, F.lit(phrase))
            result |= (s["pii_type"] == pii_type) & hit
        return result

    return F.filter(spans, lambda s: ~denied(s))


def snap(spans: Column, text: Column) -> Column:
    """Spans that begin and end with their words.

    Leading blanks go; the end moves right over ASCII word characters (and marks, for secrets), the start left if it is
    inside a word. A person takes in a title before it and then loses a leading kinship word. A span that
    changes loses its source; one that would be empty stays as it was.
    """

    def length(part: Column, pattern: str) -> Column:
        return F.length(F.regexp_extract(part, pattern, 0))

    def beyond(pages: Column, end: Column, chars: str) -> Column:
        """How many characters of a class follow; a word is rarely longer than a window, and the rest is read only where it fills one."""
        near = length(cut(pages, end, end + WINDOW), f"^[{chars}]*")
        return F.when(near < WINDOW, near).otherwise(length(cut(pages, end, F.size(pages) * PAGE), f"^[{chars}]*"))

    def one(s: Column, pages: Column) -> Column:
        start = s["start"] + length(s["text"], r"^[ \t]*")
        end = s["end"] + F.when(s["pii_type"].isin(*SECRET_TYPES), beyond(pages, s["end"], WORD + SECRET_MARKS)).otherwise(beyond(pages, s["end"], WORD))
        inside = cut(pages, start, start + 1).rlike(f"[{WORD}]")
        left = length(cut(pages, F.greatest(start - WINDOW, F.lit(0)), start), rf"[{WORD}]*\z")
        left = F.when(left < WINDOW, left).otherwise(length(cut(pages, F.lit(0), start), rf"[{WORD}]*\z"))
        start = start - F.when(inside, left).otherwise(0)
        return bound(F.struct(start.alias("start"), end.alias("end")), lambda p: finish(s, p["start"], p["end"], pages))

    def finish(s: Column, start: Column, end: Column, pages: Column) -> Column:
        person = s["pii_type"] == "PERSON"
        before = cut(pages, F.greatest(start - TITLE_WINDOW, F.lit(0)), start)
        titled = start - F.when(person, length(before, UNICODE + TITLES)).otherwise(0)
        at = titled + F.when(person, length(cut(pages, titled, end), UNICODE + KINSHIP)).otherwise(0)
        same = (at >= end) | ((at == s["start"]) & (end == s["end"]))
        return F.when(same, s).otherwise(changed(s, start=at, end=end, text=cut(pages, at, end), source=F.lit("")))

    return F.when(F.size(spans) > 0, bound(paged(text), lambda pages: F.transform(spans, lambda s: one(s, pages)))).otherwise(spans)
