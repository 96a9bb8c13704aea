"""Patterns of users: a check before they are stored, and patterns as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detect

#: Texts on which both dialects must find the same: letters of several scripts, line ends, digits, marks, blanks, words of one character.
PROBES = (
    "", " ", "a", "A1", "é", "ß İ ı ſ K", "Anna Rossi, nata a Città il 01/03/1980\nVia Roma 5\r\nfine", "x@y.it x@y", "AB123CD 123456789012345 +39 333 1234567", "a_b-c.d/e\\f", "١٢٣ ४५ Ⅷ ²", "日本語 текст ελληνικά",
    "tab\tnbsp em line next\u0085end\x0b\x0c", "'quoted' \"text\" (a) [b] {c} <d> |e| $f ^g *h +i ?j", "😀a😀", "é combining", "aaa bbb\n\nccc\n", "key: value; token = \"0123456789abcdef\"", "\x00\x1c\x1f", "last\r", "last\u2028",
)


def refusal(spark: SparkSession, pattern: detect.Pattern, probes: Iterable[str] = PROBES) -> str | None:
    """Why a pattern can't be stored: it doesn't compile in Python's or Java's dialect, lacks its group, or finds other things
    in one dialect than in the other; None if it can."""
    if pattern.compiled is None:
        return "Python can't compile it, or it hasn't the group"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern.java)
    except Exception as e:  # noqa: BLE001  the reason is in the message
        return f"Java can't compile it: {str(e).splitlines()[-1][:200]}"
    texts = list(probes)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    in_java = {r.i: r.found for r in frame.select("i", F.regexp_extract_all("text", F.lit(pattern.java), F.lit(pattern.group)).alias("found")).collect()}
    for i, text in enumerate(texts):
        in_python = [m.group(pattern.group) or "" for m in pattern.compiled.finditer(text)]
        if in_python != in_java[i]:
            return f"in {text!r} Python finds {in_python} and Java {in_java[i]}"
    return None


def checked(spark: SparkSession, rows: DataFrame, probes: Iterable[str] = PROBES) -> DataFrame:
    """New rows of the pattern table (pii_type, pattern, flags, capture_group, …) as they are; ValueError with the reasons if one
    can't be stored. A configuration table is small: its rows come to the driver."""
    named = [(r.pii_type, detect.Pattern(r.pii_type, r.pattern, r.flags or "", r.capture_group or 0)) for r in rows.collect()]
    refused = [f"{name}: {reason}" for name, p in named if (reason := refusal(spark, p, probes))]
    if refused:
        raise ValueError("; ".join(refused))
    return rows


@dataclass
class DetectPii:
    """For each text its spans, pattern by pattern: the handler of the table function."""

    patterns: tuple = detect.SEEDED + detect.USER

    def eval(self, text: str) -> Iterator[tuple]:
        for p in self.patterns:
            for m in (p.compiled.finditer(text) if text and p.compiled else ()):
                if m.group(p.group):
                    yield m.start(p.group), m.end(p.group), p.pii_type, m.group(p.group)


def register_detect_pii(spark: SparkSession, patterns: Iterable[detect.Pattern] = detect.SEEDED + detect.USER, name: str = "detect_pii") -> None:
    """Registers ``name(text)`` for SQL: ``SELECT d.doc_id, p.* FROM docs d, LATERAL detect_pii(d.text) p``.

    Rows: start, end, pii_type, value; a null text has none. Column expressions (``detect.regex_spans``) are faster; this is for those
    who have SQL only.
    """
    given = tuple(patterns)

    class Handler:
        def __init__(self):
            self.found = DetectPii(given)

        def eval(self, text: str):
            yield from self.found.eval(text)

    spark.udtf.register(name, F.udtf(Handler, returnType="start int, end int, pii_type string, value string", useArrow=True))
