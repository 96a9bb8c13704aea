"""Decoding a tagging model's logits, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from cloakwork.operators import detect, layers

TAGS = ["O", "B-private_person", "I-private_person", "E-private_person", "S-private_person", "B-secret", "E-secret", "S-nothing"]


def decode(text, lines):
    """(start, end, label, score) of a document; lines: tokens by line number."""
    out, at = [], 0
    for i, line in enumerate((text or "").splitlines(keepends=True)):
        now, done = None, []
        for start, end, logits in lines.get(i, [])[:512]:
            if start == end:
                continue
            k = logits.index(max(logits))
            p = 1 / sum(math.exp(x - max(logits)) for x in logits)
            kind, label = TAGS[k][0], TAGS[k][2:]
            follows = now is not None and now[2] == label
            if kind in "BS":
                done += [now] if now else []
                now = [start, end, label, [p]]
                if kind == "S":
                    done, now = [*done, now], None
            elif kind in "IE" and follows:
                now = [now[0], end, label, [*now[3], p]]
                if kind == "E":
                    done, now = [*done, now], None
            else:
                done, now = done + ([now] if now else []), None
        done += [now] if now else []
        out += [(at + s, at + e, label, round(sum(ps) / len(ps), 4)) for s, e, label, ps in done if sum(ps) / len(ps) >= 0.70]
        at += len(line)
    return sorted(out)


def test_decoding(spark):
    rng = random.Random(6)
    ends = ["\n", "\r\n", "\r", "\x0b", " ", "\x85", "\n\n", ""]
    docs, rows = [], []
    for d in range(40):
        text = "".join(" ".join("wörd" for _ in range(rng.randint(0, 9))) + rng.choice(ends) for _ in range(rng.randint(0, 7)))
        docs.append((d, text if d else None))
        for i, line in enumerate(text.splitlines()):
            tokens = [(j, min(j + 4, len(line)), [rng.choice([0.0, 5.0, 9.0, 1.5]) for _ in TAGS]) for j in range(0, len(line), 5)]
            rows.append((d, i, tokens + tokens[:1] * (600 if d == 7 else 0) + [(3, 3, [9.0] + [0.0] * 7)]))
        rows.append((d, 99, [(0, 4, [0.0] * 7 + [9.0])]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    logits = spark.createDataFrame(rows, "doc_id long, line int, tokens array<struct<start:int,end:int,logits:array<double>>>")
    found = detect.filter_findings(frame, logits, TAGS)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label, round(r.score, 4)))
    want = {d: w for d, text in docs if (w := decode(text, {i: t for e, i, t in rows if e == d}))}
    assert {d: sorted(x) for d, x in got.items()} == want and sum(map(len, want.values())) > 20

    spans = layers.Layers.of([layers.FindingsLayer(found, "filter", 20)]).find(frame).collect()
    by = {r.doc_id: r for r in spans}
    for d, text in docs:
        mine = [(s.start, s.end, s.pii_type, s.text) for s in by[d].spans]
        names = {"private_person": "PERSON", "secret": "SECRET"}
        assert sorted(mine) == sorted((s, e, names[label], text[s:e]) for s, e, label, _ in want.get(d, []) if label in names)


def test_lines(spark):
    texts = ["a\nb", "", None, "\n", "é\r\n\r\rx y", "one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.s for r in frame.select("i", detect.line_starts(F.col("text")).alias("s")).orderBy("i").collect()]
    for text, starts in zip(texts, got):
        want, at = [], 0
        for line in (text or "").splitlines(keepends=True):
            want.append(at)
            at += len(line)
        assert (starts or []) == want
