"""Repairing the turns of conversations by the cheapest edits, as a fold in Spark SQL.

A conversation may open with one system turn; then user and assistant take turns, and the assistant has the last word: the
initials of its roles match ``(s?(ua)+)?``. Four states tell where in this pattern a prefix stands: nothing yet, after the system
turn, after a user, after an assistant. ``aggregate`` carries one (cost, audit) struct for each of them over the sorted turns, and
``least`` takes the cheapest way, of equally cheap ones the one whose audit comes first.

Conversations of any length: rows without their texts are dealt by range of (conversation, turn), and the runs are cut into chunks
of at most ``CHUNK`` turns. A chunk that doesn't open its conversation is folded from each of the four states; a second fold joins
the chunks of a conversation. Texts are joined only to the turns that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, materialise

CHUNK = 512
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: More than any conversation costs: a state that can't be reached.
FAR = 1 << 50
WAY = "struct<cost:bigint,audit:string>"
SOLID = r"[^\x20\x09-\x0D]"


@dataclass
class Repair:
    """summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, part, chunk, item (their
    order), edit, role, text of every repaired conversation's turns; inserted ones have empty texts."""

    summary: DataFrame
    turns: DataFrame


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): turns damaged by a hash of conversation and turn; a null counts as one space.

    Of 20 remainders, 0 drops the turn (no copies), 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = space("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(at == 4, "user").otherwise(space("role")).alias("role"),
        F.when(at == 1, "").when(at == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(at == 0, 0).when(at == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _key(conv_id: Column, role: Column, text: Column) -> Column:
    """One hash for the rows of a conversation with one role and text; equal turns are ordered by it."""
    fixed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return F.unhex(fixed(F.concat(fixed(F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))), fixed(role), text)))


def _flagged(turns: DataFrame) -> DataFrame:
    """Rows without texts, equal ones summed up, each with its faults.

    A duplicate's first occurrence is the least turn of its key: a grouping and a join, so that a text which fills a
    conversation isn't gathered in one task.
    """
    last = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    rows = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "key", (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"), "copies")
    rows = rows.groupBy("conv_id", "turn", "initial", "role", "key", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.where("copies > 0").groupBy("key").agg(F.min(place).alias("first"), F.sum("copies").alias("n"), F.count("*").alias("places")).where("places > 1").select("key", "first")
    return rows.join(first, "key", "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


def _chunks(rows: DataFrame, chunk: int, parts: int | None) -> DataFrame:
    """Sorted runs of at most ``chunk`` turns of a conversation: (part, chunk) orders the runs of one conversation."""
    keys = ["conv_id", "turn", "key"]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    whole, run = Window.partitionBy("part").orderBy(*keys), Window.partitionBy("part", "conv_id").orderBy("turn", "key")
    # A conversation that isn't the first of its part begins in it.
    dealt = dealt.withColumns({"opens": ~F.col("conv_id").eqNullSafe(F.first("conv_id").over(whole)), "row": F.row_number().over(run), "to": F.sum("copies").over(run)})
    dealt = dealt.withColumn("chunk", F.floor((F.col("row") - 1) / chunk).cast("int"))
    turn = F.struct("row", "turn", "initial", "role", "key", "blank", "truncated", "again", "copies", (F.col("to") - F.col("copies")).alias("at"))
    return dealt.groupBy("part", "conv_id", "chunk").agg(
        F.min(F.col("to") - F.col("copies")).alias("before"),
        (F.first("opens") & (F.col("chunk") == 0)).alias("opens"),
        F.filter(F.array_sort(F.collect_list(turn)), lambda t: t["copies"] > 0).alias("turns"),
    )


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(way: Column, cost, letter) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _states(ways: list[Column]) -> Column:
    return F.struct(*[w.alias(f"s{i}") for i, w in enumerate(ways)])


def _forced(t: Column) -> Column:
    return t["blank"] | t["again"]


def _step(state: Column, t: Column) -> Column:
    """The four ways after one more turn and its copies. An insertion may come before a turn that stays; before
    a deleted one it is never the first of equally cheap ways."""
    s0, s1, s2, s3 = (state[f"s{i}"] for i in range(4))
    extra = F.when(t["truncated"], CUT_OFF).otherwise(0)
    kept = lambda initial: (extra + F.when(t["initial"] == initial, 0).otherwise(REROLE), F.when(t["initial"] == initial, "K").otherwise("R"))
    user_open = _then(F.least(s0, s1, s3), INSERT, "I")
    answered = _then(s2, INSERT, "I")
    to_user = _then(F.least(s0, s1, s3, answered), *kept("u"))
    to_assistant = _then(F.least(s2, user_open), *kept("a"))
    dropped = [_then(s, DELETE, "D") for s in (s0, s1, s2, s3)]
    system = F.when(t["initial"] == "s", F.least(dropped[1], _then(s0, extra, "K"))).otherwise(dropped[1])
    moved = _states([dropped[0], system, F.least(dropped[2], to_user), F.least(dropped[3], to_assistant)])
    rest = t["copies"] - F.when(_forced(t), 0).otherwise(1)
    tail = lambda s: _states([_then(s[f"s{i}"], rest * DELETE, F.repeat(F.lit("D"), rest.cast("int"))) for i in range(4)])
    # One-element arrays bind a value, so that it is computed once.
    after = F.when(_forced(t), state).otherwise(moved)
    return F.when(rest > 0, F.transform(F.array(after), tail)[0]).otherwise(after)


def _folded(chunks: DataFrame) -> DataFrame:
    """Each chunk's ways from each state it may be met in, and its counts."""
    turns = F.col("turns")
    begin = lambda p: _states([_way(F.when(p == i, 0).otherwise(FAR), F.lit("")) for i in range(4)])
    starts = F.when(F.col("opens"), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))
    total = lambda value: F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + value(t))
    fair = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    pairs = F.zip_with(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))), lambda a, b: F.when(fair(a["initial"], b["initial"]), 0).otherwise(1))
    known = F.filter(F.transform(turns, lambda t: t["turn"]), lambda t: t.isNotNull())
    return chunks.withColumns(
        {
            "ways": F.transform(starts, lambda p: F.aggregate(turns, begin(p), _step)),
            "blank": total(lambda t: F.when(t["blank"], t["copies"]).otherwise(0)),
            "duplicate": total(lambda t: F.when(t["blank"], 0).otherwise(t["copies"] - F.when(t["again"], 0).otherwise(1))),
            "truncated": total(lambda t: F.when(t["truncated"] & ~_forced(t), 1).otherwise(0)),
            "illegal": total(lambda t: t["copies"] - 1) + F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x),
            "from": F.try_element_at(turns, F.lit(1))["initial"],
            "until": F.try_element_at(turns, F.lit(-1))["initial"],
            "least": F.array_min(known),
            "most": F.array_max(known),
            "distinct": F.size(F.array_distinct(known)).cast("long"),
        }
    )


def _joined(chunks: DataFrame) -> DataFrame:
    """One row for each conversation: the chunks' ways put together, cheapest first, with the states between them."""
    fields = ["part", "chunk", "ways", "blank", "duplicate", "truncated", "illegal", "from", "until", "least", "most", "distinct"]
    grouped = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))
    path = lambda cost, audit, states: F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), states.alias("path"))
    start = _states([path(F.lit(0 if i == 0 else FAR), F.lit(""), F.lit("")) for i in range(4)])

    def step(state: Column, chunk: Column) -> Column:
        def on(p: int, q: int) -> Column:
            before, way = state[f"s{p}"], F.coalesce(F.try_element_at(chunk["ways"], F.lit(p + 1)), F.element_at(chunk["ways"], 1))[f"s{q}"]
            return path(before["cost"] + way["cost"], F.concat(before["audit"], way["audit"]), F.concat(before["path"], F.lit(str(p))))

        return _states([F.least(*[on(p, q) for p in range(4)]) for q in range(4)])

    def count(state: Column, c: Column) -> Column:
        meets = F.when(state["until"].isNull() | c["from"].isNull() | F.concat(state["until"], c["from"]).isin("su", "ua", "au"), 0).otherwise(1)
        shared = F.when(c["least"] == state["most"], 1).otherwise(0)
        sums = [(state[n] + c[n]).alias(n) for n in ("blank", "duplicate", "truncated")]
        return F.struct(
            *sums,
            (state["illegal"] + c["illegal"] + meets).alias("illegal"),
            F.coalesce(c["until"], state["until"]).alias("until"),
            F.least(state["least"], c["least"]).alias("least"),
            F.greatest(state["most"], c["most"]).alias("most"),
            (state["distinct"] + c["distinct"] - shared).alias("distinct"),
        )

    turn = chunks.schema["least"].dataType.simpleString()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(turn)
    counts = F.struct(*[zero.alias(n) for n in ("blank", "duplicate", "truncated", "illegal")], F.lit(None).cast("string").alias("until"), none.alias("least"), none.alias("most"), zero.alias("distinct"))
    ended = lambda s, q, insert: path(s["cost"] + (INSERT if insert else 0), F.concat(s["audit"], F.lit("I" if insert else "")), F.concat(s["path"], F.lit(q)))
    best = F.aggregate("chunks", start, step, lambda s: F.least(ended(s["s0"], "0", False), ended(s["s3"], "3", False), ended(s["s2"], "2", True)))
    found = grouped.withColumns({"best": best, "counts": F.aggregate("chunks", counts, count)})
    return found.select("conv_id", "best", "counts", F.transform("chunks", lambda c: F.struct(c["part"].alias("part"), c["chunk"].alias("chunk"))).alias("at"))


def _items(chunks: DataFrame, joined: DataFrame) -> DataFrame:
    """The turns that stay or are inserted, of each chunk by the states it is entered and left in."""
    digit = lambda i: F.substr(F.col("best.path"), i, F.lit(1)).cast("int")
    states = joined.select(F.col("conv_id").alias("of"), "best", F.size("at").alias("n"), F.posexplode("at").alias("i", "where"))
    states = states.select("of", F.col("where.part").alias("in_part"), F.col("where.chunk").alias("in_chunk"), digit(F.col("i") + 1).alias("p"), digit(F.col("i") + 2).alias("q"), (F.col("i") + 1 == F.col("n")).alias("last"))
    met = chunks.join(states, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")) & (F.col("chunk") == F.col("in_chunk")))
    ways = F.coalesce(F.try_element_at("ways", F.col("p") + 1), F.element_at("ways", 1))
    audit = F.element_at(F.array(*[ways[f"s{q}"]["audit"] for q in range(4)]), F.col("q") + 1)
    met = met.withColumn("letters", F.regexp_extract_all(audit, F.lit("I?[KRD]"), 0))
    item = lambda edit, t: F.struct(edit.alias("edit"), t["initial"].alias("initial"), t["role"].alias("role"), t["key"].alias("key"))
    blank = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("initial", "role")], F.lit(None).cast("binary").alias("key"))
    none = F.filter(F.array(item(F.lit("I"), blank)), lambda x: F.lit(False))
    letter = lambda t: F.element_at(F.col("letters"), (t["at"] - F.col("before") + 1).cast("int"))
    of_turn = lambda t: F.concat(F.when(letter(t).startswith("I"), F.array(item(F.lit("I"), blank))).otherwise(none), F.when(letter(t).endswith("D"), none).otherwise(F.array(item(F.right(letter(t), F.lit(1)), t))))
    end = F.when(F.col("last") & (F.col("q") == 2), F.array(item(F.lit("I"), blank))).otherwise(none)
    met = met.withColumn("items", F.concat(F.flatten(F.transform(F.filter("turns", lambda t: ~_forced(t)), of_turn)), end))
    rows = met.withColumn("led", F.coalesce((F.col("p") == 0) & (F.col("items")[0]["edit"] == "K") & (F.col("items")[0]["initial"] == "s"), F.lit(False)).cast("int"))
    rows = rows.select("conv_id", "part", "chunk", "p", "led", F.posexplode("items").alias("item", "x"))
    # After the system turn, users stand at even places.
    due = F.when((F.col("item") - F.col("led") + (F.col("p") == 2).cast("int")) % 2 == 0, "user").otherwise("assistant")
    return rows.select("conv_id", "part", "chunk", "item", "x.edit", F.when(F.col("x.edit") == "K", F.col("x.role")).otherwise(due).alias("role"), "x.key")


def repair(conversations: DataFrame, chunk: int = CHUNK, parts: int | None = None) -> Repair:
    """The cheapest edits of every conversation, and its turns after them.

    ``conversations``: conv_id, turn, role, text and perhaps copies (how often a row stands there; a conversation whose rows have
    none is empty, and still listed). Turns are taken by number, nulls first; turns of one number in the order of a SHA-256 of
    conversation, role and text, equal ones beside each other. A null id is a conversation of its own; a null role or text counts as
    one space. Other columns are ignored; an empty table gives no rows.

    A turn's first fault counts: blank; duplicate (its role and text were seen earlier); truncated (it doesn't end in
    ``.``, ``!`` or ``?``). Keeping a turn is free, giving it to user or assistant costs 1, deleting it 2 (blank ones and duplicates must be), inserting an
    empty user's or assistant's turn 5; a truncated turn that stays adds 5.

    Bounds: a task holds chunks of ``chunk`` turns without texts; a conversation's audit is one string with a letter for each turn, and
    its chunks have up to 16 of them, so joining the chunks takes 16 bytes for each turn of one conversation.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1).cast("long")
    turns = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), copies.alias("copies"))
    turns = turns.withColumn("key", _key(F.col("conv_id"), F.col("role"), F.col("text")))
    chunks = materialise(_folded(_chunks(_flagged(turns), chunk, parts)), "turn-chunks")
    joined = _joined(chunks)
    items = _items(chunks, joined)
    texts = turns.where("copies > 0").groupBy("key").agg(F.first("text").alias("text"))
    order = ["conv_id", "part", "chunk", "item", "edit", "role"]
    kept = items.where("key is not null").join(texts, "key").select(*order, "text")
    c, gaps = F.col("counts"), F.coalesce(F.col("counts.most") - F.col("counts.least") + 1 - F.col("counts.distinct"), F.lit(0))
    summary = joined.select("conv_id", gaps.cast("long").alias("gaps"), *[c[n].alias(n) for n in ("blank", "duplicate", "truncated", "illegal")], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    return Repair(summary, kept.unionAll(items.where("key is null").select(*order, F.lit("").alias("text"))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each run of rows of one conversation; a conversation's text goes through it line by line."""
    now = running = schema = None

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        schema, done = batch.schema, []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if running is None or conv != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield out(done)
    if running is not None:
        yield out([(now, running.hexdigest())])


def repaired_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired ``role:text`` lines. SHA-256 runs over a conversation in order, so one task reads it, but
    holds no more than a batch."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "item")
    return rows.select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """The summary of every conversation with the SHA-256 of its repaired turns."""
    found = repair(conversations, chunk, parts)
    digests = repaired_digests(found.turns).withColumnRenamed("conv_id", "of")
    empty = hashlib.sha256().hexdigest()
    joined = found.summary.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select(*found.summary.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql(way: str, cost: str, letter: str) -> str:
    """A way in SQL is one string, cost before audit, so that strings compare as ways do."""
    return f"lpad((left({way}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({way}, 13) || {letter}"


_USER = f"CASE WHEN ini = 'u' THEN {_sql('(least(s0, s1, s3, ' + _sql('s2', '5', chr(39) + 'I' + chr(39)) + '))', 'extra', chr(39) + 'K' + chr(39))} ELSE {_sql('(least(s0, s1, s3, ' + _sql('s2', '5', chr(39) + 'I' + chr(39)) + '))', 'extra + 1', chr(39) + 'R' + chr(39))} END"
_OPEN = f"(least(s2, {_sql('(least(s0, s1, s3))', '5', chr(39) + 'I' + chr(39))}))"
_ASSISTANT = f"CASE WHEN ini = 'a' THEN {_sql(_OPEN, 'extra', chr(39) + 'K' + chr(39))} ELSE {_sql(_OPEN, 'extra + 1', chr(39) + 'R' + chr(39))} END"
_DROP = [_sql(f"s{i}", "2", "'D'") for i in range(4)]

ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
         {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h
  FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role0 END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
         unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(coalesce('=' || conv_id::VARCHAR, '')) || sha256(role) || text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM hurt),
flagged AS (
  SELECT *, left(role, 1) AS ini, final = '' AS blank, final <> '' AND nth > 1 AS dup, final NOT IN ('', '.', '!', '?') AND nth = 1 AS cutoff,
         CASE WHEN final NOT IN ('', '.', '!', '?') THEN 5 ELSE 0 END AS extra, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev
  FROM seen),
every AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM every
  UNION ALL
  SELECT w.conv_id, f.pos, {_DROP[0]},
         CASE WHEN blank OR dup OR ini <> 's' THEN {_DROP[1]} ELSE least({_DROP[1]}, {_sql("s0", "extra", "'K'")}) END,
         CASE WHEN blank OR dup THEN {_DROP[2]} ELSE least({_DROP[2]}, {_USER}) END,
         CASE WHEN blank OR dup THEN {_DROP[3]} ELSE least({_DROP[3]}, {_ASSISTANT}) END
  FROM ways w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1),
best AS (
  SELECT conv_id, arg_max(least(s0, s3, {_sql("s2", "5", "'I'")}), pos) AS way FROM ways GROUP BY conv_id),
letters AS (
  SELECT conv_id, generate_subscripts(l, 1) AS pos, unnest(l) AS e
  FROM (SELECT conv_id, regexp_extract_all(substr(way, 13), 'I?[KRD]|I') AS l FROM best)),
items AS (
  SELECT conv_id, pos, 0 AS sub, 'I' AS edit, NULL::VARCHAR AS ini, NULL::VARCHAR AS role, '' AS text FROM letters WHERE e LIKE 'I%'
  UNION ALL
  SELECT l.conv_id, l.pos, 1, right(e, 1), ini, role, text FROM letters l JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos WHERE right(e, 1) IN ('K', 'R')),
placed AS (
  SELECT *, row_number() OVER o - 1 AS j, CASE WHEN first_value(edit) OVER o = 'K' AND first_value(ini) OVER o = 's' THEN 1 ELSE 0 END AS led
  FROM items WINDOW o AS (PARTITION BY conv_id ORDER BY pos, sub)),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t
  FROM placed GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cutoff) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flagged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(way, 12)::BIGINT AS cost, substr(way, 13) AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM every e JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
