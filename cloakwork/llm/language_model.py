"""Language-model scores by a weighted backoff automaton.

The model is a smoothed bigram model: every bigram that occurs ``least`` times or more is an arc of its first word's
state, with its log probability; a failure arc, with the state's backoff weight, leads to the empty history, which has
an arc for every word. One pass over a text, left to right, carries the state and adds up the weights.

All counts cover the whole training corpus, by Spark aggregations over 64-bit hashes of words. ``least`` doesn't depend on its
size; 1 keeps every bigram, and rarer ones than ``least`` are left to the lower order. The executors hold a part of the
automaton, bounded by construction: the most frequent words, ``WORDS`` of them at most, and the most frequent arcs between them,
``ARCS`` at most. What the pass meets beyond that, it emits: a word that isn't held, and a bigram without a held arc that a bitmap of fixed size
doesn't rule out. Joins with the tables of all words and arcs add their weights, so of the bigrams from ``least`` on none is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, remainder, text_chunks
from .line_prints import _span_hashes, mix
from .lookup import Lookup

#: Bounds of what is held on executors: words and arcs.
WORDS, ARCS = 1_000_000, 1_500_000
#: The count from which a bigram is an arc, unless ``least`` says otherwise.
LEAST = 2
DISCOUNT = 0.5
#: Bits of the maps that rule out words and bigrams.
BITMAP = 1 << 26
CHUNK = 1_000_000
#: The end of a text is a token that no text can contain; it is also the history of the first word.
END = 0x1234_5678_9ABC_DEF1

#: A-Z to a-z; white space is 20 and 09 to 0D.
KEPT = np.array([0 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b or 1 for b in range(256)], np.uint8)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of some texts, and the number of tokens of each: its words, then the end."""
    parts = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b" " * 8, np.uint8)
    kept = KEPT[raw]
    inside = kept != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]
    bounds = np.cumsum([len(p) + 1 for p in parts])
    words = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    out = np.full(len(starts) + len(parts), END, np.int64)
    place = np.ones(len(out), bool)
    place[np.cumsum(words + 1) - 1] = False
    out[place] = _span_hashes(kept, starts, stops - starts).view(np.int64)
    return out, words + 1


def bigram(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two words' hashes."""
    return mix(history.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)).view(np.int64)


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.concatenate([[END], tokens[:-1]]).astype(np.int64)
    before[np.cumsum(sizes) - sizes] = END
    return before


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of docs; words as hashes."""

    def run(batches):
        for batch in text_chunks(batches, 0, 4 * CHUNK):
            values, n = counted(tokens_of(batch.column(0).to_pylist())[0])
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """BITMAP bits, as bytes: those of the keys are set."""
    bit = F.pmod(column, F.lit(BITMAP)) + 1  # these functions count from 1
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for part in parts:
        out[(part["at"] - 1) * 4096 : part["at"] * 4096] |= np.frombuffer(part["bits"], np.uint8)
    return out


def may_be(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % BITMAP
    return (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)


def count_bigrams(docs: DataFrame, held: np.ndarray, words: np.ndarray, least: int = LEAST) -> DataFrame:
    """(history, word, n), written: bigrams of words that ``words`` (a bitmap) doesn't rule out, by hash; bigrams of ``held`` words
    are shuffled by their numbers, which are shorter."""
    shared = docs.sparkSession.sparkContext.broadcast((held, words))

    def run(batches):
        held, words = shared.value
        lookup, size = Lookup(held), len(held)
        for batch in text_chunks(batches, 0, 4 * CHUNK):
            tokens, sizes = tokens_of(batch.column(0).to_pylist())
            number, known = lookup.find(tokens), may_be(words, tokens)
            before, first = histories(tokens, sizes), np.cumsum(sizes) - sizes
            number_before, known_before = (np.concatenate([x[:1], x[:-1]]) for x in (number, known))
            number_before[first], known_before[first] = lookup.find(np.array([END]))[0], may_be(words, np.array([END]))[0]
            both = (number >= 0) & (number_before >= 0)
            pairs, n = counted(number_before[both].astype(np.int64) * size + number[both])
            rest = np.flatnonzero(~both & known & known_before)
            _, at, m = np.unique(bigram(before[rest], tokens[rest]), return_index=True, return_counts=True)
            at = rest[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pairs, before[at]])), pa.array(np.concatenate([np.zeros(len(pairs), np.int64), tokens[at]])), pa.array(np.concatenate([np.ones(len(pairs), bool), np.zeros(len(at), bool)])), pa.array(np.concatenate([n, m]))],
                ["history", "word", "numbered", "n"],
            )

    def named(batches):
        held, _ = shared.value
        for batch in batches:
            history, word, numbered = (c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[:3])
            pair = history[numbered]
            if len(pair):
                history[numbered], word[numbered] = held[pair // len(held)], held[pair % len(held)]
            yield pa.RecordBatch.from_arrays([pa.array(history), pa.array(word), batch.column(3)], ["history", "word", "n"])

    found = docs.select("text").mapInArrow(run, "history long, word long, numbered boolean, n long").groupBy("history", "word", "numbered").agg(F.sum("n").alias("n"))
    bigrams = materialise(found.where(F.col("n") >= least).mapInArrow(named, "history long, word long, n long"), "bigrams")
    shared.destroy()
    return bigrams


@dataclass
class Automaton:
    """The held part: per word (by ``words``, its hashes) the log10 weights of its arc from the empty history and of its
    failure arc, and the held arcs by ``bigram``."""

    words: np.ndarray
    low: np.ndarray
    fail: np.ndarray
    arcs: np.ndarray
    weight: np.ndarray
    known: np.ndarray
    joined: np.ndarray
    number: Lookup | None = None

    def start(self) -> Automaton:
        if self.number is None:  # once for each Python worker
            self.number, self.arc = Lookup(self.words), Lookup(self.arcs)
            self.words = self.arcs = None
        return self

    def walk(self, tokens: np.ndarray, sizes: np.ndarray):
        """Per token: whether its word is held, its weight in the base model and along the automaton (what isn't held counts
        as 0), and the bigrams whose arcs may be in the joined table (0 for none)."""
        at = self.number.find(tokens)
        before, first = histories(tokens, sizes), np.cumsum(sizes) - sizes
        state = np.concatenate([at[:1], at[:-1]])
        state[first] = self.number.find(np.array([END]))[0]
        take = lambda table, i: np.where(i >= 0, table[np.maximum(i, 0)], 0.0) if len(table) else np.zeros(len(i))
        low, fail = take(self.low, at), take(self.fail, state)
        both = bigram(before, tokens)
        arc = self.arc.find(both)
        weight = np.where(arc >= 0, take(self.weight, arc), low + fail)
        maybe = (arc < 0) & may_be(self.joined, both) & may_be(self.known, tokens) & may_be(self.known, before)
        return at >= 0, low, weight, np.where(maybe, both, 0)


@dataclass
class Model:
    automaton: Automaton
    words: DataFrame  # word, c
    held: int  # the executors hold words of this count and more
    fails: DataFrame  # word, fail: backoff weights of all states
    arcs: DataFrame  # key, delta: what the arcs that aren't held add to fail and low
    tokens: int
    total: float

    def low(self, c: Column) -> Column:
        return F.log10((c + 0.5) / self.total)


def columns(table: DataFrame) -> dict[str, np.ndarray]:
    """A bounded table as arrays; Arrow keeps it from becoming Python objects on the driver."""
    found = table.toArrow()
    return {c: found.column(c).to_numpy() for c in found.column_names}


def held_from(table: DataFrame, column: str, most: int, least: int) -> int:
    """The least of ``least``, its double, its fourfold ... that at most ``most`` rows reach."""
    steps = [least << k for k in range(45)]
    reached = table.agg(*[F.count_if(F.col(column) >= x) for x in steps]).first()
    return next(x for x, n in zip(steps, reached) if n <= most)


def learn(training: DataFrame, least: int = LEAST) -> Model:
    counts = materialise(count_words(training), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = tokens + 0.5 * (distinct + 1)
    least_word = held_from(counts, "c", WORDS, least)
    often = counts.where(F.col("c") >= least)
    frequent = counts.where(F.col("c") >= least_word)
    held = columns(frequent.select("word"))["word"]  # WORDS rows at most
    known = bitmap_of(often, "word")
    pairs = count_bigrams(training, held, known, least)
    seconds = often.select(F.col("word"), F.col("c").alias("c_word"))
    firsts = often.select(F.col("word").alias("history"), F.col("c").alias("c_history"))
    arc, p = (F.col("n") - DISCOUNT) / F.col("c_history"), (F.col("c_word") + 0.5) / total
    arcs = materialise(pairs.join(seconds, "word").join(firsts, "history").select("history", "word", "n", "c_history", "c_word", arc.alias("arc"), p.alias("p")), "arcs")
    # Absolute discounting; what is left of a history's mass is shared out by the lower order.
    left = (1 - F.sum("arc")) / F.greatest(1 - F.sum("p"), F.lit(1e-12))
    fails = materialise(arcs.groupBy("history").agg(F.log10(F.greatest(left, F.lit(1e-12))).alias("fail")).withColumnRenamed("history", "word"), "fails")

    def keyed(batches):
        for batch in batches:
            history, word = (batch.column(c).to_numpy() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(bigram(history, word)), batch.column(2)], ["key", "weight"])

    among = arcs.where((F.col("c_history") >= least_word) & (F.col("c_word") >= least_word))
    inside = (F.col("c_history") >= least_word) & (F.col("c_word") >= least_word) & (F.col("n") >= held_from(among, "n", ARCS, least))
    mine = columns(arcs.where(inside).select("history", "word", F.log10("arc").alias("weight")).mapInArrow(keyed, "key long, weight double"))  # ARCS rows at most
    beyond = arcs.where(~inside).withColumnRenamed("word", "second").join(fails.withColumnRenamed("word", "history"), "history")
    beyond = beyond.select("history", "second", (F.log10("arc") - F.col("fail") - F.log10("p")).alias("weight")).mapInArrow(keyed, "key long, weight double").withColumnRenamed("weight", "delta")
    beyond = materialise(beyond, "arcs-joined")

    own = columns(frequent.join(fails, "word", "left").select("word", "c", F.coalesce("fail", F.lit(0.0)).alias("fail")))  # WORDS rows at most
    automaton = Automaton(
        own["word"],
        np.log10((own["c"] + 0.5) / total),
        own["fail"],
        mine["key"],
        mine["weight"],
        known,
        bitmap_of(beyond, "key"),
    )
    discard(pairs)
    discard(arcs)
    return Model(automaton, counts, least_word, fails, beyond, tokens, total)


def score(docs: DataFrame, training: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))); ``score`` is the log10
    probability of the text under the automaton. A null text is empty and has one token, its
    end. Without any training text every token is unknown. Repeated rows appear as often as they come in; other columns
    are ignored; an empty table gives no rows.
    """
    model = learn(training, least)
    shared = docs.sparkSession.sparkContext.broadcast(model.automaton)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())

    def grouped(owner: np.ndarray, values: np.ndarray, many: int) -> tuple[pa.Array, pa.Array]:
        """Per owner, the distinct values and how often each occurs."""
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(owner))).astype(np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=many))]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values[at])), pa.ListArray.from_arrays(offsets, pa.array(times))

    def run(batches):
        automaton = shared.value.start()
        for batch in text_chunks(batches, 2, CHUNK):
            tokens, sizes = tokens_of(batch.column(2).to_pylist())
            held, low, weight, maybe = automaton.walk(tokens, sizes)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            others, times = grouped(owner[~held], tokens[~held], len(sizes))
            bigrams, often = grouped(owner[maybe != 0], maybe[maybe != 0], len(sizes))
            sums = [pa.array(np.add.reduceat(x, starts, dtype=kind)) for x, kind in ((held, np.int64), (low, np.float64), (weight, np.float64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *sums, others, times, bigrams, often],
                ["doc_id", "row", "n_tokens", "known", "low", "weight", "others", "times", "bigrams", "often"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_tokens long, known long, low double, weight double, others array<long>, times array<int>, bigrams array<long>, often array<int>"
    walked = materialise(rows.select("doc_id", "row", "text").mapInArrow(run, schema), "walked")

    def spread(values: str, times: str) -> DataFrame:
        each = walked.select("row", F.explode(F.arrays_zip(F.col(values).alias("value"), F.col(times).alias("n"))).alias("x"))
        return each.select("row", F.col("x.value").alias("value"), F.col("x.n").alias("times"))

    table = model.words.where(F.col("c") < model.held).join(model.fails, "word", "left")
    each = spread("others", "times").join(table, F.col("value") == F.col("word"), "left")
    low = model.low(F.coalesce("c", F.lit(0)))
    times = F.col("times")
    words = each.select("row", F.when(F.col("c") > 0, times).otherwise(0).alias("more"), (times * low).alias("base"), (times * (low + F.coalesce("fail", F.lit(0.0)))).alias("rest"))
    arcs = spread("bigrams", "often").join(model.arcs, F.col("value") == F.col("key")).select("row", F.lit(0).alias("more"), F.lit(0.0).alias("base"), (times * F.col("delta")).alias("rest"))
    added = words.unionAll(arcs).groupBy("row").agg(F.sum("more").alias("more"), F.sum("base").alias("base"), F.sum("rest").alias("rest"))
    scored = walked.select("doc_id", "row", "n_tokens", "known", "low", "weight").join(added, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.select(
        "doc_id", "n_tokens", plus("known", "more").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("low", "base").alias("base_score"), plus("weight", "rest").alias("score")
    )


def held_out_scores(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``score`` with held_out, learned from the rows that aren't held out (remainder 1 of 5)."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    found = score(docs, docs.where(~held_out), least)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
