"""Replacing spans by tokens or surrogates, the mappings that undo it, and undoing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN, bound, rebuild, stepwise
from ..functions.text import token_key

KEYS = ["context_id", "context_type"]
MAPPING = "struct<token:string,original:string,pii_type:string,start:int,end:int,score:double>"


def with_tokens(spans: Column) -> Column:
    """Each span with its token ``[TYPE_n]``.

    Spans of equal text, without regard to case and outer white space, have the token of the first of
    them, whatever their own type; n counts the values of a type from 1 in order of appearance.
    """

    def tokens(xs: Column) -> Column:
        keyed = F.array_sort(F.transform(xs, lambda s, i: F.struct(token_key(s["text"]).alias("key"), i.alias("i"), s["pii_type"].alias("pii_type"))))
        # Equal keys stand together now: they get one rank, and the first of them names the type.
        rank = "struct<i:int,rank:int,pii_type:string,first:boolean>"

        def ranked(last: Column, x: Column) -> tuple[Column, Column]:
            fresh = F.coalesce(last["key"] != x["key"], F.lit(True))
            number = last["rank"] + fresh.cast("int")
            return F.struct(x["key"].alias("key"), number.alias("rank")), F.array(F.struct(x["i"].alias("i"), number.alias("rank"), x["pii_type"].alias("pii_type"), fresh.alias("first")))

        def numbered(last: Column, x: Column) -> tuple[Column, Column]:
            number = F.when(last["pii_type"].eqNullSafe(x["pii_type"]), last["n"]).otherwise(0) + 1
            token = F.concat(F.lit("["), x["pii_type"], F.lit("_"), number.cast("string"), F.lit("]"))
            return F.struct(x["pii_type"].alias("pii_type"), number.alias("n")), F.array(F.struct(x["rank"].alias("rank"), token.alias("token")))

        def named(ranks: Column) -> Column:
            firsts = F.array_sort(F.transform(F.filter(ranks, lambda r: r["first"]), lambda r: F.struct(r["pii_type"], r["i"], r["rank"])))
            start = F.struct(F.lit(None).cast("string").alias("pii_type"), F.lit(0).alias("n"))
            by_rank = F.transform(F.array_sort(stepwise(firsts, start, numbered, "struct<rank:int,token:string>")), lambda t: t["token"])
            in_order = F.transform(F.array_sort(F.transform(ranks, lambda r: F.struct(r["i"], r["rank"]))), lambda r: r["rank"])
            return bound(by_rank, lambda names: F.zip_with(xs, in_order, lambda s, r: F.struct(s.alias("span"), F.element_at(names, r).alias("token"))))

        none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("rank"))
        return bound(stepwise(keyed, none, ranked, rank), named)

    return F.when(F.size(spans) > 0, bound(spans, tokens)).otherwise(F.array().cast(f"array<struct<span:{SPAN},token:string>>"))


def replaced(text: Column, tokens: Column) -> Column:
    """The text with each span of ``tokens`` (structs of span and token) replaced."""
    return rebuild(text, F.transform(tokens, lambda t: t["span"]), lambda s, i: F.element_at(tokens, i + 1)["token"])


def mappings(tokens: Column) -> Column:
    """token, original, pii_type, start, end, score of each span, the last in the text first."""
    entries = F.transform(
        tokens,
        lambda t: F.struct(
            t["token"].alias("token"),
            t["span"]["text"].alias("original"),
            t["span"]["pii_type"].alias("pii_type"),
            t["span"]["start"].alias("start"),
            t["span"]["end"].alias("end"),
            t["span"]["score"].alias("score"),
        ),
    )
    return F.reverse(entries)


def mapping_rows(anonymised: DataFrame) -> DataFrame:
    """(context_id, context_type, token, original, pii_type), one row for each token of a context.

    Of several originals the right-most of a text is kept, as it was cased there; of several texts of a
    context, the first by doc_id.
    """
    rows = anonymised.select(*KEYS, "doc_id", F.explode("entities").alias("e")).select(*KEYS, "doc_id", "e.token", (-F.col("e.start")).alias("minus"), "e.original", "e.pii_type")
    # A least struct and not a window: it is found in part before the rows of a frequent token meet.
    first = F.min(F.struct("doc_id", "minus", "original", "pii_type")).alias("first")
    return rows.groupBy(*KEYS, "token").agg(first).select(*KEYS, "token", "first.original", "first.pii_type")


#: What a token looks like; other tokens are surrogate values.
TOKEN = r"\[[^\[\]]*_[0-9]+\]"
#: Spans end with their words, so a surrogate value stands between characters that aren't these.
WORD = "[A-Za-z0-9_]"


def anchored(stored: DataFrame) -> DataFrame:
    """(context_id, context_type, token, original) rows with the ``anchor`` by which a text finds them, one row for each token.

    A token of the form ``TOKEN`` is its own anchor; of any other, the word that the fewest of its context have, of several the longest;
    "" if it has no word. Of several originals of a token the least is used.
    """
    token, columns = F.col("token"), [*KEYS, "token", "original", "anchor"]
    like_token = token.rlike(f"^(?:{TOKEN})$")
    named = stored.where(like_token).groupBy(*KEYS, "token").agg(F.min("original").alias("original")).withColumn("anchor", token)
    words = F.array_distinct(F.regexp_extract_all(token, F.lit(f"{WORD}+"), 0))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))
    rows = stored.where("token <> ''").where(~like_token).select(*KEYS, "token", "original", F.explode(words).alias("word"))
    counts = rows.groupBy(*KEYS, "word").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", (-F.length("word")).alias("minus"), "word", "original")).alias("best")
    values = rows.join(counts, [*KEYS, "word"]).groupBy(*KEYS, "token").agg(best, F.min("original").alias("original")).withColumn("anchor", F.col("best.word"))
    return named.select(columns).unionAll(values.select(columns))


def deanonymise(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """texts (context_id, context_type, text, …) with restored_text: every token of the context is replaced.

    Only mappings of the same context and context type are used. A text's tokens and words are joined with the anchors of the
    mappings, so it meets those that it holds, or shares a rare word with, and not all of its context's. Surrogate values are replaced
    after the tokens, longest first, where they stand as words of their own: "Rossi" isn't restored within "Rossini". A null text
    stays null; a null context has no mappings.

    A text and a word of its context go through that join as two 64-bit hashes. A mapping whose hash only coincides goes when contexts are compared, or, if it is of
    the same context, changes nothing in a text that doesn't hold it. ``texts`` is read twice.
    """
    alike = [F.col(k) for k in KEYS if texts.schema[k].dataType == stored.schema[k].dataType]
    marked = texts.withColumn("_id", F.xxhash64(*KEYS, "text"))
    parts = F.concat(*[F.regexp_extract_all("text", F.lit(p), 0) for p in (TOKEN, f"{WORD}+")], F.array(F.lit("")))
    # An inner explode would have Spark test the list's size first, below the projections that made the text, which computes them again.
    held = marked.select("_id", F.explode_outer(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(*alike, p)))).alias("_anchor"))
    named = F.col("token").rlike(f"^(?:{TOKEN})$").alias("named")
    known = anchored(stored).select(F.xxhash64(*alike, "anchor").alias("_anchor"), *KEYS, "token", "original", named)
    found = held.join(known, "_anchor")
    entry = lambda condition: F.collect_set(F.when(condition, F.struct((-F.length("token")).alias("order"), "token", "original")))
    found = found.groupBy("_id", *KEYS).agg(entry(F.col("named")).alias("_tokens"), F.array_sort(entry(~F.col("named"))).alias("_values"))
    originals = F.map_from_entries(F.transform("_tokens", lambda t: F.struct(t["token"], t["original"])))
    pieces = F.zip_with(F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), 0), lambda gap, token: F.concat(gap, F.coalesce(F.try_element_at("_originals", token), token, F.lit(""))))

    def put_back(text: Column, v: Column) -> Column:
        edge = lambda at, look: F.when(F.substr(v["token"], F.lit(at), F.lit(1)).rlike(WORD), look).otherwise("")
        literal = F.concat(F.lit("\\Q"), F.replace(v["token"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        pattern = F.concat(edge(1, f"(?<!{WORD})"), literal, edge(-1, f"(?!{WORD})"))
        return F.when(F.contains(text, v["token"]), F.regexp_replace(text, pattern, F.regexp_replace(v["original"], r"([\\$])", r"\\$1"))).otherwise(text)

    restored = F.aggregate("_values", F.array_join(pieces, ""), put_back)
    joined = marked.join(found.select("_id", *KEYS, originals.alias("_originals"), "_values"), ["_id", *KEYS], "left")
    return joined.withColumn("restored_text", F.coalesce(restored, F.col("text"))).select(*texts.columns, "restored_text")
