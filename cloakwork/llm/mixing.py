"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a target of words; the shares follow the sources' weights, but no source gives more than ``most_epochs`` times its
size, and what is above that goes to the others by weight. A source is taken as often in full as its target allows; of what is
left, documents are taken in the order of exponential keys, -ln(u) / quality with u from a hash, until their running sum
fills it.

A source may hold most of the rows, so running sums are made in two steps: keys are cut into ``BUCKETS`` ranges, a window sums within
(source, bucket), and the sums of a source's buckets are summed up in a second, small one. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
#: Ranges of keys of a source: a window partition has a thousandth of the largest source.
BUCKETS = 1024


def letter_share(text: Column) -> Column:
    """A document's quality weight, 0.5 to 1.5: half a point for any text, and the share of letters in it."""
    return F.coalesce(F.lit(0.5) + F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.5))


def _uniform(*parts: Column) -> Column:
    """A number within (0, 1) from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place in the order of names, without gathering them: ranges, places within them, and the sums of their sizes."""
    parts = materialise(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return parts.withColumn("place", place).join(offsets, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def _with_targets(sources: DataFrame, weights: tuple, share: float, most_epochs: float) -> DataFrame:
    """Targets: weight * level, at most ``most_epochs`` sizes; the level rises until the targets make up the share of all words.

    Each round is one aggregate over the sources; a source that is full stays so, and the rounds end when no other one fills up.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialise(_numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most_epochs)), "source-weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        held, left, n = rows.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == full or not left:
            break
        level, full = (total - held) / left, n
    return rows.withColumn("target", F.when(over | F.lit(not left), F.col("most")).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, epochs.

    ``size``: words of the text, none for null. Sources in code-point order, null last, have the ``weights`` in turn; together they
    get ``share`` times all words. ``taken``: words that the mix takes of the document; its whole ``epochs``, and perhaps once more; the document at
    which a source's target is met is taken in part, from its beginning. So a source's taken words differ from its target by a
    rounding, and no document is taken more than ``most_epochs`` times. ``quality``: a positive weight over the columns of ``docs``; by default ``letter_share``.

    Results depend on (doc_id, text, source) and ``seed`` only, so reruns agree. Rows that are equal in all three are interchangeable, and
    one null id is like another. An empty table gives no rows; other columns are ignored.
    """
    text, doc_id = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # One name for each source, null after all others.
    name = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    key = -F.ln(_uniform(F.lit(seed), doc_id, F.md5(F.encode(text, "UTF-8")))) / (letter_share(text) if quality is None else quality)
    rows = docs.select("doc_id", name.alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.encode(text, "UTF-8")).alias("h"), key.alias("key"))
    # Equal rows are one row with a number, however many there are.
    rows = materialise(rows.groupBy("doc_id", "source", "size", "h", "key").agg(F.count("*").alias("rows")), "sizes")

    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    sources = _with_targets(sources, weights, share, most_epochs)
    size, target = F.col("source_size"), F.col("target")
    epochs = F.coalesce(F.floor(target / F.nullif(size, F.lit(0))), F.lit(0)).cast("long")
    sources = sources.select("source", "source_size", "target", epochs.alias("epochs"), F.round(target - epochs * size).cast("long").alias("budget"))

    mean = rows.agg(F.avg("key")).first()[0] or 1.0
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / F.lit(mean))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    dealt = rows.withColumn("bucket", bucket)
    words = F.col("size") * F.col("rows")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    buckets = dealt.groupBy("source", "bucket").agg(F.sum(words).alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(sources, "source").drop("n")
    placed = dealt.withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0))).join(buckets, ["source", "bucket"])
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth"))
    left = F.col("budget") - F.col("earlier") - F.col("before") - F.col("nth") * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return each.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs")


ORACLE = rf"""
WITH rows_ AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h,
         coalesce(0.5::DOUBLE + length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::DOUBLE / nullif(length(text), 0)::DOUBLE, 0.5::DOUBLE) AS quality
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key FROM rows_),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight, source_size * 2::DOUBLE AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sizes),
levels AS (
  SELECT *, most / weight AS full_at,
         (total - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
chosen AS (SELECT coalesce(arg_min(level, struct_pack(a := full_at, b := source)) FILTER (level < full_at), 0) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN most <= weight * c.level THEN most ELSE weight * c.level END AS target FROM levels, chosen c),
plans AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN plans p USING (source))
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, epochs
FROM placed
"""
