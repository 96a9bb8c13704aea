"""Documents as a stream: stateless anonymisation, and a sink that adds what is new to the mapping table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replace import mapping_rows
from ..plans.engine import Config, PiiEngine
from ..sources.store import append, exists, new_rows

@dataclass
class ReloadedEngine:
    """An engine that follows its configuration tables: they are read when a batch asks, and a new engine is made only if their
    enabled rows have changed since.

    ``tables`` gives the tables as they are now: patterns, rules, denylist and perhaps context words (small: a plan is built from their
    rows). ``make`` gives the engine for a configuration. A table that can't be read, or a bad row, leaves the last engine in use; the
    first reading raises.
    """

    tables: Callable[[], tuple[DataFrame, ...]]
    make: Callable[[Config], PiiEngine]
    version: int = 0
    failure: Exception | None = None
    _config: Config | None = None
    _engine: PiiEngine | None = None

    def __call__(self) -> PiiEngine:
        try:
            config = Config.read(*self.tables())
            self.failure = None
        except Exception as e:
            if self._engine is None:
                raise
            self.failure, config = e, self._config
        if self._engine is None or config != self._config:
            self._engine, self._config, self.version = self.make(config), config, self.version + 1
        return self._engine


MAPPING_KEYS = ["context_id", "context_type", "token"]


def anonymise_stream(engine: PiiEngine | Callable[[], PiiEngine], docs: DataFrame, texts: str, mappings: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes anonymised texts to one folder and new mappings to another.

    The texts of a batch go to a folder of their own, which a repeated batch overwrites; mappings are inserted only if
    their token is new to its context, so repeating a batch adds none. ``engine`` may be a function, a ``ReloadedEngine`` say, which
    is called for every batch.
    """
    spark = docs.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        used = engine if isinstance(engine, PiiEngine) else engine()
        found = used.anonymise(batch).persist()
        try:
            found.select("doc_id", "context_id", "context_type", "anonymized_text", "entity_count", "mode").write.mode("overwrite").parquet(f"{texts}/batch={number}")
            rows = mapping_rows(found)
            known = spark.read.schema(rows.schema).parquet(mappings) if exists(spark, mappings) else spark.createDataFrame([], rows.schema)
            known = known.join(rows.select("context_id", "context_type").distinct(), ["context_id", "context_type"], "left_semi")
            append(new_rows(known, rows, MAPPING_KEYS, [F.col("original")]), mappings)
        finally:
            found.unpersist()
            used.clear()

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests_by_day(audit: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests in windows of 24 hours every hour; works on streams, with a watermark for late rows."""
    return audit.withWatermark("created_at", late).groupBy(F.window("created_at", "24 hours", "1 hour").alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), "requests")
