"""The whole way of a document: detect, merge, adjust, merge again, apply the policy, replace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import merge, no_spans
from ..functions.text import token_key
from ..operators import detect, policy, replace, rules, surrogates
from ..operators.layers import Layers, PatternLayer
from ..sources import store


#: The number of a written row.
ROW = "_cloakwork_row"


@dataclass(frozen=True)
class Config:
    """What a plan is built with; a later change of the tables needs a new plan."""

    patterns: tuple = detect.SEEDED + detect.USER
    rules: tuple = rules.SEEDED
    denylist: dict = field(default_factory=lambda: rules.DENYLIST)
    words: dict | None = None  # context words by type; None: the seeded ones

    @staticmethod
    def read(patterns: DataFrame, rule_rows: DataFrame, denied: DataFrame, words: DataFrame | None = None) -> Config:
        """From configuration tables; the enabled rows, in a total order. Denied values and context words count in lower
        case and without outer white space."""
        found = tuple(detect.Pattern(r.pii_type, r.pattern, r.flags or "", r.capture_group) for r in patterns.where("enabled").orderBy("pii_type", "id").collect())
        kept = tuple(rules.Rule(r.from_type, r.to_type, r.context_pattern, r.entity_pattern, r.context_window) for r in rule_rows.where("enabled").orderBy("from_type", "created_at", "id").collect())
        lists: dict = {}
        for r in denied.where("enabled").collect():
            exact, phrases = lists.setdefault(r.pii_type, (set(), []))
            if r.match_type == "contains":
                phrases.append(r.value.lower().strip())
            else:
                exact.add(r.value.lower().strip())
        near: dict | None = None if words is None else {}
        for r in [] if words is None else words.where("enabled").orderBy("entity_type", "word").collect():
            near.setdefault(r.entity_type, []).append(r.word.lower().strip())
        return Config(found, kept, {k: (frozenset(w), tuple(p)) for k, (w, p) in lists.items()}, near)


@dataclass
class PiiEngine:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    contexts: DataFrame | None = None
    policies: DataFrame | None = None
    registry: DataFrame | None = None
    stored_surrogates: DataFrame | None = None  # context_id, pii_type, real_hash, fake_value
    stored_profiles: DataFrame | None = None  # context_id, real_hash and surrogates.PERSONA
    layers: Layers | None = None  # None: the patterns of ``config``
    scratch: list = field(default_factory=list)

    def __post_init__(self):
        self.contexts = self.contexts or policy.context_types(self.spark)
        self.policies = self.policies or policy.domain_policies(self.spark)
        self.registry = self.registry or policy.type_registry(self.spark)

    def detect(self, docs: DataFrame, layers: str | None = None) -> DataFrame:
        """docs (doc_id, text, …) with ``spans`` of the engine's layers; ``layers`` names a column of further spans.

        Each stage is a projection of its own over one row, so a long expression is computed once.
        """
        text = F.col("text")
        registered = self.layers or Layers.of([PatternLayer(self.config.patterns)])
        docs = registered.find(docs)
        if layers:
            docs = docs.withColumn("spans", F.concat("spans", F.coalesce(layers, no_spans())))
        docs = docs.withColumn("spans", merge(F.col("spans"), text))
        docs = docs.withColumn("spans", rules.allowed(rules.reclassify(F.col("spans"), text, self.config.rules), self.config.denylist))
        docs = docs.withColumn("spans", rules.snap(F.col("spans"), text))
        return docs.withColumn("spans", merge(F.col("spans"), text))

    def anonymise(self, docs: DataFrame, layers: str | None = None, per_type_surrogate: bool = False) -> DataFrame:
        """docs (doc_id, text, context_id, context_type and perhaps language, mode, policy) with anonymized_text,
        entity_count, pii_types_found, entities (the last in the text first) and mode.

        A null text has no entities. In tag mode, types that a policy gives surrogates still show tags, unless
        ``per_type_surrogate``. Requests that need surrogates are searched once and written with their spans to the
        shared folder (``clear`` deletes them); each written row has a number of its own, so ids may be null or repeated, and a null
        context is a context. A value for which no surrogate is made, or one that equals it, shows its tag.
        """
        resolved, asked = policy.resolve(docs, self.contexts, self.policies), self._asked(per_type_surrogate)
        rows = self._tokens(docs, layers)
        if not resolved.where(asked).isEmpty():
            wanting = self._with_surrogates(self._settled(self._tokens(resolved.where(asked).select(docs.columns), layers)), per_type_surrogate)
            rows = self._tokens(resolved.where(~asked).select(docs.columns), layers).unionByName(wanting)
        return rows.withColumns(
            {
                "anonymized_text": replace.replaced(F.col("text"), F.col("tokens")),
                "entity_count": F.size("spans"),
                "pii_types_found": F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["pii_type"]))),
                "entities": replace.mappings(F.col("tokens")),
            }
        ).drop("spans", "tokens", "protect", "keep", "surrogate")

    def new_surrogates(self, docs: DataFrame, layers: str | None = None, per_type_surrogate: bool = False) -> tuple[DataFrame, DataFrame]:
        """What an anonymise run adds to the stored surrogates and to the stored profiles: rows whose keys they don't have."""
        asking = policy.resolve(docs, self.contexts, self.policies).where(self._asked(per_type_surrogate)).select(docs.columns)
        distinct = self._distinct(self._firsts(self._settled(self._tokens(asking, layers))))
        made = surrogates.surrogates(distinct, self.registry, self.stored_surrogates, self.stored_profiles).where(~F.col("pii_type").isin("PERSON", "FISCAL_CODE")).drop("text")
        people = surrogates.profiles_of(distinct, self.stored_profiles).select("context_id", "real_hash", *surrogates.PERSONA)
        fresh = lambda new, old, keys: store.new_rows(old if old is not None else new.limit(0), new, keys, [F.lit(0)])
        return fresh(made, self.stored_surrogates, ["context_id", "pii_type", "real_hash"]), fresh(people, self.stored_profiles, ["context_id", "real_hash"])

    @staticmethod
    def _asked(per_type: bool) -> Column:
        asked = F.col("mode") == "surrogate"
        return asked | (F.size("surrogate") > 0) if per_type else asked

    def _tokens(self, docs: DataFrame, layers: str | None) -> DataFrame:
        """Requests with their policies, and their spans with tokens.

        The policies' join stands between search and replacement: Spark pushes a later filter down through projections, and
        a copy of each expression with it, but not expressions of one side through a join.
        """
        rows = policy.resolve(self.detect(docs, layers), self.contexts, self.policies)
        rows = rows.withColumn("spans", policy.protected(F.col("spans"), F.col("protect"), F.col("keep"), F.col("surrogate")))
        return rows.withColumn("tokens", replace.with_tokens(F.col("spans")))

    def _firsts(self, rows: DataFrame) -> DataFrame:
        """The values of requests that need surrogates, without their texts."""
        language = F.coalesce("language", F.lit("it")) if "language" in rows.columns else F.lit("it")
        values = rows.select(ROW, "context_id", language.alias("language"), F.explode("spans").alias("s")).select(ROW, "context_id", "language", "s.pii_type", "s.text", "s.start")
        return surrogates.first_forms(values, ROW)

    def _settled(self, rows: DataFrame) -> DataFrame:
        table, path = store.settled(rows.withColumn(ROW, F.monotonically_increasing_id()))
        self.scratch.append(path)
        return table

    def clear(self) -> None:
        """Deletes what runs have written to the shared folder; their results can't be read after it."""
        while self.scratch:
            store.delete(self.spark, self.scratch.pop())

    @staticmethod
    def _distinct(firsts: DataFrame) -> DataFrame:
        return firsts.groupBy("context_id", "pii_type", "text").agg(F.min("language").alias("language"))

    def tag(self, docs: DataFrame) -> DataFrame:
        """Policy-free: every span becomes a tag."""
        rows = self.detect(docs).withColumn("tokens", replace.with_tokens(F.col("spans")))
        return rows.select(
            *docs.columns,
            replace.replaced(F.col("text"), F.col("tokens")).alias("anonymized_text"),
            F.size("spans").alias("entity_count"),
            F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["pii_type"]))).alias("pii_types_found"),
            replace.mappings(F.col("tokens")).alias("entities"),
        )

    def _with_surrogates(self, rows: DataFrame, per_type: bool) -> DataFrame:
        """Puts surrogates for the tokens of requests that ask for them. Each distinct value is generated once, or
        taken from what is stored."""
        firsts = self._firsts(rows)
        made = surrogates.surrogates(self._distinct(firsts), self.registry, self.stored_surrogates, self.stored_profiles)
        known = surrogates.joined(firsts, made, ["context_id", "pii_type", "text"]).where(F.lower("fake_value") != F.lower("text"))
        fakes = known.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("key", "fake_value"))).alias("_fakes"))
        # Texts without a span need no surrogates and aren't shuffled.
        has = F.coalesce(F.size("spans"), F.lit(0)) > 0
        found = rows.where(has).join(fakes, ROW, "left").unionByName(rows.where(~has), allowMissingColumns=True)
        wanted = (lambda s: (F.col("mode") == "surrogate") | F.array_contains("surrogate", s["pii_type"])) if per_type else (lambda s: F.col("mode") == "surrogate")
        fake = lambda t: F.struct(t["span"].alias("span"), F.when(wanted(t["span"]), F.coalesce(F.try_element_at("_fakes", token_key(t["span"]["text"])), t["token"])).otherwise(t["token"]).alias("token"))
        return found.withColumn("tokens", F.transform("tokens", fake)).drop(ROW, "_fakes")
