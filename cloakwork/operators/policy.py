"""Which spans a document's context protects, keeps or replaces by surrogates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import seeds

TYPES = "array<string>"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as part of the plan, so that Spark knows its size.

    A table made from Python rows is an RDD of unknown size: Spark sorts and merges, and all documents of one context or domain go to one task.
    """
    kinds = {"string": pa.string(), "boolean": pa.bool_(), TYPES: pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields]), schema)


def context_types(spark: SparkSession) -> DataFrame:
    rows = [(code, domain, "surrogate" if code in seeds.SURROGATE_CONTEXTS else "tag", True) for code, domain in seeds.CONTEXTS.items()]
    return local_table(spark, rows, "code string, domain string, default_mode string, enabled boolean")


def domain_policies(spark: SparkSession) -> DataFrame:
    rows = [(domain, protect.split(), keep.split(), [], True) for domain, (protect, keep) in seeds.POLICIES.items()]
    return local_table(spark, rows, f"domain string, protect_types {TYPES}, keep_types {TYPES}, surrogate_types {TYPES}, enabled boolean")


def type_registry(spark: SparkSession) -> DataFrame:
    rows = [(*row, True) for row in seeds.PII_TYPES]
    return local_table(spark, rows, "code string, category string, display_name string, default_action string, faker_strategy string, reversible boolean, enabled boolean")


def type_list(column: Column, kind: str) -> Column:
    """A list of types that is stored as an array or as JSON text."""
    return F.from_json(column, TYPES) if kind == "string" else column


def resolve(docs: DataFrame, contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """docs with protect (null: everything), keep, surrogate and mode.

    The columns context_type, mode and policy (a struct of the arrays protect, keep, surrogate) of docs are used if they are
    there. An array of the policy replaces the domain's one of the same name, unless it is null. An unknown or
    disabled context or policy protects everything. The mode is the document's, else the context's, else "tag"; an empty
    one counts as none. Context and policy tables hold one row per context and domain; they are broadcast only while
    Spark's own size threshold allows it.
    """
    kinds = dict(policies.dtypes)
    known = contexts.where("enabled").select(F.col("code").alias("_code"), F.col("domain").alias("_domain"), F.col("default_mode").alias("_mode"))
    rules = policies.where("enabled").select(F.col("domain").alias("_of"), *[type_list(F.col(f"{n}_types"), kinds[f"{n}_types"]).alias(f"_{n}") for n in ("protect", "keep", "surrogate")])
    has_policy, has_mode = "policy" in docs.columns, "mode" in docs.columns
    joined = docs.join(known, docs["context_type"] == known["_code"], "left").join(rules, F.col("_domain") == F.col("_of"), "left")
    own = lambda n: F.col(f"policy.{n}") if has_policy else F.lit(None).cast(TYPES)
    none = F.array().cast(TYPES)
    mode = F.nullif(F.col("mode"), F.lit("")) if has_mode else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "protect": F.coalesce(own("protect"), F.col("_protect")),
            "keep": F.coalesce(own("keep"), F.col("_keep"), none),
            "surrogate": F.coalesce(own("surrogate"), F.col("_surrogate"), none),
            "mode": F.coalesce(mode, F.nullif(F.col("_mode"), F.lit("")), F.lit("tag")),
        }
    ).drop("_code", "_domain", "_mode", "_of", "_protect", "_keep", "_surrogate")


def protected(spans: Column, protect: Column, keep: Column, surrogate: Column) -> Column:
    """The spans a policy replaces: none it keeps, and if it says what to protect, nothing else."""
    wanted = lambda s: protect.isNull() | F.array_contains(protect, s["pii_type"]) | F.array_contains(surrogate, s["pii_type"])
    return F.filter(spans, lambda s: ~F.array_contains(keep, s["pii_type"]) & wanted(s))
