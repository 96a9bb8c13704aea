"""Tables of mappings, audit rows and settings as files: what a change leaves of a table, and writing it.

Each function takes the table as it is and returns the table as it will be, so changes compose and can be
tested; ``rewrite`` puts a result in place of the old files, ``append`` adds to them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_rows(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of ``rows``, the first of each key by ``order``, unless the key is in ``existing``: what an insert adds."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(existing.select(keys), keys, "left_anti").select(rows.columns)


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return existing.unionByName(new_rows(existing, rows, keys, order))


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order`` replaces the existing one or is added."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    fresh = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return existing.join(fresh.select(keys), keys, "left_anti").select(existing.columns).unionByName(fresh.select(existing.columns))


def insert_or_conflict(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """existing and ``rows``; ValueError if a key is there already."""
    if not rows.join(existing, keys, "left_semi").isEmpty():
        raise ValueError(f"a row with this {', '.join(keys)} exists")
    return existing.unionByName(rows)


def partial_update(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Only the fields of ``changes`` that aren't null change; so no field can be set to null."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = existing.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in existing.columns])


def delete_keys(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys, keys.columns, "left_anti")


def deleted_count(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys, keys.columns, "left_semi").agg(F.count("*").alias("deleted"))


def keep_recent(existing: DataFrame, now: Column, ttl_days: int, at: str = "created_at") -> DataFrame:
    """Without rows older than ``ttl_days``; one of exactly that age stays."""
    return existing.where(F.col(at) >= now - F.make_dt_interval(F.lit(ttl_days)))


def scan(table: DataFrame, *order: str, enabled_only: bool = False) -> DataFrame:
    rows = table.where("enabled") if enabled_only else table
    return rows.orderBy(*order) if order else rows


def setting(settings: DataFrame, key: str, default: str) -> Column:
    """An aggregate: the value of a key, or the default."""
    return F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default))


def encrypted(value: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), key, F.lit("GCM")))


def decrypted(value: Column, key: Column) -> Column:
    """Null where the value doesn't decrypt with this key."""
    return F.decode(F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")), "UTF-8")


def with_encrypted(mappings: DataFrame, key: Column) -> DataFrame:
    return mappings.withColumn("original_encrypted", encrypted(F.col("original"), key)).drop("original")


def readable(mappings: DataFrame, key: Column) -> DataFrame:
    """Mappings with their originals, without those that don't decrypt."""
    return mappings.withColumn("original", decrypted(F.col("original_encrypted"), key)).where("original is not null").drop("original_encrypted")


def key_hash(key: Column) -> Column:
    return F.sha2(F.encode(key, "UTF-8"), 256)


def authorised(requests: DataFrame, api_keys: DataFrame, roles: list[str]) -> DataFrame:
    """Requests (…, api_key) whose key is active and has one of the roles."""
    good = api_keys.where(F.col("active") & F.col("role").isin(*roles)).select("key_hash")
    return requests.join(good, key_hash(F.col("api_key")) == F.col("key_hash"), "left_semi")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; a local session that names none gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="cloakwork-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def settled(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and the path: what reads it several times doesn't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/cloakwork/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps folders. A job that fails midway leaves the table as it was; between the two
    renames the old table is whole beside its place (``…-old-…``), and is put back if the second one fails."""
    spark: SparkSession = df.sparkSession
    run = uuid.uuid4().hex
    new, aside_path = f"{path.rstrip('/')}-{run}", f"{path.rstrip('/')}-old-{run}"
    df.write.parquet(new)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, aside_path))
    fs = old.getFileSystem(conf)
    there = fs.exists(old)
    if there and not fs.rename(old, aside):
        raise OSError(f"{path} can't be moved aside; the new table is in {new}")
    if not fs.rename(fresh, old):
        if there:
            fs.rename(aside, old)
        raise OSError(f"{new} can't take the place of {path}")
    if there:
        fs.delete(aside, True)


def usage(api_keys: DataFrame, requests: DataFrame) -> DataFrame:
    """api_keys with ``last_used_at`` moved on to the latest of the requests (api_key, created_at) that active keys have made."""
    used = requests.groupBy(key_hash(F.col("api_key")).alias("key_hash")).agg(F.max("created_at").alias("_at"))
    joined = api_keys.join(used, "key_hash", "left")
    return joined.withColumn("last_used_at", F.when(F.col("active"), F.greatest("last_used_at", "_at")).otherwise(F.col("last_used_at"))).select(api_keys.columns)


def found(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; LookupError if there is none."""
    row = table.where(F.col(key) == F.lit(value))
    if row.isEmpty():
        raise LookupError(f"no row with {key} {value!r}")
    return row
