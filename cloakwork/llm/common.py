"""What the operators share: input columns, intermediate tables, batches of rows in Arrow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a temporary one.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="cloakwork-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet to the shared folder and reads it back: what reads it
    twice doesn't compute it twice, and a lost executor can't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cloakwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cloakwork/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays (``lower`` would change more)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the folds of the learning operators."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor)).cast("int")


def schema_of(docs: DataFrame, columns: list[str]) -> str:
    """The DDL of some columns, for a function over Arrow batches that passes them on."""
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)


def text_chunks(batch_iter, text_at: int, most_bytes: int):
    """Cuts Arrow batches into row ranges of about ``most_bytes`` of text, so that a worker's
    memory follows the longest text and not the number of rows."""
    for batch in batch_iter:
        start = size = 0
        column = batch.column(text_at)
        for i in range(batch.num_rows):
            size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


#: The table of CRC-32 in SQL: eight steps of one shift for each byte.
CRC_TABLE = "crc_table AS (SELECT [list_reduce(list_prepend(b::UBIGINT, [0::UBIGINT for i in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)) for b in range(256)] AS entries)"


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text in UTF-8; the query has ``CRC_TABLE`` and takes rows from ``crc_table`` too."""
    step = "xor(r >> 8, entries[((xor(r, b) & 255) + 1)::BIGINT])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT for i in range(strlen({text}))]), lambda r, b: {step}), 4294967295::UBIGINT)"
