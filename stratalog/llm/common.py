"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in rows and in bytes of its values, that an operator broadcasts; beyond either, it shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: Rows of a batch where rows are large.
BATCH_ROWS = 500

_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the driver runs all tasks itself (local tests) a
    temporary folder takes its place; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; deleted when its driver ends."""
    path = f"{shared_dir(spark)}/stratalog/{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _delete(jvm, settings, path: str) -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)
    except (Py4JError, Py4JNetworkError, OSError):  # the JVM ended first
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no earlier stage, and rows
    that hold generated ids stay as they were written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is stored by now; Spark only does so
    when the driver happens to collect its garbage, and they take disk till then."""
    gc.collect()
    spark._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written for this application, once results are saved."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), scratch_dir(spark))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _value_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")) + 24 * F.size(column), F.lit(0)) + 24
        return 24 * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) + 24
    return F.lit(24 if isinstance(field.dataType, T.StructType) else 8)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most so many rows and bytes of values; reads no rows beyond that."""
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    row = df.limit(most + 1).select(size.alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return row[0] <= most and row[1] <= most_bytes


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its size allows it, else as it is. Best on a stored frame, which is read twice."""
    return F.broadcast(df) if small(df, most, most_bytes) else df


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, tables that are stored go to Python a few rows at a time, so that
    batches of long texts or large sets take little memory beside the executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, group: list[str], order: list[Column], out: str, buckets: int, dealt_by: list[Column] | None = None) -> DataFrame:
    """Add ``out``: each row's place from 0, without gaps, within its group.

    A group is cut into ``buckets`` by a hash of ``dealt_by`` (the order columns
    if not given). Rows are numbered within (group, bucket), and a bucket starts
    where the ones before it end, so that no task holds a whole group. Ties are
    numbered in any order.
    """
    bucket, n, start, place = (free_name(df, c) for c in ("bucket__", "n__", "start__", "place__"))
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*(dealt_by or order)), F.lit(buckets)).cast("int"))
    ends = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*group, bucket).agg(F.count("*").alias(n))
    starts = starts.select(*group, bucket, F.coalesce(F.sum(n).over(ends), F.lit(0)).alias(start))
    inner = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = cut.withColumn(place, F.row_number().over(inner) - 1)
    return ranked.join(starts, [*group, bucket]).withColumn(out, (F.col(start) + F.col(place)).cast("long")).drop(bucket, start, place)


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of hash of a row's id and text, in hex, by which it is found again."""
    own, text = docs[id_col], docs[text_col]
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(own, text), F.xxhash64(F.lit("second"), text, own))])


def without_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose key is not in ``keys`` (row_key), with all their columns."""
    key = free_name(docs, "row_key__")
    marked = docs.withColumn(key, row_key(docs, id_col, text_col))
    gone = checked_broadcast(stored(keys.select(F.col("row_key").alias(key)).distinct(), "gone"))
    return marked.join(gone, key, "left_anti").select(docs.columns)
