"""Exact distinct counts that grow by added rows, with a sketch beside them.

Names get numbers, in the order in which they are first seen. What a source has
seen on a day is a set of bits, in buckets of 32,768 numbers; sets of any
sources and days are or-ed, so a count over all days reads bits, never rows. A
mergeable sketch of each source and day gives an estimate for less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .upsert import Store, Transaction, numbered

#: Logarithm of a sketch's cells, and its relative standard error.
CELLS = 12
ERROR = 1.04 / 2 ** (CELLS / 2)


def add(store: Store, rows: DataFrame) -> int:
    """Add rows (source_name, day, name) to the counts; the store's new version.

    All three tables change together. Rows that are there already change
    nothing, so a batch may come again. Null names count nowhere; null sources
    and days are groups of their own. Only the new rows, the names and the bits
    of the partitions that they fall into are read.
    """
    new = rows.select("source_name", F.col("day").cast("date").alias("day"), F.col("name").cast("string").alias("name")).dropna(subset=["name"])
    new = written(new.distinct(), "added")

    def change(t: Transaction) -> None:
        known = t.read("distinct_names")
        last = known.agg(F.max("id")).first()[0]
        fresh = new.select("name").distinct().join(known, "name", "left_anti")
        t.append("distinct_names", numbered(fresh, ["name"], start=0 if last is None else last + 1).withColumnRenamed("seq", "id"))
        marked = new.join(t.read("distinct_names"), "name")
        bits = marked.groupBy("source_name", "day", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        t.merge("distinct_bits", bits, lambda both: both.groupBy("source_name", "day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        cells = new.groupBy("source_name", "day").agg(F.hll_sketch_agg("name", F.lit(CELLS)).alias("sketch"))
        t.merge("distinct_sketches", cells, lambda both: both.groupBy("source_name", "day").agg(F.hll_union_agg("sketch").alias("sketch")))

    return store.transact(change)


def _chosen(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    rows = rows if first is None else rows.filter(F.col("day") >= F.lit(first).cast("date"))
    return rows if last is None else rows.filter(F.col("day") <= F.lit(last).cast("date"))


def counts(store: Store, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Exact distinct names by any of source_name and day (none: one row), over days from first to last."""
    bits = _chosen(store.read("distinct_bits"), first, last)
    united = bits.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return united.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def estimates(store: Store, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """The same estimated from sketches, with a relative standard error of ``ERROR``."""
    cells = _chosen(store.read("distinct_sketches"), first, last)
    return cells.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
