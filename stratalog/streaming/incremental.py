"""Streaming form of the keyed tables: files of new rows are upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import Store, latest
from ..schemas import INPUTS, KEYS, TABLES


def read_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of an input or table as files arrive in a folder."""
    return spark.readStream.schema(INPUTS[name] if name in INPUTS else TABLES[name]).parquet(path)


def upsert_stream(rows: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream into a table. A batch that is run again changes nothing,
    as its rows replace themselves; within a batch the greatest row of a key holds."""
    keys = KEYS[name]

    def write(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        store.upsert(name, latest(batch, keys, *rest), keys)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_commits(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Commits of a stream, once each while within the watermark."""
    marked = rows.withWatermark("committed_ts", late)
    return marked.dropDuplicatesWithinWatermark(["source_name", "commit_hash"])


def daily_commits(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Commits by source and day; a day is told once the watermark has passed it."""
    day = F.window("committed_ts", "1 day")
    return rows.withWatermark("committed_ts", late).groupBy("source_name", day).agg(F.count("*").alias("n")).select("source_name", F.col("window.start").alias("day"), "n")
