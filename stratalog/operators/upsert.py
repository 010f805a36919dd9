"""Keyed writes on plain Parquet: last write wins, insert if absent, delete, replace; tables with versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYS, TABLES, conform, empty
from ..scratch import written
from ..versions import Folder, VersionLog


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the one that is last by the order columns.

    An aggregate rather than a window: rows of a hot key combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def telling_first(keys: list[str]) -> list[str]:
    """Keys with the source last, as it tells few rows apart: sorting begins with the first."""
    return sorted(keys, key=lambda k: k == "source_name")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of rows of ``old`` with the same key.

    Columns are picked one by one, all by the same rank and so from the same row:
    a table of numbers is then hashed and not sorted.
    """
    ranked = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    grouped = ranked.groupBy(*telling_first(keys))
    return (grouped.agg(*[F.max_by(c, "__rank").alias(c) for c in rest]) if rest else ranked.select(*keys).distinct()).select(old.columns)


def insert_absent(old: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those seeds whose key it lacks."""
    return old.unionByName(seeds.dropDuplicates(keys).join(old, keys, "left_anti").select(old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), telling_first(keys), "left_anti").select(old.columns)


@dataclass(frozen=True)
class Snapshot:
    """A version of a store: the folders that each table's rows are in, and the parts of its sources."""

    version: int
    tables: dict[str, list[str]]
    parts: dict[str, int]


class Transaction:
    """Changes of one or more tables on top of a snapshot, which become visible together.

    ``read`` sees the changes made so far. Files are only added: rows that are
    replaced stay in their old files, which the next version doesn't name.
    """

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base = store, base
        self.changed: dict[str, list[str]] = {}
        self.parts: dict[str, int] = {}
        self.looked_at: set[str] = set()
        self.added: list[str] = []

    def places(self, name: str) -> list[str]:
        self.looked_at.add(name)
        return self.changed.get(name, self.base.tables.get(name, []))

    def read(self, name: str) -> DataFrame:
        return self.store._rows(name, self.places(name))

    def parts_of(self, name: str) -> int:
        return self.parts.get(name, self.base.parts.get(name, self.store.parts))

    def repart(self, name: str, parts: int) -> None:
        """Write a table anew with another number of parts of each source."""
        rows = self.read(name)
        self.parts[name] = parts
        self._replace(name, rows, None)

    def append(self, name: str, rows: DataFrame) -> None:
        self.changed[name] = self.places(name) + self._add(name, conform(rows, TABLES[name]))

    def replace_sources(self, name: str, rows: DataFrame, sources: list[str] | None = None) -> None:
        """All rows of ``sources`` (those in ``rows`` if not given): the ones in
        ``rows`` take their place, and a source without any has none left."""
        new = conform(rows, TABLES[name])
        if not self.store._split(name):
            return self._replace(name, new, None)
        named = [r[0] for r in new.select("source_name").distinct().collect()] if sources is None else sources  # one row a source
        return self._replace(name, new.filter(F.col("source_name").isin(named)), {(s, p) for s in named for p in range(self.parts_of(name))})

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        new = conform(rows, TABLES[name])
        if not self.store._split(name):
            return self._replace(name, upsert(self.read(name), new, keys), None)
        touched = self._groups(name, new)
        return self._replace(name, upsert(self._in(name, touched), new, keys), touched)

    def merge(self, name: str, rows: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Rows and those stored in the partitions that they fall into, put together by ``combine``."""
        new = conform(rows, TABLES[name])
        touched = self._groups(name, new)
        return self._replace(name, combine(self._in(name, touched).unionByName(new)), touched)

    def insert_absent(self, name: str, seeds: DataFrame, keys: list[str]) -> None:
        """Seeds whose key the table lacks, in files of their own."""
        self.append(name, conform(seeds, TABLES[name]).dropDuplicates(keys).join(self.read(name), keys, "left_anti"))

    def append_new(self, name: str, rows: DataFrame, natural: list[str], number: str) -> None:
        """Rows whose natural key the table lacks, numbered on from its last one in the key's order."""
        held = self.read(name)
        last = held.agg(F.max(number)).first()[0]
        fresh = rows.dropDuplicates(natural).join(held.select(*natural), natural, "left_anti")
        self.append(name, numbered(fresh.drop(number), natural, start=(last or 0) + 1).withColumnRenamed("seq", number))

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        old = self.read(name)
        if not self.store._split(name):
            return self._replace(name, delete_keys(old, gone, keys), None)
        if set(KEYS[name]) <= set(keys):
            touched = self._groups(name, conform(gone.select(*keys), T.StructType([f for f in TABLES[name] if f.name in keys])))
        else:  # parts are known from the stored rows only
            touched = self._groups(name, old.join(gone.select(*keys).distinct(), keys, "left_semi").select(old.columns))
        return self._replace(name, delete_keys(self._in(name, touched), gone, keys), touched)

    def _groups(self, name: str, rows: DataFrame) -> set[tuple[str, int]]:
        """Partitions that rows fall into: at most so many as a source has parts."""
        return {(r[0], r[1]) for r in self.store._parted(name, rows, self.parts_of(name)).select("source_name", "part").distinct().collect()}

    def _in(self, name: str, touched: set[tuple[str, int]]) -> DataFrame:
        """Stored rows of some partitions; no other files are read."""
        held = {self.store._leaf(s, p) for s, p in touched}
        return self.store._rows(name, [p for p in self.places(name) if p.split("/", 1)[1] in held])

    def _replace(self, name: str, rows: DataFrame, touched: set[tuple[str, int]] | None) -> None:
        """Put rows in the place of those in the partitions touched, or of the whole table."""
        gone = None if touched is None else {self.store._leaf(s, p) for s, p in touched}
        kept = [] if gone is None else [p for p in self.places(name) if p.split("/", 1)[1] not in gone]
        self.looked_at.add(name)
        self.changed[name] = kept + self._add(name, rows)

    def _add(self, name: str, rows: DataFrame) -> list[str]:
        """Write rows into a new folder; the folders that hold them."""
        own = f"{name}/batch={uuid.uuid4().hex}"
        self.added.append(own)
        split = self.store._split(name)
        rows = conform(rows, TABLES[name])
        writer = self.store._parted(name, rows, self.parts_of(name)).write.partitionBy("source_name", "part") if split else rows.write
        writer.parquet(f"{self.store.path}/{own}")
        below = self.store.folder.matching(f"{own}/source_name=*/part=*") if split else [own]
        return [p.removeprefix(f"{name}/") for p in below]


class Store:
    """Tables of ``schemas.TABLES`` in one folder, with a log of their versions.

    A write adds files and then publishes a version that names the files of
    every table (``versions.VersionLog``); readers take the newest version, and
    what they have begun to read stays as it is. A write that is cut short at
    any step leaves the last version, and files that ``clean`` deletes. Of two
    writers at once one publishes first; the other's changes are made again on
    top of it if it has changed a table that they looked at, else only published
    under the next number.

    Tables with a source and a key are partitioned by source and, below it, by
    a hash of the key; a keyed write reads and replaces only the partitions that
    its keys fall into. A source has ``parts`` of them at first, and more once
    ``fit_parts`` finds that they hold too many rows.
    """

    PARTS = 16
    #: Rows of a partition beyond which ``fit_parts`` makes more of them.
    PART_ROWS = 2_000_000
    #: Times that a writer tries again after others have published first.
    TRIES = 50

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder, self.log = Folder(spark, self.path), VersionLog(spark, f"{self.path}/_log")
        self.parts = parts

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that ``clean`` has left."""
        number, content = self.log.last() if version is None else (version, self.log.read(version))
        return Snapshot(number, content.get("tables", {}), content.get("parts", {}))

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """The table as it is now, or in a snapshot; one that isn't there is empty."""
        return self._rows(name, (at or self.snapshot()).tables.get(name, []))

    def views(self) -> None:
        """Register every table of one snapshot for SQL."""
        at = self.snapshot()
        for name in TABLES:
            self.read(name, at).createOrReplaceTempView(name)

    def transact(self, changes: Callable[[Transaction], None]) -> int:
        """Make changes that become visible together; the version that has them."""
        now = self.snapshot()
        for _ in range(self.TRIES):
            change = Transaction(self, now)
            changes(change)
            for _ in range(self.TRIES):
                parts = now.parts | {n: change.parts_of(n) for n in change.changed if self._split(n)}
                if self.log.publish(now.version + 1, {"parts": parts, "tables": now.tables | change.changed}):
                    return now.version + 1
                now = self.snapshot()
                if any(now.tables.get(n, []) != change.base.tables.get(n, []) for n in change.looked_at):
                    break  # made on what is no longer so
            for place in change.added:
                self.folder.delete(place)
        raise RuntimeError(f"other writers were faster {self.TRIES} times")

    def append(self, name: str, rows: DataFrame) -> None:
        self.transact(lambda t: t.append(name, rows))

    def replace_sources(self, name: str, rows: DataFrame, sources: list[str] | None = None) -> None:
        self.transact(lambda t: t.replace_sources(name, rows, sources))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self.transact(lambda t: t.upsert(name, rows, keys))

    def insert_absent(self, name: str, seeds: DataFrame, keys: list[str]) -> None:
        self.transact(lambda t: t.insert_absent(name, seeds, keys))

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        self.transact(lambda t: t.delete(name, gone, keys))

    def fit_parts(self, name: str) -> int:
        """Make parts of a table's sources follow the rows of the largest one; their number.

        Rows are counted from the files' own figures; a table is written anew only
        when its parts are to double at least, so that growing by rows costs a
        constant number of copies of each.
        """
        at = self.snapshot()
        now = at.parts.get(name, self.parts)
        most = self.read(name, at).groupBy("source_name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        wanted = 1 << max(0, -(-most // self.PART_ROWS) - 1).bit_length()
        if wanted < 2 * now:
            return now
        self.transact(lambda t: t.repart(name, wanted))
        return wanted

    def clean(self, keep: int = 2, grace: float = 86_400.0) -> list[str]:
        """Delete all versions but the newest ``keep``, and the files that none of
        those names, if they are older than ``grace`` seconds: younger ones may
        belong to a write that has not ended. Returns what was deleted."""
        kept = {f"{name}/{p.split('/', 1)[0]}" for number in self.log.forget(keep) for name, places in self.log.read(number)["tables"].items() for p in places}
        gone = [p for p in self.folder.matching("*/batch=*") if p not in kept and self.folder.age(p) >= grace]
        for place in gone:
            self.folder.delete(place)
        return gone

    def drop(self, confirmed: bool = False) -> None:
        """Delete all tables; only if it is confirmed."""
        if not confirmed:
            raise PermissionError("deleting all tables must be confirmed")
        self.folder.delete()

    def _split(self, name: str) -> bool:
        return "source_name" in TABLES[name].fieldNames() and name in KEYS

    def _parted(self, name: str, rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*KEYS[name]), F.lit(parts)).cast("int"))

    def _leaf(self, source: str | None, part: int) -> str:
        """Where a partition's rows are in a batch of them."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"source_name={escape(source) if source else '__HIVE_DEFAULT_PARTITION__'}/part={part}"

    def _rows(self, name: str, places: list[str]) -> DataFrame:
        """Rows in some of a table's folders. The types of their names aren't guessed: 007 is no number."""
        if not places:
            return empty(self.spark, name)
        schema = T.StructType([*TABLES[name].fields, T.StructField("batch", T.StringType()), *([T.StructField("part", T.IntegerType())] if self._split(name) else [])])
        root = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{p}" for p in places]).select(TABLES[name].fieldNames())


#: Column of a row's block, in tables that ``in_blocks`` has written.
BLOCK = "block__"


def in_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """The rows written with the number of their block: a range of the order.

    Blocks follow each other as the order does, and rows equal in it share one;
    there are as many as shuffle partitions, if not given. Bounds are sampled by
    the one shuffle that deals the rows out, and what is written stays as it is,
    so that a task that is run again finds its rows where they were.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def numbered(df: DataFrame, order: list[str], start: int = 0, blocks: int | None = None) -> DataFrame:
    """Add ``seq``: places from ``start`` on in the given order, without gaps.

    Rows are dealt into blocks of the order, counted, and numbered within them;
    rows equal in ``order`` stand in any order.
    """
    held = in_blocks(df, order, blocks)
    counts = held.groupBy(BLOCK).agg(F.count("*").alias("__n"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(BLOCK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row a block
    inner = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order)) - 1
    return held.join(F.broadcast(starts), BLOCK).withColumn("seq", (inner + F.col("__before") + start).cast("long")).drop(BLOCK, "__before")
