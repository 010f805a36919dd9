"""Document fingerprints: exact digests of a canonical form.

Texts are normalised (NFKC), case-folded and their white space is folded to
single spaces; a 128-bit xxhash of the result is the fingerprint. Rows of one
digest are then compared byte by byte: should two canonical forms ever share a
digest, their fingerprints get different suffixes.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, plain, shuffle_partitions, stored


def canonical(text: str) -> bytes:
    """Canonical bytes: NFKC, case folding, NFKC again, white space folded."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def mark(form: bytes) -> str:
    """What tells canonical forms of one digest apart, should there ever be two."""
    return hashlib.sha256(form).hexdigest()[:32]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; null texts count as empty.

    Equal canonical forms have equal fingerprints and no others have; null ids
    are kept; very long texts are read whole; repeated rows repeat in the
    result; an empty table gives none; other columns are ignored, whatever
    their names.
    """
    rows = plain(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(f) for f in forms], pa.string()), pa.array([mark(f) for f in forms], pa.string())], names=["doc_id", "fingerprint", "mark"])

    found = stored(rows.mapInArrow(digested, f"doc_id {id_type}, fingerprint string, mark string"), "digests")
    return separate_collisions(found, rows, {"fingerprint": "mark"})


def separate_collisions(found: DataFrame, rows: DataFrame, digests: dict[str, str]) -> DataFrame:
    """Compare canonical bytes inside equal digests; split digests that collide.

    found: stored rows with doc_id and ``digests``, columns of digests with the
    columns of their marks, which are taken away. rows: (doc_id, text). Documents
    whose digest occurs again are read back and compared, as the least and
    greatest canonical form of each digest; these combine before the shuffle, so
    that a digest that a third of all rows share is no hot group. Forms that
    have no document of their own are compared by their marks. Colliding digests
    get their marks behind them, however many there are.
    """
    shared = stored(found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "shared")
    members = checked_broadcast(stored(found.join(checked_broadcast(shared), "fingerprint", "left_semi").select("doc_id").distinct(), "members"))
    again = rows.join(members, rows["doc_id"].eqNullSafe(members["doc_id"]), "left_semi")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(f) for f in made], pa.string()), pa.array(made, pa.binary())], names=["fingerprint", "form"])

    sides = again.mapInArrow(forms, "fingerprint string, form binary").groupBy("fingerprint").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    clashing = sides.filter("least <> most").select("fingerprint")
    pairs = F.explode(F.array(*[F.struct(F.col(d).alias("fingerprint"), F.col(m).alias("mark")) for d, m in digests.items()])).alias("p")
    marked = found.select(pairs).select("p.*").groupBy("fingerprint").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    clashing = stored(clashing.unionByName(marked.filter("least <> most").select("fingerprint")).distinct(), "clashing")
    kept = [c for c in found.columns if c not in digests.values()]
    if clashing.isEmpty():
        return found.select(kept)
    for column, own in digests.items():  # not seen in practice: 128-bit collisions
        known = checked_broadcast(clashing.select(F.col("fingerprint").alias(column), F.lit(True).alias("clash")))
        found = found.join(known, column, "left").withColumn(column, F.when(F.col("clash"), F.concat_ws("-", column, own)).otherwise(F.col(column))).drop("clash")
    return found.select(kept)


ROUTED = "bucket int, halo int, doc_id {id}, t1 long, t2 long, fingerprint string, mark string, packed binary"
PROBED = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, mark string, edited_mark string"


def _key(i: object, t1: int, t2: int) -> tuple:
    """Order of documents: null ids first, then by id; equal ones by hashes of the text."""
    return (0, t1, t2) if i is None else (1, i, t1, t2)


def probe_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text.

    The edited text has its last quarter of code points (rounded down) replaced
    by as many (or all) from the start of the next document in ascending id;
    the last is followed by the first. Ids may be of any type with an order;
    null ids come first; equal ids are ordered by two hashes of the raw text.
    Null texts count as empty, very long ones are read whole. A likeness is 1.0
    if the canonical bytes are equal, else 0.0. One row for each input row, so
    repeated rows repeat; an empty table gives none; one document is its own
    next; other columns are ignored, whatever their names.

    Rows go to ranges of that order, with the first row of the following range
    sent along ("halo"), so a task needs no row of another; texts travel
    compressed.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    wanted = max(2, min(4096, 4 * shuffle_partitions(docs.sparkSession)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t1"), F.col("t2")]
    # The least key of each range: at most ``wanted`` rows.
    ranges = rows.select("doc_id", "t1", "t2").repartitionByRange(wanted, *order).groupBy(F.spark_partition_id().alias("range"))
    least = ranges.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "t1", "t2")).alias("least")).select("least.*").collect()
    cuts = sorted(_key(r["doc_id"], r["t1"], r["t2"]) for r in least)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, sent = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t1", "t2", "text")), strict=True):
                raw, form, key = text.encode(), canonical(text), _key(i, t1, t2)
                bucket = bisect.bisect_right(cuts, key) - 1
                places = [(bucket, 0)]
                if cuts[bucket] == key and bucket not in sent:  # the first range goes along with the last
                    sent.add(bucket)
                    places.append(((bucket - 1) % len(cuts), 1))
                row = (i, t1, t2, digest(form), mark(form), squeeze.compress(raw))
                for place in places:
                    for column, value in zip(out, (*place, *row), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.int32(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["bucket", "halo", "doc_id", "t1", "t2", "fingerprint", "mark", "packed"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        waiting: tuple | None = None  # a document whose next one has not come yet
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for halo, i, own, own_mark, packed in zip(*(batch.column(c).to_pylist() for c in ("halo", "doc_id", "fingerprint", "mark", "packed")), strict=True):
                if waiting is None and halo:
                    continue
                text = expand.decompress(packed).decode()
                if waiting is not None:
                    at, first, print_, mark_ = waiting
                    n = len(first)
                    edited = first[: n - n // 4] + text[: n // 4]
                    form, changed, following = canonical(first), canonical(edited), canonical(text)
                    row = (at, n, hashlib.sha256(edited.encode()).hexdigest(), print_, digest(changed), float(form == changed), float(form == following), mark_, mark(changed))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                waiting = None if halo else (i, text, own, own_mark)
            types = (batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "mark", "edited_mark"])

    sent = rows.mapInArrow(routed, ROUTED.format(id=id_type)).repartition(wanted, "bucket")
    ordered = sent.sortWithinPartitions("bucket", "halo", *order)
    found = stored(ordered.mapInArrow(probed, PROBED.format(id=id_type)), "probes")
    return separate_collisions(found, rows.select("doc_id", "text"), {"fingerprint": "mark", "edited_fingerprint": "edited_mark"})
