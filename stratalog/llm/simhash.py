"""SimHash near-dedup with pivot distance tables.

Every fingerprint carries its Hamming distances to a fixed set of reference
fingerprints. Two fingerprints within t bits have no coordinate that differs
by more than t, which discards most candidate pairs by a few byte operations
before their bits are compared. Candidate pairs meet in buckets: of b blocks of
bits, any b - t at least are equal between fingerprints within t bits, so all
links share a bucket of some b - t blocks. Only distinct fingerprints are
bucketed, and a bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, shuffle_partitions, stored, without_rows
from .components import connected_components

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
PIVOTS = 16
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Buckets up to this size are compared by shifting a batch against itself.
SHIFTED = 24
#: Larger buckets than this are bucketed again by more blocks.
REFINED = 2048

#: Reference fingerprints, from a rule.
REFERENCES = [xxhash.xxh64_intdigest(f"pivot {k}".encode()) for k in range(PIVOTS)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def simhash(text: str) -> int:
    """64-bit fingerprint of a whole text as an unsigned number.

    A-Z are lower-cased, words are runs without ASCII white space, features are
    all 4-word shingles (the whole sequence if there are fewer words), and a bit
    is set if over half the feature hashes have it. No words give zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(SHINGLE_WORDS, len(words))
    first = (ends - sizes)[: len(words) - width + 1].tolist()
    last = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, fp) of every row: a hash of id and text, the id, and the
    fingerprint as a signed long."""
    rows = docs.select(row_key(docs, id_col, text_col).alias("row_key"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["row_key", "doc_id", "fp"])

    return rows.mapInArrow(made, f"row_key string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, kept: int) -> list[int]:
    """Masks of every choice of ``kept`` out of ``blocks`` blocks of the 64 bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, kept)]


def scheme(n: int, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """Blocks, and how many of them make a bucket, so that unrelated
    fingerprints seldom share one: the fewest keys with few rows a bucket."""
    for extra in range(1, 9):
        blocks = max_bits + extra
        if n <= 1 << (64 * extra // blocks):
            return blocks, extra
    return max_bits + 8, 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs are links: pivot coordinates first, then the bits."""
    keep = np.arange(len(a))
    for k in range(table.shape[1]):
        keep = keep[np.abs(table[a[keep], k] - table[b[keep], k]) <= bits]
    return keep[np.bitwise_count(fps[a[keep]] ^ fps[b[keep]]) <= bits]


def _spread(fps: np.ndarray, table: np.ndarray, members: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of one bucket: every node is reached once.

    What is left is kept in order of the first coordinate, so a node is only
    compared with the stretch that this coordinate allows.
    """
    found, rest = [], members[np.argsort(table[members, 0], kind="stable")]
    while rest.size:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            x = front.pop()
            at = table[rest, 0]
            lo, hi = np.searchsorted(at, table[x, 0] - bits, "left"), np.searchsorted(at, table[x, 0] + bits, "right")
            stretch = rest[lo:hi]
            hits = _near(fps, table, np.full(len(stretch), x), stretch, bits)
            if hits.size:
                found.append((np.full(len(hits), x), stretch[hits]))
                front.extend(stretch[hits].tolist())
                rest = np.delete(rest, lo + hits)
    return found


def bucket_links(fps: np.ndarray, table: np.ndarray, bucket: np.ndarray, bits: int, refine: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within buckets; rows of a bucket stand together."""
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if len(bucket) else 0))
    sizes = np.diff(np.append(edges, len(bucket)))
    size_of = np.repeat(sizes, sizes)
    found = []
    light = np.flatnonzero((size_of > 1) & (size_of <= SHIFTED))
    for shift in range(1, SHIFTED):
        a = light[: len(light) - shift]
        b = light[shift:]
        same = bucket[a] == bucket[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        hits = _near(fps, table, a, b, bits)
        found.append((a[hits], b[hits]))
    for start, size in zip(edges[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist(), strict=True):
        members = np.arange(start, start + size)
        if refine and size > REFINED:
            for mask in block_masks(bits + 4, 4):
                keys = fps[members] & np.uint64(mask)
                order = members[np.argsort(keys, kind="stable")]
                sub = np.unique(fps[order] & np.uint64(mask), return_inverse=True)[1]
                found += [(order[a], order[b]) for a, b in bucket_links(fps[order], table[order], sub, bits, refine=False)]
        else:
            found += _spread(fps, table, members, bits)
    return found


def forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """The links without those that close a circle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept_u, kept_v = [], []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept_u.append(a)
            kept_v.append(b)
    return kept_u, kept_v


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links between distinct fingerprints that connect all that lie
    within ``max_bits`` of each other.

    nodes: one row for each distinct ``fp``. A task holds one bucket of distinct
    fingerprints at a time (under 40 bytes each).
    """
    blocks, kept = scheme(nodes.count(), max_bits)
    packed = [
        sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * k) for k, p in enumerate(REFERENCES[start : start + 8])), F.lit(0).cast("long"))
        for start in range(0, PIVOTS, 8)
    ]
    table = nodes.select("fp", *[c.alias(f"t{k}") for k, c in enumerate(packed)])
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(block_masks(blocks, kept))])
    rows = table.select("fp", "t0", "t1", F.explode(keys).alias("b")).select("fp", "t0", "t1", "b.k", "b.key")
    placed = rows.repartition(4 * shuffle_partitions(nodes.sparkSession), "k", "key").sortWithinPartitions("k", "key")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches of a bucket that may go on
        for batch in _and_last(batches):
            done = None
            if batch is not None:
                now = [batch.column(c).to_numpy() for c in ("fp", "t0", "t1", "k", "key")]
                other = np.flatnonzero((now[3] != now[3][-1]) | (now[4] != now[4][-1]))
                at = int(other[-1]) + 1 if other.size else 0  # the last bucket may go on
                if not at and held and (held[-1][3][-1] != now[3][0] or held[-1][4][-1] != now[4][0]):
                    done, held = held, [now]
                elif at:
                    done, held = [*held, [c[:at] for c in now]], [[c[at:] for c in now]]
                else:
                    held.append(now)
            else:
                done = held
            if not done:
                continue
            part = [np.concatenate(c) for c in zip(*done, strict=True)]
            fps = part[0].view(np.uint64)
            coordinates = np.ascontiguousarray(np.stack([part[1], part[2]], axis=1)).view(np.uint8).astype(np.int16)
            starts = np.append(True, (part[3][1:] != part[3][:-1]) | (part[4][1:] != part[4][:-1]))
            pairs = bucket_links(fps, coordinates, np.cumsum(starts), max_bits)
            if pairs:
                u, v = forest(part[0][np.concatenate([p[0] for p in pairs])], part[0][np.concatenate([p[1] for p in pairs])])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return placed.mapInArrow(linked, "u long, v long")


def _and_last(batches: Iterator) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and stays of every row.

    stays is true for one document of each group: the one with the group's least
    id, and of rows with that id the one with the least hash of id and text (in
    row_key); rows that are equal in both stay together.

    component_id is the least doc_id reachable by links of at most ``max_bits``
    differing bits. Null texts count as empty; documents without words have
    fingerprint zero and are linked like any other; null ids are kept and never
    name a component unless all its ids are null; repeated rows repeat; very
    long texts are read whole; an empty table gives none; other columns are
    ignored, whatever their names. Both sides of the lookup of groups are
    shuffled from stored tables, so that Spark can split a fingerprint that a
    large part of all rows has.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    # Null ids come after all others.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    nodes = stored(prints.groupBy("fp").agg(first, F.count("*").alias("n")), "nodes")
    roots = connected_components(near_links(nodes, max_bits))
    labelled = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = labelled.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    # Only fingerprints of more than one document need a lookup; all others are their own.
    several = stored(labelled.drop("first").join(groups.filter("n > 1").select("root", "first"), "root").select("fp", "first"), "several")
    return prints.join(several, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        "row_key",
        (F.col("first").isNull() | (F.col("first.row_key") == F.col("row_key"))).alias("stays"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of one document of each near group."""
    return keep_stayers(docs, near_groups(docs, id_col, text_col, max_bits), id_col, text_col)


def keep_stayers(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``groups`` (row_key, stays) lets stay, each once."""
    groups = stored(groups, "groups")
    left = without_rows(docs, groups.filter(~F.col("stays")).select("row_key"), id_col, text_col)
    again = groups.filter("stays").groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return left
    key = free_name(left, "row_key__")
    return left.withColumn(key, row_key(left, id_col, text_col)).dropDuplicates([key]).drop(key)
