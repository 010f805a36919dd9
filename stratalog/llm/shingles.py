"""Near copies by SimHash and the Jaccard similarity of word shingles, without loss.

First fingerprints of the shingle sets are linked as ``simhash`` does it, and each
of these links is verified on the whole sets. Similar sets whose fingerprints lie
further apart are found exactly, and only pairs that are not connected by then are
decided:

If two sets have similarity t, each lacks less than a share 1 - t of itself, so
under any fixed order of all shingles their first n - ceil(t n) + 1 members
share one. Sets meet in buckets of those first members only. A table of pivots
then tells most pairs apart: how many members a set has in each of ``PIVOTS``
reference sets, which part all shingles among them. A shingle that one set has
and the other lacks changes one coordinate by one, so the sum of differences is
at most the number of such shingles, and no link is lost. What is left is
verified on the whole sets.

The order is that of how many rows hold a shingle, counted over all rows, by 42
bits of its hash. Shingles of one row alone come first and need no bucket, as no
other set has them: that leaves a few rows of a set, and buckets of as few sets
as share something rare. Tasks know the order from a table of bits that tells
which shingles repeat and from the counts of the commonest ones; both have a
fixed size. A bit set by chance, or a count that isn't known, costs rows in
buckets and never a link, as all sets are ordered alike. Members of large buckets
are compared in their bucket's task, which reaches every node once where it can.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, free_shuffles, row_key, short_batches, shuffle_partitions, stored
from .components import connected_components
from .simhash import keep_stayers, majority, near_links

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
HASH_SEED = 42
#: Bits of a hash by which shingles are counted, and of these the leading ones that choose a bit of the table.
KEY_BITS = 42
TABLE_BITS = 27
#: Counts of the commonest shingles that tasks know at most.
COMMON = 500_000
#: Rows whose shingles are parted together.
PARTED_ROWS = 2_000
#: Buckets up to this size give all their pairs.
PAIRED = 32
#: Reference sets: the shingles whose hash has one remainder. Coordinates are cut at 255, which only lessens differences.
PIVOTS = 256
#: Members of all sets of a part of the graph that one task takes.
PART_MEMBERS = 8_000_000
#: What rounding may take from a product of sizes.
EPS = 1e-9


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of all 5-word shingles; of the whole sequence if
    there are fewer words. A-Z are lower-cased, words are runs without ASCII
    white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(SHINGLE_WORDS, len(words))
    first = (ends - sizes)[: len(words) - width + 1].tolist() if width else [0]
    last = ends[width - 1 :].tolist() if width else [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], HASH_SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64).view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - EPS) + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """(key, members) of rows with a text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(key), _lists([shingle_set(t) for t in part.column("text").to_pylist()])], names=[key, "members"])

    return rows.select(key, "text").mapInArrow(made, f"{key} {rows.schema[key].dataType.simpleString()}, members array<long>")


def _keys(members: np.ndarray) -> np.ndarray:
    return members.view(np.uint64) >> np.uint64(64 - KEY_BITS)


def repeated(rows: DataFrame) -> DataFrame:
    """(key, n): the keys of shingles that several rows hold, with their number.

    Keys travel as four bytes each, by parts of their leading bits; a part is
    what some hundred rows hold on average, so parts grow in number and not in size.
    """
    bits = min(KEY_BITS, max(KEY_BITS - 32, (rows.count() // 500).bit_length()))
    low = KEY_BITS - bits

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PARTED_ROWS):
                texts = batch.slice(k, PARTED_ROWS).column("text")
                keys = np.sort(np.concatenate([_keys(shingle_set(t.as_py())) for t in texts]))
                part = (keys >> np.uint64(low)).astype(np.int64)
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                rest = (keys & np.uint64((1 << low) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(part[edges]), pa.array([x.tobytes() for x in np.split(rest, edges[1:])], pa.binary())], names=["part", "rest"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, "part"):
            part, rest = group["part"].to_numpy(), group["rest"].to_pylist()
            edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
            for a, b in pairwise(edges):
                values, n = np.unique(np.frombuffer(b"".join(rest[a:b]), "<u4"), return_counts=True)
                several = n > 1
                yield pa.RecordBatch.from_arrays([pa.array((int(part[a]) << low) + values[several].astype(np.int64)), pa.array(n[several].astype(np.int64))], names=["key", "n"])

    placed = rows.select("text").mapInArrow(parted, "part long, rest binary").repartition(4 * shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")
    return placed.mapInArrow(counted, "key long, n long")


def rarity(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tasks know of the order: the table of bits, the commonest keys and their counts.

    At most ``2 ** TABLE_BITS / 64`` numbers and ``COMMON`` keys reach the driver.
    """
    cell = F.shiftright("key", KEY_BITS - TABLE_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(key, {KEY_BITS - TABLE_BITS}) & 63L as int))")
    cells = found.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    sizes = {r["size"]: r["n"] for r in found.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    least = max(sizes, default=0) + 1
    while least > 1 and sum(n for size, n in sizes.items() if size >= least - 1) <= COMMON:
        least -= 1
    common = found.filter(F.col("n") >= 1 << least).toArrow().sort_by("key")
    return table, common["key"].to_numpy(), common["n"].to_numpy()


def ranks(members: np.ndarray, table: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each shingle stands, as far as it is known: 0 for one set alone, 1 for several."""
    keys, bits = _keys(members), (64 * len(table)).bit_length() - 1
    at = keys >> np.uint64(KEY_BITS - bits)
    rank = ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(np.int64)
    if len(known):
        own = keys.astype(np.int64)
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        rank = np.where(known[place] == own, counts[place], rank)
    return rank


def pivot_table(members: np.ndarray) -> bytes:
    return np.bincount((members.view(np.uint64) % np.uint64(PIVOTS)).astype(np.int64), minlength=PIVOTS).clip(max=255).astype(np.uint8).tobytes()


def prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """(row_key, doc_id, node, fp, n, skipped, prefix, pivots): node is a hash of the whole
    set, fp its SimHash, n its size; ``prefix`` lacks the ``skipped`` first members, which no other row has."""
    order = rows.sparkSession.sparkContext.broadcast(rarity(stored(repeated(rows), "repeated")))
    free_shuffles(rows.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, counts = order.value
        for batch in batches:
            nodes, prints, sizes, skipped, firsts, tables = [], [], [], [], [], []
            for text in (x.as_py() for x in batch.column("text")):
                members = shingle_set(text)
                rank = ranks(members, table, known, counts)
                first = np.argsort(rank, kind="stable")[: prefix_size(len(members), similarity)]
                alone = int((rank[first] == 0).sum())
                nodes.append(xxhash.xxh64_intdigest(members.tobytes()))
                prints.append(majority(members))
                sizes.append(len(members))
                skipped.append(alone)
                tables.append(pivot_table(members))
                firsts.append(members[first[alone:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(skipped, pa.int32()), _lists(firsts), pa.array(tables, pa.binary())],
                names=["row_key", "doc_id", "node", "fp", "n", "skipped", "prefix", "pivots"],
            )

    return rows.select("row_key", "doc_id", "text").mapInArrow(made, f"row_key string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, fp long, n int, skipped int, prefix array<long>, pivots binary")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a sorted stream, cut so that no group is parted."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now, keys = pa.Table.from_batches([batch]), batch.column(key).to_numpy()
        done = int(other[-1]) + 1 if (other := np.flatnonzero(keys != keys[-1])).size else 0
        if not done and held and held[-1][key][-1].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        elif done:
            yield pa.concat_tables([*held, now.slice(0, done)])
            held, now = [], now.slice(done)
        held.append(now)
    if held:
        yield pa.concat_tables(held)


def meetings(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, bucket): pairs that small buckets leave possible, bucket null; and
    the members u of large buckets, v null."""
    rows = nodes.select("node", "n", "skipped", F.posexplode("prefix").alias("pos", "s")).select("node", "n", (F.col("pos") + F.col("skipped")).alias("pos"), "s")
    placed = rows.repartition(4 * shuffle_partitions(nodes.sparkSession), "s").sortWithinPartitions("s")
    least = similarity / (1 + similarity)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, "s"):
            s, node, n, pos = (part[c].to_numpy() for c in ("s", "node", "n", "pos"))
            edges = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.repeat(sizes := np.diff(np.append(edges, len(s))), sizes)
            light = np.flatnonzero((size > 1) & (size <= PAIRED))
            us, vs = [], []
            for shift in range(1, PAIRED):
                a, b = light[: len(light) - shift], light[shift:]
                same = s[a] == s[b]
                if not same.any():
                    break
                a, b = a[same], b[same]
                # Of the first shingle that two sets share, at most the rest behind it is shared too.
                most = np.minimum(n[a] - pos[a], n[b] - pos[b])
                fit = most >= least * (n[a] + n[b]) - EPS
                us.append(np.minimum(node[a][fit], node[b][fit]))
                vs.append(np.maximum(node[a][fit], node[b][fit]))
            heavy = size > PAIRED
            u, v = np.concatenate([*us, node[heavy]]), np.concatenate([*vs, node[heavy]])
            n_pairs = len(u) - int(heavy.sum())
            none = np.arange(len(u)) < n_pairs
            bucket = np.concatenate([np.zeros(n_pairs, np.int64), s[heavy]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64(), mask=~none), pa.array(bucket, pa.int64(), mask=none)], names=["u", "v", "bucket"])

    return placed.mapInArrow(met, "u long, v long, bucket long").distinct()


def possible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that pivots and sizes leave possible."""
    mine, other = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("pivots").alias(f"pivots_{c}")) for c in ("u", "v"))
    most = (1 - similarity) / (1 + similarity)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int16) for c in ("pivots_u", "pivots_v"))
                sizes = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
                fit = np.flatnonzero(np.abs(a - b).sum(axis=1) <= most * sizes + EPS)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(fit)) for c in ("u", "v")], names=["u", "v"])

    return pairs.join(mine, "u").join(other, "v").mapInArrow(left, "u long, v long")


def spanning_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all sets of one bucket which links connect."""
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    tokens = [flat[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    found, rest = [], np.argsort(sizes, kind="stable")
    marked = np.zeros(len(members), np.int64)
    while rest.size:
        front, rest = [int(rest[0])], rest[1:]
        while front and rest.size:
            x = front.pop()
            lo, hi = np.searchsorted(sizes[rest], [math.ceil(similarity * sizes[x] - EPS), math.floor(sizes[x] / similarity + EPS) + 1])
            near = rest[lo:hi]
            if not near.size:
                continue
            marked[tokens[x]] = 1
            held = np.concatenate([tokens[k] for k in near.tolist()])
            shared = np.add.reduceat(marked[held], np.cumsum(sizes[near]) - sizes[near])
            marked[tokens[x]] = 0
            hits = np.flatnonzero(shared >= similarity * (sizes[near] + sizes[x] - shared) - EPS)
            found += [(x, k) for k in near[hits].tolist()]
            front += near[hits].tolist()
            rest = np.delete(rest, lo + hits)
    return found


def _alike(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(similarity) * (F.size(a) + F.size(b) - shared) - EPS


def pair_links(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links among the pairs, a pair at a time."""
    mine, other = (sets.select(F.col("node").alias(c), F.col("members").alias(f"of_{c}")) for c in ("u", "v"))
    pairs = met.filter("bucket is null").select("u", "v").join(mine, "u").join(other, "v")
    return pairs.filter(_alike(F.col("of_u"), F.col("of_v"), similarity)).select("u", "v")


def bucket_links(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links that connect what links of a bucket connect, a bucket at a time."""
    large = met.filter("bucket is not null").select("bucket", F.col("u").alias("node")).join(sets, "node")
    large = large.repartition(4 * shuffle_partitions(met.sparkSession), "bucket").sortWithinPartitions("bucket")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, "bucket"):
            bucket, node = part["bucket"].to_numpy(), part["node"].to_numpy()
            column = part["members"].combine_chunks()
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            edges = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:], strict=False):
                pairs = spanning_links([values[ends[k] : ends[k + 1]] for k in range(a, b)], similarity)
                u, v = (node[[a + p[k] for p in pairs]] if pairs else np.empty(0, np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return large.select("bucket", "node", "members").mapInArrow(linked, "u long, v long")


def part_links(met: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links that connect what links connect, all verified on the whole sets.

    parts: (node, root), parts of the graph of all meetings. A part's sets come
    to one task, once each; a pair or bucket that is connected already is passed over.
    """
    held = sets.join(parts, "node").select("root", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "members")
    empty = F.lit(None).cast("array<long>").alias("members")
    pairs = met.filter("bucket is null").join(parts, F.col("u") == F.col("node")).select("root", F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), empty)
    large = met.filter("bucket is not null").join(parts, F.col("u") == F.col("node")).select("root", F.lit(2).alias("kind"), F.col("u").alias("a"), F.col("bucket").alias("b"), empty)
    rows = held.unionByName(pairs).unionByName(large).repartition(4 * shuffle_partitions(met.sparkSession), "root").sortWithinPartitions("root", "kind", "b", "a")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, "root"):
            root, kind, a, b = (part[c].to_numpy() for c in ("root", "kind", "a", "b"))
            column = part["members"].combine_chunks()
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            edges = [*np.flatnonzero(np.append(True, root[1:] != root[:-1])).tolist(), len(root)]
            us, vs = [], []
            for low, high in pairwise(edges):
                found = _links_of(kind[low:high], a[low:high], b[low:high], lambda k, low=low: values[ends[low + k] : ends[low + k + 1]], similarity)
                us += [u for u, _ in found]
                vs += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(linked, "u long, v long")


def _links_of(kind: np.ndarray, a: np.ndarray, b: np.ndarray, members_at: Callable[[int], np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of one part: first its sets, then pairs, then members of buckets."""
    n_sets, n_pairs = int((kind == 0).sum()), int((kind == 1).sum())
    members = {node: members_at(k) for k, node in enumerate(a[:n_sets].tolist())}
    up = {node: node for node in members}
    found = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(x: int, y: int) -> None:
        found.append((x, y))
        up[top(x)] = top(y)

    for x, y in zip(a[n_sets : n_sets + n_pairs].tolist(), b[n_sets : n_sets + n_pairs].tolist(), strict=True):
        if top(x) != top(y):
            p, q = members[x], members[y]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            if shared >= similarity * (len(p) + len(q) - shared) - EPS:
                join(x, y)
    rest, bucket = a[n_sets + n_pairs :].tolist(), b[n_sets + n_pairs :].tolist()
    at = 0
    while at < len(rest):
        end = at
        while end < len(rest) and bucket[end] == bucket[at]:
            end += 1
        nodes = rest[at:end]
        if len({top(x) for x in nodes}) > 1:
            for x, y in spanning_links([members[x] for x in nodes], similarity):
                if top(nodes[x]) != top(nodes[y]):
                    join(nodes[x], nodes[y])
        at = end
    return found


def meeting_parts(met: DataFrame) -> DataFrame:
    """(node, root) of all nodes that meet, by the graph of pairs and of members of one bucket."""
    members = met.filter("bucket is not null").select("bucket", F.col("u").alias("node"))
    hubs = stored(members.groupBy("bucket").agg(F.min("node").alias("hub")), "hubs")
    edges = met.filter("bucket is null").select("u", "v").unionByName(members.join(hubs, "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    roots = stored(connected_components(edges), "roots")
    return stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "parts")


def _sized_parts(parts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts that a task takes as (node, root), and nodes of those that are too large."""
    load = parts.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.sum("n").alias("load"))
    large = checked_broadcast(stored(load.filter(F.col("load") > PART_MEMBERS).select("root"), "large"))
    return parts.join(large, "root", "left_anti"), stored(parts.join(large, "root", "left_semi").select("node"), "inside")


def verified_links(met: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links that connect what links connect.

    Parts of the graph of all meetings are decided as a whole. In parts that are
    too large for a task, buckets are decided by themselves and parts of the
    graph of pairs as a whole; in parts that are still too large a pair for each
    node is verified, then all pairs between what is not connected by then.
    """
    parts = meeting_parts(met)
    keys = stored(parts.join(nodes, "node").select("row_key", "node"), "wanted")
    found = texts.join(checked_broadcast(keys), "row_key")
    small_parts, inside = _sized_parts(parts, nodes)
    links = part_links(met, small_parts, _sets(found, "node"), similarity)
    if inside.isEmpty():
        return links
    sets = stored(_sets(found.join(checked_broadcast(inside), "node", "left_semi").dropDuplicates(["row_key"]), "node"), "sets")
    free_shuffles(met.sparkSession)
    left = stored(met.join(checked_broadcast(inside), met["u"] == inside["node"], "left_semi"), "left")
    pairs = left.filter("bucket is null")
    small_parts, rest = _sized_parts(meeting_parts(pairs), nodes)
    links = links.unionByName(part_links(pairs, small_parts, sets, similarity))
    links = stored(links.unionByName(bucket_links(left, sets, similarity)), "links")
    free_shuffles(met.sparkSession)
    # First a pair for each node, then those that are not connected by then.
    pairs = stored(pairs.join(checked_broadcast(rest), pairs["u"] == rest["node"], "left_semi").select("u", "v", "bucket"), "pairs")
    first = stored(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v", F.lit(None).cast("long").alias("bucket")), "first")
    links = stored(links.unionByName(pair_links(first, sets, similarity)), "links")
    free_shuffles(met.sparkSession)
    apart = stored(unconnected(pairs.join(first, ["u", "v"], "left_anti"), links).select("u", "v", "bucket"), "apart")
    return links.unionByName(pair_links(apart, sets, similarity))


def sketched_links(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links between sets whose SimHash fingerprints ``near_links`` connects,
    verified on the whole sets.

    Of sets with one fingerprint one stands for all: the others are paired with it,
    and it with those of near fingerprints.
    """
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    mine, other = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in ("u", "v"))
    across = near_links(heads.select("fp")).join(mine, "u").join(other, "v").select(F.col("head_u").alias("a"), F.col("head_v").alias("b"))
    within = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = across.unionByName(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    pairs = stored(possible_pairs(pairs, nodes, similarity), "sketched")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = checked_broadcast(stored(ends.join(nodes, "node").select("node", "first.row_key"), "sketched_keys"))
    sets = stored(_sets(texts.join(keys, "row_key"), "node"), "sketched_sets")
    return stored(pair_links(pairs.withColumn("bucket", F.lit(None).cast("long")), sets, similarity).distinct(), "sketched_links")


def unconnected(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends the links don't connect."""
    roots = connected_components(links)
    u, v = (checked_broadcast(stored(roots.select(F.col("node").alias(c), F.col("root").alias(f"top_{c}")), "tops")) for c in ("u", "v"))
    return pairs.join(u, "u", "left").join(v, "v", "left").filter(F.coalesce("top_u", "u") != F.coalesce("top_v", "v")).select(pairs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = MIN_SIMILARITY) -> DataFrame:
    """All columns of one document of each group that links of at least
    ``similarity`` connect: the one with the least id, null ids last, and of
    rows with that id the one with the least hash of id and text.

    Null texts count as empty; texts without words are alike; very long texts
    are read whole; repeated rows are copies; null ids are kept; an empty table
    gives none; columns of any names come through unchanged.
    """
    rows = docs.select(row_key(docs, id_col, text_col).alias("row_key"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    with short_batches(docs.sparkSession):
        prints = stored(prefixes(rows, similarity), "prefixes")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
        nodes = stored(prints.groupBy("node").agg(first, F.count("*").alias("count"), *[F.first(c).alias(c) for c in ("fp", "n", "skipped", "prefix", "pivots")]), "nodes")
        sketched = sketched_links(nodes, rows.select("row_key", "text"), similarity)
        free_shuffles(docs.sparkSession)
        met = stored(meetings(nodes, similarity), "meetings")
        free_shuffles(docs.sparkSession)
        pairs = possible_pairs(unconnected(met.filter("bucket is null").select("u", "v"), sketched), nodes, similarity)
        met = stored(pairs.withColumn("bucket", F.lit(None).cast("long")).unionByName(met.filter("bucket is not null")), "possible")
        free_shuffles(docs.sparkSession)
        links = verified_links(met, nodes.select("node", "n", "first.row_key"), rows.select("row_key", "text"), similarity)
        roots = connected_components(links.unionByName(sketched))
        labelled = nodes.select("node", "first", "count").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = labelled.groupBy("root").agg(F.min("first").alias("first"), F.sum("count").alias("count"))
    several = stored(labelled.select("node", "root").join(groups.filter("count > 1"), "root").select("node", "first"), "several")
    stays = F.col("first").isNull() | (F.col("first.row_key") == F.col("row_key"))
    return keep_stayers(docs, prints.join(several, "node", "left").select("row_key", stays.alias("stays")), id_col, text_col)
