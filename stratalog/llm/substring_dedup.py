"""Exact substring dedup by a distributed difference-cover suffix sort.

Suffixes are dealt out by content so that all suffixes which begin with the
same ``length`` bytes meet in one task: each window of ``length`` bytes has an
anchor, the least hash of its first stretch of short grams, and windows with
equal bytes have equal anchors. Only anchors whose surroundings occur again
are followed; their windows travel as one segment of text each. A task sorts
the suffixes of its segments by the difference cover modulo 3: it sorts the
sampled triples, recurses on their names, sorts the remaining suffixes by the
names that follow them, merges, and compares the prefixes of neighbours.

A place with more text than a task sorts (the texts around a passage of a great
many documents) is dealt out anew: its windows are cut by their distance from
the anchor into narrower stretches, and a stretch goes to a place of its own by
all the bytes that its windows have in common. The stretches narrow down to one
window, where a place holds equal windows only, so no place stays too large and
no window takes another way. Equal segments are sorted once.

The recursion ends once names stand for more bytes than a window has; what a
name leaves undecided then no window can see.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, shuffle_partitions, stored

LENGTH = 400
GRAM = 16
#: Gram positions from which a window's anchor is chosen, a power of two.
REACH = 256
#: Bytes from an anchor on that tell one place from another.
CONTEXT = LENGTH - REACH
#: Occurrences beyond which a window's second anchor tells places apart as well.
HOT = 1000
#: Bytes of text that a task sorts at a time; larger places are dealt out anew.
SORTED_BYTES = 1 << 20
#: Windows of a stretch, from one dealing to the next.
STRETCHES = (64, 16, 4, 1)
#: Bytes of small places that are sorted together: few enough for a core's cache.
TOGETHER_BYTES = 1 << 17
#: Gram positions anchored at a time.
CHUNK = 1 << 22
#: Segments that a task remembers having sent.
SENT = 200_000

#: Odd multipliers of the gram hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PLACE = (1 << 24) - 1


def anchors(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """Anchor of each window's start: the least gram hash, the first of equals,
    among the first ``REACH`` gram positions of the window."""
    count = len(raw) - length + 1
    if count < 1:
        return np.empty(0, dtype=np.int64)
    word = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    found = np.empty(count, dtype=np.int64)
    for start in range(0, count, CHUNK):
        end = min(count, start + CHUNK)
        first, second = word[start : end + REACH - 1], word[start + 8 : end + REACH + 7]
        mixed = first * np.uint64(MIX[0]) + second * np.uint64(MIX[1])
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(MIX[2])
        least = (mixed & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(mixed), dtype=np.uint64)
        step = 1
        while step < REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        found[start:end] = (least & np.uint64(PLACE)).astype(np.int64) + start
    return found


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values, and the index behind it."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1)
    return starts, np.append(starts[1:], len(values))


def place_class(raw: bytes, at: int) -> int:
    return xxhash.xxh64_intdigest(raw[at : at + CONTEXT]) - (1 << 63)


def difference_cover_order(s: np.ndarray, covered: int, most: int) -> np.ndarray:
    """Positions of ``s`` (numbers from 1) in the order of their suffixes.

    covered: how many symbols of the text one symbol of ``s`` stands for; order
    beyond ``most`` symbols of the text is left undecided.
    """
    n = len(s)
    width = max(1, int(max(n + 3, int(s.max(initial=0)) + 1)).bit_length())
    if 3 * width > 63:
        raise ValueError("too long to be sorted at a time")
    if n < 3:
        padded = [(*s[i:].tolist(),) for i in range(n)]
        return np.array(sorted(range(n), key=padded.__getitem__), dtype=np.int64)
    pad = np.concatenate([s, np.zeros(4, dtype=np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # a last, empty triple parts the halves if need be
    two = np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triples = (pad[sampled] << 2 * width) | (pad[sampled + 1] << width) | pad[sampled + 2]
    order = np.argsort(triples)
    ranked = triples[order]
    names = np.empty(len(sampled), dtype=np.int64)
    names[order] = np.cumsum(np.append(1, ranked[1:] != ranked[:-1]))
    if names.max() < len(names) and 3 * covered < most:
        order = difference_cover_order(names, 3 * covered, most)
        names[order] = np.arange(1, len(names) + 1)
    rank = np.zeros(n + 5, dtype=np.int64)
    rank[sampled] = names
    order = sampled[order]
    order = order[order < n]

    zero = np.arange(0, n, 3)
    by_one = (pad[zero] << width) | rank[zero + 1]
    sort = np.argsort(by_one)
    zero, by_one = zero[sort], by_one[sort]
    by_two = (pad[zero] << 2 * width) | (pad[zero + 1] << width) | rank[zero + 2]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    behind_two = np.searchsorted((pad[twos] << 2 * width) | (pad[twos + 1] << width) | rank[twos + 2], by_two)
    # Names that were left undecided may disagree here; such suffixes are equal as far as asked.
    behind_one = np.searchsorted((pad[ones] << width) | rank[ones + 1], by_one)
    before = np.maximum.accumulate(behind_one) + np.maximum.accumulate(behind_two)
    merged = np.empty(n, dtype=np.int64)
    at = np.arange(len(zero)) + before
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    merged[at] = zero
    merged[~taken] = order
    return merged


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows occur elsewhere among the segments."""
    sizes = np.array([len(s) for s in segments])
    joined = b"\0".join(segments) + b"\0" * 8
    bases = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(joined, dtype=np.uint8)[: int(sizes.sum() + len(sizes))]
    symbols = text.astype(np.int64) + 2
    symbols[bases + sizes] = 1  # borders, below every byte
    order = difference_cover_order(symbols, 1, length)
    asked = np.zeros(len(symbols), dtype=bool)
    for base, size in zip(bases.tolist(), sizes.tolist(), strict=True):
        asked[base : base + max(0, size - length + 1)] = True
    order = order[asked[order]]
    word = np.ndarray(shape=(len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    left, right, alive = order[:-1], order[1:], np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        if length >= 8:
            alive = alive[word[left[alive] + k] == word[right[alive] + k]]
    twice = np.zeros(len(symbols), dtype=bool)
    twice[left[alive]] = True
    twice[right[alive]] = True
    return [twice[base : base + max(0, size - length + 1)] for base, size in zip(bases.tolist(), sizes.tolist(), strict=True)]


def _own(piece: bytes) -> tuple[int, int]:
    """128 bits of a cryptographic digest, by which equal segments are known."""
    found = hashlib.blake2b(piece, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _batch(columns: list[list], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _place_documents(texts: DataFrame) -> DataFrame:
    """(t1, t2, doc_id, n_bytes, sha, classes): the class of each anchor in turn."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                at = anchors(raw)
                out[0].append(len(raw))
                out[1].append(hashlib.sha256(raw).hexdigest())
                out[2].append([place_class(raw, a) for a in at[runs_of(at)[0]].tolist()])
            made = _batch(out, (pa.int64(), pa.string(), pa.list_(pa.int64())), ["a", "b", "c"])
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), batch.column("doc_id"), *made.columns], names=["t1", "t2", "doc_id", "n_bytes", "sha", "classes"])

    return texts.mapInArrow(placed, f"t1 long, t2 long, doc_id {id_type}, n_bytes long, sha string, classes array<long>")


def _segments(texts: DataFrame) -> DataFrame:
    """Segments around followed anchors: (place, s1, s2, t1, t2, start, size, lead, bytes).

    size: windows that begin in it. lead: bytes before the anchor. bytes is null
    where the task has sent the same segment before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for t1, t2, text, marks in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "marks")), strict=True):
                raw = text.encode()
                at = anchors(raw)
                lows, highs = runs_of(at)
                for mark in marks:
                    k, hot = mark["k"], mark["hot"]
                    low, high, place = int(lows[k]), int(highs[k]), place_class(raw, int(at[lows[k]]))
                    parts = [(low, high, place)]
                    if hot:
                        # The anchor of the window's last stretch of grams, which begins LENGTH - GRAM - REACH + 1 later.
                        later = LENGTH - GRAM - REACH + 1
                        behind = anchors(raw[low + later : high - 1 + LENGTH], GRAM + REACH - 1)[: high - low]
                        parts = [
                            (low + a, low + b, xxhash.xxh64_intdigest(raw[low + later + int(behind[a]) :][:GRAM] + place.to_bytes(8, "little", signed=True) + (low + later + int(behind[a]) - int(at[low])).to_bytes(4, "little")) - (1 << 63))
                            for a, b in zip(*(x.tolist() for x in runs_of(behind)), strict=True)
                        ]
                    for first, end, where in parts:
                        piece = raw[first : end - 1 + LENGTH]
                        own = _own(piece)
                        known = own in sent
                        if not known:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(own)
                        for column, value in zip(out, (where, *own, t1, t2, first, end - first, int(at[low]) - first, None if known else piece), strict=True):
                            column.append(value)
            yield _batch(out, (*[pa.int64()] * 8, pa.binary()), ["place", "s1", "s2", "t1", "t2", "start", "size", "lead", "bytes"])

    return texts.mapInArrow(cut, "place long, s1 long, s2 long, t1 long, t2 long, start long, size long, lead long, bytes binary")


def _stretches(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces cut into stretches of ``width`` windows: (place, s1, s2, p1, p2, shift, size, lead, bytes).

    Windows of one stretch have their distance from the anchor in one interval,
    and share the bytes from its last window's start to its first window's end;
    those bytes and the interval name the new place. p1, p2, shift: the segment
    that a piece comes from, and where in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for place, p1, p2, shift, size, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("place", "p1", "p2", "shift", "size", "lead", "bytes")), strict=True):
                first = 0
                while first < size:
                    part = (lead - first) // width  # distances from part * width on
                    end = min(size, lead - part * width + 1)
                    piece = raw[first : end - 1 + LENGTH]
                    shared = raw[lead - part * width : lead - (part + 1) * width + 1 + LENGTH]
                    where = xxhash.xxh64_intdigest(shared + place.to_bytes(8, "little", signed=True) + part.to_bytes(4, "little", signed=True)) - (1 << 63)
                    for column, value in zip(out, (where, *_own(piece), p1, p2, shift + first, end - first, lead - first, piece if width > 1 else None), strict=True):
                        column.append(value)
                    first = end
            yield _batch(out, (*[pa.int64()] * 8, pa.binary()), ["place", "s1", "s2", "p1", "p2", "shift", "size", "lead", "bytes"])

    return pieces.mapInArrow(cut, "place long, s1 long, s2 long, p1 long, p2 long, shift long, size long, lead long, bytes binary")


def _sorted_places(pieces: DataFrame) -> DataFrame:
    """(s1, s2, starts, ends): runs of window starts that other pieces of a place repeat."""
    dealt = pieces.select("place", "s1", "s2", "bytes").repartition(4 * shuffle_partitions(pieces.sparkSession), "place").sortWithinPartitions("place", "s1", "s2")

    def decided(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for (_, s1, s2, _), twice in zip(held, repeated_starts([h[3] for h in held]), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
            if edges.size:
                for column, value in zip(out, (s1, s2, edges[::2].tolist(), edges[1::2].tolist()), strict=True):
                    column.append(value)
        return _batch(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), ["s1", "s2", "starts", "ends"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
        """The different pieces of each place that has more than one."""
        place: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("place", "s1", "s2", "bytes")), strict=True):
                if place and row[0] != place[0][0]:
                    if len(place) > 1:
                        yield place
                    place = []
                if not place or row[1:3] != place[-1][1:3]:
                    place.append(row)
        if len(place) > 1:
            yield place

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for place in places(batches):
            more = sum(len(p[3]) + 1 for p in place)
            if held and size + more > TOGETHER_BYTES:
                yield decided(held)
                held, size = [], 0
            held += place
            size += more
        if held:
            yield decided(held)

    return dealt.mapInArrow(swept, "s1 long, s2 long, starts array<long>, ends array<long>")


def _repeats(segments: DataFrame) -> DataFrame:
    """(s1, s2, low, high): runs of windows, by segment, that occur elsewhere.

    segments: stored rows (place, s1, s2, size, lead, bytes or null). A segment
    that occurs again is repeated whole. Pieces of places that are too large
    are cut and dealt out anew until none is.
    """
    again = segments.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n > 1")
    found = again.select("s1", "s2", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    pieces = segments.filter("bytes is not null").select("place", "s1", "s2", F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.lit(0).cast("long").alias("shift"), "size", "lead", "bytes")
    for turn, width in enumerate(STRETCHES):
        load = pieces.groupBy("place").agg(F.sum(F.octet_length("bytes") + 1).alias("load")).filter(F.col("load") > SORTED_BYTES)
        large = stored(load.select("place"), "large")
        if large.isEmpty():
            return found.unionByName(_runs(pieces, turn))
        large = checked_broadcast(large)
        found = found.unionByName(_runs(pieces.join(large, "place", "left_anti"), turn))
        left = pieces.join(large, "place", "left_semi").dropDuplicates(["p1", "p2", "shift"])
        pieces = stored(_stretches(left.select("place", "p1", "p2", "shift", "size", "lead", "bytes"), width), "pieces")
        twice = pieces.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("s1", "s2")
        whole = pieces.join(stored(twice, "twice"), ["s1", "s2"]).select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("shift").alias("low"), (F.col("shift") + F.col("size")).alias("high"))
        found = found.unionByName(whole)
    return found  # a stretch of one window is a piece of its own


def _runs(pieces: DataFrame, turn: int) -> DataFrame:
    """Sorted places, told by the segments that their pieces come from."""
    runs = _sorted_places(pieces).select("s1", "s2", F.explode(F.arrays_zip("starts", "ends")).alias("run")).select("s1", "s2", F.col("run.starts").alias("low"), F.col("run.ends").alias("high"))
    if not turn:
        return runs
    homes = pieces.select("s1", "s2", "p1", "p2", "shift")
    return homes.join(stored(runs, "runs"), ["s1", "s2"]).select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), (F.col("shift") + F.col("low")).alias("low"), (F.col("shift") + F.col("high")).alias("high"))


def _cut_texts(texts: DataFrame) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256, spans) from texts with their repeated starts."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for t1, t2, text, runs in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "runs")), strict=True):
                raw, kept, at = text.encode(), hashlib.sha256(), 0
                spans: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"] - 1 + LENGTH) for r in runs):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                for low, high in spans:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                removed = sum(high - low for low, high in spans)
                for column, value in zip(out, (t1, t2, removed, len(spans), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)), strict=True):
                    column.append(value)
            yield _batch(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.mapInArrow(done, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, spans string")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text once each byte is removed that a 400-byte
    string covers which also starts elsewhere in the corpus.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed
    runs as start:end in bytes, comma-joined). Texts count as UTF-8 bytes, null
    ones as empty, and are read whole, however long; matches don't cross
    documents; equal texts (repeated rows too) repeat each other whole from 400
    bytes on and are sorted once; null ids are kept; rows with equal ids are
    told apart by their texts; an empty table gives no rows; other columns are
    ignored, whatever their names. Texts are known by two 64-bit hashes, and an
    error is raised should two texts that differ by SHA-256 share both.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), docs[id_col].alias("doc_id"), text.alias("text"))
    base = stored(_place_documents(rows), "places")
    copies = stored(base.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sha").alias("sha"), F.max("sha").alias("other")), "copies")
    if not copies.filter("sha <> other").isEmpty():
        raise RuntimeError("two different texts share 128 bits of hash")

    # Each text once, by the copy with the least id; its anchors; those whose place occurs again.
    same = ["t1", "t2"]
    single = base.filter(F.size("classes") > 0).select(*same, "doc_id", "classes").join(copies.select(*same, "rep"), same).filter(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(same)
    spots = stored(single.select(*same, "rep", F.posexplode("classes").alias("k", "place")), "spots")
    again = stored(spots.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place", (F.col("n") > HOT).alias("hot")), "again")
    # ``again`` is stored, so that both sides are shuffled and a hot place can be split.
    marks = stored(spots.join(again, "place").groupBy(*same).agg(F.first("rep").alias("rep"), F.collect_set(F.struct("k", "hot")).alias("marks")), "marks")
    long_texts = rows.filter(F.octet_length("text") >= LENGTH).withColumnRenamed("doc_id", "rep")
    at = [long_texts[c] == marks[c] for c in same] + [long_texts["rep"].eqNullSafe(marks["rep"])]
    followed = stored(long_texts.join(marks, at).select(long_texts["t1"], long_texts["t2"], "text", "marks").dropDuplicates(same), "followed")

    segments = stored(_segments(followed), "segments")
    repeats = stored(_repeats(segments), "repeats")
    hits = segments.select("s1", "s2", *same, "start").join(repeats, ["s1", "s2"])
    hits = stored(hits.groupBy(*same).agg(F.collect_set(F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("runs")), "hits")
    cut = _cut_texts(followed.select(*same, "text").join(hits, same))

    verdicts = stored(copies.filter("copies > 1").select(*same, "copies").join(cut, same, "full_outer"), "verdicts")
    out = base.select(*same, "doc_id", "n_bytes", "sha").join(verdicts, same, "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.concat(F.lit("0:"), F.col("n_bytes").cast("string"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
    )
