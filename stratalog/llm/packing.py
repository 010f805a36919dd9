"""Packing token sequences by non-negative least squares over a length histogram.

A document's ids end with id 0. It is cut into whole windows and one tail.
Patterns of two or three tail lengths that fill a window exactly are weighted
by non-negative least squares against the histogram of tails, the weights are
rounded down to repeat counts, and the tails that no pattern took are packed
greedily, longest first, cut where a window ends. Only the histogram (fewer
than ``window`` numbers) reaches the driver; each row finds its place from
its rank among the tails of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, plain, short_batches, stored
from .tokenizing import default_vocabulary, token_ids

#: Most common unfilled lengths from which patterns of three are enumerated.
DEPTH_THREE = 64
SWEEPS = 60


def patterns(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of two lengths that fill the window, then some of three."""
    pairs = [(window - a, a) for a in range(1, window // 2 + 1) if hist[a] and hist[window - a]]
    common = [int(a) for a in np.argsort(-hist, kind="stable")[:DEPTH_THREE] if hist[a]]
    triples = {tuple(sorted((a, b, window - a - b), reverse=True)) for a in common for b in common if 0 < window - a - b < window and hist[window - a - b]}
    return pairs + sorted(triples, reverse=True)


def solve_repeats(hist: np.ndarray, found: list[tuple[int, ...]]) -> list[float]:
    """Weights x >= 0 that minimise |A x - hist|, by cyclic coordinate descent."""
    rest, weights = hist.astype(float).copy(), [0.0] * len(found)
    columns = [sorted((a, combo.count(a)) for a in set(combo)) for combo in found]
    norms = [sum(n * n for _, n in column) for column in columns]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, column in enumerate(columns):
            step = max(-weights[j], sum(n * rest[a] for a, n in column) / norms[j])
            if step:
                weights[j] += step
                moved = max(moved, abs(step))
                for a, n in column:
                    rest[a] -= n * step
        if moved < 1e-3:
            break
    return weights


def plan_tails(hist: np.ndarray, window: int) -> tuple[dict[int, list[tuple[int, int, int, int, tuple[int, ...]]]], dict[int, tuple[int, int]], int]:
    """Where the tails of each length go.

    Returns, by length, runs (first rank, end rank, first sequence, tails of
    this length in a sequence, their offsets); then, by length, the rank from
    which tails are packed greedily and the place of the first of them in the
    greedy stream; then the first sequence of that stream.
    """
    left, runs, sequence = hist.astype(np.int64).copy(), {}, 0
    found = patterns(hist, window)
    for combo, weight in zip(found, solve_repeats(hist, found), strict=True):
        repeat = min([int(weight + 1e-9)] + [int(left[a]) // combo.count(a) for a in set(combo)])
        if repeat < 1:
            continue
        offset, offsets = 0, {}
        for a in combo:
            offsets.setdefault(a, []).append(offset)
            offset += a
        for a, at in offsets.items():
            start = int(hist[a] - left[a])
            runs.setdefault(a, []).append((start, start + repeat * len(at), sequence, len(at), tuple(at)))
            left[a] -= repeat * len(at)
        sequence += repeat
    stream, greedy = 0, {}
    for a in range(len(hist) - 1, 0, -1):
        if left[a]:
            greedy[a] = (int(hist[a] - left[a]), stream)
            stream += a * int(left[a])
    return runs, greedy, sequence


TOKENS = "doc_id {id}, task int, row long, doc_tokens long, chunks long, chunks_before long, chunk_crcs array<long>, tail int, tail_before long, tail_crc long, tail_ids binary"


def tokenise(docs: DataFrame, window: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """One row a document, with its place among the rows of its task."""
    rows = plain(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, chunks_seen = TaskContext.get().partitionId(), 0, 0
        tails_seen = np.zeros(window, dtype=np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for text in batch.column("text").to_pylist():
                ids = np.array(token_ids(text, vocabulary) + [0], dtype="<u4")
                chunks, tail = divmod(len(ids), window)
                raw, last = ids.tobytes(), ids[chunks * window :].tobytes()
                crcs = [zlib.crc32(raw[4 * window * k : 4 * window * (k + 1)]) for k in range(chunks)]
                row = (task, seen, len(ids), chunks, chunks_seen, crcs, tail, int(tails_seen[tail]), zlib.crc32(last), last)
                seen, chunks_seen = seen + 1, chunks_seen + chunks
                tails_seen[tail] += 1
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["task", "row", "doc_tokens", "chunks", "chunks_before", "chunk_crcs", "tail", "tail_before", "tail_crc", "tail_ids"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["doc_id", *names])

    with short_batches(docs.sparkSession):
        return stored(rows.mapInArrow(made, TOKENS.format(id=id_type)), "tokens")


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``window``.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text has the one id 0; repeated rows
    are packed each time; null ids are kept; very long texts are packed whole;
    tails of equal length are told apart by task and row, in any order; an empty
    table gives no rows; other columns are ignored, whatever their names.
    Every sequence but the last of the greedy stream is full.
    """
    tokens = tokenise(docs, window, vocabulary or default_vocabulary(), id_col, text_col)
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    hist = np.zeros(window, dtype=np.int64)
    for r in tokens.filter("tail > 0").groupBy("tail").count().collect():  # fewer than window rows
        hist[r["tail"]] = r["count"]
    runs, greedy, stream_at = plan_tails(hist, window)
    streamed = sum(a * (int(hist[a]) - first) for a, (first, _) in greedy.items())
    whole_at = stream_at + -(-streamed // window)

    # Places within a task were taken down with the ids; here come those of the tasks before it.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = tokens.groupBy("task").agg(F.sum("chunks").alias("n"))
    chunk_base = by_task.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    whole = (
        tokens.filter("chunks > 0")
        .join(checked_broadcast(chunk_base), "task")
        .select("doc_id", "doc_tokens", (F.col("base") + F.col("chunks_before") + whole_at).alias("first"), F.posexplode("chunk_crcs").alias("k", "crc"))
        .selectExpr("doc_id", f"k * {window}L AS start", f"{window}L AS length", "crc AS ids_crc32", "doc_tokens", "first + k AS sequence_id", "0L AS offset")
    )

    by_tail = tokens.filter("tail > 0").groupBy("tail", "task").agg(F.count("*").alias("n"))
    tail_base = by_tail.select("tail", "task", F.coalesce(F.sum("n").over(earlier.partitionBy("tail")), F.lit(0)).alias("base"))
    placed = tokens.filter("tail > 0").drop("tail_ids", "chunk_crcs").join(checked_broadcast(tail_base), ["tail", "task"])
    placed = placed.select("doc_id", "task", "row", "doc_tokens", "tail", "tail_crc", (F.col("tail_before") + F.col("base")).alias("rank"))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {a: [r[0] for r in rs] for a, rs in runs.items()}
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in ("tail", "rank")}
            n = batch.num_rows
            sequence, offset, cut = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            for k, (a, rank) in enumerate(zip(columns["tail"].tolist(), columns["rank"].tolist(), strict=True)):
                if a in greedy and rank >= greedy[a][0]:
                    at = greedy[a][1] + (rank - greedy[a][0]) * a
                    sequence[k], offset[k] = stream_at + at // window, at % window
                    cut[k] = offset[k] + a > window
                else:
                    run = runs[a][np.searchsorted(starts[a], rank, "right") - 1]
                    step, slot = divmod(rank - run[0], run[3])
                    sequence[k], offset[k] = run[2] + step, run[4][slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "task", "row", "doc_tokens", "tail", "tail_crc")), pa.array(sequence), pa.array(offset), pa.array(cut)], names=["doc_id", "task", "row", "doc_tokens", "tail", "tail_crc", "sequence_id", "offset", "cut"])

    spots = stored(placed.mapInArrow(located, f"doc_id {id_type}, task int, row long, doc_tokens long, tail int, tail_crc long, sequence_id long, offset long, cut boolean"), "spots")
    uncut = spots.filter("not cut").selectExpr("doc_id", "doc_tokens - tail AS start", "cast(tail AS long) AS length", "tail_crc AS ids_crc32", "doc_tokens", "sequence_id", "offset")

    halves = checked_broadcast(spots.filter("cut").drop("doc_id", "doc_tokens", "tail", "tail_crc")).join(tokens.select("task", "row", "doc_id", "doc_tokens", "tail", "tail_ids"), ["task", "row"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, total, tail, raw, sequence, offset in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "tail_ids", "sequence_id", "offset")), strict=True):
                room = window - offset
                for row in ((i, total - tail, room, zlib.crc32(raw[: 4 * room]), total, sequence, offset), (i, total - tail + room, tail - room, zlib.crc32(raw[4 * room :]), total, sequence + 1, 0)):
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field("doc_id").type, *[pa.int64()] * 6), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return whole.unionByName(uncut).unionByName(halves.mapInArrow(split, PIECES.format(id=id_type)))
