"""Spelling variants: words one edit apart, found in sorted dictionaries.

Two words that differ by one inserted, deleted or replaced letter, the longer
one of length L, agree before and behind one place p < L. If p lies in the
second half they share their beginning, else their end. So the dictionary is
dealt out twice, by shared prefixes (the forward dictionary) and by shared
suffixes (the reversed one), for the lengths L and L + 1 that a word can be in a
pair of. A block of an interval [lo, hi) of places holds words with the same
first lo and last L - hi letters. A block of more than ``BLOCK`` words is
divided: the interval's halves deal its words out by longer prefixes and by
longer suffixes, down to single places, where a block has a word for each
letter of the alphabet at most. Blocks are then scanned in sorted order and
pairs verified at the place where the two words first differ, which lies in one
interval only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, plain, shuffle_partitions, stored

#: Least code points and occurrences of a word, and how many times more its form must have.
LEAST_LENGTH = 6
LEAST_COUNT = 5
MORE = 5
#: A run whose hash this divides has lost a letter.
THINNED = 199
#: Words of a block that are scanned together.
BLOCK = 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(prefix: bytes, text: str, least: int = LEAST_LENGTH, thinned: int = THINNED) -> Counter[str]:
    """Words of a text with their occurrences; ``prefix`` goes before each run when it is hashed."""
    folded = text.encode("utf-8", "surrogatepass").translate(UPPER).decode("utf-8", "surrogatepass")
    found: Counter[str] = Counter()
    start = zlib.crc32(prefix)
    for run, n in Counter(re.findall("[a-zÀ-ÿ]{%d,}" % least, folded)).items():
        h = zlib.crc32(run.encode(), start)
        if h % thinned == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of whole texts; see ``group_variants``."""
    rows = plain(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update(words_of(f"{own}:".encode(), text, least))
                if len(found) >= COUNTED:
                    yield handed_on()
        yield handed_on()

    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _block_key(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """What words of a block share: the first ``lo`` and the last ``size - hi`` letters."""
    return F.concat(F.substring(word, F.lit(1), lo), F.lit(" "), F.right(word, size - hi))


def _dealt(rows: DataFrame, halves: Column) -> DataFrame:
    """Rows (word, n, size) in the intervals of ``halves``, with the key of their blocks."""
    cut = rows.select("word", "n", "size", F.explode(halves).alias("part")).select("word", "n", "size", "part.*")
    return cut.withColumn("shared", _block_key(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")))


KEY = ["size", "lo", "hi", "shared"]


def _interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(size, lo, hi, shared, word, n): the words of all blocks that are to be scanned.

    Each round divides the blocks that are too large, and leaves the rest as
    they are; rounds are at most the logarithm of the longest word's length.
    """
    length = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    middle = F.floor(F.col("size") / 2).cast("int")
    halves = F.array(_interval(F.lit(0), middle), _interval(middle, F.col("size")))
    now, settled = stored(_dealt(sizes, halves), "dealt"), []
    while True:
        held = now.groupBy(*KEY).agg(F.count("*").alias("held")).filter("held > 1")
        large = stored(held.filter((F.col("held") > block) & (F.col("hi") - F.col("lo") > 1)).select(*KEY), "large")
        if large.isEmpty():
            settled.append(now)
            break
        large = checked_broadcast(large)
        settled.append(now.join(large, KEY, "left_anti").select(now.columns))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(_interval(F.col("lo"), middle), _interval(middle, F.col("hi")))
        now = stored(_dealt(now.join(large, KEY, "left_semi").select("word", "n", "size", "lo", "hi"), halves), "dealt")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def first_difference(a: str, b: str, at: int) -> int:
    """The first place from ``at`` on where two words differ."""
    most = min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    return at


def scan_block(size: int, lo: int, hi: int, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of a block one edit apart, at a place in [lo, hi), the longer word of length ``size``."""
    for k, (a, n) in enumerate(rows):
        for b, m in rows[k + 1 :]:
            if len(a) < size and len(b) < size:
                continue
            at = first_difference(a, b, lo)
            if at < hi and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at + 1 :] == b[at:] if len(a) > len(b) else a[at:] == b[at + 1 :]):
                yield a, n, b, m


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart, once in each direction."""
    parts = shuffle_partitions(words.sparkSession)
    rows = blocks(words, block).repartition(parts, *KEY).sortWithinPartitions(*KEY, "word")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ordered() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in [*KEY, "word", "n"]), strict=True)

        found: list[tuple[str, int, str, int]] = []
        for (size, lo, hi, _), own in groupby(ordered(), key=lambda r: r[:4]):
            for a, n, b, m in scan_block(size, lo, hi, [r[4:] for r in own]):
                found += [(a, n, b, m), (b, m, a, n)]
            if len(found) >= 10_000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    def batch_of(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])

    return rows.mapInArrow(scanned, "word string, n long, near string, near_n long")


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for links (word, form) that lead to ever more frequent words.

    Each round follows every link's own link, so paths are halved; a path has
    at most the logarithm of the largest count links, as counts grow ``MORE``-fold.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        after = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        moved = stored(now.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now
    raise RuntimeError("forms lead in a circle")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: int = MORE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` have A-Z in lower case; one whose CRC-32 of
    ``<id>:<run>`` is a multiple of ``THINNED`` loses the letter at that hash modulo
    its length. Words are those of ``LEAST_LENGTH`` letters and ``LEAST_COUNT``
    occurrences n at least. Near words differ by one inserted, deleted or
    replaced letter; n_near counts them. A word's form is its most frequent near
    word (ties: the least by code points) if it has ``more`` times the word's
    occurrences at least, else null. Its root is what forms lead to in the end,
    itself if it has none.

    Null texts count as empty, null ids as empty in the hash; repeated rows
    count each time; very long texts and words are read whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    words = stored(count_words(docs, id_col, text_col), "words")
    pairs = near_words(words, block)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word"))).alias("best")
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best, F.first("n").alias("own"))
    leads = -F.col("best.order") >= more * F.col("own")
    near = stored(found.select("word", "n_near", F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.order")).alias("form_n")), "near")
    rooted = roots(near.filter("form is not null"))
    joined = words.join(near, "word", "left").join(rooted, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
