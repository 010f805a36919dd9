"""Phrase collocations by Apriori passes over the corpus.

Level 1 counts words. Level k counts a phrase of k words only where both of its
overlapping parts of k - 1 words are frequent: their hashes are set in a table
of ``FILTER_BITS`` bits that is sent to every task. The table's size is fixed,
however many phrases are frequent; a bit set by chance only lets a phrase be
counted that falls short of the least count afterwards, so no phrase is lost.
Cuts are scored from the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, stored

#: Phrases that are counted: occurrences and words.
LEAST = 10
LONGEST = 3
#: A phrase goes if a longer one around it has this share of its occurrences, in hundredths.
INSIDE = 50
#: Rows reported for each language, and what shares of 1 are counted in.
MOST = 2000
MILLION = 1_000_000
#: Bits of the table of frequent phrases: 8 MB.
FILTER_BITS = 1 << 26
#: Bytes of text that a task tokenises at once, and rows of a batch that it takes up for that.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 128
#: Parts of a language's candidates, each of which is ranked for itself first.
SALTS = 256

#: Marks between pieces become line feeds, tabs spaces, A-Z lower case.
PIECE_MARKS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(PIECE_MARKS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(PIECE_MARKS) + b" abcdefghijklmnopqrstuvwxyz")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(language, texts joined by line feeds) of a batch, a few MB at a time."""
    open_texts: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for first in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(first, SLICE_ROWS)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            open_texts.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= SLICE_BYTES:
                yield lang, b"\n".join(open_texts.pop(lang))
                del sizes[lang]
    for lang, texts in open_texts.items():
        yield lang, b"\n".join(texts)


def _coded(texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words as places in a list of distinct ones; -1 between pieces."""
    tokens = list(filter(None, texts.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")))
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = encoded.dictionary.to_pylist()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if b"\n" in words:
        codes[codes == words.index(b"\n")] = -1
    return codes, words


def _in_table(lang: bytes, phrases: list[bytes], table: np.ndarray) -> np.ndarray:
    own = xxhash.xxh64_intdigest
    bits = np.fromiter((own(lang + b"\n" + p, 42) for p in phrases), np.uint64, len(phrases)) % np.uint64(len(table) * 64)
    return (table[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def _grams(codes: np.ndarray, words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts of all phrases of a length, the number of each one's phrase, and the phrases."""
    starts = np.flatnonzero(codes >= 0)
    own, texts = codes[starts], words
    for j in range(1, length):
        fits = starts + j < len(codes)
        starts, own = starts[fits], own[fits]
        after = codes[starts + j]
        starts, own, after = starts[after >= 0], own[after >= 0], after[after >= 0]
        keys, own = np.unique(own * len(words) + after, return_inverse=True)
        texts = [texts[a] + b" " + words[b] for a, b in zip(keys // len(words), keys % len(words), strict=True)]
    return starts, own, texts


def _phrases_of(lang: bytes, texts: bytes, length: int, table: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """Phrases of a slice whose overlapping parts are both in the table, with counts."""
    codes, words = _coded(texts)
    if length == 1:
        counts = np.bincount(codes[codes >= 0], minlength=len(words)) if words else np.zeros(0, np.int64)
        seen = np.flatnonzero(counts)
        return [words[i] for i in seen] + [b""], np.append(counts[seen], counts.sum())  # the empty phrase counts all words
    starts, own, parts = _grams(codes, words, length - 1)
    if not parts:
        return [], np.zeros(0, np.int64)
    part_at = np.full(len(codes) + 1, -1, np.int64)
    known = _in_table(lang, parts, table)
    part_at[starts[known[own]]] = own[known[own]]
    both = np.flatnonzero((part_at[:-1] >= 0) & (part_at[1:] >= 0))
    keys, counts = np.unique(part_at[both] * len(words) + codes[both + length - 1], return_counts=True)
    return [parts[a] + b" " + words[b] for a, b in zip(keys // len(words), keys % len(words), strict=True)], counts


def _level(rows: DataFrame, length: int, table, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of a length that occur ``least`` times at least."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _slices(batch):
                phrases, counts = _phrases_of(lang, texts, length, table.value if table else None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.binary()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    found = rows.mapInArrow(counted, "lang binary, phrase binary, f long")
    summed = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(summed.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f"), f"level{length}")


def _sent(spark: SparkSession, level: DataFrame, bits: int):
    """The level's phrases as a broadcast table of bits; at most ``bits / 64`` numbers reach the driver."""
    at = F.expr(f"pmod(xxhash64(concat(lang, '\\n', phrase)), {bits}L)").alias("at")
    cells = level.select(at).select(F.shiftright("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("bit"))
    set_bits = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[set_bits.column("cell").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _joined_words(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) in numbers of up to 38 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(MILLION).cast("decimal(7,0)") * a * a, left * right)


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, most: int = MOST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z in lower case, end pieces at ``.,;:!?`` and line ends, and
    words at spaces and tabs. A phrase of 2 to ``longest`` words within a piece,
    with ``least`` occurrences a at least (overlapping ones count), is a
    candidate. Its score is that of its weakest cut in two, of l and r
    occurrences; ties go to the cut after fewer words. A candidate inside a
    longer one with ``inside`` hundredths of its occurrences goes. n counts the
    language's words. Ranks go by score, a, and the phrase's bytes.

    Null texts count as empty, null languages as ``und``; rows of equal texts
    count each time; very long texts are read whole; an empty table gives no
    rows; ids are not looked at, and other columns are ignored, whatever their
    names. Ties in score and a are broken by the phrase, which is unique.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).cast("binary").alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    levels = [_level(rows, 1, None, least)]
    totals = levels[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    levels[0] = levels[0].filter("phrase <> ''")
    for length in range(2, longest + 1):
        table = _sent(spark, levels[-1], filter_bits)
        levels.append(_level(rows, length, table, least))
        table.unpersist()
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)

    words = F.split("phrase", " ")
    candidates = counts.withColumn("words", words).filter(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined_words(F.col("words"), F.lit(1), F.col("cut")).alias("first"), _joined_words(F.col("words"), F.col("cut") + 1, F.size("words")).alias("rest"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.select("lang", "phrase", "a", F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r").alias("weakest"), F.lit(None).cast("long").alias("longer"))
    # Phrases of two words and more inside a candidate; the ones with its first or last word left out have those between inside them.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: _joined_words(F.col("words"), i, n))))
    shorter = candidates.filter(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("f").alias("longer"))
    shorter = shorter.select("lang", "phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["weakest"].dataType).alias("weakest"), "longer")
    merged = scored.unionByName(shorter).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("weakest").alias("weakest"), F.max("longer").alias("longer"))
    kept = merged.filter(f"longer is null or 100 * longer < {inside} * a").select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    return _first(kept, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(kept: DataFrame, most: int) -> DataFrame:
    """Ranks of the first rows of each language: parts of it send their first ones, so that
    the last sort gets ``SALTS * most`` rows of a language at most."""
    salt = free_name(kept, "salt__")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    firsts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= most).drop(salt)
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
