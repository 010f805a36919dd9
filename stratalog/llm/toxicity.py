"""Toxicity by compression distance.

Two separate zstandard dictionaries are trained: one on running text of
ordinary rows, one on running text of toxic rows. A window of running text
(``WINDOW_WORDS`` words, one word further each time) is compressed with each;
its gain is the number of bytes by which the toxic dictionary does better. A
word stands in two windows, and both must gain for it to tell. A logistic
calibration, fitted on rows that trained neither dictionary, turns the counts
of windows beyond several thresholds into a score of the whole text.

Toxic rows are ordinary text for the most part, so the dictionaries are trained
in rounds. The first toxic dictionary is trained on all text of toxic rows.
Each round compresses the training windows with both dictionaries: windows of
toxic rows that gain make the next toxic dictionary, windows of ordinary rows
that gain join the ordinary one. Compression lengths alone choose windows; no
word is looked at.

Both dictionaries are filled up to one size, so that matches cost the same in
either, and each window follows a carrier that both hold, so that it is never
stored uncompressed and lengths differ byte by byte.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, stored

#: Labelled rows of each class that dictionaries and calibration are fitted on
#: at most, and the longest text among them in bytes. Scores read whole texts.
SAMPLE_TOXIC = 1500
SAMPLE_ORDINARY = 3000
SAMPLE_BYTES = 20_000
#: One row in so many calibrates instead of fitting dictionaries.
CALIBRATE_EVERY = 3

WINDOW_WORDS = 2
#: Words of a stretch of running text that dictionaries are trained on.
STRETCH_WORDS = 40
#: Size of either dictionary; half of it is trained, the rest takes ordinary windows that gained.
DICTIONARY_BYTES = 1 << 18
FIRST_TOXIC_BYTES = 1 << 17
TOXIC_BYTES = 8192
#: Segments and substrings of dictionary training, as zstandard names them k and d.
COARSE, FINE, SUBSTRING = 64, 24, 8
ROUNDS = 4
#: Gain from which a window is taken up in the first round and in later ones.
FIRST_GAIN, LATER_GAIN = 2, 1
#: Window thresholds whose counts are calibrated, and the greatest gain that counts.
THRESHOLDS = (1, 2, 3)
GREATEST = 12

#: Borders of words.
WORD = re.compile(rb'[^\s.,!?;:#$%&*|"()<>\[\]{}=+/\\]+')
#: Bytes before each window, which stand at the end of both dictionaries.
CARRIER = bytes([*range(1, 32), *range(128, 160)])
#: Bytes behind a window: the compressor starts no match within its last eight bytes.
TAIL = b"q" * 12
FILLER = b"~"
#: Windows that are compressed in one call.
TOGETHER = 20_000


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def window(words: list[bytes], k: int) -> bytes:
    return b" " + b" ".join(words[k : k + WINDOW_WORDS]) + b" "


def windows(text: str) -> list[bytes]:
    """Windows of running text, one word further each; one for a shorter text, none without words."""
    found = _words(text)
    return [window(found, k) for k in range(max(1, len(found) - WINDOW_WORDS + 1))] if found else []


def stretches(text: str) -> list[bytes]:
    found = _words(text)
    return [b" ".join(found[k : k + STRETCH_WORDS]) for k in range(0, len(found), STRETCH_WORDS)]


@dataclass(frozen=True)
class Model:
    """Dictionary contents and calibration weights, the constant first."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def train(samples: Sequence[bytes], size: int, segment: int) -> bytes:
    """Dictionary content trained on samples; the samples themselves if they are too few."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=segment, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    log = DICTIONARY_BYTES.bit_length() - 1
    fit = zstandard.ZstdCompressionParameters(window_log=log + 2, hash_log=log, chain_log=log, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    filled = content[:DICTIONARY_BYTES].ljust(DICTIONARY_BYTES, FILLER) + CARRIER + FILLER * len(TAIL)
    held = zstandard.ZstdCompressionDict(filled, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=fit)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=fit)


class Gauge:
    """Gains of windows under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def gains(self, asked: list[bytes]) -> np.ndarray:
        """Gain of each window."""
        out = np.zeros(len(asked), dtype=np.int64)
        for k in range(0, len(asked), TOGETHER):
            framed = [CARRIER + w + TAIL for w in asked[k : k + TOGETHER]]
            plain, other = (np.fromiter(map(len, c.multi_compress_to_buffer(framed)), np.int64, len(framed)) for c in (self.ordinary, self.toxic))
            out[k : k + len(framed)] = plain - other
        return out

    def pairs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gains of the two windows around a word, where both are positive.

        Of two neighbours one has an even place, so windows at even places are
        compressed first, and others only beside one that gains.
        """
        n = max(1, len(words) - WINDOW_WORDS + 1) if words else 0
        even = self.gains([window(words, k) for k in range(0, n, 2)])
        first = 2 * np.flatnonzero(even > 0)
        if n == 1:
            return even[even > 0], even[even > 0]
        low, high = first[first > 0], first[first < n - 1]
        near = np.concatenate([low, high])
        odd, back = np.unique(np.concatenate([low - 1, high + 1]), return_inverse=True)
        other = self.gains([window(words, k) for k in odd.tolist()])[back]
        return even[near // 2][other > 0], other[other > 0]

    def features(self, text: str) -> list[float]:
        """What is calibrated: the greatest gain around a word, by threshold how
        many words gain in both their windows, as a number and as a share, and
        how many gain much."""
        found = _words(text)
        one, two = self.pairs(found)
        if not len(one):
            return [0.0] * (2 + 2 * len(THRESHOLDS))
        both, summed = np.minimum(one, two), one + two
        counts = [int((both >= t).sum()) for t in THRESHOLDS]
        shares = [1000.0 * c / (len(found) + 50) for c in counts]
        return [float(min(int(summed.max()), GREATEST)), *(math.log1p(v) for v in (*counts, *shares)), math.log1p(int((summed >= 2 * THRESHOLDS[-1]).sum()))]


def train_pair(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    base = train([s for t in ordinary for s in stretches(t)], DICTIONARY_BYTES // 2, COARSE)
    other = train([s for t in toxic for s in stretches(t)], FIRST_TOXIC_BYTES, COARSE)
    bad = list(dict.fromkeys(w for t in toxic for w in windows(t)))
    good = list(dict.fromkeys(w for t in ordinary for w in windows(t)))
    taken = b""
    for turn in range(ROUNDS):
        gauge, least = Gauge(taken + base, other), LATER_GAIN if turn else FIRST_GAIN
        picked = [w for w, gain in zip(bad, gauge.gains(bad).tolist(), strict=True) if gain >= least]
        if not picked:
            break
        gained = sorted((-gain, w) for w, gain in zip(good, gauge.gains(good).tolist(), strict=True) if gain >= least)
        taken = (b"".join(w for _, w in gained) + taken)[: DICTIONARY_BYTES // 2]
        other = train(picked, TOXIC_BYTES, FINE)
    return taken + base, other


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Model from texts of both classes; without one of them, a constant score."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1.0)
        return Model(b"", b"", (math.log(prior / (1 - prior)),))

    def split(texts: list[str]) -> tuple[list[str], list[str]]:
        own = [t for k, t in enumerate(texts) if (k + 1) % CALIBRATE_EVERY]
        return own or texts, [t for k, t in enumerate(texts) if not (k + 1) % CALIBRATE_EVERY] or texts

    (toxic_own, toxic_rest), (plain_own, plain_rest) = split(toxic), split(ordinary)
    pair = train_pair(toxic_own, plain_own)
    gauge = Gauge(*pair)
    x = np.array([gauge.features(t) for t in toxic_rest + plain_rest])
    y = np.array([1.0] * len(toxic_rest) + [0.0] * len(plain_rest))
    return Model(*pair, calibrate(x, y))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps, on features of one scale."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = np.where(x.std(axis=0) > 0, w[1:] / scale, 0.0)
    return (float(w[0] - slopes @ mean), *(float(v) for v in slopes))


@lru_cache(maxsize=2)
def _gauge(ordinary: bytes, toxic: bytes) -> Gauge:
    return Gauge(ordinary, toxic)


def score_text(model: Model, text: str) -> float:
    """Score of a whole text from 0 to 1."""
    z, *slopes = model.weights
    if slopes:
        z += sum(s * v for s, v in zip(slopes, _gauge(model.ordinary, model.toxic).features(text), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxicity(model: Model, text: Column) -> Column:
    """Score column; a null text counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(model, t or "") for t in texts], dtype="float64")

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out.

    Null labels and ids are passed over; of several labels of a document the
    greatest holds, of several texts under one id the least. The sample is
    chosen by a hash of the id and sorted, so that the order of rows and tasks
    does not matter; at most ``SAMPLE_TOXIC + SAMPLE_ORDINARY`` texts of
    ``SAMPLE_BYTES`` reach the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for value, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    wanted = F.broadcast(picked[0].unionByName(picked[1]))  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    texts = rows.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.collect())
    return fit([t for _, t, y in found if y == 1], [t for _, t, y in found if y == 0])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every row.

    Scores depend on the text alone: null texts count as empty, repeated rows
    and equal texts get the same score, very long texts are read whole. Null
    ids are kept and not held out; an empty table gives no rows; without labels
    of either class all scores are the same; columns other than id and text are
    ignored, whatever their names.
    """
    model = fit_documents(docs, labels, id_col, text_col)
    scored = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), toxicity(model, docs[text_col]).alias("score"))
    with short_batches(docs.sparkSession):
        scored = stored(scored, "scores")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
