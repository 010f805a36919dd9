"""Token counts kept by delta-maintained rollups.

Events are signed: an insert adds a document's counts, a delete subtracts
them, a revision subtracts the old and adds the new ones. A batch is summed by
(source, lang, tokenizer) and added to the totals of the last version; the new
totals are written into a folder of their own and published as the next version
of a log (``stratalog.versions``), which fails if another writer has published
that number meanwhile. A batch that the totals hold already changes nothing, so
retries and replays count once; what was left half-written is never read. Work
follows the batch and the number of keys, not the history: which batches are in
the totals is told by a small file for each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..versions import Folder, VersionLog
from .common import scratch_dir, stored
from .tokenizing import default_vocabulary, token_ids

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
#: Versions that stay for readers that began before a newer one was published.
KEPT_VERSIONS = 3


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(source, lang, n_tokens, n_words, n_bytes) of each row's whole text.

    A null text counts as empty; null sources and languages stay null; equal and
    repeated rows count each; very long texts are counted whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select("source", "lang", F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("source"),
                    batch.column("lang"),
                    pa.array([len(token_ids(t, path)) for t in texts], pa.int64()),
                    pa.array([len(t.split()) for t in texts], pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                ],
                names=["source", "lang", "n_tokens", "n_words", "n_bytes"],
            )

    return rows.mapInArrow(counted, "source string, lang string, n_tokens long, n_words long, n_bytes long")


class RollupStore:
    """Totals by source, language and tokenizer, with a version for each batch.

    A version names the folder of its totals and the batch that made them. The
    file that marks a batch as held is created behind its version, and at the
    latest before the next one, so that only the newest version can lack it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder, self.log = Folder(spark, self.path), VersionLog(spark, f"{self.path}/log")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Add a batch of signed events to the totals; whether it was new.

        Events have ``KEYS``, ``SUMS`` and sign (1 or -1; null counts as 0, as
        do null numbers). Null keys form groups of their own; repeated and
        equal events count each time; other columns are ignored, whatever their
        names; an empty batch only leaves its id.
        """
        signed = [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.coalesce(F.col("sign"), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in SUMS]
        delta = stored(events.groupBy(*KEYS).agg(*signed), "delta")
        while True:
            version, now = self.log.last()
            if version:
                self._mark(now["batch"])
            if self.folder.exists(self._marker(batch_id)):
                return False
            total = self._totals(now).unionByName(delta).groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
            own = f"totals-{uuid.uuid4().hex}"
            total.filter(" or ".join(f"{c} <> 0" for c in SUMS)).coalesce(1).write.parquet(f"{self.path}/{own}")
            if self.log.publish(version + 1, {"batch": batch_id, "totals": own}):
                self._mark(batch_id)
                self._clean()
                return True
            self.folder.delete(own)

    @staticmethod
    def _marker(batch_id: str) -> str:
        digest = hashlib.sha256(batch_id.encode()).hexdigest()
        return f"batches/{digest[:2]}/{digest}"

    def _mark(self, batch_id: str) -> None:
        if not self.folder.exists(self._marker(batch_id)):
            self.folder.create(self._marker(batch_id), batch_id)

    def _clean(self) -> None:
        """Delete old totals; another writer may have done so already."""
        for number in self.log.numbers()[:-KEPT_VERSIONS]:
            try:
                self.folder.delete(self.log.read(number)["totals"])
            except Py4JJavaError:
                continue
        self.log.forget(KEPT_VERSIONS)

    def _totals(self, version: dict) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{version['totals']}") if version else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """Totals of the last version, without keys that came to nothing; empty before the first batch."""
        return self._totals(self.log.last()[1])


def rollup_documents(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Totals of a table that is counted under one tokenizer and moved to another.

    Batch ``load`` inserts every document with its white-space word count, once
    under tokenizer ``words`` and once as a first guess under the BPE
    vocabulary; batch ``revise`` takes the guesses back and adds the real
    counts; batch ``retire`` deletes all documents of tokenizer ``words``.
    ``revise`` is sent once more, as a retry would. Returns source, lang,
    tokenizer, n_docs, n_tokens, n_bytes.

    Null texts count as empty; null sources and languages are groups of their
    own; very long texts are counted whole; repeated rows count each time; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    store = RollupStore(spark, path or f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    counted = count_tokens(docs, vocabulary).groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("bpe"), F.sum("n_words").alias("words"), F.sum("n_bytes").alias("n_bytes")
    )
    counted = stored(counted, "counts")

    def events(tokenizer: str, column: str, sign: int) -> DataFrame:
        return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_docs", F.col(column).alias("n_tokens"), "n_bytes", F.lit(sign).alias("sign"))

    store.commit("load", events("words", "words", 1).unionByName(events("byte_bpe_50k", "words", 1)))
    for _ in range(2):
        store.commit("revise", events("byte_bpe_50k", "words", -1).unionByName(events("byte_bpe_50k", "bpe", 1)))
    store.commit("retire", events("words", "words", -1))
    return store.totals()
