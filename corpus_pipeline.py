"""Corpus pipeline: filter, clean, deduplicate, decontaminate and pack documents.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontamination, line_dedup, packing, shingles, toxicity
from stratalog.llm.common import free_name, short_batches, stored, without_rows

#: A source stands for a site: lines on more than this share of its documents
#: go, if so many documents at least hold them.
SITE_RATIO = 0.05
SITE_DOCUMENTS = 20
WINDOW = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, takes for toxic go.

    Null and empty texts are scored as empty and stay or go by that score;
    repeated rows go together; very long texts are read whole; an empty table
    gives none; further columns come through, whatever their names.
    """
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with short_batches(spark):
        return stored(docs.filter(toxicity.toxicity(model, docs["text"]) < 0.5), "ordinary")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share are cut out of them.

    All rows stay. Null texts become empty ones; null sources are one source;
    repeated rows count as documents; very long texts are read whole; an empty
    table gives none; further columns come through, whatever their names.
    """
    text, lines, dropped = names = tuple(free_name(docs, c) for c in ("kept_text", "all_lines", "dropped_lines"))
    cut = line_dedup.drop_site_lines(docs, docs["source"], docs["text"], SITE_RATIO, SITE_DOCUMENTS, names)
    changed = cut.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")})
    return changed.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard of 0.8 or more.

    SimHash links come first, each verified; what lies further apart is found exactly.

    The one with the least id stays, null ids last; of rows with that id the one
    with the least hash; repeated rows are copies. Null and wordless texts are
    copies of each other; very long texts are compared whole; an empty table
    gives none; further columns come through, whatever their names.
    """
    return shingles.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts stay; repeated rows go together; very long texts are
    read whole; an empty table on either side drops nothing; further columns
    come through, whatever their names.
    """
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_rows(docs, leaks.select("row_key"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most ``WINDOW`` tokens.

    Null texts are one closing id; repeated rows are packed each time; very long
    texts are cut into pieces; an empty table gives no pieces.
    """
    return packing.pack(docs, WINDOW)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: Fitted dictionaries and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
