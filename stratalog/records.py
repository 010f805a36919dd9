"""Results of the programming interface as typed, immutable records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, make_dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import RECORDS

#: Columns of the engine under the names that records have for them.
OTHER_NAMES = {"authored_date": "authored_at", "committed_date": "committed_at", "changed_files": "files"}
KINDS = {T.StringType(): str, T.BooleanType(): bool, T.LongType(): int, T.ArrayType(T.StringType()): list}


@cache
def record_type(name: str) -> type:
    """The frozen dataclass of a record, made from its schema."""
    return make_dataclass(name, [(f.name, KINDS[f.dataType]) for f in RECORDS[name]], frozen=True)


def typed(df: DataFrame, name: str) -> DataFrame:
    """Columns of a record in its order and types; null text is empty, as are null lists, null numbers and flags are 0."""
    out = []
    for f in RECORDS[name]:
        column = F.col(f.name if f.name in df.columns else OTHER_NAMES.get(f.name, f.name)).cast(f.dataType)
        nothing = {str: F.lit(""), bool: F.lit(False), int: F.lit(0), list: F.array()}[KINDS[f.dataType]]
        out.append(F.coalesce(column, nothing.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def records(df: DataFrame, name: str) -> Iterator:
    """Records of a frame, a partition at a time; for results that a driver can look at."""
    kind = record_type(name)
    for row in typed(df, name).toLocalIterator():
        yield kind(*(row[f.name] for f in fields(kind)))
