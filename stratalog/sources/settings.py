"""Settings from an environment file and the process environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_environment(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Names and values of ``KEY=value`` lines, under what the environment sets.

    Blank lines, comments and lines without a name are passed over; ``export``
    before a name and a pair of quotes around a value are taken away. A file
    that isn't there gives nothing.
    """
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                name, sign, value = line.strip().removeprefix("export ").partition("=")
                name, value = name.strip(), value.strip()
                if not sign or not name or name.startswith("#"):
                    continue
                if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                    value = value[1:-1]
                found[name] = value
    set_now = os.environ if environment is None else environment
    return found | {k: v for k, v in set_now.items() if k in found} if path else dict(set_now)


def settings_table(spark: SparkSession, values: Mapping[str, str], step: int) -> DataFrame:
    """Settings as rows of the settings table."""
    return spark.createDataFrame([(step, k, v) for k, v in sorted(values.items())], "step int, key string, value string")


def repository_path(configured: str, root: str) -> str:
    """A configured path: as it is if absolute, else below the root; ``~`` is the home folder."""
    path = os.path.expanduser(configured.strip())
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
