from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, place int, row long, row_key string, site string, mark long, first int, score string, kind string, n long, __row_key long, row_key__ long, __text string, bucket int, halo int"


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta9", "the", "of", "and", "quick", "brown"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = prose(90)
    texts = [None, "", " \n\t ", "one", "two words", common, common, common + " tail", prose(40) + " " + common, prose(12_000), "x" * 30_000, "é" * 900, prose(300)]
    texts += [prose(rng.randint(1, 200)) for _ in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1, 2, 3, "4", "5", 6, 7, "8", "9", 10, 11, 12, "13", 14, 15) for k, t in enumerate(texts)]
    rows += [rows[5], rows[9]]  # repeated rows
    rows.append((5, prose(30), "de", "s1", 1, *[None] * 15))  # the same id with another text
    rows.append((None, prose(20), None, None, None, *[None] * 15))
    rows.append((None, None, None, None, None, *[None] * 15))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
