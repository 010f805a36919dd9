"""Recall of re-parameterised items: other numbers, names and units at the start, in the middle and at the end."""

from __future__ import annotations

import random

import pytest

from stratalog.llm import decontamination

NAMES = ["Tom", "Anna", "Maria", "Peter", "Lucy", "Omar", "Wei", "Ines"]
UNITS = ["kg", "miles", "dollars", "hours", "cups"]
FRAMES = {
    "start": "{a} buys {n} pens for {m} {u} each. {a} pays with a note of {k} {u} while the clerk counts the pens slowly. How much change is handed back over the wooden counter",
    "middle": "In the old mill near the river a miller called {a} grinds {n} sacks of grain and gives {b} another {m} {u} of flour before the evening. What is left after {k} {u} are sold",
    "end": "What is the total that the two friends carry home from the market in the rain if the first one carries {n} {u}, the second {m} {u}, and both meet {a} and {b} with {k} {u}",
}


def filled(rng, frame):
    a, b = rng.sample(NAMES, 2)
    n, m, k = rng.sample(range(2, 900), 3)
    return FRAMES[frame].format(a=a, b=b, n=n, m=m, k=k, u=rng.choice(UNITS))


@pytest.mark.parametrize("frame", list(FRAMES))
def test_recall(spark, frame):
    rng = random.Random(frame)
    prose = lambda n: " ".join(rng.choice(["stone", "walks", "under", "green", "evening", "Harbour", "and", "the", "boats."]) for _ in range(n))
    rows = [(k, f"{prose(rng.randint(0, 60))} {filled(rng, frame)}. {prose(rng.randint(0, 60))}") for k in range(60)] + [(100 + k, prose(120)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, filled(rng, frame))], "item_id long, text string")
    found = {r["doc_id"] for r in decontamination.find_leaks(docs, items).collect()}
    assert len([d for d in found if d < 100]) >= 54 and not [d for d in found if d >= 100]
