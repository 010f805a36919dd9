"""Leaks whose names start sentences, and leaks behind an altered instance."""

from __future__ import annotations

from stratalog.llm import decontamination

SUM = "Tom has 3 apples. Bob has 5 apples. How many apples do Tom and Bob have together?"
LIST = "in the red basket lie 3 apples and 3 pears for the cook of the house"
SHORT = "Green cows eat blue grass daily"


def leaks(spark, docs, items):
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in found}


def test_names_at_sentence_starts(spark):
    other = SUM.replace("Tom", "Ann").replace("Bob", "Eve").replace("3", "4").replace("5", "9")
    docs = [(1, "Intro. " + other), (2, "as seen here " + SHORT + " and so on"), (3, SUM.lower()), (4, other.replace("do Ann", "do Zed"))]
    found = leaks(spark, docs, [(1, SUM), (2, SHORT)])
    assert found == {(1, 1): "template", (2, 2): "copy"} | {k: v for k, v in found.items() if k == (3, 1)}


def test_lower_case_copy_without_names(spark):
    item = "Stones roll down. Rivers run to the sea. Why do birds sing all day long"
    assert leaks(spark, [(1, item.lower())], [(1, item)]) == {(1, 1): "copy"}


def test_copy_behind_an_altered_instance(spark):
    altered = LIST.replace("3 apples", "4 apples").replace("3 pears", "7 pears")
    docs = [(1, altered), (2, f"{altered}. Then {LIST}"), (3, f"{LIST}. Then {altered}")]
    found = leaks(spark, docs, [(1, LIST)])
    assert (1, 1) not in found and found[2, 1] == found[3, 1] == "copy"
