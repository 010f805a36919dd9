from __future__ import annotations

from stratalog.operators import listing


def test_pilot_candidates_keep_a_whitelist_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(listing, "WHITELIST_ROWS", 3)
    commits = spark.createDataFrame([("s", "a"), ("s", "b")], "source_name string, commit_hash string")
    items = spark.createDataFrame([(f"A.C{k}",) for k in range(5)], "item string")
    found = {tuple(r) for r in listing.pilot_candidates(commits, items).collect()}
    assert found == {("s", c, f"A.C{k}") for c in "ab" for k in range(5)}
