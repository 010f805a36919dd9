"""The pipeline's near-dedup against brute-force Jaccard on five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from stratalog.llm import shingles


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """Least id of each group that links of Jaccard 0.8 or more connect."""
    sets = {k: brute_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(k) for k in root}


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def rows_with_copies(seed=3):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    line = prose(30)
    texts = ["", " ", None, "one", "One", "one two three four five", prose(300) + " Q", prose(300)]
    texts += [line + " " + prose(60) for _ in range(60)]
    for size in (20, 60, 200):
        base = prose(size)
        texts += [base, base.upper(), *[edited(rng, base, rng.randint(0, size // 15)) for _ in range(60)]]
    return [*enumerate(texts)]


@pytest.mark.parametrize("part_members", [shingles.PART_MEMBERS, 3000, 0])
def test_near_copies_match_brute_force(spark, monkeypatch, part_members):
    monkeypatch.setattr(shingles, "PART_MEMBERS", part_members)
    rows = rows_with_copies()
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(brute_kept(rows)) and len(kept) < len(rows) - 80


def test_near_copies_of_the_tables_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs).collect()) == sorted(brute_kept(rows))


def test_pivots_lose_no_link():
    rng = random.Random(5)
    line = [f"w{rng.randint(0, 400)}" for _ in range(40_000)]
    for size in (1, 6, 9, 40, 700, 40_000):
        for _ in range(20 if size < 1000 else 2):
            a = " ".join(line[:size])
            b = edited(rng, a, rng.randint(0, max(1, size // 40)))
            x, y = (shingles.shingle_set(t) for t in (a, b))
            shared = len(set(x.tolist()) & set(y.tolist()))
            apart = sum(abs(p - q) for p, q in zip(shingles.pivot_table(x), shingles.pivot_table(y)))
            assert apart <= len(x) + len(y) - 2 * shared
            if shared >= 0.8 * (len(x) + len(y) - shared):
                assert apart <= 0.2 / 1.8 * (len(x) + len(y)) + 1e-9


def test_order_is_that_of_all_rows(spark, monkeypatch):
    """Shingles of one row alone need no bucket; the commonest ones come last; whatever tasks know, no link is lost."""
    rows = rows_with_copies(7)
    docs = spark.createDataFrame([(k, t or "") for k, t in rows], "doc_id long, text string").withColumn("row_key", shingles.F.col("doc_id").cast("string")).repartition(3)
    found = {r["key"]: r["n"] for r in shingles.repeated(docs).collect()}
    seen = {}
    for _, t in rows:
        for key in shingles._keys(shingles.shingle_set(t or "")).tolist():
            seen[key] = seen.get(key, 0) + 1
    assert found == {k: n for k, n in seen.items() if n > 1}
    prints = {r["doc_id"]: r for r in shingles.prefixes(docs, 0.8).collect()}
    for k, t in rows:
        members = shingles.shingle_set(t or "")
        first = sorted(members.tolist(), key=lambda m: (seen[int(shingles._keys(shingles.np.array([m]))[0])], m))[: shingles.prefix_size(len(members), 0.8)]
        alone = [m for m in first if seen[int(shingles._keys(shingles.np.array([m]))[0])] == 1]
        assert prints[k]["skipped"] == len(alone) and sorted(prints[k]["prefix"]) == sorted(first[len(alone) :])
    monkeypatch.setattr(shingles, "TABLE_BITS", 6)
    monkeypatch.setattr(shingles, "COMMON", 3)
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs.select("doc_id", "text")).collect()) == sorted(brute_kept(rows))


def test_simhash_links_come_first_and_are_verified(spark, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), "one two three four five six", "one two three four five seven", "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    plain = shingles.near_links

    def seen(nodes, *more):
        asked.append(nodes.count())
        # Links that bits alone would make of all fingerprints.
        return nodes.crossJoin(nodes.selectExpr("fp as v")).selectExpr("fp as u", "v").filter("u < v") if len(asked) == 2 else plain(nodes, *more)

    monkeypatch.setattr(shingles, "near_links", seen)
    for _ in range(2):
        assert sorted(r["doc_id"] for r in shingles.keep_one(docs).collect()) == [0, 2, 3]
    assert asked == [3, 3]  # the two long texts have one fingerprint
