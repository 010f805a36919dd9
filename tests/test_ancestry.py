"""Reachability from refs and changed paths of snapshots, against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
import xxhash

from stratalog.operators import ancestry, funnel, snapshots

PARENTS = "source_name string, commit_hash string, parent_hash string, place int"
REFS = "source_name string, branch string, commit_hash string"


def brute_reach(refs, parents):
    onward = defaultdict(list)
    for s, c, p, k in parents:
        if None not in (s, c, p, k):
            onward[s, c].append((s, p))
    found = set()
    for s, b, c in refs:
        if None in (s, b, c):
            continue
        todo, seen = [(s, c)], {(s, c)}
        while todo:
            for at in onward[todo.pop()]:
                if at not in seen:
                    seen.add(at)
                    todo.append(at)
        found |= {(s, at, b) for s, at in seen}
    return found


def reached(spark, refs, parents):
    labels, numbers = ancestry.reach(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    rows = [tuple(r) for r in ancestry.commit_branches(labels, numbers).select("source_name", "commit_hash", "branch").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def history(seed, n, source, merges):
    """Commits 0..n-1 on a few lines that fork and merge."""
    rng, rows, tips = random.Random(seed), [], [0]
    for c in range(1, n):
        first = rng.choice(tips)
        rows.append((source, f"{c}", f"{first}", 0))
        if rng.random() < merges:
            rows += [(source, f"{c}", f"{rng.choice(tips)}", place) for place in range(1, rng.randint(2, 3))]
        if rng.random() < 0.8:
            tips.remove(first)
        tips.append(c)
    return rows, tips


@pytest.mark.parametrize("merges", [0.0, 0.3])
def test_reach(spark, merges):
    rows, tips = history(1, 150, "S", merges)
    more, ends = history(2, 60, "T", merges)
    rng = random.Random(5)
    refs = [("S", f"origin/b{k}", str(rng.choice([*tips, rng.randrange(150)]))) for k in range(90)] + [("T", f"t{c}", str(c)) for c in ends]
    refs += [refs[0], ("S", "tip only", "nowhere"), (None, "x", "1"), ("S", None, "1"), ("S", "x", None)]
    parents = rows + more + [rows[3], ("S", "0", "cut off", 0), ("S", "0", None, 0), (None, "1", "2", 0)]
    assert reached(spark, refs, parents) == brute_reach(refs, parents)


def test_rounds_are_logarithmic(spark):
    chain = [("S", str(c), str(c - 1), 0) for c in range(1, 300)]
    steps = ancestry.ladder(spark.createDataFrame(chain, PARENTS).selectExpr("source_name", "commit_hash", "parent_hash as to"))
    assert len(steps) == math.floor(math.log(299, ancestry.WAYS)) + 1
    assert [s.count() for s in steps] == [299, 292, 236], "a row a commit, not a way"
    with pytest.raises(ValueError, match="circle"):
        ancestry.reach(spark.createDataFrame([("S", "b", "1")], REFS), spark.createDataFrame([("S", "1", "2", 0), ("S", "2", "1", 0)], PARENTS))


def test_rounds_do_not_write_all_commits_anew(spark, monkeypatch):
    """Five merges on the way from one line to the last, with lines whose commits are joined in turns."""
    n, rows = 400, [0]

    def counting(df, name, written=ancestry.written):
        held = written(df, name)
        rows[0] += held.count() if name in ("labels", "entered", "fresh", "known") else 0
        return held

    monkeypatch.setattr(ancestry, "FEW_LINKS", 100, raising=False)
    monkeypatch.setattr(ancestry, "written", counting)
    parents = [("S", str(c), str(c - 8), 0) for c in range(8, n)] + [("S", str(n - 1 - 21 * k), str(n - 14 - 21 * k), 1) for k in range(5)]
    parents += [("S", f"side {k}", str(40 * k), 0) for k in range(3)]
    refs = [("S", "tip", str(n - 1)), ("S", "inner", "200"), ("S", "side", "side 2")]
    assert reached(spark, refs, parents) == brute_reach(refs, parents)
    assert rows[0] < n


def test_reach_of_nothing_and_funnel_form(spark):
    assert reached(spark, [], []) == set()
    assert reached(spark, [("S", "b", "1")], []) == {("S", "1", "b")}
    rows = [("S", "2", "1", 0), ("S", "3", "1", 0)]
    labels, numbers = ancestry.reach(spark.createDataFrame([("S", "origin/main", "2"), ("S", "origin/gh-pages", "3")], REFS), spark.createDataFrame(rows, PARENTS))
    found = {r["commit_hash"]: (r["branches"], r["only_excluded"]) for r in funnel.commit_refs(ancestry.commit_branches(labels, numbers), ["gh-pages"]).collect()}
    assert found == {"1": ("main", False), "2": ("main", False), "3": ("gh-pages", True)}


# --- snapshots

TREES = "source_name string, commit_hash string, path string, blob string"


def lines_of(text):
    hashes = sorted({xxhash.xxh64_intdigest(line.encode(), 42) for line in text.split("\n")}, key=lambda h: h - (h >> 63 << 64))
    return set(hashes[: snapshots.SKETCH_LINES])


def brute_changes(trees, parents, texts=None):
    tree, out = defaultdict(dict), set()
    for s, c, p, b in trees:
        tree[s, c][p] = b
    first = {(s, c): p for s, c, p, k in parents if k == 0}
    for s, c in {k for k in tree} | {k for k in first}:
        old, new = tree.get((s, first.get((s, c))), {}), tree.get((s, c), {})
        out |= {(s, c, "M", p, p, None) for p in old.keys() & new.keys() if old[p] != new[p]}
        gone, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
        for same_name in (True, False):
            for a in list(gone):
                fits = [b for b in came if new[b] == old[a] and old[a] is not None and (not same_name or a.split("/")[-1] == b.split("/")[-1])]
                if fits:
                    out.add((s, c, "R", a, fits[0], 100))
                    gone.remove(a)
                    came.remove(fits[0])
        if texts:
            pairs = []
            for a in gone:
                for b in came:
                    if old[a] in texts and new[b] in texts:
                        x, y = lines_of(texts[old[a]]), lines_of(texts[new[b]])
                        if 100 * len(x & y) >= 50 * len(x | y):
                            pairs.append((-(100 * len(x & y) // len(x | y)), a, b))
            for off, a, b in sorted(pairs):
                if a in gone and b in came:
                    out.add((s, c, "R", a, b, -off))
                    gone.remove(a)
                    came.remove(b)
        out |= {(s, c, "D", a, None, None) for a in gone} | {(s, c, "A", None, b, None) for b in came}
    return out


def told(spark, trees, parents, texts=None):
    blobs = None if texts is None else spark.createDataFrame(list(texts.items()), "blob string, text string")
    rows = [tuple(r) for r in snapshots.changes(spark.createDataFrame(trees, TREES), spark.createDataFrame(parents, PARENTS), blobs).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_changes(spark):
    """Additions, deletions, changes, roots, a missing parent, an emptied tree, copies of one blob under many names."""
    rng = random.Random(4)
    trees, parents = [], []
    for s in "ST":
        now = {f"d{k % 3}/f{k}.mo": f"b{rng.randrange(6)}" for k in range(12)}
        for c in range(8):
            trees += [(s, f"c{c}", p, b) for p, b in now.items()]
            if c:
                parents.append((s, f"c{c}", f"c{c - 1}", 0))
            now = dict(now)
            for p in rng.sample(sorted(now), 4):
                blob = now.pop(p)
                kind = rng.randrange(4)
                if kind == 0:
                    now["moved/" + p.split("/")[-1]] = blob
                elif kind == 1:
                    now[f"new/{rng.randrange(99)}.mo"] = blob
                elif kind == 2:
                    now[p] = f"b{rng.randrange(6)}"
    parents += [("S", "c0", "unknown", 0), ("S", "c3", "c0", 1), ("T", "gone", "c7", 0), ("S", "side", "c2", 0)]
    trees += [("S", "side", "only", None), ("S", "side", "d0/f0.mo", "b1")]
    assert told(spark, trees + trees[:5], parents + parents[:2]) == brute_changes(trees, parents)


def test_similar_files_are_renames(spark):
    rng = random.Random(9)
    licence = [f"licence {k}" for k in range(3)]
    texts, trees = {}, []
    for k in range(14):
        body = [f"line {k} {i}" for i in range(rng.choice([1, 4, 20, 150]))]
        texts[f"a{k}"] = "\n".join([*licence, *body])
        changed = [x if rng.random() > rng.choice([0.05, 0.3, 0.9]) else f"other {rng.random()}" for x in body]
        texts[f"z{k}"] = "\n".join([*licence, *changed])
        trees += [("S", "1", f"old/{k}", f"a{k}"), ("S", "2", f"new/{k}", f"z{k}")]
    texts |= {"e": "", "f": ""}
    trees += [("S", "1", "old/empty", "e"), ("S", "2", "new/empty", "f"), ("S", "2", "new/unknown", "no text")]
    want = brute_changes(trees, [("S", "2", "1", 0)], texts)
    assert sum(r[2] == "R" for r in want) > 4 and any(r[2] == "D" for r in want)
    assert told(spark, trees, [("S", "2", "1", 0)], texts) == want


def test_matching_takes_the_best_first(spark):
    """A pair that is best for one path only waits until the other's better one is taken."""
    rows = [("S", "c", a, b, n) for a, b, n in (("a", "x", 90), ("a", "y", 95), ("b", "y", 97), ("b", "x", 60), ("c", "x", 90), ("d", "z", 50), ("e", "z", 50))]
    pairs = spark.createDataFrame(rows, "source_name string, commit_hash string, a_path string, b_path string, similarity int")
    assert {tuple(r)[2:] for r in snapshots.matched(pairs).collect()} == {("b", "y", 97), ("a", "x", 90), ("d", "z", 50)}


def test_lines_that_all_files_share_bring_no_pairs_together(spark):
    """Candidates stay few where every file holds the same licence."""
    rows = [("S", "c", f"{k}", [1, 2, 3, *range(100 * k + 10, 100 * k + 20)]) for k in range(40)]
    schema = "source_name string, commit_hash string, {} string, sketch array<bigint>"
    gone, new = spark.createDataFrame(rows, schema.format("a_path")), spark.createDataFrame(rows, schema.format("b_path"))
    ranks = gone.unionByName(new.withColumnRenamed("b_path", "a_path")).selectExpr("source_name", "commit_hash", "explode(sketch) as line").groupBy("source_name", "commit_hash", "line").count().withColumnRenamed("count", "files")
    met = snapshots._prefixes(gone, "a_path", ranks, 50).join(snapshots._prefixes(new, "b_path", ranks, 50), ["source_name", "commit_hash", "line"]).select("a_path", "b_path").distinct()
    assert met.count() == 40
    assert snapshots.similar_pairs(gone, new).count() == 40


def test_paths_are_dealt_out_once_for_changes_and_once_for_renames(spark, monkeypatch):
    plans = []

    def shuffles(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))

    def looking(df, name, written=snapshots.written):
        shuffles(df)
        return written(df, name)

    monkeypatch.setattr(snapshots, "written", looking)
    trees = [("S", "1", "a/x", "b"), ("S", "1", "a/y", "b"), ("S", "1", "z", "b"), ("S", "2", "c/y", "b"), ("S", "2", "d", "b"), ("S", "2", "z", None)]
    found = snapshots.changes(spark.createDataFrame(trees, TREES), spark.createDataFrame([("S", "2", "1", 0)], PARENTS))
    shuffles(found)
    assert {tuple(r)[1:] for r in found.filter("commit_hash = '2'").collect()} == {("2", "M", "z", "z", None), ("2", "R", "a/y", "c/y", 100), ("2", "R", "a/x", "d", 100)}
    assert sum(plans) <= 5  # parents, both sides of their join with trees, changes, renames


def test_changes_of_nothing(spark):
    assert told(spark, [], []) == set()
    assert told(spark, [("S", "c", "p", "b")], []) == {("S", "c", "A", None, "p", None)}
