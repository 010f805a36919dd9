"""Changed paths of commits from their trees: additions, deletions, changes, renames.

A commit's (path, blob) rows meet its first parent's in a full outer join. What
was deleted and what was added are then paired: by equal blobs first, those of
the same file name before others, then by the similarity of the files' lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

COMMIT = ["source_name", "commit_hash"]
#: The same for keys that are sorted: sorting looks at the first eight bytes of the
#: first column before all else, which the same source has in every row.
SORTED = ["commit_hash", "source_name"]
CHANGE = [*COMMIT, "status", "a_path", "b_path", "similarity"]
#: Least share of common lines of a rename, in hundredths, and lines of a file's sketch.
RENAME_SHARE = 50
SKETCH_LINES = 64


def path_changes(trees: DataFrame, parents: DataFrame) -> DataFrame:
    """(source_name, commit_hash, a_path, b_path, a_blob, b_blob) of every path that a
    commit has otherwise than its first parent; the side that lacks it is null.

    trees: (source_name, commit_hash, path, blob); parents as in ``ancestry``.
    A commit without a parent, or with one that has no tree, adds all its paths.
    Keys are (commit, path), so that no commit lands in one task. Both sides are
    aggregated in one shuffle, where repeated rows fall together.
    """
    first = parents.filter("place = 0 and parent_hash is not null").select(*COMMIT, "parent_hash").distinct()
    old = trees.withColumnRenamed("commit_hash", "parent_hash").join(first, ["parent_hash", "source_name"])
    sides = old.select(*COMMIT, "path", "blob", F.lit(1).alias("side")).unionByName(trees.select(*COMMIT, "path", "blob", F.lit(2).alias("side")))
    keys = [*SORTED, "path"]
    blob = [F.max(F.when(F.col("side") == side, F.col("blob"))).alias(name) for side, name in ((1, "a_blob"), (2, "b_blob"))]
    both = sides.repartition(*keys).groupBy(*keys).agg(F.bit_or("side").alias("sides"), *blob).filter((F.col("sides") < 3) | ~F.col("a_blob").eqNullSafe(F.col("b_blob")))
    # A commit without rows of its own has deleted all its parent's paths, if it is known at all.
    return both.select(*COMMIT, F.when(F.col("sides") != 2, F.col("path")).alias("a_path"), F.when(F.col("sides") != 1, F.col("path")).alias("b_path"), "a_blob", "b_blob")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exact_renames(found: DataFrame) -> DataFrame:
    """(source_name, commit_hash, a_path, b_path, blob): paths that are on one side only,
    in pairs of equal blobs where there are any; a path is in one row.

    found: rows of ``path_changes``. Files that kept their name are paired first,
    the first with the first by path, then the others. Null blobs are in no pair.
    Rows are dealt out once, by commit and blob.
    """
    one = found.filter("a_path is null or b_path is null").select(*COMMIT, F.coalesce("a_path", "b_path").alias("path"), F.coalesce("a_blob", "b_blob").alias("blob"), F.col("b_path").isNotNull().alias("new"))
    alike = F.when(F.col("blob").isNull(), F.concat(F.lit("p"), "path")).otherwise(F.concat(F.lit("b"), "blob"))  # a path without a blob stands alone
    keys = [*SORTED, "alike"]
    named = one.withColumn("alike", alike).repartition(*keys).withColumn("name", file_name(F.col("path")))
    place = F.row_number().over(Window.partitionBy(*keys, "name", "new").orderBy("path"))
    n = [F.count(F.when(F.col("new") == side, 1)).over(Window.partitionBy(*keys, "name")) for side in (False, True)]
    # Pairs keep name and place; of what is left, whatever its name, the first new one meets the first deleted one.
    told = named.withColumn("place", place).withColumn("kept", F.col("place") <= F.least(*n))
    again = F.row_number().over(Window.partitionBy(*keys, "kept", "new").orderBy("path"))
    met = told.withColumn("pair", F.when(F.col("kept"), F.col("name"))).withColumn("at", F.when(F.col("kept"), F.col("place")).otherwise(again))
    sides = [F.max(F.when(F.col("new") == side, F.col("path"))).alias(name) for side, name in ((False, "a_path"), (True, "b_path"))]
    return met.groupBy(*keys, "pair", "at").agg(*sides, F.max("blob").alias("blob")).drop("alike", "pair", "at")


def _without(rows: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    return rows.join(pairs.select(*COMMIT, path), [*COMMIT, path], "left_anti")


def sketch(text: Column, lines: int = SKETCH_LINES) -> Column:
    """The least hashes of a text's distinct lines: all of them where there are few."""
    hashes = F.array_distinct(F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line)))
    return F.slice(F.array_sort(hashes), 1, lines)


def _prefixes(files: DataFrame, path: str, ranks: DataFrame, share: int) -> DataFrame:
    """Each file with those of its lines' hashes one of which a file similar enough shares.

    Of two sets with ``share`` hundredths in common, the rarest ``n - ceil(share n) + 1``
    elements of one meet those of the other, if both are ordered alike: so lines
    that all files of a commit have bring no pairs together.
    """
    listed = files.select(*COMMIT, path, F.explode("sketch").alias("line")).join(ranks, [*COMMIT, "line"])
    ordered = listed.groupBy(*COMMIT, path).agg(F.array_sort(F.collect_list(F.struct("files", "line"))).alias("lines"))
    n = F.size("lines")
    kept = n - F.ceil(n * share / 100).cast("int") + 1
    return ordered.select(*COMMIT, path, F.explode(F.slice("lines", 1, kept)).alias("rare")).select(*COMMIT, path, "rare.line")


def similar_pairs(gone: DataFrame, new: DataFrame, share: int = RENAME_SHARE) -> DataFrame:
    """(source_name, commit_hash, a_path, b_path, similarity) of files whose sketches
    have ``share`` hundredths of their lines in common at least.

    gone: (source_name, commit_hash, a_path, sketch), new: (..., b_path, sketch).
    """
    every = gone.select(*COMMIT, F.explode("sketch").alias("line")).unionByName(new.select(*COMMIT, F.explode("sketch").alias("line")))
    ranks = written(every.groupBy(*COMMIT, "line").agg(F.count("*").alias("files")), "lines")
    met = _prefixes(gone, "a_path", ranks, share).join(_prefixes(new, "b_path", ranks, share), [*COMMIT, "line"]).select(*COMMIT, "a_path", "b_path").distinct()
    both = met.join(gone.withColumnRenamed("sketch", "a"), [*COMMIT, "a_path"]).join(new.withColumnRenamed("sketch", "b"), [*COMMIT, "b_path"])
    common, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return both.withColumn("similarity", F.floor(100 * common / union).cast("int")).filter(100 * common >= share * union).select(*COMMIT, "a_path", "b_path", "similarity")


def matched(pairs: DataFrame) -> DataFrame:
    """The pairs that are taken one after the other, most similar first (ties: by
    the paths), each path once.

    Each round takes the pairs that are best for both their paths, which is what
    taking them in order comes to, and drops those that share a path with them.
    """
    left = written(pairs, "pairs")
    taken = left.limit(0)
    worth = F.struct((-F.col("similarity")).alias("off"), "a_path", "b_path")
    while not left.isEmpty():
        ranked = left.withColumn("worth", worth)
        best_a = ranked.groupBy(*COMMIT, "a_path").agg(F.min("worth").alias("worth"))
        best_b = ranked.groupBy(*COMMIT, "b_path").agg(F.min("worth").alias("worth"))
        now = best_a.join(best_b.select(*COMMIT, "b_path", "worth"), [*COMMIT, "worth"]).select(*COMMIT, "a_path", "b_path", (-F.col("worth.off")).alias("similarity"))
        now = written(now, "taken")
        taken = taken.unionByName(now)
        left = written(_without(_without(left, now, "a_path"), now, "b_path"), "pairs")
    return taken


def changes(trees: DataFrame, parents: DataFrame, texts: DataFrame | None = None, share: int = RENAME_SHARE) -> DataFrame:
    """(source_name, commit_hash, status, a_path, b_path, similarity) of all changes.

    status is A (added), D (deleted), M (changed) or R (renamed; similarity in
    hundredths, 100 for equal blobs). texts: (blob, text) of blobs, without which
    only equal blobs are renames; of long texts the ``SKETCH_LINES`` least line
    hashes stand for all. Repeated tree rows are one; an empty tree gives nothing.
    """
    found = written(path_changes(trees, parents), "changes")
    exact = F.when(F.col("a_path").isNotNull() & F.col("b_path").isNotNull(), 100).alias("similarity")
    single = exact_renames(found)
    if texts is None:
        single = single.select(*COMMIT, "a_path", "b_path", exact)
    else:
        single = written(single, "renames")
        gone = single.filter("b_path is null").select(*COMMIT, "a_path", "blob")
        new = single.filter("a_path is null").select(*COMMIT, "b_path", "blob")
        sketches = texts.select("blob", sketch(F.col("text")).alias("sketch"))
        similar = similar_pairs(*[written(side.join(sketches, "blob").drop("blob"), "sketches") for side in (gone, new)], share)
        likely = matched(similar)
        single = _without(_without(single, likely, "a_path"), likely, "b_path").select(*COMMIT, "a_path", "b_path", exact).unionByName(likely)
    status = F.when(F.col("a_path").isNull(), "A").when(F.col("b_path").isNull(), "D").otherwise("R")
    changed = found.filter("a_path is not null and b_path is not null")
    return changed.select(*COMMIT, F.lit("M").alias("status"), "a_path", "b_path", F.lit(None).cast("int").alias("similarity")).unionByName(single.withColumn("status", status)).select(CHANGE)
