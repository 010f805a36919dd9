"""Which refs reach which commits, over a flat table of parents.

First parents make a forest: every commit has one way to a root. It is cut into
lines at its forks, and a commit is told by its line and its distance from the
line's last commit. Lines are found by joining pairs of neighbours, picked by
hash, until few are left: each turn has a quarter fewer rows, so that all turns
together come to a few times the commits. What enters a line somewhere reaches
all of it from there on, so a ref is known by the farthest place where it
enters; it goes on to the lines that first parents lead to from there by
pointers over 1 to 8, then 8 to 64 lines and so on. Other parents (merges) lead
from one place to another, until no line learns of a ref farther up. Refs are
bits: a row holds 64 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .upsert import numbered

COMMIT = ["source_name", "commit_hash"]
LABEL = [*COMMIT, "word"]
#: Refs of one row.
WORD = 64
#: Doublings of a round's pointers.
DOUBLINGS = 3
WAYS = 1 << DOUBLINGS
#: Rounds that any history can need; more mean that parents lead in a circle.
LEVELS = 16
#: Links of lines that are few enough for pointers over all of them.
FEW_LINKS = 500_000
#: Beyond the distance of any commit: what reaches a line whole.
WHOLE = 1 << 62
#: Words whose names are sent to every task.
NAME_WORDS = 10_000


def ref_numbers(refs: DataFrame) -> DataFrame:
    """(source_name, branch, word, bit): the place of each ref in the bitmaps."""
    named = numbered(refs.select("source_name", "branch").distinct(), ["source_name", "branch"])
    return named.select("source_name", "branch", F.floor(F.col("seq") / WORD).cast("int").alias("word"), (F.col("seq") % WORD).cast("int").alias("bit"))


def _combined(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*LABEL).agg(F.bit_or("bits").alias("bits"))


def _highest(labels: DataFrame) -> DataFrame:
    """(source_name, commit_hash, word, bit, far): the farthest place of each ref on each line."""
    few = labels.groupBy(*LABEL, "bits").agg(F.max("far").alias("far"))
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)
    return few.select(*LABEL, F.explode(held).alias("bit"), "far").groupBy(*LABEL, "bit").agg(F.max("far").alias("far"))


def _packed(places: DataFrame) -> DataFrame:
    """Refs that enter a line at one place as bits of a row."""
    return places.groupBy(*LABEL, "far").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _news(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Labels of refs that enter lines farther up than is known."""
    old = _highest(known).withColumnRenamed("far", "old")
    return _packed(_highest(labels).join(old, [*LABEL, "bit"], "left").filter("old is null or far > old"))


def ladder(first: DataFrame) -> list[DataFrame]:
    """Pointers (source_name, commit_hash, ways): the next ``WAYS`` first parents, then
    as many in strides of ``WAYS``, and so on, as long as there are any. A row has
    fewer where its way ends at a root."""
    base, steps = written(first, "pointers"), []
    while not base.isEmpty():
        if len(steps) == LEVELS:
            raise ValueError("parents lead in a circle")
        ways = base.select(*COMMIT, F.array("to").alias("ways"))
        for _ in range(DOUBLINGS):
            onward = ways.select("source_name", F.col("commit_hash").alias("last"), F.col("ways").alias("more"))
            both = ways.withColumn("last", F.element_at("ways", -1)).join(onward, ["source_name", "last"], "left")
            ways = both.select(*COMMIT, F.concat("ways", F.coalesce("more", F.array().cast("array<string>"))).alias("ways"))
        steps.append(written(ways, "ways"))
        base = steps[-1].filter(F.size("ways") == WAYS).select(*COMMIT, F.get("ways", F.lit(WAYS - 1)).alias("to"))
    return steps


def lines(links: DataFrame) -> DataFrame:
    """(source_name, commit_hash, line, far): the last commit of each one's line and the links to it.

    links: (source_name, commit_hash, to), a commit being in one row at most on
    either side. A line's last commit has no row in the result. In a turn, commits
    take in the next one where hashes say that they stay and the next one goes,
    which is a quarter of all; these are placed again in reverse order.
    """
    left, gone = written(links.select(*COMMIT, "to", F.lit(1).cast("long").alias("far")), "links"), []
    while True:
        n, circle = left.agg(F.count("*"), F.max(F.col("commit_hash") == F.col("to"))).first()
        if circle:
            raise ValueError("parents lead in a circle")
        if n <= FEW_LINKS:
            break
        goes = lambda c, turn=len(gone): F.xxhash64("source_name", c, F.lit(turn)) % 2 != 0
        own, following = goes("commit_hash"), goes("to")
        going = left.filter(own).select("source_name", F.col("commit_hash").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        met = left.filter(~own & following).join(going, ["source_name", "to"], "full_outer")
        both = F.col("commit_hash").isNotNull() & F.col("beyond").isNotNull()
        far = F.coalesce("far", F.lit(0)) + F.coalesce("more", F.lit(0))
        now = met.select("source_name", F.coalesce("commit_hash", "to").alias("commit_hash"), F.coalesce("beyond", "to").alias("to"), far.alias("far"), F.when(both, F.col("to")).alias("gone"), F.when(both, F.col("far")).alias("back"))
        none = [F.lit(None).cast("string").alias("gone"), F.lit(None).cast("long").alias("back")]
        turn = written(now.unionByName(left.filter(~own & ~following).select("*", *none)), "turn")
        left = turn.select(*COMMIT, "to", "far")
        gone.append(turn.filter("gone is not null").select(*COMMIT, "gone", "back"))
    for _ in range(-(-n.bit_length() // DOUBLINGS)):
        for _ in range(DOUBLINGS):
            onward = left.select("source_name", F.col("commit_hash").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
            left = left.join(onward, ["source_name", "to"], "left").select(*COMMIT, F.coalesce("beyond", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        left = written(left, "pointers")
        if left.join(left.select("source_name", F.col("commit_hash").alias("to")), ["source_name", "to"], "left_semi").isEmpty():
            break
    else:
        if n:
            raise ValueError("parents lead in a circle")
    placed = left.select(*COMMIT, F.col("to").alias("line"), "far")
    for turn in reversed(gone):
        more = turn.join(placed, COMMIT).select("source_name", F.col("gone").alias("commit_hash"), "line", (F.col("far") - F.col("back")).alias("far"))
        placed = placed.unionByName(written(more, "placed"))
    return placed


def _at(rows: DataFrame, column: str, placed: DataFrame, line: str, far: str) -> DataFrame:
    """Rows with the line and place of a commit; one that isn't placed is the last of its own line."""
    known = placed.select("source_name", F.col("commit_hash").alias(column), F.col("line").alias(line), F.col("far").alias(far))
    return rows.join(known, ["source_name", column], "left").withColumn(line, F.coalesce(line, column)).withColumn(far, F.coalesce(far, F.lit(0)))


def _handed_down(labels: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Labels at every commit that first parents lead to from one that has them.

    Two strides go into one plan; what is written is read twice by the next.
    """
    for k, step in enumerate(steps):
        moved = labels.join(step, COMMIT).select("source_name", F.explode(F.slice("ways", 1, WAYS - 1)).alias("commit_hash"), "word", "bits")
        labels = _combined(labels.unionByName(moved))
        if k % 2 or k == len(steps) - 1:
            labels = written(labels, "labels")
    return labels


def _with_ancestors(labels: DataFrame, up: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Labels and, where lines lead to others, the same refs on those as a whole."""
    if not steps:
        return labels
    passed = _combined(labels.join(up, COMMIT).select("source_name", F.col("to").alias("commit_hash"), "word", "bits"))
    return labels.unionByName(_handed_down(passed, steps).withColumn("far", F.lit(WHOLE)))


def _held(far: Column) -> Column:
    """Bits of those of a line's labels that enter it at a place or farther up."""
    return F.aggregate(F.filter("highs", lambda h: h["far"] >= far), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(h["bits"]))


def reach(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bitmaps (source_name, commit_hash, word, bits) of the refs that reach each
    commit, and the numbers of the refs (``ref_numbers``).

    refs: (source_name, branch, commit_hash); parents: (source_name,
    commit_hash, parent_hash, place), place 0 being a commit's first parent.
    Rows with a null, and repeated ones, do no harm. A parent that has no row of
    its own (a history cut off) is reached like any other. A circle of first
    parents is an error.

    Rounds are the logarithm of the longest way of first parents over forks,
    times one more than the most merges that the least merged way from a ref to
    a commit has. Tables of all commits are written and shuffled a fixed number
    of times; what grows with the rounds has a row a line, place of entry and 64
    refs.
    """
    edges = parents.dropna(subset=[*COMMIT, "parent_hash", "place"]).select(*COMMIT, F.col("parent_hash").alias("to"), (F.col("place") > 0).alias("merge"))
    nth = F.row_number().over(Window.partitionBy(*COMMIT).orderBy("merge", "to"))
    edges = written(edges.repartition(*COMMIT).distinct().withColumn("first", (nth == 1) & ~F.col("merge")), "edges")
    children = F.count("*").over(Window.partitionBy("source_name", "to"))
    first = written(edges.filter("first").select(*COMMIT, "to").withColumn("forked", children > 1), "first")
    placed = lines(first.filter("not forked").select(*COMMIT, "to"))
    # A commit before a fork is the last of its line, a fork the first of its own.
    up = written(_at(first.filter("forked").select(*COMMIT, "to"), "to", placed, "line", "far").select(*COMMIT, F.col("line").alias("to")), "up")
    steps = ladder(up)
    merges = _at(_at(edges.filter("not first").select(*COMMIT, "to").distinct(), "to", placed, "to_line", "to_far"), "commit_hash", placed, "line", "from_far")
    merges = written(merges.select("source_name", F.col("line").alias("commit_hash"), "from_far", "to_line", "to_far"), "merges")
    heads = written(refs.dropna(subset=["source_name", "branch", "commit_hash"]).select("source_name", "branch", "commit_hash").distinct(), "heads")
    numbers = written(ref_numbers(heads), "refs")
    bits = F.expr("shiftleft(1L, bit)").alias("bits")
    seeds = _at(heads.join(numbers, ["source_name", "branch"]), "commit_hash", placed, "line", "far").select("source_name", F.col("line").alias("commit_hash"), "word", "far", bits)
    seeds = written(_packed(_highest(seeds)), "seeds")
    known = fresh = written(_packed(_highest(_with_ancestors(seeds, up, steps))), "known")
    while True:
        crossed = fresh.join(merges, COMMIT).filter("from_far <= far").select("source_name", F.col("to_line").alias("commit_hash"), "word", F.col("to_far").alias("far"), "bits")
        entered = written(_news(crossed, known), "entered")
        if entered.isEmpty():
            break
        fresh = written(_news(_with_ancestors(entered, up, steps), known), "fresh") if steps else entered
        known = written(_packed(_highest(known.unionByName(fresh))), "known")
    highs = known.groupBy(*LABEL).agg(F.collect_list(F.struct("far", "bits")).alias("highs")).withColumnRenamed("commit_hash", "line")  # 64 at most
    last = known.select(*COMMIT, F.col("commit_hash").alias("line"), F.lit(0).cast("long").alias("far")).distinct()
    labels = placed.unionByName(last).join(highs, ["source_name", "line"]).select(*COMMIT, "word", _held(F.col("far")).alias("bits"))
    return labels.filter("bits <> 0"), numbers


def commit_branches(labels: DataFrame, numbers: DataFrame) -> DataFrame:
    """(source_name, commit_hash, branch): the bitmaps of ``reach`` as rows, in the
    form that the funnel takes."""
    names = numbers.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bit", "branch"))).alias("names"))  # 64 at most
    few = names.limit(NAME_WORDS + 1).count() <= NAME_WORDS
    joined = labels.join(F.broadcast(names) if few else names, "word")
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)
    return joined.select(*COMMIT, F.explode(F.transform(held, lambda b: F.element_at("names", b))).alias("branch"))
