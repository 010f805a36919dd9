"""Statistics: funnel, growth, outcomes, failure classes, invariants, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import BOT_SIGNS, EMPTY_FAILURE, FAILURES, OTHER_FAILURE, REPORTED_FAILURES
from ..functions.numbers import disk_text, percent, tex_size
from ..functions.text import first_match, strip
from .listing import commit_counts, growth, listing_totals
from .upsert import numbered

COMMIT = ["source_name", "commit_hash"]
#: Rows of a series that a task orders.
BLOCK_ROWS = 100_000


def reason_bucket(reason: Column) -> Column:
    """Bucket of an exclusion reason by what it contains; null for none."""
    low = F.lower(reason)
    bot = reduce(lambda a, b: a | b, [low.contains(s) for s in BOT_SIGNS])
    return F.when(low.contains("excluded branch"), "branch").when(low.contains("before tag"), "tag").when(low.startswith("commit date:"), "age").when(low.contains("no .mo files"), "files").when(bot, "bot")


def funnel_metrics(commits: DataFrame) -> DataFrame:
    """Counts of each bucket and what remains after each, in one pass."""
    bucket = F.when(F.col("excluded") == 1, reason_bucket(F.col("exclusion_reason")))
    counted = commits.agg(
        F.count("*").alias("FilterInputCommits"),
        *[F.count_if(bucket == b).alias(name) for b, name in (("branch", "FilterExclBranches"), ("tag", "FilterExclPreVThree"), ("age", "FilterExclAge"), ("bot", "FilterExclBot"), ("files", "FilterExclNoMo"))],
        F.count_if(F.col("excluded") == 0).alias("FilterRetained"),
    )
    return counted.withColumns(
        {
            "FilterAfterBranches": F.col("FilterInputCommits") - F.col("FilterExclBranches"),
            "FilterAfterPreVThree": F.col("FilterInputCommits") - F.col("FilterExclBranches") - F.col("FilterExclPreVThree"),
            "FilterAfterBot": F.col("FilterInputCommits") - F.col("FilterExclBranches") - F.col("FilterExclPreVThree") - F.col("FilterExclAge") - F.col("FilterExclBot"),
            "FilterRetainedPct": percent(F.col("FilterRetained"), F.col("FilterInputCommits")),
        }
    )


def funnel_summary(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Run metrics of the funnel: shares of all, but files' of those that got so far; files per commit."""
    row = funnel_metrics(commits)
    per_commit = files.groupBy(*COMMIT).agg(F.count("*").alias("n"))
    spread = per_commit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("StepOneCommitMoPairs"), F.median("n").alias("StepOneCommitMoPairsMedian"))
    total = F.col("FilterInputCommits")
    out = total - F.col("FilterRetained")
    return row.crossJoin(spread).select(
        total.alias("StepOneInputUniqueCommits"),
        *[e for c, name in (("FilterExclBranches", "Branches"), ("FilterExclBot", "Bot"), ("FilterExclPreVThree", "PreVThree")) for e in (F.col(c).alias(f"StepOneExcluded{name}Count"), percent(F.col(c), total).alias(f"StepOneExcluded{name}Pct"))],
        F.col("FilterExclNoMo").alias("StepOneExcludedNoMoCount"),
        percent(F.col("FilterExclNoMo"), F.col("FilterExclNoMo") + F.col("FilterRetained")).alias("StepOneExcludedNoMoPct"),
        out.alias("StepOneTotalExcludedCount"),
        percent(out, total).alias("StepOneTotalExcludedPct"),
        F.col("FilterRetained").alias("TotalCommitsFiltered"),
        "StepOneCommitMoPairs",
        F.when(F.col("FilterRetained") > 0, F.col("StepOneCommitMoPairs") / F.col("FilterRetained")).otherwise(0.0).alias("StepOneCommitMoPairsMean"),
        F.coalesce("StepOneCommitMoPairsMedian", F.lit(0.0)).alias("StepOneCommitMoPairsMedian"),
    )


def listing_metrics(listing: DataFrame) -> DataFrame:
    return listing_totals(listing).crossJoin(growth(commit_counts(listing)))


def without_listing(commits: DataFrame, listing: DataFrame) -> DataFrame:
    """Retained commits that no listing row names."""
    return commits.filter("excluded = 0").select(*COMMIT).join(listing.select(*COMMIT).distinct(), COMMIT, "left_anti")


def load_failures(listing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(n): eligible listing rows of commits without any outcome."""
    missing = listing.filter("is_experiment = 1").join(outcomes.select(*COMMIT).distinct(), COMMIT, "left_anti")
    return missing.agg(F.count("*").alias("n"))


def outcome_metrics(commits: DataFrame, listing: DataFrame, outcomes: DataFrame, extra: int) -> DataFrame:
    """Produced and failed versions; load failures count as failed."""
    made = outcomes.agg(F.count_if(F.col("canonical_produced") == 1).alias("produced"), (F.count_if(F.col("canonical_produced") == 0) + extra).alias("failed"))
    walked = listing.filter("is_experiment = 1").agg(F.count_distinct(*COMMIT).alias("eligible_commits"))
    kept = commits.agg(F.count_if(F.col("excluded") == 0).alias("retained"))
    base = F.col("produced") + F.col("failed")
    return made.crossJoin(walked).crossJoin(kept).select(
        F.col("eligible_commits").alias("CanonCommitsWithExperiment"),
        percent(F.col("eligible_commits"), F.col("retained")).alias("CanonCommitsWithExperimentPct"),
        F.col("produced").alias("CanonProducedVersions"),
        percent(F.col("produced"), base).alias("CanonProducedVersionsPct"),
        F.col("failed").alias("CanonFailures"),
        percent(F.col("failed"), base).alias("CanonFailuresPct"),
    )


def failure_class(message: Column) -> Column:
    bare = strip(message)
    return F.when(bare == "", EMPTY_FAILURE).otherwise(first_match(bare, FAILURES, OTHER_FAILURE))


def failure_histogram(outcomes: DataFrame, extra: int = 0) -> DataFrame:
    """(label, n) of failures, most first; load failures folded in.

    Failures without a message count as such, so that classes add up to failures.
    """
    failed = outcomes.filter("canonical_produced = 0")
    counts = failed.groupBy(failure_class(F.coalesce("error_message", F.lit(""))).alias("label")).agg(F.count("*").alias("n"))
    if extra:
        more = failed.sparkSession.range(1).select(F.lit("Package load failure").alias("label"), F.lit(extra).cast("long").alias("n"))
        counts = counts.unionByName(more).groupBy("label").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "label")


def failure_metrics(histogram: DataFrame) -> DataFrame:
    """(name, n, pct) of the classes that reports name."""
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    names = histogram.sparkSession.createDataFrame(list(REPORTED_FAILURES.items()), "label string, name string")
    return names.join(histogram, "label", "left").crossJoin(F.broadcast(total)).select("name", F.coalesce("n", F.lit(0)).alias("n"), percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("pct"))


def moving_average_window(n: int) -> int:
    return min(50, n // 5) if n > 10 else 1


def moving_average(series: DataFrame, order: list[str], value: str, k: int) -> DataFrame:
    """Rows with the mean of a centred frame of k rows; incomplete frames give none.

    Rows are numbered in ranges of the order, and each goes to the block of its
    number; the rows at a block's edges go to the neighbours along with it, so
    that no task orders the whole series. Rows equal in ``order`` stand in any order.
    """
    block = max(BLOCK_ROWS, k)
    at = F.col("seq__")
    near = F.array(*[F.floor((at + d) / block) for d in (-k, 0, k)])
    spread = numbered(series, order).withColumnRenamed("seq", "seq__").withColumn("block__", F.explode(F.array_distinct(near)))
    frame = Window.partitionBy("block__").orderBy("seq__").rowsBetween(-(k // 2), k - 1 - k // 2)
    framed = spread.withColumns({"mean": F.avg(value).over(frame), "n__": F.count("*").over(frame)})
    return framed.filter((F.floor(at / block) == F.col("block__")) & (F.col("n__") == k)).drop("n__", "seq__", "block__")


def pixel_series(series: DataFrame, x: str, y: str, width: int) -> DataFrame:
    """(pixel, x, y): what a line drawn over ``width`` pixels needs of a series.

    Of the points that fall into a pixel's stretch of x, the first, the last,
    the lowest and the highest (M4, Jugel et al., 2014): at most ``4 width`` rows
    whatever the series' length, and the drawn line is the same. Points of equal
    x are in order of y; of equal y the lowest is the first and the highest the
    last. Rows with a null are left out; ``x`` and ``y`` are numbers. One
    aggregate with map-side combination, on bounds from another.
    """
    points = series.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    bounds = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    share = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) * width / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.0)
    placed = points.crossJoin(F.broadcast(bounds)).select(F.least(F.floor(share), F.lit(width - 1)).cast("int").alias("pixel"), "x", "y")
    across, upward = F.struct("x", "y"), F.struct("y", "x")
    four = placed.groupBy("pixel").agg(F.min(across).alias("first"), F.max(across).alias("last"), F.min(upward).alias("low"), F.max(upward).alias("high"))
    corners = F.array(*[F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for c in ("first", "last", "low", "high")])
    return four.select("pixel", F.explode(F.array_distinct(corners)).alias("p")).select("pixel", "p.x", "p.y")


def timeline(listing: DataFrame, dates: DataFrame) -> DataFrame | None:
    """Counts of each dated commit with moving averages; None below ten commits."""
    rows = commit_counts(listing).join(dates.select(*COMMIT, "committed_ts"), COMMIT).withColumn("date", F.date_format("committed_ts", "yyyy-MM-dd"))
    n = rows.count()
    if n < 10:
        return None
    k = moving_average_window(n)
    both = [moving_average(rows.select("date", "commit_hash", c), ["date", "commit_hash"], c, k).withColumnRenamed("mean", f"{c}_mean").drop(c) for c in ("n_classes", "n_eligible")]
    return rows.join(both[0], ["date", "commit_hash"], "left").join(both[1], ["date", "commit_hash"], "left").orderBy("date", "commit_hash")


def invariants(values: dict[str, int], categories: int, package_load: int, extra: int, listed_commits: int, unlisted: int, pilot: bool = False, progress: dict[str, int] | None = None) -> list[tuple[str, int, int, bool]]:
    """(label, left, right, ok) of what must agree between the metrics."""
    states = progress or {}
    found = [
        ("retained + excluded = input", values["FilterRetained"] + sum(values[f"FilterExcl{b}"] for b in ("Branches", "PreVThree", "Age", "Bot", "NoMo")), values["FilterInputCommits"]),
        ("listed + unlisted commits = retained", listed_commits + unlisted, values["FilterRetained"]),
        ("eligible + other = all", values["ListExperimentVersions"] + values["ListNonExperimentVersions"], values["ListAllClassVersions"]),
    ]
    if pilot:
        found += [("all walked commits complete", states.get("complete", 0), sum(states.values())), ("walked commits = retained", sum(states.values()), values["FilterRetained"])]
    else:
        found.append(("produced + failed = eligible", values["CanonProducedVersions"] + values["CanonFailures"], values["ListExperimentVersions"]))
    found.append(("categories = failures", categories, values["CanonFailures"]))
    told = [(label, a, b, a == b) for label, a, b in found]
    return [*told, ("package load covers load failures", package_load, extra, package_load >= extra)]


def checks(commits: DataFrame, listing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(label, lhs, rhs, ok) of what must agree between tables, each of which is read once.

    Listing rows are counted by commit and meet the commits there; sums of
    buckets and classes are made apart from the totals that they are held against.
    """
    bucket = F.when(F.col("excluded") == 1, reason_bucket(F.col("exclusion_reason")))
    listed = commit_counts(listing).join(commits.select(*COMMIT, "excluded", bucket.alias("bucket")), COMMIT, "full_outer")
    kept, known = F.col("excluded") == 0, F.col("n_classes").isNotNull()
    by_bucket = [F.count_if(F.col("bucket") == b) for b in ("branch", "tag", "age", "bot", "files")]
    row = listed.agg(
        (F.count_if(kept) + reduce(lambda a, b: a + b, by_bucket)).alias("retained_excluded"),
        F.count("excluded").alias("input"),
        F.count_if(kept & known).alias("listed"),
        F.count_if(kept & ~known).alias("unlisted"),
        F.count_if(kept).alias("retained"),
        F.coalesce(F.sum("n_classes"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("n_eligible"), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum(F.col("n_classes") - F.col("n_eligible")), F.lit(0)).alias("other"),
    )
    failed = F.col("canonical_produced") == 0
    made = outcomes.agg(F.count_if(F.col("canonical_produced") == 1).alias("produced"), F.count_if(failed).alias("failed"), F.count(F.when(failed, failure_class(F.coalesce("error_message", F.lit(""))))).alias("categories"))
    sides = {
        "retained + excluded = input": (F.col("retained_excluded"), F.col("input")),
        "listed + unlisted commits = retained": (F.col("listed") + F.col("unlisted"), F.col("retained")),
        "eligible + other = all": (F.col("eligible") + F.col("other"), F.col("all")),
        "produced + failed = eligible": (F.col("produced") + F.col("failed"), F.col("eligible")),
        "categories = failures": (F.col("categories"), F.col("failed")),
    }
    told = F.array(*[F.struct(F.lit(label).alias("label"), a.cast("long").alias("lhs"), b.cast("long").alias("rhs"), (a == b).alias("ok")) for label, (a, b) in sides.items()])
    return row.crossJoin(made).select(F.explode(told).alias("c")).select("c.*")  # one row each


def storage_metrics(sizes: DataFrame) -> DataFrame:
    """(name, value) of stored artifacts from (name, bytes), as reports show them; those that aren't there are left out."""
    return sizes.filter("bytes is not null").select("name", tex_size(disk_text(F.col("bytes"))).alias("value"))


def guard_pilot(enabled: bool, allowed: bool) -> None:
    """Pilot data give no report unless that is allowed."""
    if enabled and not allowed:
        raise SystemExit(2)


def coverage(expected: set[str], computed: set[str], defined: set[str]) -> dict[str, set[str]]:
    """Metric names that one side has and another lacks."""
    return {"not computed": expected - computed, "not expected": computed - expected, "not defined": computed - defined, "never computed": defined - computed}
