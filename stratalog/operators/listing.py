"""Class listings per commit, whitelist matching, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import FAILURE_TYPES
from ..functions.numbers import half_even, percent, ratio
from ..functions.text import class_file, dotted_prefixes, load_targets, output_problem, strip

COMMIT = ["source_name", "commit_hash"]
CLASS = [*COMMIT, "class_name"]
#: Type under which failures of types that aren't known are logged.
UNKNOWN_FAILURE = "unknown_failure"
#: Whitelists up to this many rows are sent to every task.
WHITELIST_ROWS = 100_000
#: Load targets, and paths of them, up to this many are sent to every task.
TARGET_ROWS = 100_000


def commit_counts(listing: DataFrame, keys: list[str] | None = None, flag: Column | None = None) -> DataFrame:
    """Rows and eligible rows of each commit."""
    eligible = F.col("is_experiment") == 1 if flag is None else flag
    return listing.groupBy(*(keys or COMMIT)).agg(F.count("*").alias("n_classes"), F.count_if(eligible).alias("n_eligible"))


def growth(counts: DataFrame) -> DataFrame:
    """Means and maxima over commits; the ratio is a mean of ratios, not a ratio of sums."""
    return counts.agg(
        half_even(F.avg("n_classes")).alias("GrowthAllClassMean"),
        F.max("n_classes").alias("GrowthAllClassMax"),
        half_even(F.avg("n_eligible")).alias("GrowthExperimentMean"),
        F.max("n_eligible").alias("ListMaxExperimentPerCommit"),
        (100 * F.avg(ratio(F.col("n_eligible"), F.col("n_classes")))).alias("GrowthExperimentRatioMean"),
    )


def listing_totals(listing: DataFrame) -> DataFrame:
    """Distinct names, all, eligible and other rows in one pass."""
    eligible = F.count_if(F.col("is_experiment") == 1)
    other = F.count_if(F.col("is_experiment") == 0)
    total = F.count("*")
    return listing.agg(
        F.count_distinct("class_name").alias("ListDistinctClassNames"),
        total.alias("ListAllClassVersions"),
        other.alias("ListNonExperimentVersions"),
        percent(other, total).alias("ListNonExperimentVersionsPct"),
        eligible.alias("ListExperimentVersions"),
        percent(eligible, total).alias("ListExperimentVersionsPct"),
    )


def classes_by_commit(listing: DataFrame, eligible_only: bool = True) -> DataFrame:
    """Sorted class names of each commit as an array."""
    rows = listing.filter("is_experiment = 1") if eligible_only else listing
    return rows.groupBy(*COMMIT).agg(F.array_sort(F.collect_list("class_name")).alias("classes"))


def enumerated(listing: DataFrame, source: str, commit: str, eligible_only: bool = False) -> DataFrame:
    rows = listing.filter((F.col("source_name") == source) & (F.col("commit_hash") == commit))
    return (rows.filter("is_experiment = 1") if eligible_only else rows).select("class_name", "is_experiment").orderBy("class_name")


def enabled_whitelist(whitelist: DataFrame) -> DataFrame:
    return whitelist.filter("enabled = 1").select(F.col("class_name").alias("item")).distinct()


def match_whitelist(classes: DataFrame, items: DataFrame, allow_prefix: bool, name: str = "class_name") -> DataFrame:
    """Each row with matched, mode (exact, prefix or none) and the longest matching item.

    A name matches an item that it equals, or lies in behind a dot. Names are
    spread to their prefixes and met by equality, which stays a hash join where
    a ``startswith`` condition would compare all pairs.
    """
    distinct = classes.select(name).distinct()
    spread = distinct.select(name, F.explode(dotted_prefixes(F.col(name)) if allow_prefix else F.array(name)).alias("item"))
    known = items.select("item").distinct()
    known = F.broadcast(known) if known.limit(WHITELIST_ROWS + 1).count() <= WHITELIST_ROWS else known
    found = spread.join(known, "item").groupBy(name).agg(F.max_by("item", F.length("item")).alias("matched_item"))
    mode = F.when(F.col("matched_item").isNull(), "none").when(F.col("matched_item") == F.col(name), "exact").otherwise("prefix")
    return classes.join(found, name, "left").select(classes.columns + [F.col("matched_item").isNotNull().alias("matched"), mode.alias("mode"), F.coalesce("matched_item", F.lit("")).alias("matched_item")])


def pilot_candidates(commits: DataFrame, items: DataFrame) -> DataFrame:
    """Every whitelist item for every commit; a whitelist of more than
    ``WHITELIST_ROWS`` rows is not broadcast, but crossed by partitions."""
    names = items.select(F.col("item").alias("class_name"))
    few = names.limit(WHITELIST_ROWS + 1).count() <= WHITELIST_ROWS
    return commits.select(*COMMIT).crossJoin(F.broadcast(names) if few else names)


def canonical_path(root: str, source: Column, commit: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(root), source, commit, F.concat(class_file(name), F.lit(".mo")))


Canonicalizer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
TEXTS = "source_name string, commit_hash string, class_name string, text string, error_message string"


def canonicalize(candidates: DataFrame, plug_in: Canonicalizer) -> DataFrame:
    """Texts of candidate classes from a compiler outside, batch by batch."""
    return candidates.select(*CLASS).mapInPandas(plug_in, TEXTS)


def load_plan(commits: DataFrame, sources: DataFrame, files: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(source_name, commit_hash, place, package, path): what is loaded for each commit, in order.

    sources: (name, package_file) with load targets as text; files: (source_name,
    commit_hash, path) of the commit's own tree, shared: (path) of what all may
    use. Of a target's paths the first that is there is taken, in the commit's
    tree before the shared one. A target that has none is passed over, but the
    last one: its row stays, without a path (``load_problems``).

    Targets are sent to every task if they are few (``TARGET_ROWS``): no row is
    dealt out by its source or by a path, of which there may be few. What is dealt
    out is a number for each hit, the place of its path among the target's.
    """
    targets = sources.select(F.col("name").alias("source_name"), load_targets(F.col("package_file")).alias("targets")).distinct()
    each = targets.select("source_name", F.size("targets").alias("n"), F.xxhash64("targets").alias("listed"), F.posexplode("targets").alias("place", "target"))
    each = each.select("source_name", "listed", "place", "n", "target.package", "target.paths")
    ranked = each.select("source_name", "listed", "place", F.posexplode("paths").alias("rank", "path"))
    few = ranked.limit(TARGET_ROWS + 1).count() <= TARGET_ROWS and each.limit(TARGET_ROWS + 1).count() <= TARGET_ROWS
    sent = F.broadcast if few else lambda df: df
    key = [*COMMIT, "listed", "place"]
    common = F.lit(None).cast("int")
    if shared is not None:
        there = ranked.join(shared.select("path").distinct(), "path", "left_semi").groupBy("source_name", "listed", "place").agg((2 * F.min("rank") + 1).alias("common"))
        each, common = each.join(there, ["source_name", "listed", "place"], "left"), F.col("common")
    asked = commits.select(*COMMIT).join(sent(each.select("source_name", "listed", "place", common.alias("hit"))), "source_name").select(*key, F.when(F.col("commit_hash").isNotNull(), F.col("hit")).alias("hit"), F.lit(True).alias("asked"))
    own = files.select(*COMMIT, "path").dropna().join(sent(ranked), ["source_name", "path"]).select(*key, (2 * F.col("rank")).alias("hit"), F.lit(False).alias("asked"))
    best = asked.unionByName(own).groupBy(*key).agg(F.min("hit").alias("hit"), F.max("asked").alias("asked")).filter("asked")
    named = best.join(sent(each.select("source_name", "listed", "place", "n", "package", "paths")), ["source_name", "listed", "place"])
    return named.filter("hit is not null or place = n - 1").select(*COMMIT, "place", "package", F.get("paths", F.floor(F.col("hit") / 2).cast("int")).alias("path"))


def load_problems(plan: DataFrame) -> DataFrame:
    """Commits whose last load target is not there, as ``commit_failures`` takes them."""
    missing = plan.filter("path is null")
    return missing.select(*COMMIT, F.lit(FAILURE_TYPES[1]).alias("failure_type"), F.concat(F.lit("no file for "), "package").alias("compiler_message"))


def outcomes(candidates: DataFrame, texts: DataFrame, root: str, items: DataFrame | None = None, allow_prefix: bool = True) -> DataFrame:
    """Outcome of every candidate class: path if its text is complete, else the error.

    Without ``items`` whitelisting is off: all rows match, mode ``disabled``.
    A class without text or message failed without output.
    """
    if items is None:
        judged = candidates.select(*CLASS, F.lit(True).alias("matched"), F.lit("disabled").alias("mode"), F.lit("").alias("matched_item"))
    else:
        judged = match_whitelist(candidates.select(*CLASS), items, allow_prefix)
    joined = judged.join(texts.select(*CLASS, "text", "error_message"), CLASS, "left")
    problem = F.coalesce(F.nullif(strip(F.coalesce("error_message", F.lit(""))), F.lit("")), F.when(F.col("text").isNull(), "saveTotalModel produced no output file"), F.nullif(output_problem(F.col("text")), F.lit("")))
    told = joined.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return told.select(
        *CLASS,
        F.lit(1).alias("is_experiment"),
        F.when(good, canonical_path(root, *[F.col(c) for c in CLASS])).otherwise("").alias("canonical_model_path"),
        F.coalesce("problem", F.lit("")).alias("error_message"),
        F.col("matched").cast("int").alias("is_inside_sublibraries_list"),
        F.col("mode").alias("pilot_match_mode"),
        F.col("matched_item").alias("matched_sublibrary"),
        good.cast("int").alias("canonical_produced"),
    )


def commit_failures(problems: DataFrame, at: Column) -> DataFrame:
    """Failure log of commits that could not be processed: problems are (source_name,
    commit_hash, failure_type, compiler_message). All are kept, whatever their type:
    a type that isn't known is logged as ``UNKNOWN_FAILURE`` with its name in the message."""
    known = F.col("failure_type").isin(FAILURE_TYPES)
    message = strip(F.coalesce("compiler_message", F.lit("")))
    told = F.concat(F.coalesce("failure_type", F.lit("")), F.lit(": "), message)
    return problems.select(*COMMIT, F.lit("").alias("class_name"), F.when(known, F.col("failure_type")).otherwise(UNKNOWN_FAILURE).alias("failure_type"), F.when(known, message).otherwise(told).alias("compiler_message"), at.alias("created_at_utc"))


def failure_rows(outcome_rows: DataFrame, at: Column) -> DataFrame:
    """Failure log of outcomes without a text."""
    return outcome_rows.filter("canonical_produced = 0").select(*CLASS, F.lit(FAILURE_TYPES[4]).alias("failure_type"), F.col("error_message").alias("compiler_message"), at.alias("created_at_utc"))


def reconcile(outcome_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Outcomes against the files there are, (path, text): every row of either side.

    ``state`` is missing (produced, but no whole file), present (not produced,
    but there), orphan (a file that no outcome names) or same; ``corrupt`` marks
    files that are not complete, which count as absent.
    """
    there = files.select("path", output_problem(F.col("text")).alias("problem"))
    named = F.when(strip(F.col("canonical_model_path")) != "", strip(F.col("canonical_model_path")))
    joined = outcome_rows.withColumn("path", named).join(there, "path", "full_outer")
    whole = F.col("problem").isNotNull() & (F.col("problem") == "")
    state = (
        F.when(F.col("source_name").isNull(), "orphan")
        .when((F.col("canonical_produced") == 1) & ~whole, "missing")
        .when((F.col("canonical_produced") == 0) & whole, "present")
        .otherwise("same")
    )
    return joined.withColumns({"state": state, "corrupt": F.col("source_name").isNotNull() & F.coalesce(F.col("problem") != "", F.lit(False))})


def reconciled(outcome_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Outcomes mended by what ``reconcile`` finds."""
    rows = reconcile(outcome_rows, files).filter("state <> 'orphan'")
    mended = {
        "canonical_produced": F.when(F.col("state") == "missing", 0).when(F.col("state") == "present", 1).otherwise(F.col("canonical_produced")),
        "canonical_model_path": F.when(F.col("state") == "missing", "").otherwise(F.col("canonical_model_path")),
        "error_message": F.when(F.col("state") == "present", "").otherwise(F.col("error_message")),
    }
    return rows.withColumns(mended).select(outcome_rows.columns)
