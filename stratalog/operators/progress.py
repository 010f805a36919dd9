"""Resumable processing: what is left, states, seeds and totals."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ALL_SCOPE, PILOT_SCOPE
from ..functions.numbers import percent
from ..functions.text import metric_words

COMMIT = ["source_name", "commit_hash"]


def remaining(commits: DataFrame, progress: DataFrame, limit: int = 0) -> DataFrame:
    """Retained commits not complete yet, in order of their hash; the first few in a dry run."""
    todo = commits.filter("excluded = 0").select(*COMMIT)
    todo = todo.orderBy("commit_hash").limit(limit) if limit > 0 else todo
    return todo.join(progress.filter("status = 'complete'").select(*COMMIT), COMMIT, "left_anti")


def listing_progress(commits: DataFrame, listing: DataFrame, at: datetime) -> DataFrame:
    """Complete states of processed commits with their counts; 0 for those without classes."""
    counts = listing.groupBy(*COMMIT).agg(F.count("*").alias("n"))
    joined = commits.select(*COMMIT).join(counts, COMMIT, "left")
    return joined.select(*COMMIT, F.lit("complete").alias("status"), F.coalesce("n", F.lit(0)).alias("enumerated_classes_count"), F.lit(at).alias("last_updated_utc"))


def outcome_counts(outcomes: DataFrame, failures: DataFrame, commits: DataFrame) -> DataFrame:
    """Classes, saved texts and logged failures of each commit; 0 where there are none."""
    classes = outcomes.groupBy(*COMMIT).agg(F.count("*").alias("classes"), F.count_if(F.col("canonical_produced") == 1).alias("saved"))
    logged = failures.groupBy(*COMMIT).agg(F.count("*").alias("failed"))
    joined = commits.select(*COMMIT).join(classes, COMMIT, "left").join(logged, COMMIT, "left")
    return joined.select(*COMMIT, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("classes", "saved", "failed")])


def seed_progress(commits: DataFrame, known: DataFrame, outcomes: DataFrame, failures: DataFrame, at: datetime) -> DataFrame:
    """Complete states for commits that have rows but no state yet."""
    counts = outcome_counts(outcomes, failures, commits).join(known.select(*COMMIT), COMMIT, "left_anti")
    found = counts.filter("classes > 0 or failed > 0")
    return found.select(
        *COMMIT,
        F.lit("complete").alias("status"),
        F.col("classes").alias("processed_classes_count"),
        F.col("saved").alias("saved_models_count"),
        F.col("failed").alias("failure_count"),
        F.lit(at).alias("last_updated_utc"),
    )


def by_status(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count("*").alias("n"))


def scope_metrics(progress: DataFrame, scope: DataFrame) -> DataFrame:
    """Complete commits in scope, and those of them with a saved text."""
    inside = progress.join(scope.select(*COMMIT).distinct(), COMMIT, "left_semi")
    done = F.col("status") == "complete"
    return inside.agg(F.count_if(done).alias("complete_commits"), F.count_if(done & (F.col("saved_models_count") > 0)).alias("with_texts"))


def totals(outcomes: DataFrame, failures: DataFrame, listing: DataFrame, pilot: bool) -> DataFrame:
    """One row of counts over one source; in pilot mode listings come from the outcomes."""
    made = outcomes.agg(
        F.count("*").alias("outcome_rows"),
        F.count_if(F.col("canonical_produced") == 1).alias("flagged"),
        F.count_distinct(F.when(F.col("canonical_produced") == 1, F.col("commit_hash"))).alias("saved_commit_folders"),
        F.count_if(F.col("is_inside_sublibraries_list") == 1).alias("whitelisted_rows"),
    )
    logged = failures.agg(F.count("*").alias("total_failures"), F.count_if(F.col("failure_type") == "canonical_no_output").alias("canonical_failures"))
    if pilot:
        listed = made.select(F.col("outcome_rows").alias("total_rows"), F.col("outcome_rows").alias("experiment_rows"), F.lit(0).cast("long").alias("non_experiment_rows"))
    else:
        listed = listing.agg(F.count("*").alias("total_rows"), F.count_if(F.col("is_experiment") == 1).alias("experiment_rows"), F.count_if(F.col("is_experiment") == 0).alias("non_experiment_rows"))
    row = made.crossJoin(logged).crossJoin(listed)  # one row each
    saved = F.greatest(F.col("flagged"), F.col("outcome_rows") - F.col("canonical_failures"))
    return row.select("total_rows", "experiment_rows", "non_experiment_rows", saved.alias("total_saved"), "saved_commit_folders", "whitelisted_rows", "canonical_failures", "total_failures")


def run_metrics(total_row: DataFrame, scope_row: DataFrame, scope_commits: int, pilot: bool) -> DataFrame:
    """Metrics of a run as (name, value): counts, shares and the scope they refer to."""
    row = total_row.crossJoin(scope_row)
    scope = F.col("whitelisted_rows") if pilot else F.col("experiment_rows")
    values = {
        "ProcessedCommitsCount": F.col("complete_commits"),
        "ProcessedCommitsPercentage": percent(F.col("complete_commits"), F.lit(scope_commits)),
        "ExtractionFailures": F.col("canonical_failures"),
        "ExtractionFailuresCount": F.col("canonical_failures"),
        "ExtractionFailuresPercentage": percent(F.col("canonical_failures"), scope),
        "FinalCanonicalModelVersions": F.col("total_saved"),
        "FinalCanonicalModelVersionsPercentage": percent(F.col("total_saved"), scope),
        "StepOneCommitFoldersWithCanonicals": F.col("with_texts"),
        "StepThreeInputScope": scope,
        "StepThreeScopeLabel": F.lit(PILOT_SCOPE if pilot else ALL_SCOPE),
        "TotalClassVersions": F.col("total_rows"),
        "ExperimentClassVersions": F.col("experiment_rows"),
        "ExperimentClassVersionsPercentage": percent(F.col("experiment_rows"), F.col("total_rows")),
        "NonExperimentClassVersions": F.col("non_experiment_rows"),
        "NonExperimentClassVersionsPercentage": percent(F.col("non_experiment_rows"), F.col("total_rows")),
        "WhitelistedExperimentClassVersions": F.col("whitelisted_rows"),
        "WhitelistedExperimentClassVersionsPercentage": percent(F.col("whitelisted_rows"), F.col("experiment_rows")),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in values.items()])
    return row.select(F.explode(entries).alias("m")).select("m.name", "m.value")


def latest_metrics(metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Newest value of each metric by run time, then order of writing."""
    runs = logs.select(F.col("id").alias("run_id"), "generated_at_utc", "source_name")
    joined = metrics.join(runs, "run_id")
    return joined.groupBy("name").agg(F.max_by("value", F.struct("generated_at_utc", "seq")).alias("value"))


def settings_json(settings: DataFrame, step: int) -> DataFrame:
    """Settings of a step as JSON with sorted keys."""
    pairs = F.array_sort(F.collect_list(F.struct("key", F.coalesce("value", F.lit("")).alias("value"))))
    return settings.filter(F.col("step") == step).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def setting(settings: DataFrame, step: int, key: str, default: str = "") -> str:
    row = settings.filter((F.col("step") == step) & (F.col("key") == key)).select("value").first()
    return row[0] if row else default


def run_log(run_id: int, source: str, step: str, at: datetime, settings: str, sources: DataFrame) -> DataFrame:
    """Log row of a run that begins; its duration comes later."""
    row = sources.sparkSession.range(1).select(F.lit(run_id).cast("long").alias("id"))
    return row.select("id", F.lit(source).alias("source_name"), F.lit(step).alias("step_name"), F.lit(at).alias("generated_at_utc"), F.lit(None).cast("double").alias("duration_s"), F.lit(settings).alias("run_settings_json"))


def finished_run(logs: DataFrame, run_id: int, seconds: float) -> DataFrame:
    """The log row of a run with its duration, to be upserted."""
    return logs.filter(F.col("id") == run_id).withColumn("duration_s", F.lit(float(seconds)))


def metric_rows(values: DataFrame, run_id: int, step: int) -> DataFrame:
    """(name, value) as metric rows of a run, to be upserted by run and name."""
    return values.select(F.lit(run_id).cast("long").alias("run_id"), "name", F.lit(step).alias("step"), "value", F.xxhash64("name").alias("seq"))


def metric_names(values: DataFrame) -> DataFrame:
    """(name, words) of the macros that TeX files define, as seeds of metric names."""
    return values.select("name", metric_words(F.col("name")).alias("words")).distinct()


def source_record(sources: DataFrame, name: str) -> dict | None:
    """One enabled source by name; None if it isn't there, isn't enabled, or the table can't be read."""
    try:
        row = sources.filter((F.col("name") == name) & (F.col("enabled") == 1)).first()
    except AnalysisException:
        return None
    return None if row is None else row.asDict()


def moved_paths(sources: DataFrame, root: str) -> DataFrame:
    """Sources whose repository path is absolute and lies outside ``root``, with
    the path by which they are named there, to be upserted."""
    inside = F.concat(F.lit(root.rstrip("/") + "/"), F.element_at(F.split(F.rtrim(F.col("repo_path"), F.lit("/")), "/"), -1))
    stale = F.col("repo_path").startswith("/") & ~F.col("repo_path").startswith(root.rstrip("/") + "/")
    return sources.filter(stale).withColumn("repo_path", inside)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled = 1").orderBy("name")
