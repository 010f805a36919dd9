"""Commit funnel: branches, ordered exclusion, touched files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import BOT_MESSAGES, DOC_EXTENSIONS, DOC_ONLY, EXCLUDED_BRANCH, HUMAN_OVERRIDE, NO_FILES
from ..functions.text import blank_to_empty, branch_name, contains_any, first_line, strip, suffix
from .upsert import numbered

COMMIT = ["source_name", "commit_hash"]


def commit_refs(branches: DataFrame, excluded: list[str]) -> DataFrame:
    """One row a commit: its branches, sorted and joined, and whether all are excluded.

    A commit on any other branch names only those; names are compared without case.
    """
    name = branch_name(F.col("branch"))
    out = F.lower(name).isin([b.lower() for b in excluded]) if excluded else F.lit(False)
    named = branches.select(*COMMIT, name.alias("name"), out.alias("out")).distinct()
    seen = named.groupBy(*COMMIT).agg(F.bool_and("out").alias("only_excluded"), F.collect_set("name").alias("all"), F.collect_set(F.when(~F.col("out"), F.col("name"))).alias("kept"))
    shown = F.when(F.col("only_excluded"), F.col("all")).otherwise(F.col("kept"))
    return seen.select(*COMMIT, F.array_join(F.array_sort(shown), "; ").alias("branches"), "only_excluded")


def touched_paths(diffs: DataFrame) -> DataFrame:
    """All paths of a commit's diff, both sides, once each."""
    sides = diffs.select(*COMMIT, F.explode(F.array("b_path", "a_path")).alias("path"))
    return sides.filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct()


def touched_files(diffs: DataFrame) -> DataFrame:
    """Touched model files; the suffix is compared with case."""
    return touched_paths(diffs).filter(F.col("path").endswith(".mo")).withColumnRenamed("path", "mo_file_path")


def changed_extensions(diffs: DataFrame) -> DataFrame:
    return touched_paths(diffs).groupBy(*COMMIT).agg(F.collect_set(suffix(F.col("path"))).alias("extensions"))


def message_reason(message: Column) -> Column:
    """Why a message looks like a bot's: the first pattern on its first line; null if a human's."""
    return line_reason(first_line(message))


def line_reason(line: Column) -> Column:
    """The same from the first line itself."""
    human = F.lit(False)
    for pattern in HUMAN_OVERRIDE:
        human = human | line.rlike(f"(?iuU){pattern}")
    hits = [F.when(line.rlike(f"(?iuU){p}"), F.lit(f"commit message matches '{p}'")) for p in BOT_MESSAGES]
    return F.when(~human & (line != ""), F.coalesce(*hits))


def bot_reason(name: Column, email: Column, line: Column, extensions: Column, names: list[str], emails: list[str]) -> Column:
    """Why a commit is a bot's, by name, e-mail, then the message's first line; null if it isn't.

    A message about documentation only is a human's if other kinds of files changed.
    """
    by_name = contains_any(blank_to_empty(name), names)
    by_email = contains_any(blank_to_empty(email), emails)
    doc_only = F.lit(False)
    for pattern in DOC_ONLY:
        doc_only = doc_only | line.rlike(f"(?iuU){pattern}")
    others = F.size(F.array_except(F.coalesce(extensions, F.array().cast("array<string>")), F.array(*map(F.lit, DOC_EXTENSIONS)))) > 0
    return F.coalesce(
        F.when(by_name.isNotNull(), F.concat(F.lit("author name contains '"), by_name, F.lit("'"))),
        F.when(by_email.isNotNull(), F.concat(F.lit("author email contains '"), by_email, F.lit("'"))),
        F.when(~(doc_only & others), line_reason(line)),
    )


def before_tag(authored: Column, tag: str | None, cutoff: Column | datetime | None) -> Column:
    """Reason of a commit authored before the cutoff; null at or after it, or without one."""
    if cutoff is None:
        return F.lit(None).cast("string")
    at = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return F.when(authored < at, F.concat(F.lit(f"before tag {tag} (tag date: "), F.date_format(at, "yyyy-MM-dd"), F.lit(")")))


def too_old(authored: Column, limit_years: float | None, now: datetime | None) -> Column:
    """Reason of a commit older than the limit in years of 365.25 days; null without a limit."""
    if limit_years is None:
        return F.lit(None).cast("string")
    days = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(authored)) / 86400)
    age = days / F.lit(365.25)
    return F.when(age > limit_years, F.concat(F.lit("commit date: "), F.date_format(authored, "yyyy-MM-dd"), F.lit(", age: "), F.format_string("%.1f", age), F.lit(" years")))


def tag_cutoff(tags: DataFrame, source: str, tag: str | None) -> datetime | None:
    """Authored time of a source's tag; a tag that isn't there is an error."""
    if tag is None:
        return None
    row = tags.filter((F.col("source_name") == source) & (F.col("tag") == tag)).select("authored_ts").first()
    if row is None:
        raise LookupError(f"tag {tag} of {source} is not there")
    return row[0]


def tag_cutoffs(commits: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """(source_name, cutoff) of every source; one without the tag is an error."""
    named = tags.filter(F.col("tag") == tag).groupBy("source_name").agg(F.min("authored_ts").alias("cutoff"))
    found = commits.select("source_name").distinct().join(named, "source_name", "left")
    lacking = found.filter("cutoff is null").select("source_name").first()
    if lacking is not None:
        raise LookupError(f"tag {tag} of {lacking[0]} is not there")
    return found


def funnel(
    commits: DataFrame,
    branches: DataFrame,
    diffs: DataFrame,
    excluded_branches: list[str] | None = None,
    tag: str | None = None,
    cutoff: datetime | DataFrame | None = None,
    limit_years: float | None = None,
    now: datetime | None = None,
    bot_names: list[str] | None = None,
    bot_emails: list[str] | None = None,
) -> DataFrame:
    """Every commit with the first reason for which it is left out, or none.

    Order: excluded branch, before the tag, too old, bot, no model files. Order
    of commits stays in ``seq``. All joins are on the commit's key. ``cutoff`` is
    one time, or one of each source (``tag_cutoffs``). An age limit needs ``now``.
    """
    if limit_years is not None and now is None:
        raise ValueError("an age limit needs the time that ages are counted from")
    refs = commit_refs(branches, excluded_branches or [])
    extensions = changed_extensions(diffs)
    touching = touched_files(diffs).select(*COMMIT).distinct().withColumn("touching", F.lit(True))
    joined = commits.join(refs, COMMIT).join(extensions, COMMIT, "left").join(touching, COMMIT, "left")
    if isinstance(cutoff, DataFrame):
        joined, cutoff = joined.join(F.broadcast(cutoff.select("source_name", "cutoff")), "source_name", "left"), F.col("cutoff")  # one row a source
    joined = joined.withColumn("line", first_line(F.col("message")))
    reason = F.coalesce(
        F.when(F.col("only_excluded"), EXCLUDED_BRANCH),
        before_tag(F.col("authored_ts"), tag, cutoff),
        too_old(F.col("authored_ts"), limit_years, now),
        bot_reason(F.col("author_name"), F.col("author_email"), F.col("line"), F.col("extensions"), bot_names or [], bot_emails or []),
        F.when(F.col("touching").isNull(), NO_FILES),
        F.lit(""),
    )
    told = joined.withColumn("exclusion_reason", reason)
    return told.select(
        *COMMIT,
        "seq",
        blank_to_empty(F.col("author_email")).alias("author_email"),
        "branches",
        strip(blank_to_empty(F.col("message"))).alias("commit_message"),
        (F.col("exclusion_reason") != "").cast("int").alias("excluded"),
        "exclusion_reason",
    )


def in_recorded_order(rows: DataFrame) -> DataFrame:
    """Funnel rows with ``seq`` as they are recorded: within a source, commits of excluded
    branches only before all others, and each of both in the order in which they came."""
    placed = rows.withColumn("later__", F.col("exclusion_reason") != EXCLUDED_BRANCH).withColumnRenamed("seq", "came__")
    return numbered(placed, ["source_name", "later__", "came__", "commit_hash"]).drop("later__", "came__").select(rows.columns)


def retained_files(funnel_rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """Touched model files of retained commits."""
    kept = funnel_rows.filter("excluded = 0").select(*COMMIT)
    return touched_files(diffs).join(kept, COMMIT, "left_semi").select(*COMMIT, "mo_file_path", F.lit(0).alias("is_baseline"))
