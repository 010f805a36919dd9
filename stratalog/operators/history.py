"""Read-only queries: sources, commits, timelines, runs of equal content, linked issues."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty, references
from ..schemas import GITHUB_COMMIT, GITHUB_ISSUE, GITHUB_PULLS
from ..scratch import written
from .upsert import BLOCK, in_blocks

COMMIT = ["source_name", "commit_hash"]
VERSION = ["source_name", "commit_hash", "class_name", "is_experiment", "canonical_model_path"]


def canonical_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _same(keys: list[str], a: str, b: str) -> Column:
    """Rows of two frames with equal keys; nulls are equal to each other."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, blocks: int | None = None) -> DataFrame:
    """Runs of equal consecutive values within a key, numbered from 1.

    Columns: the keys, version_index, the value, first and last order columns
    (as structs), n. Nulls are equal to each other.

    Rows are dealt into blocks by key and order, so a key with many rows has
    many blocks, and no task holds a key. Runs are found within blocks; then a
    row for each key and block, with its first and its last value, tells whether
    the run at its start goes on from the block before.
    """
    place = F.struct(*order)
    held = in_blocks(rows.select(*keys, *[c for c in order if c not in keys], *[c for c in [value] if c not in [*keys, *order]]), [*keys, *order], blocks)
    within = Window.partitionBy(BLOCK, *keys).orderBy(*order)
    changed = F.when(F.row_number().over(within) == 1, 0).otherwise((~F.lag(value).over(within).eqNullSafe(F.col(value))).cast("int"))
    marked = held.withColumn("changed__", changed)
    own = marked.withColumn("run__", F.sum("changed__").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # The value has a name of its own, as it may be a key or an order column too.
    pieces = written(own.groupBy(BLOCK, *keys, "run__").agg(F.first(value).alias("value__"), F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")), "pieces")
    ends = pieces.groupBy(BLOCK, *keys).agg(F.min_by("value__", "run__").alias("head__"), F.max_by("value__", "run__").alias("tail__"), F.max("run__").alias("more__"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    opened = F.when(F.row_number().over(across) == 1, 1).otherwise((~F.lag("tail__").over(across).eqNullSafe(F.col("head__"))).cast("int"))
    counted = ends.withColumn("opened__", opened)
    before = F.coalesce(F.sum(F.col("opened__") + F.col("more__")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(BLOCK, *keys, (before + F.col("opened__")).alias("start__"))
    joined = pieces.alias("p").join(starts.alias("s"), _same([BLOCK, *keys], "p", "s")).select("p.*", (F.col("s.start__") + F.col("p.run__")).alias("version_index"))
    merged = joined.groupBy(*keys, "version_index").agg(F.first("value__").alias("value__"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return merged.withColumnRenamed("value__", value) if value not in keys else merged.drop("value__")


def neighbours(versions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Versions with the value before and behind them.

    Each version is sent to its own number and to the ones beside it, and those
    of a number meet; a key's versions don't.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), (F.col("version_index") + d).alias("at")) for role, d in (("own", 0), ("previous", 1), ("next", -1))]))
    sent = versions.select(*keys, roles.alias("to"), F.struct(*versions.columns).alias("row"))
    met = sent.groupBy(*keys, "to.at").agg(*[F.max_by("row", F.when(F.col("to.role") == role, 1)).alias(role) for role in ("own", "previous", "next")])
    return met.filter("own is not null").select("own.*", F.col(f"previous.{value}").alias("previous"), F.col(f"next.{value}").alias("next"))


@dataclass
class History:
    """Queries over stored tables. Methods return DataFrames; ``texts`` has
    (source_name, commit_hash, class_name, text), ``github`` the repository of
    each source, ``payloads`` records fetched from there: (repository, kind,
    key, payload), kind being commit, pulls (both by commit) or issue (by number)."""

    commits: DataFrame
    listing: DataFrame
    outcomes: DataFrame
    failures: DataFrame
    texts: DataFrame | None = None
    github: dict[str, str] | None = None
    payloads: DataFrame | None = None

    def __enter__(self) -> History:
        return self

    def __exit__(self, *error: object) -> None:
        return None

    def list_sources(self) -> DataFrame:
        return self.commits.select("source_name").distinct().orderBy("source_name")

    def list_commits(self, source: str, include_excluded: bool = False) -> DataFrame:
        rows = self.commits.filter(F.col("source_name") == source)
        return (rows if include_excluded else rows.filter("excluded = 0")).orderBy("seq").select("commit_hash")

    def get_commit(self, source: str, commit: str) -> DataFrame:
        return self.commits.filter((F.col("source_name") == source) & (F.col("commit_hash") == commit)).drop("seq")

    def list_experiment_classes(self, source: str) -> DataFrame:
        rows = self.outcomes.filter((F.col("source_name") == source) & (F.col("canonical_produced") == 1))
        return rows.select("class_name").distinct().orderBy("class_name")

    def get_enumerated_classes(self, source: str, commit: str) -> DataFrame:
        rows = self.listing.filter((F.col("source_name") == source) & (F.col("commit_hash") == commit))
        return rows.select("class_name", "is_experiment").orderBy("class_name")

    def _versions(self, source: str) -> DataFrame:
        rows = self.outcomes.filter((F.col("source_name") == source) & (F.col("canonical_produced") == 1))
        return rows.withColumn("canonical_model_path", blank_to_empty(F.col("canonical_model_path"))).select(VERSION)

    def get_class_timeline(self, source: str, name: str) -> DataFrame:
        """Produced versions of a class in commit order."""
        order = self.commits.filter(F.col("source_name") == source).select(*COMMIT, "seq")
        return self._versions(source).filter(F.col("class_name") == name).join(order, COMMIT).orderBy("seq").select(*VERSION, "seq")

    def get_models_for_commit(self, source: str, commit: str) -> DataFrame:
        return self._versions(source).filter(F.col("commit_hash") == commit).orderBy("class_name")

    def list_canonicalization_failures(self, source: str, class_name: str | None = None) -> DataFrame:
        rows = self.failures.filter(F.col("source_name") == source)
        rows = rows if class_name is None else rows.filter(F.col("class_name") == class_name)
        return rows.orderBy("id").select(*COMMIT, "class_name", "failure_type", "compiler_message", "created_at_utc")

    def read_canonical_model(self, source: str, commit: str, name: str, *fallbacks: DataFrame) -> DataFrame:
        """The text from the first place that has it: own texts, then fallbacks of the same shape."""
        places = [t for t in (self.texts, *fallbacks) if t is not None]
        rows = [t.filter((F.col("source_name") == source) & (F.col("commit_hash") == commit) & (F.col("class_name") == name)).select(F.lit(k).alias("place"), "text") for k, t in enumerate(places)]
        found = rows[0]
        for more in rows[1:]:
            found = found.unionByName(more)
        return found.filter("text is not null").orderBy("place").limit(1).select("text")

    def summary(self, source: str) -> DataFrame:
        """Counts of one source; failures are those of the log. Snapshots are distinct texts."""
        own = F.col("source_name") == source
        commits = self.commits.filter(own & (F.col("excluded") == 0)).agg(F.count("*").alias("commits"))
        made = self.outcomes.filter(own & (F.col("canonical_produced") == 1)).agg(F.count_distinct("class_name").alias("classes"), F.count("*").alias("canonical_models"))
        logged = self.failures.filter(own).agg(F.count("*").alias("canonicalization_failures"))
        row = commits.crossJoin(made).crossJoin(logged)  # one row each
        if self.texts is None:
            return row
        return row.crossJoin(self.texts.filter(own).agg(F.count_distinct(canonical_hash(F.col("text"))).alias("unique_snapshots")))

    def hashed_versions(self, source: str) -> DataFrame:
        """Versions with the hash, size and lines of their texts, and commit order."""
        order = self.commits.filter(F.col("source_name") == source).select(*COMMIT, "seq")
        texts = self.texts.filter(F.col("source_name") == source).select(
            *COMMIT, "class_name", canonical_hash(F.col("text")).alias("canonical_hash"), F.octet_length("text").alias("byte_count"), (F.size(F.split("text", "\n", -1)) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).alias("line_count")
        )
        return self._versions(source).join(texts, [*COMMIT, "class_name"]).join(order, COMMIT)

    def get_semantic_versions(self, source: str, name: str | None = None) -> DataFrame:
        """Runs of commits with the same text, by class."""
        rows = self.hashed_versions(source)
        rows = rows if name is None else rows.filter(F.col("class_name") == name)
        found = runs(rows, ["class_name"], ["seq", "commit_hash", "canonical_model_path"], "canonical_hash")
        return found.select("class_name", "version_index", F.col("first.commit_hash").alias("first_commit"), F.col("first.seq").alias("first_seq"), F.col("last.seq").alias("last_seq"), "canonical_hash", F.col("n").alias("commit_count"), F.col("first.canonical_model_path").alias("canonical_model_path"))

    def get_neighbour_versions(self, source: str, name: str, commit: str) -> DataFrame:
        """The version of a class at a commit, with the ones before and after it."""
        seq = self.commits.filter((F.col("source_name") == source) & (F.col("commit_hash") == commit)).select(F.col("seq").alias("at"))
        versions = neighbours(self.get_semantic_versions(source, name), ["class_name"], "canonical_hash")
        return versions.join(F.broadcast(seq), (F.col("at") >= F.col("first_seq")) & (F.col("at") <= F.col("last_seq"))).drop("at")

    def get_commits_for_canonical(self, source: str, digest: str) -> DataFrame:
        return self.hashed_versions(source).filter(F.col("canonical_hash") == digest).orderBy("seq").select("commit_hash", "class_name")

    def get_commits_touching_class(self, source: str, name: str) -> DataFrame:
        return self.get_class_timeline(source, name).select("commit_hash")

    def get_semantic_change_commits(self, source: str, name: str) -> DataFrame:
        return self.get_semantic_versions(source, name).orderBy("version_index").select(F.col("first_commit").alias("commit_hash"))

    def get_check_model_result(self, source: str, digest: str, checks: DataFrame) -> DataFrame:
        """Validation results (by canonical_hash, from outside) with line and byte counts."""
        sizes = self.hashed_versions(source).filter(F.col("canonical_hash") == digest).select("canonical_hash", "line_count", "byte_count").distinct()
        return sizes.join(checks.drop("line_count", "byte_count"), "canonical_hash", "left")

    def github_repository(self, source: str) -> str:
        found = (self.github or {}).get(source)
        if not found:
            raise ValueError(f"no repository is known for {source}")
        return found

    def _payload(self, source: str, kind: str, key: str | None = None) -> DataFrame:
        if self.payloads is None:
            raise ValueError("no fetched records were given")
        own = (F.col("repository") == self.github_repository(source)) & (F.col("kind") == kind)
        return self.payloads.filter(own if key is None else own & (F.col("key") == key))

    def get_github_commit(self, source: str, commit: str) -> DataFrame:
        return self._payload(source, "commit", commit).select(github_commit(F.col("payload")).alias("c")).select("c.*")

    def get_github_pull_requests(self, source: str, commit: str) -> DataFrame:
        return self._payload(source, "pulls", commit).select(F.explode(github_pulls(F.col("payload"))).alias("p")).select("p.*")

    def get_github_issue(self, source: str, number: int) -> DataFrame:
        return self._payload(source, "issue", str(number)).select(github_issue(F.col("payload")).alias("i")).select("i.*")

    def get_github_linked_issues(self, source: str, commit: str) -> DataFrame:
        """Issues among the fetched records that a commit's message refers to."""
        issues = self._payload(source, "issue").select(github_issue(F.col("payload")).alias("i")).select("i.*")
        return self.get_linked_issues(source, commit, issues)

    def get_linked_issues(self, source: str, commit: str, issues: DataFrame) -> DataFrame:
        """Issues that a commit's message refers to; unknown numbers are passed over."""
        numbers = self.get_commit(source, commit).select(F.explode(references(F.col("commit_message"))).alias("number"))
        return numbers.join(issues, "number").orderBy("number")

    def semantic_change_context(self, source: str, name: str, commits: DataFrame, pulls: DataFrame, issues: DataFrame) -> DataFrame:
        """One nested record for each change of a class: version, neighbours, commit, pull requests, issues.

        commits: (commit_hash, info), pulls: (commit_hash, pulls), issues: (number, ...).
        """
        versions = neighbours(self.get_semantic_versions(source, name), ["class_name"], "canonical_hash").withColumnRenamed("first_commit", "commit_hash")
        own = self.commits.filter(F.col("source_name") == source).select("commit_hash", F.explode_outer(references(F.col("commit_message"))).alias("number"))
        linked = own.join(issues, "number", "left").groupBy("commit_hash").agg(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("number", "title", "state")))).alias("issues"))
        joined = versions.join(commits, "commit_hash", "left").join(pulls, "commit_hash", "left").join(linked, "commit_hash", "left")
        return joined.select("class_name", "version_index", "commit_hash", F.struct("canonical_hash", "commit_count", "previous", "next").alias("version"), F.col("info").alias("commit"), "pulls", "issues", F.size("issues").alias("n_issues"))


def github_commit(payload: Column) -> Column:
    """Commit record of a JSON payload; what is absent is empty or 0."""
    p = F.from_json(payload, GITHUB_COMMIT)
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    files = F.coalesce(F.transform(p["files"], lambda f: f["filename"]), F.array().cast("array<string>"))
    return F.struct(
        text(p["sha"]).alias("sha"), text(p["html_url"]).alias("url"), text(p["author"]["login"]).alias("author_login"), text(p["committer"]["login"]).alias("committer_login"),
        text(p["commit"]["author"]["name"]).alias("author_name"), text(p["commit"]["author"]["email"]).alias("author_email"), text(p["commit"]["author"]["date"]).alias("authored_at"),
        text(p["commit"]["committer"]["name"]).alias("committer_name"), text(p["commit"]["committer"]["date"]).alias("committed_at"), text(p["commit"]["message"]).alias("message"),
        number(p["stats"]["additions"]).alias("additions"), number(p["stats"]["deletions"]).alias("deletions"), F.size(files).alias("files_changed"), files.alias("files"),
    )


def github_pulls(payload: Column) -> Column:
    """Pull requests of a JSON payload; none if it isn't a list."""
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, GITHUB_PULLS))
    return F.transform(
        F.coalesce(listed, F.array().cast(GITHUB_PULLS)),
        lambda p: F.struct(p["number"].alias("number"), p["title"].alias("title"), p["html_url"].alias("url"), p["state"].alias("state"), (F.coalesce(p["merged_at"], F.lit("")) != "").alias("merged"), F.coalesce(F.transform(p["labels"], lambda x: x["name"]), F.array().cast("array<string>")).alias("labels")),
    )


def github_issue(payload: Column) -> Column:
    p = F.from_json(payload, GITHUB_ISSUE)
    return F.struct(p["number"].alias("number"), F.coalesce(p["title"], F.lit("")).alias("title"), F.coalesce(p["html_url"], F.lit("")).alias("url"), F.coalesce(p["state"], F.lit("")).alias("state"), F.coalesce(F.transform(p["labels"], lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"))
