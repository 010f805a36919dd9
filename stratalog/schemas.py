"""Schemas of inputs and results; readers never infer them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Schemas(Mapping):
    """Schemas by name, parsed when they are asked for."""

    def __init__(self, ddl: dict[str, str]):
        self.ddl = ddl

    def __getitem__(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(self.ddl[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.ddl)

    def __len__(self) -> int:
        return len(self.ddl)


#: What stands in for the walk over a repository and for the compiler.
INPUTS = Schemas({
    "commits_raw": "source_name string, commit_hash string, seq bigint, author_name string, author_email string, authored_ts timestamp, committed_ts timestamp, message string",
    "commit_branches": "source_name string, commit_hash string, branch string",
    "commit_diffs": "source_name string, commit_hash string, a_path string, b_path string",
    "tags": "source_name string, tag string, commit_hash string, authored_ts timestamp",
    "class_listing": "source_name string, commit_hash string, class_name string, is_experiment int",
    "canonical_texts": "source_name string, commit_hash string, class_name string, text string, error_message string",
    "annotations": "source_name string, commit_hash string, package string, annotation string",
    "github_payloads": "repository string, kind string, key string, payload string",
})

#: Stored tables. Commits and failures carry ``seq``: the order in which they came.
TABLES = Schemas({
    "sources": "name string, repo_path string, package_file string, enabled int, excluded_branches string, default_branch string, commit_cutoff_tag string",
    "settings": "step int, key string, value string",
    "whitelist": "class_name string, enabled int",
    "run_logs": "id bigint, source_name string, step_name string, generated_at_utc timestamp, duration_s double, run_settings_json string",
    "metrics": "run_id bigint, name string, step int, value string, seq bigint",
    "commits": "source_name string, commit_hash string, seq bigint, author_email string, branches string, commit_message string, excluded int, exclusion_reason string",
    "files": "source_name string, commit_hash string, mo_file_path string, is_baseline int",
    "listing": INPUTS.ddl["class_listing"],
    "listing_progress": "source_name string, commit_hash string, status string, enumerated_classes_count bigint, last_updated_utc timestamp",
    "outcomes": "source_name string, commit_hash string, class_name string, is_experiment int, canonical_model_path string, error_message string, is_inside_sublibraries_list int, pilot_match_mode string, matched_sublibrary string, canonical_produced int",
    "failures": "id bigint, source_name string, commit_hash string, class_name string, failure_type string, compiler_message string, created_at_utc timestamp",
    "outcome_progress": "source_name string, commit_hash string, status string, processed_classes_count bigint, saved_models_count bigint, failure_count bigint, last_updated_utc timestamp",
    "distinct_names": "name string, id bigint",
    "distinct_bits": "source_name string, day date, bucket bigint, bits binary",
    "distinct_sketches": "source_name string, day date, sketch binary",
})

#: Keys by which rows are unique; Spark doesn't hold tables to them.
KEYS = {
    "sources": ["name"],
    "settings": ["step", "key"],
    "whitelist": ["class_name"],
    "commits": ["source_name", "commit_hash"],
    "run_logs": ["id"],
    "metrics": ["run_id", "name"],
    "files": ["source_name", "commit_hash", "mo_file_path"],
    "listing": ["source_name", "commit_hash", "class_name"],
    "listing_progress": ["source_name", "commit_hash"],
    "outcomes": ["source_name", "commit_hash", "class_name"],
    "failures": ["id"],
    "outcome_progress": ["source_name", "commit_hash"],
    "distinct_bits": ["source_name", "day", "bucket"],
    "distinct_sketches": ["source_name", "day"],
}

#: Nested payloads.
GITHUB_COMMIT = (
    "sha string, html_url string, author struct<login:string>, committer struct<login:string>, "
    "commit struct<author:struct<name:string,email:string,date:string>,committer:struct<name:string,date:string>,message:string>, "
    "stats struct<total:bigint,additions:bigint,deletions:bigint>, files array<struct<filename:string>>"
)
GITHUB_PULLS = "array<struct<number:bigint,title:string,html_url:string,state:string,merged_at:string,labels:array<struct<name:string>>>>"
GITHUB_ISSUE = "number bigint, title string, html_url string, state string, labels array<struct<name:string>>"

#: What the programming interface's records are called, and their fields.
RECORDS = Schemas({
    "ClassVersion": "commit_hash string, class_name string, canonical_model_path string, is_experiment boolean",
    "CommitInfo": "commit_hash string, author_email string, commit_message string, excluded boolean, exclusion_reason string",
    "CanonicalizationFailure": "commit_hash string, class_name string, failure_type string, compiler_message string, created_at_utc string",
    "GitHubCommitInfo": "sha string, url string, author_login string, author_name string, author_email string, authored_date string, committer_login string, committer_name string, committed_date string, message string, files_changed bigint, additions bigint, deletions bigint, changed_files array<string>",
    "GitHubPullRequest": "number bigint, title string, url string, state string, merged boolean, labels array<string>",
    "GitHubIssue": "number bigint, title string, url string, state string, labels array<string>",
})

#: Names that tables and columns had before.
FORMER_COLUMNS = {"omc_error": "compiler_message"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table that isn't there counts as one without rows."""
    return spark.createDataFrame([], TABLES[name] if name in TABLES else INPUTS[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order: former names, missing columns and types mended."""
    for old, new in FORMER_COLUMNS.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    """Keys that more than one row holds."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).filter("n > 1")
