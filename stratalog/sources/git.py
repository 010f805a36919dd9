"""Commits of a local repository as a data source, read through the git program.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").option("path", repo).option("rows", "commits").load()

fallbacks names further paths, separated by semicolons, for where the first is
no repository. rows is commits (default), branches or diffs. Every remote branch (or local
one, if there is no remote) is a partition of branches; commits and diffs are
dealt out by ranges of hashes.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import INPUTS

TABLES = {"commits": "commits_raw", "branches": "commit_branches", "diffs": "commit_diffs"}
FIELD, RECORD = "\x1f", "\x1e"
CHUNK = 2000


def _git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, check=False)
    if done.returncode:
        raise FileNotFoundError(f"{path} is no repository that can be read: {done.stderr.decode(errors='replace')[:300]}")
    return done.stdout.decode(errors="replace")


def _refs(path: str) -> list[str]:
    for space in ("refs/remotes", "refs/heads"):
        found = [r for r in _git(path, "for-each-ref", "--format=%(refname:short)", space).split("\n") if r and not r.endswith("/HEAD") and r != "origin"]
        if found:
            return found
    return []


class Part(InputPartition):
    def __init__(self, value: str, first: int):
        self.value, self.first = value, first


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows = options.get("rows", "commits")
        # Of the paths that are given, the first that is a repository.
        given = [options["path"], *filter(None, options.get("fallbacks", "").split(";"))]
        self.path = next((p for p in given if os.path.exists(os.path.join(p, ".git")) or os.path.exists(os.path.join(p, "HEAD"))), given[0])
        self.source = options.get("source", self.path.rstrip("/").rsplit("/", 1)[-1])

    def partitions(self) -> list[Part]:
        refs = _refs(self.path)
        if self.rows == "branches":
            return [Part(r, 0) for r in refs]
        hashes = list(dict.fromkeys(h for r in refs for h in _git(self.path, "rev-list", r).split()))
        return [Part(" ".join(hashes[k : k + CHUNK]), k) for k in range(0, len(hashes), CHUNK)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if self.rows == "branches":
            for commit in _git(self.path, "rev-list", partition.value).split():
                yield self.source, commit, partition.value
        elif self.rows == "commits":
            layout = FIELD.join(["%H", "%an", "%ae", "%at", "%ct", "%B"]) + RECORD
            for k in range(0, len(hashes := partition.value.split()), 200):
                text = _git(self.path, "show", "-s", f"--format={layout}", *hashes[k : k + 200])
                for n, record in enumerate(r.lstrip("\n") for r in text.split(RECORD) if r.strip()):
                    commit, name, email, authored, committed, message = record.split(FIELD, 5)
                    yield self.source, commit, partition.first + k + n, name, email, self._time(authored), self._time(committed), message
        else:
            for commit in partition.value.split():
                for line in _git(self.path, "diff-tree", "--root", "-r", "-M", "-m", "--first-parent", "--no-commit-id", "--name-status", "-z", commit).split("\0\0"):
                    yield from self._sides(commit, [f for f in line.split("\0") if f])

    def _sides(self, commit: str, fields: list[str]) -> Iterator[tuple]:
        at = 0
        while at < len(fields):
            both = fields[at][0] in "RC"
            yield self.source, commit, fields[at + 1], fields[at + 1 + both]
            at += 2 + both

    @staticmethod
    def _time(epoch: str) -> datetime:
        return datetime.fromtimestamp(int(epoch), timezone.utc)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return INPUTS.ddl[TABLES[self.options.get("rows", "commits")]]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))
