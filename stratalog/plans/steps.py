"""The three steps over a store: funnel, listing, canonical texts; then metrics and reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_point
from ..operators import funnel, listing, progress, report
from ..operators.upsert import Store, Transaction
from ..schemas import KEYS
from ..sources.readers import scalar

COMMIT = ["source_name", "commit_hash"]


@dataclass
class Run:
    """Settings of a run; ``now`` is given, so that a rerun gives the same rows."""

    store: Store
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    excluded_branches: list[str] = field(default_factory=list)
    tag: str | None = None
    limit_years: float | None = None
    root: str = "canonical_models"
    pilot: bool = False
    allow_prefix: bool = True

    def step_one(self, commits: DataFrame, branches: DataFrame, diffs: DataFrame, tags: DataFrame) -> None:
        """Funnel and touched files of all sources; each source's rows in both tables are replaced together."""
        cutoffs = funnel.tag_cutoffs(commits, tags, self.tag) if self.tag else None
        rows = funnel.funnel(commits, branches, diffs, self.excluded_branches, self.tag, cutoffs, self.limit_years, self.now)
        sources = [r[0] for r in commits.select("source_name").distinct().collect()]  # one row a source

        def replace(change: Transaction) -> None:
            change.replace_sources("commits", rows, sources)
            change.replace_sources("files", funnel.retained_files(change.read("commits"), diffs), sources)

        self.store.transact(replace)

    def _begin(self, todo: DataFrame, table: str) -> None:
        """Mark commits as begun, so that one cut short differs from one never begun."""
        self.store.upsert(table, todo.select(*COMMIT, F.lit("processing").alias("status"), F.lit(self.now).alias("last_updated_utc")), KEYS[table])

    def _log(self, failed: DataFrame) -> None:
        """Append failures with ids that go on from the last one. A run that is made
        again logs nothing twice; what earlier runs logged stays."""
        natural = [*COMMIT, "class_name", "failure_type", "created_at_utc"]
        self.store.transact(lambda t: t.append_new("failures", failed, natural, "id"))

    def step_two(self, listed: DataFrame, problems: DataFrame | None = None) -> None:
        """Listings of commits not complete yet; a rerun finds nothing left to do.

        problems: commits that could not be checked out or loaded, with failure type and message.
        """
        todo = progress.remaining(self.store.read("commits"), self.store.read("listing_progress"))
        self._begin(todo, "listing_progress")
        if problems is not None:
            self._log(listing.commit_failures(problems.join(todo, COMMIT, "left_semi"), F.lit(self.now)))
        rows = listed.join(todo, COMMIT, "left_semi")
        self.store.upsert("listing", rows, KEYS["listing"])
        self.store.upsert("listing_progress", progress.listing_progress(todo, self.store.read("listing"), self.now), KEYS["listing_progress"])

    def step_three(self, texts: DataFrame, problems: DataFrame | None = None) -> None:
        """Outcomes of eligible classes of commits not complete yet.

        Outcomes and failures are upserted before states, so that what was cut
        short is done again and counts once. problems: commits that could not be
        loaded or cleaned, with failure type and message; their classes have no outcome.
        """
        todo = progress.remaining(self.store.read("commits"), self.store.read("outcome_progress"))
        self._begin(todo, "outcome_progress")
        lost = None if problems is None else problems.join(todo, COMMIT, "left_semi")
        items = listing.enabled_whitelist(self.store.read("whitelist")) if self.pilot else None
        if self.pilot:
            candidates = listing.pilot_candidates(todo, items)
        else:
            candidates = self.store.read("listing").filter("is_experiment = 1").join(todo, COMMIT, "left_semi")
        if lost is not None:
            candidates = candidates.join(lost.select(*COMMIT).distinct(), COMMIT, "left_anti")
        made = listing.outcomes(candidates, texts, self.root, items, self.allow_prefix)
        self.store.upsert("outcomes", made, KEYS["outcomes"])
        fresh = self.store.read("outcomes").join(todo, COMMIT, "left_semi")
        failed = listing.failure_rows(fresh, F.lit(self.now))
        if lost is not None:
            failed = failed.unionByName(listing.commit_failures(lost, F.lit(self.now)))
        self._log(failed)
        counts = progress.outcome_counts(fresh, failed, todo)
        states = counts.select(*COMMIT, F.lit("complete").alias("status"), F.col("classes").alias("processed_classes_count"), F.col("saved").alias("saved_models_count"), F.col("failed").alias("failure_count"), F.lit(self.now).alias("last_updated_utc"))
        self.store.upsert("outcome_progress", states, KEYS["outcome_progress"])

    def report(self, source: str) -> dict[str, object]:
        """All metrics of one source by name, with the invariants under ``checks``."""
        own = {name: self.store.read(name).filter(F.col("source_name") == source) for name in ("commits", "listing", "outcomes", "outcome_progress")}
        extra = int(scalar(report.load_failures(own["listing"], own["outcomes"])))
        values: dict[str, object] = {}
        for row in (report.funnel_metrics(own["commits"]), report.listing_metrics(own["listing"]), report.outcome_metrics(own["commits"], own["listing"], own["outcomes"], extra)):
            values |= row.first().asDict()
        histogram = report.failure_histogram(own["outcomes"], extra)
        classes = {r["label"]: r["n"] for r in histogram.collect()}  # one row a failure class
        for r in report.failure_metrics(histogram).collect():
            values |= {r["name"]: r["n"], f"{r['name']}Pct": r["pct"]}
        unlisted = report.without_listing(own["commits"], own["listing"]).count()
        listed = own["commits"].filter("excluded = 0").join(own["listing"].select(*COMMIT).distinct(), COMMIT, "left_semi").count()
        states = {r["status"]: r["n"] for r in progress.by_status(own["outcome_progress"]).collect()}
        values["checks"] = report.invariants(values, sum(classes.values()), classes.get("Package load failure", 0), extra, listed, unlisted, self.pilot, states)
        return values


def tex_lines(values: dict[str, object]) -> list[str]:
    """Macro definitions of metrics, for a driver-side writer: counts with separators, shares with a decimal."""
    out = []
    for name, value in sorted(values.items()):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            continue
        body = fixed_point(value) if isinstance(value, float) else f"{value:,}".replace(",", "{,}")
        out.append(f"\\newcommand{{\\{name}}}{{{body}}}")
    return out


def updated_tex(lines: list[str], values: dict[str, str]) -> tuple[list[str], list[str]]:
    """Lines with macro bodies replaced where they differ, and the names replaced."""
    from ..functions.parsing import macro_of

    out, changed = [], []
    for line in lines:
        found = macro_of(line)
        if found and found[0] in values and found[1] != values[found[0]]:
            line = line.replace(f"{{\\{found[0]}}}{{{found[1]}}}", f"{{\\{found[0]}}}{{{values[found[0]]}}}", 1)
            changed.append(found[0])
        out.append(line)
    return out, changed
