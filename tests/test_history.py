"""The funnel, listings, outcomes, progress, history queries and reports on hand-made rows."""

from __future__ import annotations

import json
import subprocess
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalog import schemas
from stratalog.operators import funnel, history, listing, progress, report, upsert
from stratalog.plans.steps import Run, tex_lines, updated_tex
from stratalog.sources import readers
from stratalog.sources import settings as environment
from stratalog.sources.git import GitHistory
from stratalog.streaming import incremental

T0, T1, TAG = datetime(2019, 1, 1), datetime(2021, 1, 1), datetime(2020, 1, 1)


def frame(spark, name, rows):
    schema = schemas.INPUTS[name] if name in schemas.INPUTS else schemas.TABLES[name]
    return spark.createDataFrame(rows, schema)


CASES = {
    # commit: message, authored, branches, diff sides, expected reason
    "override": ("Fix version bump", T1, ["origin/master"], [("a.mo", "a.mo")], ""),
    "anchored": ("Prefix version bump", T1, ["origin/master"], [("a.mo", "a.mo")], "commit message matches"),
    "skip": ("Merge x [skip ci]", T1, ["origin/master"], [("a.mo", "a.mo")], "commit message matches"),
    "update": ("Update to v4", T1, ["origin/master"], [("a.mo", "a.mo")], "commit message matches"),
    "second": ("Feature\nVersion bump", T1, ["origin/master"], [("a.mo", "a.mo")], ""),
    "docs": ("Update release notes", T1, ["origin/master"], [("a.md", "a.mo")], "commit message matches"),
    "code": ("Update release notes", T1, ["origin/master"], [("a.md", "a.c"), ("b.mo", "b.mo")], ""),
    "dot": ("Update release notes", T1, ["origin/master"], [(".x", ".x"), ("b.mo", "b.mo")], ""),
    "blank": ("  ", T1, ["origin/master"], [("a.mo", "a.mo")], ""),
    "pages": ("Version bump", T1, ["origin/GH-PAGES"], [("a.mo", "a.mo")], "excluded branch"),
    "both": ("x", T1, ["origin/gh-pages", "origin/master", "origin/dev"], [("a.mo", "a.mo")], ""),
    "at": ("x", TAG, ["origin/master"], [("a.mo", "a.mo")], ""),
    "old": ("Version bump", T0, ["origin/master"], [("a.mo", "a.mo")], "before tag v3.0 (tag date: 2020-01-01)"),
    "upper": ("x", T1, ["origin/master"], [("A.MO", "A.MO")], "no .mo files"),
    "rename": ("x", T1, ["origin/master"], [("a.mo", "b.mo")], ""),
    "none": ("x", T1, ["origin/master"], [], "no .mo files"),
}


def inputs(spark):
    raw = frame(spark, "commits_raw", [("S", c, k, "Ann", "a@b", at, at, m) for k, (c, (m, at, _, _, _)) in enumerate(CASES.items())])
    refs = frame(spark, "commit_branches", [("S", c, b) for c, v in CASES.items() for b in v[2]])
    diffs = frame(spark, "commit_diffs", [("S", c, a, b) for c, v in CASES.items() for a, b in v[3]])
    tags = frame(spark, "tags", [("S", "v3.0", "t", TAG)])
    return raw, refs, diffs, tags


def test_funnel(spark):
    raw, refs, diffs, tags = inputs(spark)
    rows = {r["commit_hash"]: r for r in funnel.funnel(raw, refs, diffs, ["gh-pages"], "v3.0", funnel.tag_cutoff(tags, "S", "v3.0")).collect()}
    assert set(rows) == set(CASES)
    for name, (*_, want) in CASES.items():
        got = rows[name]["exclusion_reason"]
        assert got.startswith(want) and bool(got) == bool(want) == bool(rows[name]["excluded"]), (name, got)
    assert rows["both"]["branches"] == "dev; master"
    files = {(r["commit_hash"], r["mo_file_path"]) for r in funnel.touched_files(diffs).collect()}
    assert {("rename", "a.mo"), ("rename", "b.mo")} <= files and not any(c == "upper" for c, _ in files)
    with pytest.raises(LookupError):
        funnel.tag_cutoff(tags, "S", "v9")


def test_age_names_and_mail(spark):
    raw, refs, diffs, _ = inputs(spark)
    rows = funnel.funnel(raw, refs, diffs, limit_years=1.5, now=datetime(2021, 6, 1)).collect()
    assert {r["commit_hash"] for r in rows if r["exclusion_reason"].startswith("commit date: 2019")} == {"old"}
    named = funnel.funnel(raw, refs, diffs, bot_names=["ANN"]).filter("exclusion_reason like 'author name%'").count()
    mailed = funnel.funnel(raw, refs, diffs, bot_emails=["@B"]).filter("exclusion_reason like 'author email%'").count()
    assert named == mailed == len(CASES)


@pytest.mark.parametrize(("name", "prefix", "want"), [("A.B", True, (True, "exact", "A.B")), ("A.B", False, (True, "exact", "A.B")), ("A.B.C.D", True, (True, "prefix", "A.B.C")), ("A.BX", True, (False, "none", "")), ("A.B.X", False, (False, "none", ""))])
def test_whitelist(spark, name, prefix, want):
    items = spark.createDataFrame([("A.B",), ("A.B.C",)], "item string")
    row = listing.match_whitelist(spark.createDataFrame([(name,)], "class_name string"), items, prefix).first()
    assert (row["matched"], row["mode"], row["matched_item"]) == want


def test_steps_resume_and_report(spark, tmp_path):
    raw, refs, diffs, tags = inputs(spark)
    store = upsert.Store(spark, str(tmp_path / "store"))
    run = Run(store, now=T1, excluded_branches=["gh-pages"], tag="v3.0")
    run.step_one(raw, refs, diffs, tags)
    kept = [c for c, v in CASES.items() if not v[4]]
    listed = frame(spark, "class_listing", [("S", c, f"L.{n}", int(n != "C")) for c in kept[:-1] for n in "ABC"])
    run.step_two(listed)
    run.step_two(listed)
    assert store.read("listing").count() == 3 * (len(kept) - 1)
    assert store.read("listing_progress").filter("enumerated_classes_count = 0").count() == 1
    texts = frame(spark, "canonical_texts", [("S", c, f"L.{n}", f"model\nend {n};\n" if n == "A" else None, "" if n == "A" else "Class X not found in scope") for c in kept[:-1] for n in "AB"])
    run.step_three(texts)
    run.step_three(texts)
    assert store.read("failures").count() == len(kept) - 1, "a rerun logs nothing again"
    values = run.report("S")
    assert values["FilterInputCommits"] == len(CASES) and values["FilterRetained"] == len(kept)
    assert values["CanonProducedVersions"] == values["CanonFailures"] == values["FailMissingClass"] == len(kept) - 1
    assert all(ok for *_, ok in values["checks"]), values["checks"]
    assert any("FilterInputCommits}{16}" in line for line in tex_lines(values))
    assert updated_tex([r"\newcommand{\A}{1} % x", r"\newcommand{\B}{2}"], {"A": "3", "B": "2"}) == ([r"\newcommand{\A}{3} % x", r"\newcommand{\B}{2}"], ["A"])
    with pytest.raises(PermissionError):
        store.drop()
    store.drop(confirmed=True)
    assert store.read("commits").count() == 0


def test_plug_in(spark):
    def compiler(batches):
        for batch in batches:
            yield pd.DataFrame({**{c: batch[c] for c in ("source_name", "commit_hash", "class_name")}, "text": "end " + batch["class_name"] + ";", "error_message": ""})

    rows = spark.createDataFrame([("S", "c", "A.B")], "source_name string, commit_hash string, class_name string")
    made = listing.outcomes(rows, listing.canonicalize(rows, compiler), "root").first()
    assert (made["canonical_model_path"], made["pilot_match_mode"], made["canonical_produced"]) == ("root/S/c/A_B.mo", "disabled", 1)


def test_reconcile(spark):
    made = [("S", "c", n, 1, p, "e", 1, "disabled", "", k) for n, p, k in (("gone", "p/gone", 1), ("back", "p/back", 0), ("bad", "p/bad", 1), ("same", "p/same", 1), ("never", "", 0))]
    files = spark.createDataFrame([("p/back", "end a;"), ("p/bad", "cut"), ("p/same", "end a;"), ("p/orphan", "end a;")], "path string, text string")
    found = {(r["class_name"], r["state"], r["corrupt"]) for r in listing.reconcile(frame(spark, "outcomes", made), files).collect()}
    assert found == {("gone", "missing", False), ("back", "present", False), ("bad", "missing", True), ("same", "same", False), ("never", "same", False), (None, "orphan", False)}
    fixed = {r["class_name"]: (r["canonical_produced"], r["canonical_model_path"], r["error_message"]) for r in listing.reconciled(frame(spark, "outcomes", made), files).collect()}
    assert fixed["gone"] == (0, "", "e") and fixed["back"] == (1, "p/back", "") and len(fixed) == 5


def test_progress_and_metrics(spark):
    commits = frame(spark, "commits", [("S", c, k, "", "", "", 0, "") for k, c in enumerate("abcd")])
    made = frame(spark, "outcomes", [("S", "a", "x", 1, "", "", 1, "exact", "x", 1), ("S", "a", "y", 1, "", "e", 0, "none", "", 0)])
    failed = frame(spark, "failures", [(1, "S", "b", "x", "canonical_no_output", "", T1)])
    known = frame(spark, "outcome_progress", [("S", "c", "complete", 0, 0, 0, T1)])
    seeds = {r["commit_hash"]: (r["processed_classes_count"], r["saved_models_count"], r["failure_count"]) for r in progress.seed_progress(commits, known, made, failed, T1).collect()}
    assert seeds == {"a": (2, 1, 0), "b": (0, 0, 1)}
    assert {r[1] for r in progress.remaining(commits, known, limit=3).collect()} == {"a", "b"}
    listed = frame(spark, "listing", [("S", "a", "x", 1), ("S", "a", "z", 0)])
    total = progress.totals(made, failed, listed, pilot=False)
    assert total.first()["total_saved"] == 1 and total.first()["total_rows"] == 2
    scope = progress.scope_metrics(known, commits)
    values = {r["name"]: r["value"] for r in progress.run_metrics(total, scope, 4, pilot=True).collect()}
    assert values["StepThreeInputScope"] == "1" and values["ProcessedCommitsPercentage"] == "25.0" and values["StepThreeScopeLabel"] == "Pilot whitelist"
    logs = frame(spark, "run_logs", [(1, "S", "step1", T0, 1.0, "{}"), (2, "S", "step1", T1, 1.0, "{}")])
    metrics = frame(spark, "metrics", [(1, "m", 1, "old", 0), (2, "m", 1, "new", 0), (2, "m", 1, "newest", 1)])
    assert progress.latest_metrics(metrics, logs).first()["value"] == "newest"
    settings = frame(spark, "settings", [(3, "b", "1"), (3, "a", "x")])
    assert progress.settings_json(settings, 3).first()[0] == '{"a":"x","b":"1"}'
    assert progress.setting(settings, 3, "b") == "1" and progress.setting(settings, 3, "c", "d") == "d"


def dataset(spark):
    commits = frame(spark, "commits", [("S", c, k, "", "m", f"see #{k} and #7", int(c == "x"), "") for k, c in enumerate(["c", "a", "b", "x", "d"])])
    made = frame(spark, "outcomes", [("S", c, "K", 1, f"p/{c}", "", 1, "disabled", "", 1) for c in "cabd"] + [("S", "c", "Z", 1, "", "bad", 1, "disabled", "", 0)])
    texts = frame(spark, "canonical_texts", [("S", c, "K", t, "") for c, t in zip("cabd", ["one\n", "one\n", "two\n", "one\n"])])
    failed = frame(spark, "failures", [(2, "S", "c", "Z", "canonical_no_output", "bad", T1), (1, "S", "c", "Z", "no_classes", "", T1)])
    return history.History(commits, frame(spark, "listing", [("S", "c", "Z", 0), ("S", "c", "K", 1)]), made, failed, texts, {"S": "o/r"})


def test_history_queries(spark):
    with dataset(spark) as h:
        assert [r[0] for r in h.list_sources().collect()] == ["S"]
        assert [r[0] for r in h.list_commits("S").collect()] == ["c", "a", "b", "d"]
        assert h.list_commits("S", include_excluded=True).count() == 5
        assert h.get_commit("S", "a").first()["author_email"] == "" and h.get_commit("S", "?").first() is None
        assert [r[0] for r in h.list_experiment_classes("S").collect()] == ["K"]
        assert [tuple(r) for r in h.get_enumerated_classes("S", "c").collect()] == [("K", 1), ("Z", 0)]
        assert [r["commit_hash"] for r in h.get_class_timeline("S", "K").collect()] == ["c", "a", "b", "d"]
        assert h.get_models_for_commit("S", "c").count() == 1
        assert [r["failure_type"] for r in h.list_canonicalization_failures("S").collect()] == ["no_classes", "canonical_no_output"]
        assert h.list_canonicalization_failures("S", "K").count() == 0
        assert h.read_canonical_model("S", "b", "K").first()[0] == "two\n" and h.read_canonical_model("S", "?", "K").first() is None
        assert h.summary("S").first().asDict() == {"commits": 4, "classes": 1, "canonical_models": 4, "canonicalization_failures": 2, "unique_snapshots": 2}
        versions = h.get_semantic_versions("S", "K").orderBy("version_index").collect()
        assert [(r["version_index"], r["first_commit"], r["commit_count"]) for r in versions] == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
        near = h.get_neighbour_versions("S", "K", "b").first()
        assert near["previous"] == near["next"] == versions[0]["canonical_hash"]
        assert [r[0] for r in h.get_commits_for_canonical("S", versions[0]["canonical_hash"]).collect()] == ["c", "a", "d"]
        assert [r[0] for r in h.get_semantic_change_commits("S", "K").collect()] == ["c", "b", "d"]
        assert h.get_commits_touching_class("S", "K").count() == 4
        checks = spark.createDataFrame([(versions[1]["canonical_hash"], True)], "canonical_hash string, compiles boolean")
        row = h.get_check_model_result("S", versions[1]["canonical_hash"], checks).first()
        assert (row["line_count"], row["byte_count"], row["compiles"]) == (1, 4, True)
        issues = spark.createDataFrame([(7, "t", "open"), (2, "u", "closed")], "number bigint, title string, state string")
        assert [r["number"] for r in h.get_linked_issues("S", "b", issues).collect()] == [2, 7]
        info = spark.createDataFrame([("b", "i")], "commit_hash string, info string")
        pulls = spark.createDataFrame([("b", [1])], "commit_hash string, pulls array<int>")
        context = {r["commit_hash"]: r for r in h.semantic_change_context("S", "K", info, pulls, issues).collect()}
        assert context["b"]["n_issues"] == 2 and context["b"]["commit"] == "i" and context["c"]["n_issues"] == 1
        assert h.github_repository("S") == "o/r"
        with pytest.raises(ValueError):
            h.github_repository("?")


def test_github_lookups(spark):
    h = dataset(spark)
    rows = [("o/r", "commit", "b", json.dumps({"sha": "b"})), ("o/r", "pulls", "b", json.dumps([{"number": 4}, {"number": 5}])), ("o/r", "issue", "7", json.dumps({"number": 7, "title": "t"})), ("x/y", "commit", "b", json.dumps({"sha": "other"}))]
    with pytest.raises(ValueError):
        h.get_github_commit("S", "b")
    h.payloads = frame(spark, "github_payloads", rows)
    assert [r["sha"] for r in h.get_github_commit("S", "b").collect()] == ["b"] and h.get_github_commit("S", "?").count() == 0
    assert [r["number"] for r in h.get_github_pull_requests("S", "b").collect()] == [4, 5]
    assert h.get_github_issue("S", 7).first()["title"] == "t" and h.get_github_issue("S", 8).first() is None
    assert [r["number"] for r in h.get_github_linked_issues("S", "b").collect()] == [7]


def test_runs_and_metrics(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "store"))
    store.upsert("run_logs", progress.run_log(1, "S", "step1", T0, "{}", store.read("sources")), ["id"])
    assert store.read("run_logs").first()["duration_s"] is None
    store.upsert("run_logs", progress.finished_run(store.read("run_logs"), 1, 2.5), ["id"])
    assert [r["duration_s"] for r in store.read("run_logs").collect()] == [2.5]
    for value in ("old", "new"):
        values = spark.createDataFrame([("m", value), ("n", "1")], "name string, value string")
        store.upsert("metrics", progress.metric_rows(values, 1, 1), schemas.KEYS["metrics"])
    assert sorted((r["name"], r["value"]) for r in store.read("metrics").collect()) == [("m", "new"), ("n", "1")]
    assert progress.metric_names(spark.createDataFrame([("StepOneInputCommits",)], "name string")).first()["words"] == "input commits"


def test_sources_and_settings(spark, tmp_path):
    rows = frame(spark, "sources", [("S", "/old/place/lib", "", 1, "", "", None), ("T", "lib", "", 0, "", "", None)])
    assert progress.source_record(rows, "S")["repo_path"] == "/old/place/lib" and progress.source_record(rows, "T") is None
    assert progress.source_record(spark.createDataFrame([("S",)], "name string"), "S") is None
    assert [(r["name"], r["repo_path"]) for r in progress.moved_paths(rows, "/new").collect()] == [("S", "/new/lib")]
    (tmp_path / ".env").write_text("# note\nexport A = 'x y'\nB=\"\"\nnothing\n=v\nC=1\n")
    found = environment.read_environment(str(tmp_path / ".env"), {"C": "2", "D": "3"})
    assert found == {"A": "x y", "B": "", "C": "2"} and environment.read_environment(str(tmp_path / "none"), {"D": "3"}) == {}
    assert environment.settings_table(spark, found, 3).count() == 3
    assert environment.repository_path(" lib/x ", "/root") == "/root/lib/x" and environment.repository_path("/a/../b", "/root") == "/b"


def test_store_deletes_and_replaces(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "store"))
    rows = [(s, f"c{k}", "p.mo", 0) for s in ("a", "b=/ x", "007") for k in range(40)]
    store.replace_sources("files", frame(spark, "files", rows))
    assert sorted(tuple(r) for r in store.read("files").collect()) == sorted(rows)
    store.delete("files", frame(spark, "files", rows[:40]), schemas.KEYS["files"])
    assert sorted(tuple(r) for r in store.read("files").collect()) == sorted(rows[40:])
    store.delete("files", frame(spark, "files", rows[40:42]).select("commit_hash"), ["commit_hash"])
    assert store.read("files").count() == 76
    store.replace_sources("files", frame(spark, "files", []), ["b=/ x"])
    assert {r[0] for r in store.read("files").select("source_name").distinct().collect()} == {"007"}
    store.upsert("files", frame(spark, "files", [("007", "c5", "p.mo", 1), ("n", "c", "q.mo", 0)]), schemas.KEYS["files"])
    assert store.read("files").filter("is_baseline = 1").count() == 1 and store.read("files").count() == 39


def test_commits_that_could_not_be_processed(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "store"))
    run = Run(store, now=T1)
    store.replace_sources("commits", frame(spark, "commits", [("S", c, k, "", "", "", 0, "") for k, c in enumerate("ab")]))
    store.upsert("listing", frame(spark, "listing", [("S", c, "X", 1) for c in "ab"]), schemas.KEYS["listing"])
    problems = spark.createDataFrame([("S", "a", "load_model_failed", " no file "), ("S", "b", "unheard of", "x")], "source_name string, commit_hash string, failure_type string, compiler_message string")
    texts = frame(spark, "canonical_texts", [("S", "b", "X", "model\nend X;\n", "")])
    run.step_three(texts, problems.filter("commit_hash = 'a'"))
    assert [tuple(r)[1:6] for r in store.read("failures").collect()] == [("S", "a", "", "load_model_failed", "no file")]
    states = {r["commit_hash"]: (r["status"], r["saved_models_count"], r["failure_count"]) for r in store.read("outcome_progress").collect()}
    assert states == {"a": ("complete", 0, 1), "b": ("complete", 1, 0)}
    assert listing.commit_failures(problems, F.lit(T1)).count() == 2
    broken = texts.withColumn("text", F.expr("raise_error('cut short')"))
    store.replace_sources("commits", frame(spark, "commits", [("S", "c", 2, "", "", "", 0, "")]))
    store.upsert("listing", frame(spark, "listing", [("S", "c", "X", 1)]), schemas.KEYS["listing"])
    with pytest.raises(Exception, match="cut short"):
        run.step_three(broken)
    assert store.read("outcome_progress").filter("commit_hash = 'c' and status = 'processing'").count() == 1


def test_age_limit_needs_a_time(spark):
    raw, refs, diffs, tags = inputs(spark)
    with pytest.raises(ValueError):
        funnel.funnel(raw, refs, diffs, limit_years=1.5)
    with pytest.raises(LookupError):
        funnel.tag_cutoffs(raw, tags, "v9")
    old = frame(spark, "commits", [("S", "a", 0, "", "", "", 1, "commit date: 2019-01-01, age: 2.4 years"), ("S", "b", 1, "", "", "", 0, "")])
    row = report.funnel_metrics(old).first()
    assert (row["FilterExclAge"], row["FilterAfterBot"], row["FilterRetained"]) == (1, 1, 1)


def test_numbering_and_means_in_ranges(spark, monkeypatch):
    rows = [(k * 7919 % 1000 // 3, float(k)) for k in range(1000)]
    series = spark.createDataFrame([(a, k, v) for k, (a, v) in enumerate(rows)], "a int, b int, v double").repartition(5)
    found = upsert.numbered(series, ["a", "b"], blocks=9).orderBy("seq").collect()
    want = sorted((a, k, v) for k, (a, v) in enumerate(rows))
    assert [(r["a"], r["b"], r["v"], r["seq"]) for r in found] == [(*w, k) for k, w in enumerate(want)]
    monkeypatch.setattr(report, "BLOCK_ROWS", 20)
    for k in (1, 4, 50):
        means = {(r["a"], r["b"]): r["mean"] for r in report.moving_average(series, ["a", "b"], "v", k).collect()}
        low, high = k // 2, k - 1 - k // 2
        assert means == {want[i][:2]: pytest.approx(sum(w[2] for w in want[i - low : i + high + 1]) / k) for i in range(low, len(want) - high)}


def test_github_payloads(spark):
    commit = json.dumps({"sha": "s", "commit": {"author": {"name": "n"}}, "files": [{"filename": "f"}], "stats": {"total": 99}})
    pulls = json.dumps([{"number": 1, "merged_at": "x", "labels": [{"name": "l"}]}, {"number": 2, "merged_at": None}])
    rows = spark.createDataFrame([(commit, pulls, json.dumps({"number": 3})), ("{}", "{}", "{}")], "c string, p string, i string")
    first, second = rows.select(history.github_commit(F.col("c")).alias("c"), history.github_pulls(F.col("p")).alias("p"), history.github_issue(F.col("i")).alias("i")).collect()
    assert (first["c"]["author_name"], first["c"]["files_changed"], first["c"]["author_login"]) == ("n", 1, "")
    assert [(p["number"], p["merged"], p["labels"]) for p in first["p"]] == [(1, True, ["l"]), (2, False, [])]
    assert first["i"]["number"] == 3 and second["p"] == [] and second["c"]["sha"] == ""


@pytest.mark.parametrize(
    ("message", "want"),
    [("base class X not found", "Missing base class"), ("Class Foo not found in scope", "Missing referenced class"), ("saveTotalModel produced no output file", "Canonicalization timeout"), ("package Q not found", "Package load failure"), ("xyz", "Other"), ("   ", "Empty error / unknown")],
)
def test_failure_classes(spark, message, want):
    assert spark.createDataFrame([(message,)], "m string").select(report.failure_class(F.col("m"))).first()[0] == want


def test_report_pieces(spark):
    counts = spark.createDataFrame([("S", "a", 2, 1), ("S", "b", 0, 0), ("S", "c", 4, 4)], "source_name string, commit_hash string, n_classes bigint, n_eligible bigint")
    assert listing.growth(counts).first()["GrowthExperimentRatioMean"] == pytest.approx(50.0)
    assert [report.moving_average_window(n) for n in (10, 60, 1000)] == [1, 12, 50]
    series = spark.createDataFrame([(k, float(k)) for k in range(7)], "k int, v double")
    assert [r["mean"] for r in report.moving_average(series, ["k"], "v", 4).orderBy("k").collect()] == [1.5, 2.5, 3.5, 4.5]
    with pytest.raises(SystemExit):
        report.guard_pilot(True, False)
    report.guard_pilot(True, True)
    assert report.coverage({"a"}, {"b"}, {"b", "c"})["never computed"] == {"c"}
    rows = frame(spark, "listing", [("S", f"c{k}", "x", k % 2) for k in range(12)])
    dates = frame(spark, "commits_raw", [("S", f"c{k}", k, "", "", T1, T1, "") for k in range(12)])
    assert report.timeline(rows, dates).filter("n_classes_mean is not null").count() == 11
    assert report.timeline(rows.limit(5), dates) is None
    files = frame(spark, "files", [("S", "a", "x", 0), ("S", "a", "y", 0), ("S", "b", "x", 0)])
    commits = frame(spark, "commits", [("S", "a", 0, "", "", "", 0, ""), ("S", "b", 1, "", "", "", 0, ""), ("S", "c", 2, "", "", "", 1, "no .mo files")])
    row = report.funnel_summary(commits, files).first()
    assert (row["StepOneCommitMoPairsMedian"], row["StepOneCommitMoPairsMean"], row["StepOneTotalExcludedCount"]) == (1.5, 1.5, 1)


def test_published_numbers_agree():
    assert 10139 - 223 - 1334 - 88 - 1134 == 7360 and 36_320_196 + 2_582_873 == 38_903_069 and 2_505_835 + 77_038 == 2_582_873


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted(tuple(r) for r in upsert.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(tuple(r) for r in upsert.insert_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert [tuple(r) for r in upsert.delete_keys(old, new, ["k"]).collect()] == [(1, "a")]
    assert schemas.duplicate_keys(frame(spark, "sources", [("n", "", "", 1, "", "", None)] * 2), "sources").first()["n"] == 2
    assert [r["seq"] for r in upsert.numbered(old, ["k"], start=5).orderBy("k").collect()] == [5, 6]


def test_sources(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/a.json").write_text(json.dumps({"source_name": "S", "commit_hash": "c", "classes": [{"name": " A ", "is_experiment": True}, {"name": " "}, {"is_experiment": True}]}))
    (tmp_path / "cache/b.json").write_text("not json")
    assert [tuple(r) for r in readers.listing_cache(spark, str(tmp_path / "cache")).collect()] == [("S", "c", "A", 1)]
    readers.write_listing_cache(frame(spark, "class_listing", [("S", "c", "A", 1)]), str(tmp_path / "out"))
    assert readers.listing_cache(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "canonical_models/S/c").mkdir(parents=True)
    (tmp_path / "canonical_models/S/c/A.mo").write_text("end A;")
    assert [tuple(r) for r in readers.canonical_files(spark, str(tmp_path / "canonical_models")).collect()] == [("S/c/A.mo", "end A;")]
    assert readers.folder_sizes(spark, {"m": str(tmp_path / "canonical_models")}).first()["bytes"] == 6
    (tmp_path / "v.tex").write_text("\\newcommand{\\A}{1{,}2} % n\nx\n")
    assert [tuple(r) for r in readers.tex_values(spark, str(tmp_path / "v.tex")).collect()] == [("A", "1{,}2")]
    assert readers.scalar(spark.range(0)) == 0
    there = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, rank int, path string")
    assert readers.first_existing(there, spark.createDataFrame([("y",)], "path string")).first()["path"] == "y"


def test_git_source(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "a.mo").write_text("model a\nend a;\n" * 9)
    git("add", "-A")
    git("commit", "-qm", "first\n\nbody")
    git("mv", "a.mo", "b.mo")
    git("commit", "-qm", "second")
    spark.dataSource.register(GitHistory)
    read = lambda rows: spark.read.format("git_history").option("path", str(tmp_path)).option("rows", rows).load()
    assert {r["message"].strip() for r in read("commits").collect()} == {"first\n\nbody", "second"}
    assert {r["branch"] for r in read("branches").collect()} == {"main"}
    assert {(r["a_path"], r["b_path"]) for r in read("diffs").collect()} == {("a.mo", "a.mo"), ("a.mo", "b.mo")}


def test_streaming(spark, tmp_path):
    rows = [("S", "c", "A", 1), ("S", "c", "B", 0)]
    frame(spark, "listing", rows).write.parquet(str(tmp_path / "in"))
    store = upsert.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = incremental.read_stream(spark, str(tmp_path / "in"), "listing")
        incremental.upsert_stream(stream, store, "listing", str(tmp_path / "check")).awaitTermination()
        frame(spark, "listing", [("S", "c", "B", 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in store.read("listing").collect()) == [("S", "c", "A", 1), ("S", "c", "B", 1)]
    (tmp_path / "none").mkdir()
    raw = incremental.read_stream(spark, str(tmp_path / "none"), "commits_raw")
    assert incremental.new_commits(raw).isStreaming and incremental.daily_commits(raw).columns == ["source_name", "day", "n"]


def test_failures_of_unknown_types_are_kept(spark, tmp_path):
    """A commit that failed in a way that nobody foresaw is logged, not lost with its classes."""
    store = upsert.Store(spark, str(tmp_path / "store"))
    run = Run(store, now=T1)
    store.replace_sources("commits", frame(spark, "commits", [("S", c, k, "", "", "", 0, "") for k, c in enumerate("ab")]))
    store.upsert("listing", frame(spark, "listing", [("S", c, "X", 1) for c in "ab"]), schemas.KEYS["listing"])
    problems = spark.createDataFrame([("S", "a", "disk_full", " no room \n"), ("S", "b", None, None)], "source_name string, commit_hash string, failure_type string, compiler_message string")
    run.step_three(frame(spark, "canonical_texts", []), problems)
    logged = {r["commit_hash"]: (r["failure_type"], r["compiler_message"]) for r in store.read("failures").collect()}
    assert logged == {"a": ("unknown_failure", "disk_full: no room"), "b": ("unknown_failure", ": ")}
    assert {r["commit_hash"]: r["failure_count"] for r in store.read("outcome_progress").collect()} == {"a": 1, "b": 1}


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_runs_of_huge_keys(spark, blocks):
    """A key that spans many blocks, nulls as keys and values, runs over borders, keys with one row."""
    import random

    rng = random.Random(blocks)
    rows, at = [], 0
    for _ in range(400):
        at += rng.randint(1, 2)
        rows.append((rng.choice(["k", "k", "k", None, f"s{at}"]), at, rng.choice(["x", "x", "x", "y", None])))
    want = []
    for key in {r[0] for r in rows}:
        number, last = 0, object()
        for _, place, value in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if number == 0 or value != last:
                number += 1
                want.append([key, number, value, place, place, 0])
            want[-1][4:] = [place, want[-1][5] + 1]
            last = value
    data = spark.createDataFrame(rows, "k string, at int, v string").repartition(5)
    found = history.runs(data, ["k"], ["at"], "v", blocks)
    got = [(r["k"], r["version_index"], r["v"], r["first"]["at"], r["last"]["at"], r["n"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)
    beside = {(r["k"], r["version_index"]): (r["previous"], r["next"]) for r in history.neighbours(found, ["k"], "v").collect()}
    values = {(k, n): v for k, n, v, *_ in want}
    assert beside == {(k, n): (values.get((k, n - 1)), values.get((k, n + 1))) for k, n in values}


def test_no_task_holds_a_key(spark):
    """Rows of one key are dealt into as many blocks as there are partitions."""
    data = spark.range(4000).selectExpr("1 as k", "id", "id div 700 as v")
    sizes = [r["count"] for r in upsert.in_blocks(data, ["k", "id"], 16).groupBy(upsert.BLOCK).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1000
    assert history.runs(data, ["k"], ["id"], "v", 16).count() == 6


def test_distinct_counts_grow_by_days(spark, tmp_path):
    """Days are added one by one, twice, and late; older rows are never read again."""
    from stratalog.operators import distinct

    store = upsert.Store(spark, str(tmp_path / "store"), parts=2)
    schema = "source_name string, day date, name string"
    days = [[("S", "2024-01-01", f"n{k}") for k in range(200)] + [("T", "2024-01-01", "n1"), ("T", "2024-01-01", None)], [("S", "2024-01-03", f"n{k}") for k in range(100, 70_000, 7)], [("S", "2024-01-02", f"n{k}") for k in range(150, 300)] + [(None, None, "n5")]]
    seen = {}
    for day in [*days, days[1]]:
        rows = [(s, None if d is None else datetime.fromisoformat(d).date(), n) for s, d, n in day]
        distinct.add(store, spark.createDataFrame(rows, schema))
        for s, d, n in day:
            if n is not None:
                seen.setdefault((s, d), set()).add(n)
    got = {(r["source_name"], r["day"] and str(r["day"])): r["n"] for r in distinct.counts(store, ["source_name", "day"]).collect()}
    assert got == {k: len(v) for k, v in seen.items()}
    union = set().union(*seen.values())
    assert distinct.counts(store, []).first()["n"] == len(union)
    assert {r["source_name"]: r["n"] for r in distinct.counts(store, ["source_name"], "2024-01-02", "2024-01-02").collect()} == {"S": 150}
    guess = distinct.estimates(store, []).first()["n"]
    assert abs(guess - len(union)) < 5 * distinct.ERROR * len(union)
    assert distinct.counts(upsert.Store(spark, str(tmp_path / "none")), ["source_name"]).count() == 0


def test_pixels_keep_the_drawn_line(spark):
    """First, last, lowest and highest of each pixel, whatever the number of points."""
    import random

    rng = random.Random(2)
    points = [(rng.random() * 100, rng.gauss(0, 5)) for _ in range(3000)] + [(7.0, None), (None, 1.0), (0.0, 1.0), (100.0, 2.0), (100.0, -2.0)]
    found = [tuple(r) for r in report.pixel_series(spark.createDataFrame(points, "t double, v double"), "t", "v", 40).collect()]
    whole = [(t, v) for t, v in points if t is not None and v is not None]
    want = set()
    for pixel in range(40):
        own = [p for p in whole if min(int((p[0]) * 40 / 100.0), 39) == pixel]
        want |= {(pixel, *p) for p in (min(own), max(own), min(own, key=lambda p: (p[1], p[0])), max(own, key=lambda p: (p[1], p[0])))}
    assert set(found) == want and len(found) == len(want) <= 160
    assert report.pixel_series(spark.createDataFrame([(1, 2), (1, 3)], "t int, v int"), "t", "v", 5).count() == 2
    assert report.pixel_series(spark.createDataFrame([], "t int, v int"), "t", "v", 5).count() == 0


ENTRIES = [
    ('{"classes": [{"name": " A ", "is_experiment": true}, {"name": "B"}]}', [("A", 1), ("B", 0)]),
    ('{"classes": [{"name": "A", "is_experiment": 1}, 5, "x", null, [], {"other": 1}, {"name": ""}, {"name": "\\n"}]}', [("A", 1)]),
    ('{"classes": [{"name": null}, {"name": 7}, {"name": 1.5, "is_experiment": 0.0}, {"name": true, "is_experiment": "no"}]}', [("None", 0), ("7", 0), ("1.5", 0), ("True", 1)]),
    ('{"classes": [{"name": "A", "is_experiment": []}, {"name": "B", "is_experiment": {"x": 1}}, {"name": "C", "is_experiment": null}]}', [("A", 0), ("B", 1), ("C", 0)]),
    ('{"classes": {"name": "A"}}', None), ('{"classes": null}', None), ("[1]", None), ('{"classes": [', None), ("", None), (None, None), ('{"classes": []}', []),
]


def test_tolerant_listings(spark, tmp_path):
    """One bad entry is dropped, and not its record; the reference reads them with a general JSON parser."""
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(ENTRIES)], "k int, p string").select("k", readers.listed_classes(F.col("p")).alias("c")).orderBy("k").collect()
    assert [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in rows] == [want for _, want in ENTRIES]
    place = tmp_path / "cache" / "Lib"
    place.mkdir(parents=True)
    for k, (payload, _) in enumerate(ENTRIES):
        (place / f"c{k}.json").write_text(payload or "")
    (place / "many.json").write_text('{"source_name": "Q", "commit_hash": "z", "classes": [{"name": "L"}]}\nbroken\n{"commit_hash": "y", "classes": [{"name": "M"}]}\n')
    found = sorted(tuple(r) for r in readers.listing_cache(spark, str(tmp_path / "cache")).collect())
    assert found == sorted([("Lib", f"c{k}", *c) for k, (_, want) in enumerate(ENTRIES) for c in want or []] + [("Q", "z", "L", 0), ("Lib", "y", "M", 0)])


def test_checks_read_each_table_once(spark):
    commits = frame(spark, "commits", [("S", c, k, "", "", "", int(bool(r)), r) for k, (c, r) in enumerate([("a", ""), ("b", ""), ("c", "excluded branch"), ("d", "no such bucket")])])
    listed = frame(spark, "listing", [("S", "a", "A", 1), ("S", "a", "B", 0), ("S", "x", "C", 1)])
    made = frame(spark, "outcomes", [("S", "a", "A", 1, "p", "", 0, "", "", 1), ("S", "x", "C", 1, "", "type error", 0, "", "", 0)])
    found = report.checks(commits, listed, made)
    assert {r["label"]: (r["lhs"], r["rhs"], r["ok"]) for r in found.collect()} == {"retained + excluded = input": (3, 4, False), "listed + unlisted commits = retained": (2, 2, True), "eligible + other = all": (3, 3, True), "produced + failed = eligible": (2, 2, True), "categories = failures": (1, 1, True)}


def test_failure_log_goes_on(spark, tmp_path):
    """Ids go on from run to run; a run that is made again logs nothing twice, and older messages stay."""
    store = upsert.Store(spark, str(tmp_path / "store"), parts=2)
    problems = lambda *rows: spark.createDataFrame(list(rows), "source_name string, commit_hash string, failure_type string, compiler_message string")
    first = listing.commit_failures(problems(("S", "b", "no_classes", "x"), ("S", "a", "no_classes", "y")), F.lit(T0))
    for _ in range(2):
        Run(store, now=T0)._log(first)
    Run(store, now=T1)._log(listing.commit_failures(problems(("S", "a", "no_classes", "again")), F.lit(T1)))
    assert sorted((r["id"], r["commit_hash"], r["compiler_message"]) for r in store.read("failures").collect()) == [(1, "a", "y"), (2, "b", "x"), (3, "a", "again")]


def test_recorded_order(spark):
    rows = frame(spark, "commits", [("S", "a", 5, "", "", "", 0, ""), ("S", "b", 7, "", "", "", 1, "excluded branch"), ("S", "c", 6, "", "", "", 1, "no .mo files"), ("S", "d", 9, "", "", "", 1, "excluded branch")])
    assert [r["commit_hash"] for r in funnel.in_recorded_order(rows).orderBy("seq").collect()] == ["b", "d", "a", "c"]


def test_records(spark):
    from stratalog import records

    h = history.History(frame(spark, "commits", [("S", "c", 0, None, "", "m", 1, "x")]), None, frame(spark, "outcomes", [("S", "c", "A", 1, None, "", 0, "", "", 1)]), None)
    (info,) = records.records(h.get_commit("S", "c"), "CommitInfo")
    assert (info.commit_hash, info.author_email, info.excluded, info.exclusion_reason) == ("c", "", True, "x")
    (version,) = records.records(h.get_models_for_commit("S", "c"), "ClassVersion")
    assert version == records.record_type("ClassVersion")("c", "A", "", True)
    with pytest.raises(AttributeError):
        version.class_name = "B"
    h.payloads, h.github = frame(spark, "github_payloads", [("o/r", "commit", "c", '{"sha": "c", "files": [{"filename": "f"}]}')]), {"S": "o/r"}
    (fetched,) = records.records(h.get_github_commit("S", "c"), "GitHubCommitInfo")
    assert (fetched.sha, fetched.changed_files, fetched.files_changed, fetched.authored_date) == ("c", ["f"], 1, "")


def test_load_plan(spark):
    """Targets in order, candidates in order, the own tree before the shared one; the last target must be there."""
    commits = frame(spark, "commits", [("S", c, k, "", "", "", 0, "") for k, c in enumerate("abc")]).select("source_name", "commit_hash")
    sources = spark.createDataFrame([("S", "P=p/x.mo,p/y.mo;Q=q.mo;R=r.mo")], "name string, package_file string")
    files = spark.createDataFrame([("S", "a", "p/y.mo"), ("S", "a", "r.mo"), ("S", "b", "p/x.mo"), ("S", "b", "q.mo"), ("T", "c", "r.mo")], "source_name string, commit_hash string, path string")
    shared = spark.createDataFrame([("p/x.mo",), ("q.mo",)], "path string")
    plan = listing.load_plan(commits, sources, files, shared)
    rows = sorted(tuple(r)[1:] for r in plan.collect())
    assert rows == [("a", 0, "P", "p/x.mo"), ("a", 1, "Q", "q.mo"), ("a", 2, "R", "r.mo"), ("b", 0, "P", "p/x.mo"), ("b", 1, "Q", "q.mo"), ("b", 2, "R", None), ("c", 0, "P", "p/x.mo"), ("c", 1, "Q", "q.mo"), ("c", 2, "R", None)]
    alone = listing.load_plan(commits, sources, files)
    assert sorted(tuple(r)[1:] for r in alone.filter("commit_hash = 'a'").collect()) == [("a", 0, "P", "p/y.mo"), ("a", 2, "R", "r.mo")]
    assert sorted(tuple(r) for r in listing.load_problems(plan).collect()) == [("S", c, "load_model_failed", "no file for R") for c in "bc"]


def test_storage_metrics(spark):
    rows = [("a", 0), ("b", 1023), ("c", 1024), ("d", 1025), ("e", 12 << 20), ("f", (12 << 30) + 1), ("g", 199 << 30), ("h", None)]
    found = report.storage_metrics(spark.createDataFrame(rows, "name string, bytes long")).collect()
    assert {r["name"]: r["value"] for r in found} == {"a": r"0\,B", "b": r"1023\,B", "c": r"1.0\,KB", "d": r"1.1\,KB", "e": r"12\,MB", "f": r"13\,GB", "g": r"199\,GB"}
