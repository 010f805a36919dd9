"""Text helpers against the semantics they stand for."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import numbers, parsing, text


def column(spark, values, make, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    found = spark.createDataFrame(rows, f"k int, v {kind}").select("k", make(F.col("v")).alias("r")).orderBy("k").collect()
    return [r["r"] for r in found]


BLANKS = ["a", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "é"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(BLANKS), max_size=8), min_size=20, max_size=20))
def test_strip_and_first_line(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.first_line) == [(v.strip().splitlines() or [""])[0] for v in values]


def test_suffix(spark):
    paths = ["a/b.MO", ".gitignore", "x.tar.GZ", "trailing.", "none", "d.e/none", "a/.b.c"]
    from pathlib import PurePosixPath

    want = [PurePosixPath(p).suffix.lower() for p in paths]
    got = column(spark, paths, text.suffix)
    assert [g for g, p in zip(got, paths) if p != "trailing."] == [w for w, p in zip(want, paths) if p != "trailing."]
    assert got[paths.index("trailing.")] == ""


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("P=a,b;Q=c", [("P", ["a", "b"]), ("Q", ["c"])]),
        ("Lib/package.mo", [("Lib", ["Lib/package.mo"])]),
        (";; P= a , ;", [("P", ["a"])]),
        ("", []),
        (None, []),
    ],
)
def test_load_targets(spark, given, want):
    assert [(t["package"], t["paths"]) for t in column(spark, [given], text.load_targets)[0]] == want


def test_main_package(spark):
    frame = spark.createDataFrame([("P=a;Q=b", "s"), ("", "s"), (None, "s")], "v string, s string")
    assert [r[0] for r in frame.select(text.main_package(F.col("v"), F.col("s"))).collect()] == ["Q", "s", "s"]


def test_output_problem(spark):
    texts = ["", "model X\nend X;\n", "model X\n", "end a.b_c ;\n\n \n", None, "end 1;", "x" * 5000 + "\nend Y;", "é" * 3000 + "\nend Y;", "end Y;" + " " * 4096]
    kinds = [p.split(" (")[0] for p in column(spark, texts, text.output_problem)]
    assert kinds == ["canonical output is empty", "", "canonical output is truncated", "", "canonical output is empty", "canonical output is truncated", "", "", "canonical output is truncated"]


def test_paths(spark):
    paths = ["/x/dataset/canonical_models/S/c1/A_B.mo", "S/c1/A_B.mo", "a/b"]
    assert column(spark, paths, text.under_segment) == ["S/c1/A_B.mo", "S/c1/A_B.mo", "a/b"]
    assert [r and tuple(r) for r in column(spark, paths, text.path_key)] == [("S", "c1", "A_B"), ("S", "c1", "A_B"), None]


def test_small_parsers(spark):
    assert column(spark, ['"a b"', "''", None, " x ", '"'], text.compiler_error) == ["a b", "", "", "x", ""]
    assert column(spark, ["fixes #12, #3 and #12, #12345678901234567890", None], text.references) == [[3, 12], []]
    assert column(spark, ["1,234", "", "x", None, "10{,}139"], text.parsed_int) == [1234, 0, 0, 0, 10139]
    assert column(spark, ["On", "0", "yes ", None], text.parsed_flag) == [True, False, True, False]
    assert column(spark, [10139], text.tex_number, "bigint") == ["10{,}139"]
    assert column(spark, ["a;;b", "", None], text.list_of) == [["a", "b"], [], []]
    assert column(spark, ["a.b.c"], text.dotted_prefixes) == [["a.b.c", "a.b", "a"]]
    assert column(spark, ["\\StepOneInputCommits"], text.metric_words) == ["input commits"]
    assert column(spark, ["origin/x", "origin/origin/x"], text.branch_name) == ["x", "origin/x"]


@pytest.mark.parametrize(
    ("given", "items", "kept"),
    [
        ('(version = "4.0.0", uses(M(version="1")))', 2, []),
        ('(experiment(StopTime=2), __Dymola_x = "a, b)")', 2, ["experiment(StopTime=2)"]),
        ("(__OpenModelica_y = 1)", 1, ["__OpenModelica_y = 1"]),
        ("", 0, []),
        ("(a(b", 0, []),
        (None, 0, []),
    ],
)
def test_annotations(spark, given, items, kept):
    frame = spark.createDataFrame([(given,)], "v string").select(parsing.annotation_items(F.col("v")).alias("i"))
    row = frame.select("i", parsing.semantic_items(F.col("i")).alias("k")).first()
    assert (len(row["i"]), row["k"]) == (items, kept)


STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def plain_mask(given):
    return STRING.sub(lambda m: '"' + "." * (len(m[0]) - 2) + '"', given)


def plain_items(given):
    """The same by one walk over a masked text."""
    shown, depth, start, out = plain_mask(given), 0, None, []
    close = None
    for i, sign in enumerate(shown):
        if sign == "(" and start is None:
            start = i
        depth += start is not None and {"(": 1, ")": -1}.get(sign, 0)
        if start is not None and depth == 0:
            close = i
            break
    if close is None:
        return []
    level, begin = 0, start + 1
    for i in range(start + 1, close):
        level += (shown[i] in "([{") - (shown[i] in ")]}")
        if shown[i] == "," and level == 0:
            out.append(given[begin:i].strip())
            begin = i + 1
    return out + [given[begin:close].strip()] * bool(given[begin:close].strip())


PIECES = ["a", "(", ")", "[", "]", "{", "}", ",", '"', "\\", '\\"', " ", "\n", "é", "ab = 1", "()", '"x, (y"']


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=60, max_size=60))
def test_scanning_equals_a_walk(spark, values):
    assert column(spark, values, parsing.mask_literals) == [plain_mask(v) for v in values]
    assert column(spark, values, parsing.annotation_items) == [plain_items(v) for v in values]
    balanced = [f"annotation({v})" for v in values]
    assert column(spark, balanced, parsing.annotation_items) == [plain_items(v) for v in balanced]


def test_scanning_long_texts(spark):
    """Many items, many escapes in a literal, deep brackets, quotes without an end."""
    values = ["(" + ", ".join(f"a{k}(b, {{c, {k}}})" for k in range(3000)) + ")", '("' + '\\"' * 20_000 + '", b)', "(" * 3000 + "a, b" + ")" * 3000, '(a, "b, c' + "x" * 50_000 + ", d)", "(" + "x" * 100_000 + ', "' + "y" * 100_000 + '")', None]
    assert column(spark, values, parsing.annotation_items) == [plain_items(v or "") for v in values]
    assert column(spark, values, parsing.mask_literals) == [v and plain_mask(v) for v in values]


def test_annotations_need_no_python_workers(spark):
    plan = spark.createDataFrame([("(a, b)",)], "v string").select(parsing.annotation_items(F.col("v")), parsing.mask_literals(F.col("v")), parsing.clean_annotation(F.col("v")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_macros():
    assert parsing.macro_of(r"\newcommand{\A}{10{,}139} % note") == ("A", "10{,}139")
    assert parsing.macro_of("text") is None


def test_numbers(spark):
    frame = spark.createDataFrame([(1, 0), (1, 4), (3, 8)], "a int, b int")
    assert [r[0] for r in frame.select(numbers.percent(F.col("a"), F.col("b"))).collect()] == [0.0, 25.0, 37.5]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.4,)], "v double")
    assert [r[0] for r in halves.select(numbers.half_even(F.col("v"))).collect()] == [0, 2, 2, 3]
    assert (numbers.fixed_point(0.25), numbers.fixed_point(0.15)) == ("0.2", "0.1")
    assert [numbers.duration_text(x) for x in (-1, 0, 59.96, 62, 60, 7200)] == ["0 s", "0.0 s", "60.0 s", "1.0 m", "1.0 m", "2.0 hr"]
    assert [numbers.size_text(n) for n in (0, 1023, 1024, 1536, 1 << 30, 5 << 50)] == ["   0.00 B", "1023.00 B", "   1.00 KB", "   1.50 KB", "   1.00 GB", "5120.00 TB"]
    assert column(spark, ["4.0K", "12M\tx", "0", " 1.5G", "x", None, "7B"], numbers.disk_bytes) == [4096, 12 << 20, 0, 3 << 29, None, None, 7]
