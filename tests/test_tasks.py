"""Work that must not come to one task, whatever few files, sources or paths there are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratalog import queries
from stratalog.functions import parsing
from stratalog.operators import listing

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["annotation_parsing", "annotation_items_of"])
def test_parsing_is_dealt_out(spark, name):
    assert queries.table(spark, SMALL, "part").rdd.getNumPartitions() == 1
    assert queries.queries()[name](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parts_of_an_annotation_are_computed_once(spark):
    plan = spark.createDataFrame([("(a, b)",)], "v string").select(parsing.annotation_items(F.col("v")).alias("items"))
    assert plan._jdf.queryExecution().analyzed().toString().count("zip_with") == 1


def test_load_plan_sorts_no_paths(spark):
    commits = spark.range(100).selectExpr("'S' as source_name", "cast(id as string) as commit_hash")
    files = commits.selectExpr("source_name", "commit_hash", "'a.mo' as path").filter("commit_hash < '5'")
    sources = spark.createDataFrame([("S", "P=b.mo,a.mo")], "name string, package_file string")
    plan = listing.load_plan(commits, sources, files, spark.createDataFrame([("b.mo",)], "path string"))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["path"] for r in plan.collect()} == {"b.mo"} and plan.count() == 100
