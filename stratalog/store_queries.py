"""Queries of the versioned store and of histories as graphs, and their SQL.

Orders stand for commits: order k has k - 7 for its first parent, so there are
seven lines of descent, and urgent orders merge k // 2. The lines of an order
are its tree: flag and line number make a path, tens of the quantity its blob.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ancestry, distinct, funnel, history, listing, report, snapshots
from .operators.upsert import Store
from .queries import classes, commits, outcome_rows, query, table, versions_history
from .schemas import KEYS
from .scratch import shared_folder, written
from .sources import readers


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", parts=4)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parents and merges of orders."""
    o = table(spark, sf_dir, "orders")
    merged = F.when(F.col("o_orderpriority") == "1-URGENT", F.floor(F.col("o_orderkey") / 2))
    sides = F.array(F.struct((F.col("o_orderkey") - 7).alias("parent"), F.lit(0).alias("place")), F.struct(merged.alias("parent"), F.lit(1).alias("place")))
    return o.select(F.lit("s").alias("source_name"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.explode(sides).alias("p")).select("source_name", "commit_hash", F.col("p.parent").cast("string").alias("parent_hash"), "p.place")


EDGES = "SELECT o_orderkey AS k, o_orderkey - 7 AS parent FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderpriority = '1-URGENT'"
HEADS = "SELECT o_orderkey AS k, 'line ' || (o_orderkey % 7) AS branch FROM orders WHERE o_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)"


@query(
    f"WITH RECURSIVE edges AS MATERIALIZED (SELECT e.k, parent FROM ({EDGES}) e JOIN orders ON o_orderkey = parent), reach(k, branch) AS (SELECT k, branch FROM ({HEADS}) UNION SELECT parent, branch FROM reach JOIN edges USING (k)) "
    "SELECT k::VARCHAR AS commit_hash, string_agg(branch, '; ' ORDER BY branch) FILTER (branch <> 'line 3' OR lone) AS branches, lone AS only_excluded FROM (SELECT *, bool_and(branch = 'line 3') OVER (PARTITION BY k) AS lone FROM (SELECT DISTINCT k, branch FROM reach)) GROUP BY k, lone"
)
def reachable_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches from whose tips each order can be reached, in the funnel's form."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    tips = o.join(o.select((F.col("k") - 7).alias("k")), "k", "left_anti")
    refs = tips.select(F.lit("s").alias("source_name"), F.concat(F.lit("origin/line "), (F.col("k") % 7).cast("string")).alias("branch"), F.col("k").cast("string").alias("commit_hash"))
    known = o.select(F.col("k").cast("string").alias("parent_hash"))
    labels, numbers = ancestry.reach(refs, parents(spark, sf_dir).join(known, "parent_hash", "left_semi"))
    return funnel.commit_refs(ancestry.commit_branches(labels, numbers), ["LINE 3"]).drop("source_name")


TREE = "SELECT l_orderkey AS k, l_returnflag || '/' || l_linenumber || '.mo' AS path, max(l_quantity::INT // 10)::VARCHAR AS blob FROM lineitem GROUP BY ALL"


@query(
    f"WITH tree AS MATERIALIZED ({TREE}), old AS (SELECT o_orderkey AS k, path, blob FROM orders JOIN tree ON tree.k = o_orderkey - 7), "
    "diff AS MATERIALIZED (SELECT coalesce(n.k, o.k) AS k, o.path AS a_path, n.path AS b_path, o.blob AS a, n.blob AS b FROM old o FULL JOIN tree n ON n.k = o.k AND n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR o.blob <> n.blob), "
    "gone AS (SELECT k, a_path, a AS blob, split_part(a_path, '/', 2) AS name FROM diff WHERE b_path IS NULL), came AS (SELECT k, b_path, b AS blob, split_part(b_path, '/', 2) AS name FROM diff WHERE a_path IS NULL), "
    "kept AS MATERIALIZED (SELECT k, a_path, b_path FROM (SELECT *, row_number() OVER (PARTITION BY k, blob, name ORDER BY a_path) AS i FROM gone) JOIN (SELECT *, row_number() OVER (PARTITION BY k, blob, name ORDER BY b_path) AS i FROM came) USING (k, blob, name, i)), "
    "moved AS MATERIALIZED (SELECT k, a_path, b_path FROM (SELECT *, row_number() OVER (PARTITION BY k, blob ORDER BY a_path) AS i FROM gone ANTI JOIN kept USING (k, a_path)) JOIN (SELECT *, row_number() OVER (PARTITION BY k, blob ORDER BY b_path) AS i FROM came ANTI JOIN kept USING (k, b_path)) USING (k, blob, i) UNION ALL SELECT * FROM kept) "
    "SELECT k::VARCHAR AS commit_hash, status, a_path, b_path FROM (SELECT k, 'M' AS status, a_path, b_path FROM diff WHERE a_path IS NOT NULL AND b_path IS NOT NULL UNION ALL SELECT k, 'R', a_path, b_path FROM moved UNION ALL SELECT k, 'D', a_path, NULL FROM gone ANTI JOIN moved USING (k, a_path) UNION ALL SELECT k, 'A', NULL, b_path FROM came ANTI JOIN moved USING (k, b_path))"
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions, deletions, changes and renames of every order's tree against its first parent's."""
    path = F.concat("l_returnflag", F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".mo")).alias("path")
    tree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("commit_hash"), path).agg(F.max(F.floor(F.col("l_quantity").cast("int") / 10)).cast("string").alias("blob"))
    found = snapshots.changes(tree.select(F.lit("s").alias("source_name"), "commit_hash", "path", "blob"), parents(spark, sf_dir))
    return found.select("commit_hash", "status", "a_path", "b_path")


@query("SELECT l_returnflag AS source_name, l_orderkey::VARCHAR AS commit_hash, l_linenumber::VARCHAR AS mo_file_path, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::INT AS is_baseline FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL HAVING l_returnflag <> 'A' OR is_baseline = 1")
def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the store after an upsert, one that replaces, a delete, and a source replaced by less."""
    lines, store, keys = table(spark, sf_dir, "lineitem"), new_store(spark), KEYS["files"]
    key = [F.col("l_returnflag").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.col("l_linenumber").cast("string").alias("mo_file_path")]
    rows = written(lines.groupBy(*key).agg(F.max((F.col("l_linestatus") == "O").cast("int")).alias("open")), "rows")  # read by all changes
    store.upsert("files", rows.withColumn("is_baseline", F.lit(0)), keys)
    opened = rows.filter("open = 1").withColumn("is_baseline", F.lit(1))
    store.upsert("files", opened, keys)
    store.transact(lambda t: (t.delete("files", rows.filter("mo_file_path = '7'"), keys), t.replace_sources("files", opened.filter("source_name = 'A' and mo_file_path < '7'"), ["A"])))
    store.clean(keep=1, grace=0)
    return store.read("files")


@query("SELECT o_orderkey::VARCHAR AS commit_hash, row_number() OVER (ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) - 1 AS seq FROM orders")
def recorded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits in the order in which the funnel records them."""
    return funnel.in_recorded_order(commits(spark, sf_dir)).select("commit_hash", "seq")


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey) AS id, l_orderkey::VARCHAR AS commit_hash, l_partkey::VARCHAR AS class_name FROM (SELECT DISTINCT l_orderkey, l_partkey, year(l_shipdate) AS l_shipdate FROM lineitem WHERE l_returnflag = 'R')")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of returned lines, logged year by year; a year that is logged again adds nothing."""
    lines, store = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), new_store(spark)
    key = [F.lit("s").alias("source_name"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("commit_hash"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("class_name")]
    rows = lines.select(*key, F.lit("no_classes").alias("failure_type"), F.lit("").alias("compiler_message"), F.date_trunc("year", "l_shipdate").alias("created_at_utc"))
    years = [r[0] for r in rows.select("created_at_utc").distinct().orderBy("created_at_utc").collect()]  # a few
    for year in [*years, *years[-1:]]:
        store.transact(lambda t, year=year: t.append_new("failures", rows.filter(F.col("created_at_utc") == year), ["created_at_utc", "commit_hash", "class_name"], "id"))
    plain = [F.regexp_replace(c, "^0+(?=.)", "").alias(c) for c in ("commit_hash", "class_name")]
    return store.read("failures").select("id", *plain)


@query(
    "WITH c AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END AS s FROM orders), f AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linenumber AS path FROM lineitem), t(s, place, package, rank, path) AS (VALUES ('F', 0, 'A', 0, 'R1'), ('F', 0, 'A', 1, 'all'), ('F', 1, 'B', 0, 'N2'), ('F', 1, 'B', 1, 'A3'), ('O', 0, 'N4', 0, 'N4')), "
    "hits AS (SELECT c.k, place, min_by(t.path, (rank, base)) AS path FROM c JOIN t ON t.s = c.s JOIN (SELECT k, path, 0 AS base FROM f UNION ALL SELECT k, 'all', 1 FROM c UNION ALL SELECT k, 'A3', 1 FROM c WHERE false) x ON x.k = c.k AND x.path = t.path GROUP BY c.k, place) "
    "SELECT c.k::VARCHAR AS commit_hash, t.place, package, hits.path FROM c JOIN (SELECT DISTINCT s, place, package FROM t) t ON t.s = c.s LEFT JOIN hits ON hits.k = c.k AND hits.place = t.place WHERE hits.path IS NOT NULL OR t.place = CASE c.s WHEN 'F' THEN 1 ELSE 0 END"
)
def load_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load targets of all orders: lines are the files of their trees, one file is shared."""
    source = F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("source_name")
    own = table(spark, sf_dir, "orders").select(source, F.col("o_orderkey").cast("string").alias("commit_hash"))
    paths = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_hash"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("path"))
    sources = spark.createDataFrame([("F", "A=R1,all; B = N2 , A3"), ("O", "N4")], "name string, package_file string")
    shared = spark.createDataFrame([("all",)], "path string")
    return listing.load_plan(own, sources, own.join(paths, "commit_hash"), shared).drop("source_name")


HALF = "CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END"


@query(
    f"SELECT k, version_index, event_type, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY event_id)::BIGINT AS version_index FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY k ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM (SELECT event_id, event_type, {HALF} AS k FROM events))) GROUP BY k, version_index, event_type"
)
def runs_of_a_huge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types where one key holds half of all events."""
    e = table(spark, sf_dir, "events").select(F.expr(HALF).alias("k"), "event_id", "event_type")
    found = history.runs(e, ["k"], ["event_id"], "event_type")
    return found.select("k", "version_index", "event_type", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "n")


@query("SELECT l_returnflag AS source_name, year(l_shipdate) AS year, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, year(l_shipdate)), (l_returnflag), ())")
def incremental_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts by flag and year, by flag, and in all, from bits to which years were added one batch after the other."""
    lines, store = table(spark, sf_dir, "lineitem"), new_store(spark)
    rows = lines.select(F.col("l_returnflag").alias("source_name"), F.date_trunc("year", "l_shipdate").alias("day"), F.col("l_partkey").alias("name"))
    for batch in ("day < '1995-01-01'", "day > '1996-12-31' or day is null", "day between '1994-01-01' and '1996-12-31'"):
        distinct.add(store, rows.filter(batch))  # a year comes again
    year = F.year("day").cast("long").alias("year")
    none = F.lit(None)
    parts = [distinct.counts(store, ["source_name", "day"]).select("source_name", year, "n"), distinct.counts(store, ["source_name"]).select("source_name", none.cast("long").alias("year"), "n"), distinct.counts(store, []).select(none.cast("string").alias("source_name"), none.cast("long").alias("year"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


WIDTH = 200


@query(
    "WITH b AS (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events WHERE value IS NOT NULL), p AS (SELECT least(floor((epoch(ts)::DOUBLE - lo) * 200 / (hi - lo)), 199)::INT AS pixel, epoch(ts)::DOUBLE AS x, value AS y FROM events, b WHERE value IS NOT NULL), "
    "c AS (SELECT pixel, unnest([min((x, y)), max((x, y))]) AS xy, unnest([min((y, x)), max((y, x))]) AS yx FROM (SELECT pixel, x, y FROM p) GROUP BY pixel) "
    "SELECT DISTINCT pixel, x, y FROM (SELECT pixel, xy[1] AS x, xy[2] AS y FROM c UNION ALL SELECT pixel, yx[2], yx[1] FROM c)"
)
def figure_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a figure of 200 pixels needs of the series of all events."""
    series = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "value")
    return report.pixel_series(series.select((F.col("at") / 1_000_000).alias("at"), "value"), "at", "value", WIDTH)


@query("SELECT event_id, unnest(CASE WHEN event_id % 5 = 3 THEN [] WHEN user_id % 4 = 0 THEN [event_type || '|1', 'None|0', '7|0'] ELSE [event_type || '|0', 'None|0', '7|0', 'T' || event_type || '|1'] END) AS entry FROM events")
def tolerant_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached listings: entries of wrong types are passed over one by one, records cut short as a whole."""
    e = table(spark, sf_dir, "events")
    odd = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit('{"name": " '), "event_type", F.lit('\\n", "is_experiment": "yes"}, [1, {"name": "x"}]'))).otherwise(F.concat(F.lit('{"name": "'), "event_type", F.lit('"}, "text", 3.5')))
    last = F.when(F.col("user_id") % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"is_experiment": 2, "other": {}, "name": "T'), "event_type", F.lit('"}')))
    record = F.concat(F.lit('{"props": '), F.coalesce("props", F.lit("null")), F.lit(', "classes": ['), odd, F.lit(', {"name": null}, {"name": 7, "is_experiment": []}, {"name": "  "}, {}, '), last, F.lit("]}"))
    payload = F.when(F.col("event_id") % 5 == 3, F.substring(record, F.lit(1), F.length(record) - 1)).otherwise(record)
    found = e.select("event_id", F.explode(readers.listed_classes(payload)).alias("c"))
    return found.select("event_id", F.concat_ws("|", "c.class_name", F.col("c.is_experiment").cast("string")).alias("entry"))


@query(
    "WITH lines AS (SELECT l_orderkey, l_partkey, max(l_suppkey) AS s, max(l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey::VARCHAR AS commit_hash, l_partkey::VARCHAR || '.C' AS class_name, CASE WHEN s % 3 = 0 THEN 'root/s/' || l_orderkey || '/' || l_partkey || '_C.mo' ELSE '' END AS canonical_model_path, "
    "CASE s % 3 WHEN 0 THEN '' WHEN 1 THEN 'Class ' || s || ' not found' ELSE CASE WHEN n = 1 THEN 'saveTotalModel produced no output file' ELSE 'canonical output is empty (0 bytes)' END END AS error_message, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS is_inside_sublibraries_list, CASE WHEN l_partkey % 4 = 0 THEN 'exact' WHEN l_partkey % 2 = 0 THEN 'prefix' ELSE 'none' END AS pilot_match_mode, CASE WHEN l_partkey % 4 = 0 THEN l_partkey || '.C' WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR ELSE '' END AS matched_sublibrary, CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS canonical_produced FROM lines"
)
def class_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all lines as classes: whole texts, messages, empty texts and none, with even parts whitelisted."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_suppkey").alias("s"), F.max("l_linenumber").alias("n"))
    name = F.concat(F.col("l_partkey").cast("string"), F.lit(".C"))
    key = [F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), name.alias("class_name")]
    third = F.col("s") % 3
    text = F.when(third == 0, F.concat(F.lit("model C\nend "), F.lit("C;\n"))).when((third == 2) & (F.col("n") > 1), "")
    message = F.when(third == 1, F.concat(F.lit(" Class "), F.col("s").cast("string"), F.lit(" not found\n")))
    part = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().filter("l_partkey % 2 = 0")
    items = part.select(F.when(F.col("l_partkey") % 4 == 0, name).otherwise(F.col("l_partkey").cast("string")).alias("item"))
    return listing.outcomes(lines.select(*key), lines.select(*key, text.alias("text"), message.alias("error_message")), "root", items).drop("source_name", "is_experiment")


@query(
    "WITH o AS (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR o_orderstatus = 'P' THEN 1 ELSE 0 END AS out FROM orders), l AS (SELECT * FROM lineitem), failed AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'), "
    "sides AS (SELECT 'retained + excluded = input' AS label, (SELECT count(*) FILTER (out = 0) + count(*) FILTER (out = 1) FROM o) AS lhs, (SELECT count(*) FROM orders) AS rhs UNION ALL SELECT 'listed + unlisted commits = retained', (SELECT count(*) FROM o WHERE out = 0 AND o_orderkey IN (SELECT l_orderkey FROM l)) + (SELECT count(*) FROM o WHERE out = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM l)), (SELECT count(*) FROM o WHERE out = 0) "
    "UNION ALL SELECT 'eligible + other = all', (SELECT count(*) FROM l WHERE l_returnflag = 'R') + (SELECT count(*) FROM l WHERE l_returnflag <> 'R'), (SELECT count(*) FROM l) UNION ALL SELECT 'produced + failed = eligible', (SELECT count(*) FROM l WHERE l_returnflag = 'R' AND l_linestatus = 'F') + (SELECT count(*) FROM failed), (SELECT count(*) FROM l WHERE l_returnflag = 'R') "
    "UNION ALL SELECT 'categories = failures', (SELECT count(*) FILTER (l_linenumber = 1) + count(*) FILTER (l_linenumber > 1) FROM failed), (SELECT count(*) FROM failed)) SELECT *, lhs = rhs AS ok FROM sides"
)
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must agree between tables, in one plan that reads each once."""
    return report.checks(commits(spark, sf_dir), classes(spark, sf_dir), outcome_rows(spark, sf_dir))
