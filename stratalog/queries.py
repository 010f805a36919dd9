"""Queries of the history engine on the driver's tables, and their SQL.

Orders stand for commits, their lines for class listings (``l_returnflag = 'R'``
is the eligibility flag), customers for sources, events for logs and timelines,
documents for messages and errors, pages for paths and references.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import FAILURES
from .functions.numbers import half_even, percent, ratio
from .functions.parsing import annotation_items, mask_literals, semantic_items, tex_macro
from .functions.text import class_file, compiler_error, dotted_prefixes, first_line, first_match, list_of, load_targets, main_package, metric_words, output_problem, parsed_flag, parsed_int, path_key, references, strip, suffix, tex_number, under_segment
from .operators import funnel, history, listing, progress, report, upsert
from .plans.steps import tex_lines
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def registered(run: Query) -> Query:
        FOUND[run.__name__] = (run, sql)
        return run

    return registered


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly to a few tasks a core: a split of a file holds very
    many short rows, and what is computed of each may take long."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the commit table; pending ones stand for excluded."""
    o = table(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "excluded branch").when(F.col("o_orderpriority") == "2-HIGH", "before tag v3.0 (tag date: 2010-01-01)").when(F.col("o_orderpriority") == "3-MEDIUM", "commit message matches 'x'").when(F.col("o_orderstatus") == "P", "no .mo files").otherwise("")
    rows = o.select(F.lit("s").alias("source_name"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderkey").alias("seq"), reason.alias("exclusion_reason"))
    return rows.withColumn("excluded", (F.col("exclusion_reason") != "").cast("int"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of the class listing."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.col("l_partkey").cast("string").alias("class_name"), (F.col("l_returnflag") == "R").cast("int").alias("is_experiment"))


LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"]


def one_row_a_key(sql: str) -> str:
    """The query over one line of each order and line number, as ``versions_history`` takes them."""
    order = ", ".join(f"{c} DESC" for c in LINE_ORDER)
    return sql.replace("lineitem", f"(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1) lineitem")


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible lines as outcomes: those in line status O failed, the first in a commit without a message."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    key = [F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.col("l_partkey").cast("string").alias("class_name")]
    message = F.when((F.col("l_linestatus") == "F") | (F.col("l_linenumber") == 1), "").otherwise("x not found in scope")
    return lines.select(*key, F.lit(1).alias("is_experiment"), F.lit("").alias("canonical_model_path"), message.alias("error_message"), (F.col("l_linenumber") % 2).alias("is_inside_sublibraries_list"), (F.col("l_linestatus") == "F").cast("int").alias("canonical_produced"))


def versions_history(spark: SparkSession, sf_dir: str) -> history.History:
    """Line numbers as sources, customers as the order of commits, ship dates as texts."""
    orders = table(spark, sf_dir, "orders")
    lines = upsert.latest(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER), ["l_orderkey", "l_linenumber"], *LINE_ORDER)
    key = [F.col("l_linenumber").cast("string").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash")]
    own = lines.select(*key, F.col("l_orderkey").alias("o_orderkey")).distinct().join(orders.select("o_orderkey", F.col("o_custkey").alias("seq"), "o_orderstatus", F.concat(F.lit("see #"), F.col("o_custkey").cast("string")).alias("commit_message")), "o_orderkey")
    own = own.select("source_name", "commit_hash", "seq", F.lit("").alias("author_email"), F.lit("").alias("branches"), "commit_message", (F.col("o_orderstatus") == "P").cast("int").alias("excluded"), F.lit("").alias("exclusion_reason"))
    name = F.col("l_partkey").cast("string").alias("class_name")
    made = lines.select(*key, name, F.lit(1).alias("is_experiment"), F.lit(None).cast("string").alias("canonical_model_path"), (F.col("l_returnflag") == "R").cast("int").alias("canonical_produced"))
    failed = lines.filter("l_returnflag = 'A'").select(*key, name, F.col("l_orderkey").alias("id"), F.lit("no_classes").alias("failure_type"), F.lit("").alias("compiler_message"), F.col("l_shipdate").cast("timestamp").alias("created_at_utc"))
    listed = lines.select(*key, name, (F.col("l_returnflag") == "R").cast("int").alias("is_experiment"))
    texts = lines.select(*key, name, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("\n")).alias("text"))
    return history.History(own, listed, made, failed, texts, {"1": "o/r"})


REASON = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'branch' WHEN o_orderpriority = '2-HIGH' THEN 'tag' WHEN o_orderpriority = '3-MEDIUM' THEN 'bot' WHEN o_orderstatus = 'P' THEN 'files' END"
PER_COMMIT = "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY l_orderkey"


@query("SELECT l_orderkey, count(*) AS n_classes, count(*) FILTER (l_returnflag = 'R') AS n_eligible FROM lineitem GROUP BY l_orderkey")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.commit_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R")


@query(f"SELECT round(100 * avg(CASE WHEN n > 0 THEN e::DOUBLE / n ELSE 0 END), 9) AS ratio_mean FROM ({PER_COMMIT})")
def per_commit_ratio_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = listing.commit_counts(classes(spark, sf_dir))
    return counts.agg(F.round(100 * F.avg(ratio(F.col("n_eligible"), F.col("n_classes"))), 9).alias("ratio_mean"))


@query(f"SELECT median(n)::DOUBLE AS median_n, round(avg(n), 9) AS mean_n, max(n) AS max_n FROM ({PER_COMMIT})")
def median_files_per_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = listing.commit_counts(classes(spark, sf_dir))
    return counts.agg(F.median("n_classes").alias("median_n"), F.round(F.avg("n_classes"), 9).alias("mean_n"), F.max("n_classes").alias("max_n"))


@query(f"SELECT round_even(avg(n), 0)::BIGINT AS class_mean, round_even(avg(e), 0)::BIGINT AS eligible_mean, max(e) AS eligible_max FROM ({PER_COMMIT})")
def half_even_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = listing.commit_counts(classes(spark, sf_dir))
    return counts.agg(half_even(F.avg("n_classes")).alias("class_mean"), half_even(F.avg("n_eligible")).alias("eligible_mean"), F.max("n_eligible").alias("eligible_max"))


@query(f"SELECT count(*) AS n FROM orders WHERE ({REASON}) IS NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def retained_without_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.without_listing(commits(spark, sf_dir), classes(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey::VARCHAR AS commit_hash, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) FILTER (l_returnflag <> 'N' OR only_n) AS branches, bool_and(only_n) AS only_excluded FROM (SELECT l_orderkey, l_returnflag, bool_and(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS only_n FROM lineitem) GROUP BY l_orderkey")
def branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.concat(F.lit("origin/"), "l_returnflag").alias("branch"))
    return funnel.commit_refs(refs, ["n"]).drop("source_name")


MESSAGES = [("the", "first"), ("und|der", "second"), (r"\bde\b", "third")]


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)the') THEN 'first' WHEN regexp_matches(text, '(?i)und|der') THEN 'second' WHEN regexp_matches(text, '(?i)\\bde\\b') THEN 'third' ELSE 'other' END AS reason FROM documents")
def ordered_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_match(F.col("text"), MESSAGES, "other").alias("reason"))


@query("SELECT doc_id, split_part(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), 1) AS line FROM documents")
def first_line_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_line(F.col("text")).alias("line"))


@query("SELECT doc_id, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS n FROM documents")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(strip(F.col("text"))).cast("long").alias("n"))


@query(
    "WITH names AS (SELECT p_partkey, replace(p_name, ' ', '.') AS name FROM part), items AS (SELECT DISTINCT split_part(replace(p_name, ' ', '.'), '.', 1) AS item FROM part WHERE p_partkey % 7 = 0 UNION SELECT DISTINCT replace(p_name, ' ', '.') FROM part WHERE p_partkey % 11 = 0), "
    "hits AS (SELECT p_partkey, item, row_number() OVER (PARTITION BY p_partkey ORDER BY length(item) DESC) AS k, name FROM names JOIN items ON name = item OR starts_with(name, item || '.')) "
    "SELECT n.p_partkey, item IS NOT NULL AS matched, CASE WHEN item IS NULL THEN 'none' WHEN item = n.name THEN 'exact' ELSE 'prefix' END AS mode, coalesce(item, '') AS matched_item FROM names n LEFT JOIN hits h ON h.p_partkey = n.p_partkey AND k = 1"
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("class_name"))
    items = part.filter("p_partkey % 7 = 0").select(F.split("class_name", r"\.")[0].alias("item")).union(part.filter("p_partkey % 11 = 0").select("class_name"))
    return listing.match_whitelist(part, items, True).drop("class_name")


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n, split_part(p_name, ' ', 1) AS shortest FROM part")
def dotted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = dotted_prefixes(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(prefixes).cast("long").alias("n"), F.element_at(prefixes, -1).alias("shortest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return upsert.latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query("SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN a.c_mktsegment ELSE 'new' END AS segment FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey")
def upsert_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 > 0").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("segment"))
    return upsert.upsert(old, new, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0")
def insert_absent_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return upsert.insert_absent(c.filter("c_custkey % 3 > 0"), c.withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def delete_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return upsert.delete_keys(c, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return upsert.latest(events, ["user_id"], "ts", "event_id").drop("ts", "event_id")


@query("SELECT user_id, version_index, event_type, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS version_index FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, version_index, event_type")
def semantic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "version_index", "event_type", "n")


@query("WITH r AS (SELECT user_id, version_index, any_value(event_type) AS event_type FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS version_index FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, version_index) SELECT user_id, version_index, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY version_index) AS previous, lead(event_type) OVER (PARTITION BY user_id ORDER BY version_index) AS next FROM r")
def version_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return history.neighbours(found, ["user_id"], "event_type").select("user_id", "version_index", "event_type", "previous", "next")


@query(f"WITH s AS (SELECT l_orderkey, n, d FROM ({PER_COMMIT}) JOIN (SELECT l_orderkey AS k, min(l_shipdate) AS d FROM lineitem GROUP BY l_orderkey) ON k = l_orderkey) SELECT l_orderkey, round(m, 9) AS mean FROM (SELECT l_orderkey, avg(n) OVER w AS m, count(*) OVER w AS c FROM s WINDOW w AS (ORDER BY d, l_orderkey ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)) WHERE c = 50")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("d"))
    return report.moving_average(series, ["d", "l_orderkey"], "n", 50).select("l_orderkey", F.round("mean", 9).alias("mean"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(replace(url, '/', '#') || '#' || page_id || '99999999999999999999', '#([0-9]+)', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL))), ',') AS refs FROM pages")
def linked_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number of every text is beyond 64 bits."""
    shown = F.concat(F.replace(F.col("url"), F.lit("/"), F.lit("#")), F.lit("#"), F.col("page_id").cast("string"), F.lit("99999999999999999999"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(references(shown), ",").alias("refs"))


@query("SELECT event_id, event_id::VARCHAR AS sha, '' AS author_login, event_type AS author_name, user_id AS additions, 0::BIGINT AS deletions, 2 AS files_changed, props AS message FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetched commit payloads; what a payload lacks is empty or 0."""
    e = table(spark, sf_dir, "events")
    author = F.struct(F.struct(F.col("event_type").alias("name")).alias("author"), F.col("props").alias("message"))
    files = F.array(F.struct(F.lit("a.mo").alias("filename")), F.struct(F.lit("b.mo").alias("filename")))
    payload = F.to_json(F.struct(F.col("event_id").cast("string").alias("sha"), author.alias("commit"), F.struct(F.col("user_id").cast("long").alias("additions")).alias("stats"), files.alias("files")))
    return e.select("event_id", history.github_commit(payload).alias("c")).select("event_id", "c.sha", "c.author_login", "c.author_name", "c.additions", "c.deletions", "c.files_changed", "c.message")


@query("SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '[^/](\\.[^./]+)$', 1)) AS suffix FROM pages")
def suffix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", suffix(F.col("url")).alias("suffix"))


@query("SELECT o_orderkey::VARCHAR AS commit_hash, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of wanted commits."""
    raw = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_name"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderdate").cast("timestamp").alias("committed_ts"))
    return readers.commit_dates(raw, classes(spark, sf_dir).filter("is_experiment = 1")).select("commit_hash", "date")


@query(one_row_a_key("SELECT l_linenumber::VARCHAR AS source_name, l_orderkey::VARCHAR AS commit_hash, l_partkey::VARCHAR AS class_name, o_custkey AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_partkey = 7"))
def two_key_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline of one class: first lines as one source, customers as order of commits."""
    return versions_history(spark, sf_dir).get_class_timeline("1", "7").select("source_name", "commit_hash", "class_name", "seq")


@query(f"SELECT b AS label, count(*) AS n FROM (SELECT {REASON} AS b FROM orders) WHERE b IS NOT NULL GROUP BY ALL")
def top_n_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of exclusion reasons, by the engine's buckets."""
    left_out = commits(spark, sf_dir).filter("excluded = 1")
    return left_out.groupBy(report.reason_bucket(F.col("exclusion_reason")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (l_linestatus = 'F') AS complete_commits, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS with_texts FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def scope_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.lit("s").alias("source_name")]
    states = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(*key, F.col("l_orderkey").cast("string").alias("commit_hash"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("processing").alias("status"), (F.col("l_quantity") > 25).cast("int").alias("saved_models_count"))
    scope = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(*key, F.col("o_orderkey").cast("string").alias("commit_hash"))
    return progress.scope_metrics(states, scope)


@query("SELECT state, corrupt, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'orphan' WHEN toxic = 1 AND whole IS NOT TRUE THEN 'missing' WHEN toxic = 0 AND whole THEN 'present' ELSE 'same' END AS state, o.doc_id IS NOT NULL AND coalesce(NOT whole, false) AS corrupt FROM labels o FULL JOIN (SELECT doc_id, n_chars % 2 = 0 AS whole FROM documents) f ON f.doc_id = o.doc_id) GROUP BY ALL")
def full_outer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as outcomes, texts as files; those of odd length are cut off."""
    named = F.concat(F.lit("a/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "labels").select(F.lit("s").alias("source_name"), F.lit("c").alias("commit_hash"), F.col("doc_id").cast("string").alias("class_name"), named.alias("canonical_model_path"), F.lit("").alias("error_message"), F.col("toxic").alias("canonical_produced"))
    files = table(spark, sf_dir, "documents").select(named.alias("path"), F.concat("text", F.when(F.col("n_chars") % 2 == 0, "\nend a;\n").otherwise("\n.")).alias("text"))
    return listing.reconcile(rows, files).groupBy("state", "corrupt").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, count(l_orderkey) AS classes, count(*) FILTER (l_returnflag = 'R') AS saved, coalesce(any_value(f), 0) AS failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, count(*) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) ON k = o_orderkey GROUP BY o_orderkey")
def seed_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(spark, sf_dir).withColumn("canonical_produced", F.col("is_experiment"))
    failed = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"))
    return progress.outcome_counts(rows, failed, commits(spark, sf_dir)).select(F.col("commit_hash").cast("long").alias("o_orderkey"), "classes", "saved", "failed")


@query(f"SELECT (SELECT count(*) FROM orders WHERE ({REASON}) IS NULL) AS commits, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R') AS classes, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS canonical_models, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS canonicalization_failures")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(spark, sf_dir)
    made = rows.withColumns({"canonical_produced": F.col("is_experiment"), "canonical_model_path": F.lit("")})
    failed = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.lit("s").alias("source_name"))
    return history.History(commits(spark, sf_dir), rows, made, failed).summary("s")


@query("SELECT count(*) AS total_rows, count(*) FILTER (l_returnflag = 'R') AS experiment_rows, count(*) FILTER (l_returnflag <> 'R') AS non_experiment_rows, greatest(count(*) FILTER (l_returnflag = 'R'), count(*) - count(*) FILTER (l_linestatus = 'O')) AS total_saved, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS saved_commit_folders, count(*) FILTER (l_linenumber = 1) AS whitelisted_rows, count(*) FILTER (l_linestatus = 'O') AS canonical_failures, count(*) AS total_failures FROM lineitem")
def distinct_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run; lines in status O stand for failures without output."""
    lines, rows = table(spark, sf_dir, "lineitem"), classes(spark, sf_dir)
    made = lines.select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), (F.col("l_returnflag") == "R").cast("int").alias("canonical_produced"), (F.col("l_linenumber") == 1).cast("int").alias("is_inside_sublibraries_list"))
    failed = lines.select(F.when(F.col("l_linestatus") == "O", "canonical_no_output").otherwise("no_classes").alias("failure_type"))
    return progress.totals(made, failed, rows, pilot=False)


@query(f"SELECT count(*) AS \"FilterInputCommits\", count(*) FILTER (b = 'branch') AS \"FilterExclBranches\", count(*) FILTER (b = 'tag') AS \"FilterExclPreVThree\", 0::BIGINT AS \"FilterExclAge\", count(*) FILTER (b = 'bot') AS \"FilterExclBot\", count(*) FILTER (b = 'files') AS \"FilterExclNoMo\", count(*) FILTER (b IS NULL) AS \"FilterRetained\", count(*) FILTER (b IS NULL OR b <> 'branch') AS \"FilterAfterBranches\", count(*) FILTER (b IS NULL OR b NOT IN ('branch', 'tag')) AS \"FilterAfterPreVThree\", count(*) FILTER (b IS NULL OR b = 'files') AS \"FilterAfterBot\", round(100.0 * count(*) FILTER (b IS NULL) / count(*), 9) AS \"FilterRetainedPct\" FROM (SELECT {REASON} AS b FROM orders)")
def funnel_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.funnel_metrics(commits(spark, sf_dir)).withColumn("FilterRetainedPct", F.round("FilterRetainedPct", 9))


@query(f"SELECT b AS bucket, count(*) AS n FROM (SELECT {REASON} AS b FROM orders) GROUP BY ALL")
def reason_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir)
    return rows.groupBy(F.when(F.col("excluded") == 1, report.reason_bucket(F.col("exclusion_reason"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS \"ListDistinctClassNames\", count(*) AS \"ListAllClassVersions\", count(*) FILTER (l_returnflag <> 'R') AS \"ListNonExperimentVersions\", round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*), 9) AS \"ListNonExperimentVersionsPct\", count(*) FILTER (l_returnflag = 'R') AS \"ListExperimentVersions\", round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 9) AS \"ListExperimentVersionsPct\" FROM lineitem")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = listing.listing_totals(classes(spark, sf_dir))
    return row.withColumns({c: F.round(c, 9) for c in row.columns if c.endswith("Pct")})


@query(f"SELECT round_even(avg(n), 0)::BIGINT AS \"GrowthAllClassMean\", max(n) AS \"GrowthAllClassMax\", round_even(avg(e), 0)::BIGINT AS \"GrowthExperimentMean\", max(e) AS \"ListMaxExperimentPerCommit\", round(100 * avg(e::DOUBLE / n), 9) AS \"GrowthExperimentRatioMean\" FROM ({PER_COMMIT})")
def listing_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.growth(listing.commit_counts(classes(spark, sf_dir))).withColumn("GrowthExperimentRatioMean", F.round("GrowthExperimentRatioMean", 9))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def progress_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.by_status(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FILTER (keep OR none) AS branches, bool_and(none) AS only_excluded FROM (SELECT *, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS keep, bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH')) OVER (PARTITION BY o_custkey) AS none FROM orders) GROUP BY o_custkey")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as commits, priorities as branches: those only on excluded ones are told apart."""
    refs = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_name"), F.col("o_custkey").cast("string").alias("commit_hash"), F.concat(F.lit("origin/"), "o_orderpriority").alias("branch"))
    return funnel.commit_refs(refs, ["1-urgent", "2-HIGH"]).select(F.col("commit_hash").cast("long").alias("o_custkey"), "branches", "only_excluded")


@query(f"SELECT o_orderkey FROM orders WHERE ({REASON}) IS NULL AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("processing").alias("status"))
    return progress.remaining(commits(spark, sf_dir), done).select(F.col("commit_hash").cast("long").alias("o_orderkey"))


@query("SELECT sha256(text) AS canonical_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = history.canonical_hash(F.col("text")).alias("canonical_hash")
    return table(spark, sf_dir, "documents").groupBy(digest).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


CLASSIFIED = " ".join(f"WHEN regexp_matches(m, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for p, label in FAILURES)
MESSAGE_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'Class ' || p_name || ' not found in scope' WHEN 1 THEN 'restriction of ' || p_name WHEN 2 THEN 'redeclare ' || p_name WHEN 3 THEN 'base class ' || p_name || ' not found' WHEN 4 THEN 'saveTotalModel produced no output file' ELSE p_name END"


@query(f"SELECT CASE {CLASSIFIED} ELSE 'Other' END AS label, count(*) AS n FROM (SELECT {MESSAGE_SQL} AS m FROM part) GROUP BY ALL")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.expr(MESSAGE_SQL).alias("error_message"), F.lit(0).alias("canonical_produced"))
    return report.failure_histogram(rows)


@query("SELECT count(*) AS n FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linestatus = 'O')")
def load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.lit("s").alias("source_name"), F.col("l_orderkey").cast("string").alias("commit_hash"))
    return report.load_failures(classes(spark, sf_dir), made)


@query("SELECT l_orderkey::VARCHAR AS commit_hash, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS classes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def classes_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.classes_by_commit(classes(spark, sf_dir)).select("commit_hash", F.array_join("classes", ",").alias("classes"))


@query("SELECT doc_id, CASE WHEN t IS NULL OR strlen(t) = 0 THEN 'canonical output is empty (0 bytes)' WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 AND strlen(text) < 4000 THEN '' ELSE 'canonical output is truncated (no terminating ''end <class>;'')' END AS problem FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 4 THEN '' ELSE text END AS t FROM documents)")
def output_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a model: whole ones, such whose end lies beyond the bytes looked at or is missing, and empty ones."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    ended = F.when(k == 0, F.concat("text", F.lit("\nend A.b_1 ;\n \n"))).when((k == 1) & (F.octet_length("text") < 4000), F.concat("text", F.lit("\nend X;"))).otherwise(F.concat("text", F.lit("\nx")))
    return docs.select("doc_id", output_problem(F.when(F.col("doc_id") % 5 == 4, "").otherwise(ended)).alias("problem"))


@query("SELECT o_orderkey, replace(format('{:,}', o_orderkey * 7919), ',', '{,}') AS shown, array_to_string(list_filter(string_split(o_orderpriority, '-'), lambda x: x <> ''), '|') AS parts FROM orders")
def tex_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tex_number(F.col("o_orderkey") * 7919).alias("shown"), F.array_join(list_of(F.col("o_orderpriority"), "-"), "|").alias("parts"))


@query("SELECT o_custkey, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) ELSE 0 END, 9) AS pct FROM orders GROUP BY o_custkey")
def guarded_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count("*").alias("b"))
    return rows.select("o_custkey", F.round(percent(F.col("a"), F.col("b")), 9).alias("pct"))


@query("SELECT l_orderkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq, l_partkey FROM lineitem")
def ordered_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return upsert.numbered(lines.select(*order), order).select("l_orderkey", "seq", "l_partkey")


@query(f"SELECT * FROM (SELECT 'retained + excluded = input' AS label, count(*) AS lhs, count(*) AS rhs, true AS ok FROM orders UNION ALL SELECT 'eligible + other = all', count(*), count(*), true FROM lineitem UNION ALL SELECT 'produced + failed = eligible', count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'R'), true FROM lineitem UNION ALL SELECT 'categories = failures', count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'), count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'), true FROM lineitem UNION ALL SELECT 'listed + unlisted commits = retained', count(*) FILTER (b IS NULL), count(*) FILTER (b IS NULL), true FROM (SELECT {REASON} AS b FROM orders) UNION ALL SELECT 'package load covers load failures', 0, 0, true)")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's checks over one run; a few numbers reach the driver."""
    rows, own, made = classes(spark, sf_dir), commits(spark, sf_dir), outcome_rows(spark, sf_dir)
    values: dict[str, int] = {}
    for frame in (report.funnel_metrics(own), report.listing_metrics(rows), report.outcome_metrics(own, rows, made, 0)):
        values |= frame.first().asDict()
    categories = sum(r["n"] for r in report.failure_histogram(made).collect())  # one row a class of failures
    unlisted = report.without_listing(own, rows).count()
    listed = own.filter("excluded = 0").join(rows.select("source_name", "commit_hash").distinct(), ["source_name", "commit_hash"], "left_semi").count()
    return spark.createDataFrame(report.invariants(values, categories, 0, 0, listed, unlisted), "label string, lhs long, rhs long, ok boolean")


# --- queries of the programming interface


@query(one_row_a_key("SELECT DISTINCT l_linenumber::VARCHAR AS source_name FROM lineitem"))
def api_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).list_sources()


@query(one_row_a_key("SELECT DISTINCT l_orderkey::VARCHAR AS commit_hash FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 2 AND o_orderstatus <> 'P'"))
def api_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).list_commits("2")


@query(one_row_a_key("SELECT DISTINCT l_orderkey::VARCHAR AS commit_hash FROM lineitem WHERE l_linenumber = 2"))
def api_all_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).list_commits("2", include_excluded=True)


@query(one_row_a_key("SELECT DISTINCT '1' AS source_name, '7' AS commit_hash, '' AS author_email, '' AS branches, 'see #' || o_custkey AS commit_message, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS excluded, '' AS exclusion_reason FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderkey = 7"))
def api_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).get_commit("1", "7")


@query(one_row_a_key("SELECT DISTINCT l_partkey::VARCHAR AS class_name FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R'"))
def api_experiment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).list_experiment_classes("3")


@query(one_row_a_key("SELECT l_partkey::VARCHAR AS class_name, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS is_experiment FROM lineitem WHERE l_linenumber = 1 AND l_orderkey = 7"))
def api_enumerated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).get_enumerated_classes("1", "7")


@query(one_row_a_key("SELECT l_linenumber::VARCHAR AS source_name, l_orderkey::VARCHAR AS commit_hash, l_partkey::VARCHAR AS class_name, 1 AS is_experiment, '' AS canonical_model_path FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R')"))
def api_models_for_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = versions_history(spark, sf_dir)
    first = h.outcomes.filter("source_name = '1' and canonical_produced = 1").agg(F.min(F.col("commit_hash").cast("long"))).first()[0]
    return h.get_models_for_commit("1", str(first))


@query(one_row_a_key("SELECT l_linenumber::VARCHAR AS source_name, l_orderkey::VARCHAR AS commit_hash, l_partkey::VARCHAR AS class_name, 'no_classes' AS failure_type, '' AS compiler_message, strftime(l_shipdate, '%Y-%m-%d') AS created FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'A'"))
def api_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).list_canonicalization_failures("2").withColumn("created", F.date_format("created_at_utc", "yyyy-MM-dd")).drop("created_at_utc")


@query(one_row_a_key("SELECT l_quantity::INT::VARCHAR || chr(10) AS text FROM lineitem WHERE l_linenumber = 1 AND l_orderkey = 7"))
def api_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is found in the second place only."""
    h = versions_history(spark, sf_dir)
    name = h.texts.filter("source_name = '1' and commit_hash = '7'").first()
    places, h.texts = h.texts, h.texts.filter("commit_hash <> '7'")
    return h.read_canonical_model("1", "7", name["class_name"] if name else "", places)


@query(one_row_a_key("SELECT l_partkey::VARCHAR AS class_name, l_orderkey::VARCHAR AS commit_hash FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity::INT = 7"))
def api_commits_for_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = hashlib.sha256(b"7\n").hexdigest()
    return versions_history(spark, sf_dir).get_commits_for_canonical("1", digest)


@query(one_row_a_key("SELECT l_orderkey::VARCHAR AS commit_hash FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_partkey = 7"))
def api_commits_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).get_commits_touching_class("1", "7")


VERSIONS = one_row_a_key("SELECT *, CASE WHEN q = lag(q) OVER w THEN 0 ELSE 1 END AS c FROM (SELECT l_partkey, l_orderkey, o_custkey, l_quantity::INT AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'R') WINDOW w AS (PARTITION BY l_partkey ORDER BY o_custkey, l_orderkey::VARCHAR)")


@query(f"SELECT l_partkey::VARCHAR AS class_name, v::BIGINT AS version_index, min_by(l_orderkey::VARCHAR, (o_custkey, l_orderkey::VARCHAR)) AS first_commit, min(o_custkey) AS first_seq, max(o_custkey) AS last_seq, sha256(any_value(q)::VARCHAR || chr(10)) AS canonical_hash, count(*) AS commit_count, '' AS canonical_model_path FROM (SELECT *, sum(c) OVER (PARTITION BY l_partkey ORDER BY o_custkey, l_orderkey::VARCHAR) AS v FROM ({VERSIONS})) GROUP BY l_partkey, v")
def api_semantic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).get_semantic_versions("1")


@query(f"SELECT l_orderkey::VARCHAR AS commit_hash FROM ({VERSIONS}) WHERE c = 1 AND l_partkey = 7")
def api_semantic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_history(spark, sf_dir).get_semantic_change_commits("1", "7")


@query(one_row_a_key("SELECT DISTINCT sha256('7' || chr(10)) AS canonical_hash, 1 AS line_count, 2 AS byte_count, true AS compiles FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity::INT = 7"))
def api_check_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = hashlib.sha256(b"7\n").hexdigest()
    checks = spark.createDataFrame([(digest, True)], "canonical_hash string, compiles boolean")
    return versions_history(spark, sf_dir).get_check_model_result("1", digest, checks)


@query(one_row_a_key("SELECT DISTINCT c_custkey AS number, c_name AS title, '' AS state FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderkey = 7"))
def api_linked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fetched issues."""
    h = versions_history(spark, sf_dir)
    issue = F.to_json(F.struct(F.col("c_custkey").alias("number"), F.col("c_name").alias("title")))
    h.payloads = table(spark, sf_dir, "customer").select(F.lit("o/r").alias("repository"), F.lit("issue").alias("kind"), F.col("c_custkey").cast("string").alias("key"), issue.alias("payload"))
    return h.get_github_linked_issues("1", "7").select("number", "title", "state")


@query("SELECT l_orderkey AS number, 'p' || l_linenumber AS title, '' AS url, '' AS state, l_returnflag = 'R' AS merged FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def api_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a customer's orders as its pull requests."""
    h = versions_history(spark, sf_dir)
    pull = F.struct(F.col("l_orderkey").alias("number"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("title"), F.lit("").alias("html_url"), F.lit("").alias("state"), F.when(F.col("l_returnflag") == "R", "then").alias("merged_at"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    h.payloads = rows.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.to_json(F.collect_list(pull)).alias("payload")).select(F.lit("o/r").alias("repository"), F.lit("pulls").alias("kind"), "key", "payload")
    return h.get_github_pull_requests("1", "7").select("number", "title", "url", "state", "merged")


@query(f"SELECT v::BIGINT AS version_index, l_orderkey::VARCHAR AS commit_hash, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS n_issues, CASE WHEN l_orderkey % 2 = 0 THEN 'info ' || l_orderkey END AS commit, CASE WHEN l_orderkey % 3 = 0 THEN 'pulls ' || o_custkey END AS pulls FROM (SELECT *, sum(c) OVER (PARTITION BY l_partkey ORDER BY o_custkey, l_orderkey::VARCHAR) AS v FROM ({VERSIONS})) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey WHERE c = 1 AND l_partkey = 7")
def api_change_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as issues, even orders as commits and every third one with pull requests, so that some are missing."""
    h = versions_history(spark, sf_dir)
    issues = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("number"), F.col("c_name").alias("title"), F.lit("open").alias("state"))
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    infos = o.filter("o_orderkey % 2 = 0").select(key.alias("commit_hash"), F.concat(F.lit("info "), key).alias("info"))
    pulls = o.filter("o_orderkey % 3 = 0").select(key.alias("commit_hash"), F.concat(F.lit("pulls "), F.col("o_custkey").cast("string")).alias("pulls"))
    return h.semantic_change_context("1", "7", infos, pulls, issues).select("version_index", "commit_hash", "n_issues", "commit", "pulls")


FIRST_OF_CLASS = one_row_a_key("SELECT o_custkey AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag = 'R' AND l_partkey = 7 ORDER BY o_orderkey LIMIT 1")


@query(
    f"SELECT class_name, version_index, first_seq, last_seq, n AS commit_count, previous, next FROM (SELECT *, lag(digest) OVER w AS previous, lead(digest) OVER w AS next FROM (SELECT l_partkey::VARCHAR AS class_name, v::BIGINT AS version_index, sha256(any_value(q)::VARCHAR || chr(10)) AS digest, min(o_custkey) AS first_seq, max(o_custkey) AS last_seq, count(*) AS n "
    f"FROM (SELECT *, sum(c) OVER (PARTITION BY l_partkey ORDER BY o_custkey, l_orderkey::VARCHAR) AS v FROM ({VERSIONS})) WHERE l_partkey = 7 GROUP BY l_partkey, v) WINDOW w AS (ORDER BY version_index)) JOIN ({FIRST_OF_CLASS}) ON place BETWEEN first_seq AND last_seq"
)
def api_neighbour_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a class at one of its commits, with the ones before and after it."""
    h = versions_history(spark, sf_dir)
    at = h.get_commits_touching_class("1", "7").agg(F.min(F.col("commit_hash").cast("long"))).first()[0]
    return h.get_neighbour_versions("1", "7", str(at)).select("class_name", "version_index", "first_seq", "last_seq", "commit_count", "previous", "next")


def fetched(spark: SparkSession, sf_dir: str) -> history.History:
    """Orders as fetched commits, with their lines as files, and customers as issues with labels."""
    h, lines = versions_history(spark, sf_dir), table(spark, sf_dir, "lineitem")
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("filename")))).alias("files"), F.sum("l_linenumber").alias("n"))
    o = table(spark, sf_dir, "orders").join(files, F.col("l_orderkey") == F.col("o_orderkey"))
    author = F.struct(F.struct(F.col("o_orderpriority").alias("name")).alias("author"), F.col("o_orderstatus").alias("message"))
    commit = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("sha"), F.struct(F.col("o_custkey").cast("string").alias("login")).alias("author"), author.alias("commit"), F.struct(F.col("n").alias("additions")).alias("stats"), "files"))
    c = table(spark, sf_dir, "customer")
    issue = F.to_json(F.struct(F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.lit("open").alias("state"), F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.lit("x").alias("name"))).alias("labels")))
    kinds = [o.select(F.lit("o/r").alias("repository"), F.lit("commit").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), commit.alias("payload")), c.select(F.lit("o/r").alias("repository"), F.lit("issue").alias("kind"), F.col("c_custkey").cast("string").alias("key"), issue.alias("payload"))]
    h.payloads = kinds[0].unionByName(kinds[1])
    return h


@query("SELECT o_orderkey::VARCHAR AS sha, o_custkey::VARCHAR AS author_login, o_orderpriority AS author_name, o_orderstatus AS message, sum(l_linenumber)::BIGINT AS additions, count(DISTINCT l_linenumber)::INT AS files_changed, string_agg(DISTINCT 'f' || l_linenumber, ',' ORDER BY 'f' || l_linenumber) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 GROUP BY ALL")
def api_github_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fetched(spark, sf_dir).get_github_commit("1", "7")
    return found.select("sha", "author_login", "author_name", "message", "additions", "files_changed", F.array_join("files", ",").alias("files"))


@query("SELECT c_custkey AS number, c_name AS title, 'open' AS state, '' AS url, c_mktsegment || ',x' AS labels FROM customer WHERE c_custkey = 7")
def api_github_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir).get_github_issue("1", 7).select("number", "title", "state", "url", F.array_join("labels", ",").alias("labels"))


# --- reports and runs


@query("SELECT count(DISTINCT l_orderkey) AS \"CanonCommitsWithExperiment\", (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R') * 100.0 / (SELECT count(*) FROM orders WHERE (" + REASON + ") IS NULL) AS \"CanonCommitsWithExperimentPct\", count(*) FILTER (l_linestatus = 'F') AS \"CanonProducedVersions\", 100.0 * count(*) FILTER (l_linestatus = 'F') / count(*) AS \"CanonProducedVersionsPct\", count(*) FILTER (l_linestatus = 'O') AS \"CanonFailures\", 100.0 * count(*) FILTER (l_linestatus = 'O') / count(*) AS \"CanonFailuresPct\" FROM lineitem WHERE l_returnflag = 'R'")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.outcome_metrics(commits(spark, sf_dir), classes(spark, sf_dir), outcome_rows(spark, sf_dir), 0)


@query("SELECT 'Missing referenced class' AS label, count(*) FILTER (l_linenumber > 1) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' HAVING count(*) FILTER (l_linenumber > 1) > 0 UNION ALL SELECT 'Empty error / unknown', count(*) FILTER (l_linenumber = 1) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' HAVING count(*) FILTER (l_linenumber = 1) > 0 UNION ALL SELECT 'Package load failure', 5")
def failure_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of failures with load failures folded in; failures without a message count."""
    return report.failure_histogram(outcome_rows(spark, sf_dir), 5)


@query(
    f"WITH s AS (SELECT count(*) AS t, count(*) FILTER (b = 'branch') AS br, count(*) FILTER (b = 'bot') AS bot, count(*) FILTER (b = 'tag') AS tag, count(*) FILTER (b = 'files') AS nomo, count(*) FILTER (b IS NULL) AS kept FROM (SELECT {REASON} AS b FROM orders)), f AS (SELECT (SELECT count(*) FROM lineitem) AS p, median(n)::DOUBLE AS m FROM ({PER_COMMIT})) "
    'SELECT t AS "StepOneInputUniqueCommits", br AS "StepOneExcludedBranchesCount", round(100.0 * br / t, 9) AS "StepOneExcludedBranchesPct", bot AS "StepOneExcludedBotCount", round(100.0 * bot / t, 9) AS "StepOneExcludedBotPct", tag AS "StepOneExcludedPreVThreeCount", round(100.0 * tag / t, 9) AS "StepOneExcludedPreVThreePct", nomo AS "StepOneExcludedNoMoCount", round(100.0 * nomo / (nomo + kept), 9) AS "StepOneExcludedNoMoPct", '
    't - kept AS "StepOneTotalExcludedCount", round(100.0 * (t - kept) / t, 9) AS "StepOneTotalExcludedPct", kept AS "TotalCommitsFiltered", p AS "StepOneCommitMoPairs", round(p::DOUBLE / kept, 9) AS "StepOneCommitMoPairsMean", m AS "StepOneCommitMoPairsMedian" FROM s, f'
)
def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summary of the funnel; lines stand for touched files."""
    row = report.funnel_summary(commits(spark, sf_dir), classes(spark, sf_dir))
    return row.withColumns({c: F.round(c, 9) for c in row.columns if c.endswith(("Pct", "Mean"))})


@query(
    "WITH t AS (SELECT count(*) AS t, count(*) FILTER (l_returnflag = 'R') AS e, count(*) FILTER (l_returnflag <> 'R') AS o, greatest(count(*) FILTER (l_returnflag = 'R'), count(*) - count(*) FILTER (l_linestatus = 'O')) AS s, count(*) FILTER (l_linenumber = 1) AS w, count(*) FILTER (l_linestatus = 'O') AS f FROM lineitem), "
    "c AS (SELECT count(*) FILTER (l_linestatus = 'F') AS c, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS x FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) "
    "SELECT v.name, round(v.value, 6) AS value FROM t, c, LATERAL (VALUES ('ProcessedCommitsCount', c::DOUBLE), ('ProcessedCommitsPercentage', 100.0 * c / 10), ('ExtractionFailures', f::DOUBLE), ('ExtractionFailuresCount', f::DOUBLE), ('ExtractionFailuresPercentage', 100.0 * f / e), ('FinalCanonicalModelVersions', s::DOUBLE), ('FinalCanonicalModelVersionsPercentage', 100.0 * s / e), ('StepOneCommitFoldersWithCanonicals', x::DOUBLE), "
    "('StepThreeInputScope', e::DOUBLE), ('StepThreeScopeLabel', NULL::DOUBLE), ('TotalClassVersions', t::DOUBLE), ('ExperimentClassVersions', e::DOUBLE), ('ExperimentClassVersionsPercentage', 100.0 * e / t), ('NonExperimentClassVersions', o::DOUBLE), ('NonExperimentClassVersionsPercentage', 100.0 * o / t), ('WhitelistedExperimentClassVersions', w::DOUBLE), ('WhitelistedExperimentClassVersionsPercentage', 100.0 * w / e)) v(name, value)"
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a run; the label of its scope is no number."""
    rows = progress.run_metrics(distinct_when(spark, sf_dir), scope_semi_join(spark, sf_dir), 10, pilot=False)
    return rows.select("name", F.round(F.col("value").try_cast("double"), 6).alias("value"))


@query("SELECT event_type AS name, max_by(event_id, (user_id, event_id))::VARCHAR AS value FROM events GROUP BY ALL")
def latest_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs in order of their id, events as metric values."""
    e = table(spark, sf_dir, "events")
    logs = e.select(F.col("user_id").alias("id")).distinct().select("id", F.timestamp_seconds("id").alias("generated_at_utc"), F.lit("s").alias("source_name"))
    metrics = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return progress.latest_metrics(metrics, logs)


@query("SELECT o_orderkey::VARCHAR AS commit_hash, 'complete' AS status, n AS enumerated_classes_count FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def listing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.listing_progress(commits(spark, sf_dir), classes(spark, sf_dir), datetime(2021, 1, 1)).select("commit_hash", "status", "enumerated_classes_count")


@query("SELECT 'Key' || n_nationkey AS name, replace(format('{:,}', n_nationkey * 7919 * 1000 + n_regionkey), ',', '{,}') AS body FROM nation")
def tex_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as macros and read again."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7919 * 1000 + F.col("n_regionkey")).alias("v"))
    values = {f"Key{r[0]}": int(r[1]) for r in nations.collect()}  # 25 rows
    return spark.createDataFrame([(x,) for x in tex_lines(values)], "line string").select(tex_macro(F.col("line")).alias("m")).select("m.name", "m.body")


# --- predicates of the funnel


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as commits of their own: names, addresses of mail, account numbers as ages."""
    c = table(spark, sf_dir, "customer")
    key = [F.lit("s").alias("source_name"), F.col("c_custkey").cast("string").alias("commit_hash")]
    at = F.timestamp_seconds(F.lit(1_600_000_000) - F.col("c_custkey") * 86400)
    raw = c.select(*key, F.col("c_custkey").cast("long").alias("seq"), F.col("c_name").alias("author_name"), F.concat(F.lower("c_mktsegment"), F.lit("@x")).alias("author_email"), at.alias("authored_ts"), at.alias("committed_ts"), F.lit("x").alias("message"))
    return raw, c.select(*key, F.lit("origin/m").alias("branch")), c.select(*key, F.lit("a.mo").alias("a_path"), F.lit("b.mo").alias("b_path"))


@query("SELECT c_custkey, CASE WHEN floor(c_custkey) / 365.25 > 0.25 THEN 'age' WHEN contains(lower(c_name), '#0000001') THEN 'author name contains ' || chr(39) || 'CUSTOMER#0000001' || chr(39) WHEN c_mktsegment = 'BUILDING' THEN 'author email contains ' || chr(39) || 'Building@' || chr(39) ELSE '' END AS reason FROM customer")
def age_name_and_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnel.funnel(*people(spark, sf_dir), limit_years=0.25, now=datetime.fromtimestamp(1_600_000_000, timezone.utc).replace(tzinfo=None), bot_names=["CUSTOMER#0000001"], bot_emails=["Building@"])
    reason = F.col("exclusion_reason")
    return found.select(F.col("commit_hash").cast("long").alias("c_custkey"), F.when(reason.startswith("commit date: "), "age").otherwise(reason).alias("reason"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN 'commit message matches ' || chr(39) || '\\bVersion\\s+bump\\b' || chr(39) WHEN o_orderpriority = '1-URGENT' THEN 'commit message matches ' || chr(39) || '\\bUpdate\\s+release\\s+notes\\b' || chr(39) ELSE '' END AS reason FROM orders"
)
def doc_only_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message about documentation is a bot's only if no other kind of file changed; others are a bot's or not by themselves."""
    o = table(spark, sf_dir, "orders")
    extensions = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(".md"), F.lit(".mo"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit(".md"), F.lit(".c"))).otherwise(F.array(F.lit("")))
    number = F.col("o_orderkey").cast("string")
    message = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Fix version bump "), number)).when(F.col("o_orderstatus") == "O", F.concat(number, F.lit(" version  bump"))).otherwise(F.concat(F.lit("update Release notes "), number))
    reason = funnel.bot_reason(F.lit(""), F.lit(""), message, extensions, [], [])
    return o.select("o_orderkey", F.coalesce(reason, F.lit("")).alias("reason"))


# --- text helpers


@query("SELECT page_id, regexp_extract(replace(url, '=', ''), '([^/]*)$', 1) AS package, len(string_split(url, '/')) AS n, CASE WHEN page_id % 2 = 0 THEN 'q' ELSE regexp_extract(replace(url, '=', ''), '([^/]*)$', 1) END AS main FROM pages")
def load_target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as paths of a load target whose package is their last segment."""
    plain = F.replace(F.col("url"), F.lit("="), F.lit(""))
    last = F.element_at(F.split(plain, "/"), -1)
    targets = load_targets(F.concat(F.lit(" "), last, F.lit(" = "), F.replace(plain, F.lit("/"), F.lit(",.")), F.lit(" ;; q=x")))
    return table(spark, sf_dir, "pages").select("page_id", targets[0]["package"].alias("package"), F.size(targets[0]["paths"]).cast("long").alias("n"), main_package(F.when(F.col("page_id") % 2 == 0, F.concat(last, F.lit("=a;q=b"))).otherwise(F.concat(F.lit("q=b;"), last, F.lit("=a"))), F.lit("s")).alias("main"))


@query("SELECT p_partkey, replace(replace(p_name, ' ', '.'), '.', '_') AS file, 'S/' || p_partkey || '/' || split_part(p_name, ' ', 1) || '.mo' AS under, 'S' AS source_name, p_partkey::VARCHAR AS commit_hash, split_part(p_name, ' ', 1) AS class_stem FROM part")
def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split("p_name", " ")[0]
    path = F.concat(F.lit("/x/canonical_models/S/"), F.col("p_partkey").cast("string"), F.lit("/"), first, F.lit(".mo"))
    return table(spark, sf_dir, "part").select("p_partkey", class_file(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("file"), under_segment(path).alias("under"), path_key(path).alias("k")).select("p_partkey", "file", "under", "k.*")


@query("SELECT p_partkey, p_name AS message, p_partkey * 1001 AS number, p_partkey % 4 < 2 AS flag, p_name AS words FROM part")
def small_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    flag = F.element_at(F.array(F.lit("yes "), F.lit("ON"), F.lit("0"), F.lit("")), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", compiler_error(F.concat(F.lit(' " '), "p_name", F.lit('" '))).alias("message"), parsed_int(F.format_number(key * 1001, 0)).alias("number"), parsed_flag(flag).alias("flag"), metric_words(F.concat(F.lit("\\StepTwo"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))).alias("words"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) + 1 AS n, 1 AS kept FROM part")
def annotation_items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a name an item without effect, and one with brackets, a literal and commas that has one."""
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("__V_"), w, F.lit(" = 1")))
    text = F.concat(F.lit("annotation("), F.array_join(words, ", "), F.lit(', experiment(a = {1, 2}, b = "x, \\") y"))'))
    items = annotation_items(text)
    return spread(table(spark, sf_dir, "part")).select("p_partkey", items.alias("items")).select("p_partkey", F.size("items").cast("long").alias("n"), F.size(semantic_items(F.col("items"))).alias("kept"))


@query(
    "SELECT p_partkey, 'version=\"' || p_name || '\"|experiment(StopTime=' || p_size || ')|__Other_' || p_partkey || ' = \"a, b)\"|__OpenModelica_x = 1' AS items, 'experiment(StopTime=' || p_size || ')|__OpenModelica_x = 1' AS kept, "
    "'annotation(version=\"' || repeat('.', length(p_name)) || '\", experiment(StopTime=' || p_size || '), __Other_' || p_partkey || ' = \".....\", __OpenModelica_x = 1)' AS masked FROM part"
)
def annotation_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of annotation texts made of part names, those with an effect, and the text without its literals."""
    text = F.format_string('annotation(version="%s", experiment(StopTime=%s), __Other_%s = "a, b)", __OpenModelica_x = 1)', F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    items = spread(table(spark, sf_dir, "part")).select("p_partkey", annotation_items(text).alias("items"), mask_literals(text).alias("masked"))
    return items.select("p_partkey", F.array_join("items", "|").alias("items"), F.array_join(semantic_items(F.col("items")), "|").alias("kept"), "masked")


@query(
    "SELECT doc_id, n_chars, CASE WHEN source = 'src0' THEN 'excluded branch' WHEN n_chars < 300 THEN 'before tag v1 (tag date: 2020-01-01)' WHEN regexp_matches(lower(trim(split_part(trim(text, chr(32) || chr(10)), chr(10), 1))), '\\bupdate\\s+version\\b') THEN 'commit message matches ''\\bUpdate\\s+version\\b''' WHEN n_chars % 3 = 0 THEN 'no .mo files' ELSE '' END AS exclusion_reason FROM documents"
)
def funnel_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel over documents as commits: sources are branches, short texts are old."""
    docs = table(spark, sf_dir, "documents")
    key = [F.lit("s").alias("source_name"), F.col("doc_id").cast("string").alias("commit_hash")]
    when = F.when(F.col("n_chars") < 300, F.lit(datetime(2019, 1, 1))).otherwise(F.lit(datetime(2021, 1, 1)))
    raw = docs.select(*key, F.col("doc_id").alias("seq"), F.lit("").alias("author_name"), F.lit("").alias("author_email"), when.alias("authored_ts"), when.alias("committed_ts"), F.col("text").alias("message"))
    refs = docs.select(*key, F.concat(F.lit("origin/"), "source").alias("branch"))
    diffs = docs.select(*key, F.when(F.col("n_chars") % 3 == 0, "a.c").otherwise("a.mo").alias("a_path"), F.lit("b.c").alias("b_path"))
    found = funnel.funnel(raw, refs, diffs, ["SRC0"], "v1", datetime(2020, 1, 1))
    return found.withColumn("doc_id", F.col("commit_hash").cast("long")).join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "exclusion_reason")
