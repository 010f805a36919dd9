"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Candidates are found by patterns, and each candidate value is counted over the
corpus by distinct repositories and owners. A value that many owners have, or
very many repositories, is a copied example; one that few have looks live. Pattern hits of the three
base kinds are always reported; generic high-entropy tokens only where their
value is owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

#: Fixed patterns of the base kinds, in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_CHARS = 6
#: Runs are matched whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Generic tokens: long runs with a digit; letters and variety are checked after.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
TOKEN_DISTINCT_CHARS = 10
#: Owners, or repositories of any owners, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 50
#: Matches whose places are summed at a time.
BLOCK = 256

KINDS = ("assign", "access", "hex", "token")
SPAN = "struct<start:int,rank:int,end:int,kind:string,mark:bigint>"


def _starts(steps: Column) -> Column:
    """Places of matches from the gaps before them and their sizes.

    Summed within blocks, then over blocks: an array that grows by a value at a
    time is copied each time, which is only cheap while it is short.
    """
    none = F.array().cast("array<int>")

    def walk(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("starts")),
            lambda seen, step: F.struct((seen["at"] + step["gap"] + step["size"]).alias("at"), F.concat(seen["starts"], F.array(seen["at"] + step["gap"])).alias("starts")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: walk(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    bases = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), none.alias("bases")),
        lambda seen, block: F.struct((seen["at"] + block["at"]).alias("at"), F.concat(seen["bases"], F.array(seen["at"])).alias("bases")),
        lambda seen: seen["bases"],
    )
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), bases.alias("base")), lambda x: F.transform(x["block"]["starts"], lambda at: at + x["base"])))


def spans_of(text: Column, pattern: str, rank: int, value_group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points.

    The text between matches comes from splitting by the pattern; adding the
    lengths up gives the places. ``mark`` is a hash of the value group.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    steps = F.transform(F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("size")), lambda s: F.struct(s["gap"].alias("gap"), F.coalesce(s["size"], F.lit(0)).alias("size")))
    walked = _starts(steps)

    def span(hit: Column) -> Column:
        return F.struct(
            hit["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (hit["start"] + F.length(hit["whole"])).alias("end"),
            F.lit(KINDS[rank]).alias("kind"),
            F.xxhash64(hit["value"]).alias("mark"),
            hit["value"].alias("value"),
        )

    zipped = F.arrays_zip(F.slice(walked, F.lit(1), F.size(whole)).alias("start"), whole.alias("whole"), values.alias("value"))
    return F.transform(zipped, span)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["mark"].alias("mark"))).cast(f"array<{SPAN}>")


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One stored row a document: row, doc_id, owner, repo, base and extra spans."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[owner_col].alias("owner"), docs[repo_col].alias("repo"), text.alias("text"))
    text = F.col("text")
    # Where a plain search finds no sign of a kind, its pattern need not run.
    assign = F.when(text.rlike("[:=]"), _bare(F.filter(spans_of(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE_CHARS))).otherwise(_none())
    access = F.when(text.contains("AKIA"), _bare(spans_of(text, ACCESS, 1))).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _bare(spans_of(text, HEX, 2))).otherwise(_none())
    varied = F.filter(spans_of(text, TOKEN, 3), lambda s: s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= TOKEN_DISTINCT_CHARS))
    tokens = F.when(text.rlike(TOKEN), _bare(varied)).otherwise(_none())
    found = rows.select("doc_id", "owner", "repo", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), tokens.alias("token"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    found = found.select("doc_id", "owner", "repo", base.alias("base"), "token")
    apart = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "base", apart.alias("extra")), "secrets")


def ownership(spans: DataFrame) -> DataFrame:
    """(mark, n_repos, n_owners) of every candidate value in the corpus.

    Each step sums before its shuffle, so a value that a third of all rows
    hold sends one row a task.
    """
    places = spans.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["mark"]))).alias("mark"))
    by_owner = places.distinct().groupBy("mark", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("mark").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Spans of secrets in every row, with ownership verdicts.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example. Spans read kind:start:end, ordered by start, then kind. n_example
    counts the spans whose value at least ``example_owners`` owners or
    ``example_repos`` repositories have, n_live the others. A null text counts
    as empty, a null owner or repository is one of its own; very long texts are
    read whole; spans with one start are ordered by kind; each input row gives
    one row, so repeated rows repeat (and count as one repository); an empty
    table gives none; other columns are ignored, whatever their names.
    """
    spans = candidate_spans(docs, id_col, text_col, owner_col, repo_col)
    wide = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    examples = stored(ownership(spans).filter(wide).select("mark", F.lit(True).alias("example")), "examples")
    single = spans.select("row", F.explode(F.concat("base", "extra")).alias("span")).select("row", "span", F.col("span.mark").alias("mark"))
    judged = single.join(checked_broadcast(examples), "mark", "left").select("row", "span", F.coalesce("example", F.lit(False)).alias("example"))
    kept = judged.groupBy("row").agg(F.collect_list(F.struct(F.col("span.start"), F.col("span.rank"), F.col("span.end"), F.col("span.kind"), F.col("example"))).alias("hits"))

    def listed(hits: Column) -> Column:
        return F.array_join(F.transform(hits, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    hits = F.array_sort(F.filter(F.coalesce("hits", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,example:boolean>>")), lambda s: (s["rank"] < 3) | ~s["example"]))
    return (
        spans.join(kept, "row", "left")
        .withColumn("__hits", hits)
        .select(
            "doc_id",
            of_kind(0).alias("n_assign"),
            of_kind(1).alias("n_access"),
            of_kind(2).alias("n_hex"),
            F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
            listed(F.col("__hits")).alias("spans"),
            F.size(F.filter("__hits", lambda s: ~s["example"])).cast("long").alias("n_live"),
            F.size(F.filter("__hits", lambda s: s["example"])).cast("long").alias("n_example"),
        )
    )
