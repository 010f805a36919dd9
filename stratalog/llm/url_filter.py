"""URL filters: rules, and a tree of path templates where no rule fits.

The tree is built for each host from the root down, one level of path segments
at a time. Digits in a segment become ``#``; a segment stays a branch of its own
if it is frequent enough below its node, else it becomes the wildcard ``*``.
What lies deeper than ``DEPTH`` segments is one wildcard ``**``. Addresses that
a rule decides are the labelled ones. Branches whose labelled share is not
significantly off their node's are merged, and an address without a rule is
rejected if the smoothed share of blocked addresses in its branch is too large.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

#: Segments of a template; deeper ones are one wildcard.
DEPTH = 4
#: A segment is a branch of its own with so many addresses and such a share of its node's.
LEAST_ADDRESSES = 5
LEAST_SHARE = 0.02
#: Standard errors by which a branch's share is off its node's, if it isn't merged.
ERRORS = 2.0
#: Weight, in addresses, of the share that a branch's own is smoothed towards.
PRIOR_WEIGHT = 4.0
#: Smoothed share of blocked addresses beyond which a template is pure enough to be rejected.
LIMIT = 0.75

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Addresses of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        """A line like ``block example.org/es/``."""
        verdict, _, place = line.strip().partition(" ")
        host, slash, path = place.strip().partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {line}")
        return cls(verdict, host.lower(), slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


#: The rules of the registered query.
RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty for null."""
    rest = _behind_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?`` or ``#``; empty for null."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one; of equally long ones the first by name.

    The rules are part of the plan: some hundreds at most.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict), reverse=True):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path, runs of digits as ``#``; those beyond ``DEPTH`` are one ``**``."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def path_tree(shapes: DataFrame, roots: list[str]) -> DataFrame:
    """Add ``template`` to rows (``roots``, shape, n, ...): the branch that a shape falls into.

    There is a tree for each value of ``roots``. One round a level: addresses
    are counted by (tree, branch so far, segment), and segments too rare below
    their node become wildcards, so a node keeps ``1 / LEAST_SHARE`` branches of
    its own at most. Each level is written, and read by the next.
    """
    node = [*roots, "template"]
    now = shapes.withColumn("template", F.lit(""))
    for level in range(DEPTH):
        now = stored(now.withColumn("segment", F.get("shape", F.lit(level))), "level")
        counts = now.filter("segment is not null").groupBy(*node, "segment").agg(F.sum("n").alias("n"))
        totals = counts.groupBy(*node).agg(F.sum("n").alias("total"))
        kept = counts.join(totals, node).filter((F.col("n") >= LEAST_ADDRESSES) & (F.col("n") >= LEAST_SHARE * F.col("total")))
        joined = now.join(kept.select(*node, "segment", F.lit(True).alias("own")), [*node, "segment"], "left")
        named = F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("segment")).otherwise("*"))
        now = joined.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(named)).select(*shapes.columns, "template")
    return now.withColumn("template", F.when(F.size("shape") > DEPTH, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))


def _share(blocked: Column, labelled: Column, prior: Column, weight: float = PRIOR_WEIGHT) -> Column:
    return (blocked + F.lit(weight) * prior) / (labelled + F.lit(weight))


def merged_branches(tree: DataFrame) -> DataFrame:
    """(host, template, branch_blocked, branch_labelled) of a tree's templates.

    A template whose share of blocked addresses is within ``ERRORS`` standard
    errors of its host's is merged with the host's others like it; the rest
    stay branches of their own, as do those without a labelled address.
    """
    sums = [F.sum(c).cast("double").alias(c) for c in ("blocked", "labelled")]
    templates = tree.groupBy("host", "template").agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("blocked").alias("hits"), F.sum("labelled").alias("total"))
    off = F.abs(F.col("blocked") * F.col("total") - F.col("labelled") * F.col("hits"))
    apart = (F.col("labelled") == 0) | (off > F.lit(ERRORS) * F.sqrt(F.col("labelled") * F.col("hits") * (F.col("total") - F.col("hits"))))
    named = stored(templates.join(hosts, "host").withColumn("branch", F.when(apart, F.col("template")).otherwise("*")), "branches")
    pooled = named.groupBy("host", "branch").agg(F.sum("blocked").alias("branch_blocked"), F.sum("labelled").alias("branch_labelled"))
    return named.join(pooled, ["host", "branch"]).select("host", "template", "branch_blocked", "branch_labelled")


def judged_shapes(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, verdict) of rows (host, shape, n, blocked, labelled).

    A branch's share of blocked addresses is smoothed towards the share of the
    address's template in a tree of all hosts together, and that one towards the
    share of all labelled addresses.
    """
    counts = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    together = shapes.groupBy("shape").agg(*counts).select(F.lit(True).alias("together"), F.lit("").alias("host"), "shape", "n", "blocked", "labelled")
    trees = shapes.select(F.lit(False).alias("together"), *shapes.columns).unionByName(together)
    trees = stored(path_tree(trees, ["together", "host"]), "trees")
    tree, everywhere = trees.filter("not together"), trees.filter("together")
    sums = everywhere.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()  # one row
    overall = F.lit(sums["b"] / sums["l"] if sums["l"] else 0.0)
    priors = everywhere.groupBy("template").agg(_share(F.sum("blocked"), F.sum("labelled"), overall).alias("prior"))
    priors = everywhere.select("shape", "template").join(priors, "template").select("shape", "prior")
    joined = tree.join(merged_branches(tree), ["host", "template"]).join(priors, "shape")
    score = _share(F.col("branch_blocked"), F.col("branch_labelled"), F.col("prior"))
    return joined.select("host", "shape", "template", F.when(score > LIMIT, "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, rules: tuple[str, ...] | list[str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and template of every address.

    The longest rule that fits decides; ``rule`` is its host and path, null
    without one. Else the smoothed purity of the address's template decides,
    with the addresses under rules as labelled ones; without any labelled
    address nothing is rejected. Null addresses and those without ``://`` have
    empty hosts and paths and are a host of their own.

    Ids don't matter and may be null or repeated: a row gives a row, and
    repeated rows count each time in the tree. Very long addresses are read
    whole; an empty table gives no rows; equal shares at the limit allow; other
    columns are ignored, whatever their names. Addresses are counted by (host,
    shape) before they are shuffled, so a hot host is a few rows of each task.
    """
    known = [Rule.parse(r) for r in rules]
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    name, verdict = longest_rule(known, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "by_rule": verdict, "shape": shape(F.col("path"))})
    blocked, labelled = F.count_if(F.col("by_rule") == "block"), F.count("by_rule")
    shapes = stored(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), blocked.alias("blocked"), labelled.alias("labelled")), "shapes")
    templates = checked_broadcast(stored(judged_shapes(shapes), "verdicts"))
    joined = rows.join(templates, ["host", "shape"])
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "verdict").alias("verdict"), "template")
