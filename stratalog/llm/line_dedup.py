"""Line dedup by site-relative frequency, with DataFrame functions only.

A line that stands on more than a given share of a host's pages is that site's
boilerplate and is dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small, stored

#: Share of a host's pages beyond which a line is boilerplate. It must repeat: on
#: a host of one page any line stands on all of them.
MAX_RATIO = 0.1
LEAST_PAGES = 2
#: White space that lines are compared without.
AROUND = " \t\x0b\x0c\r"
#: Parts of a host's pages where its lines are too many to be broadcast.
SALTS = 64

#: Fixed patterns by which markup becomes lines.
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|li|ul|ol|nav|br|h1|h2|h3|h4|article|section|header|footer|title|head|body|table|tr|td)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def html_lines(html: Column) -> Column:
    """Visible text of a page, a line for each block."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, BLOCK, "\n"), TAG, "")


def url_host(url: Column) -> Column:
    """Host of an address in lower case; empty if it has none or is null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def drop_site_lines(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """All columns of ``pages`` with the three ``names`` added: the text of the
    lines left, the number of non-blank lines there were, and of those dropped.

    A line is dropped from all pages of a host if more than ``max_ratio`` of the
    host's pages hold it, and ``least_pages`` at least. It counts once a page,
    compared without white space (space, tab, vertical tab, form feed, carriage
    return) around it. Null texts count as empty, null hosts as one host with an
    empty name; repeated rows count as pages; very long texts are read whole; an
    empty table gives no rows; ratios equal to the limit keep the line. ``pages``
    may have columns of any other names; one of the ``names`` is an error.

    Lines travel as 64-bit hashes, and (host, line) pairs are counted before and
    after the shuffle. A host's dropped lines are at most its mean number of
    lines a page divided by the ratio, so they fit beside each page; where they
    are too many to be sent to every task, pages of a host are dealt out over
    ``SALTS`` parts, each with a copy of its host's lines.
    """
    if clash := set(names) & set(pages.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    key, gone, part = (free_name(pages, c) for c in ("site__", "marks__", "part__"))
    site = F.xxhash64(F.coalesce(host, F.lit("")))
    body = F.coalesce(text, F.lit(""))

    def mark(line: Column) -> Column:
        return F.xxhash64(F.btrim(line, F.lit(AROUND)))

    blank = F.xxhash64(F.lit(""))
    marks = F.filter(F.array_distinct(F.transform(F.split(body, "\n", -1), mark)), lambda m: m != blank)
    totals = pages.groupBy(site.alias("site")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    counts = pages.select(site.alias("site"), F.explode(marks).alias("mark")).groupBy("site", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    common = counts.join(totals, "site").filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    dropped = stored(common.groupBy(F.col("site").alias(key)).agg(F.collect_list("mark").alias(gone)), "boilerplate")

    marked = pages.withColumn(key, site)
    if small(dropped):
        joined = marked.join(F.broadcast(dropped), key, "left").drop(key)
    else:
        salted = marked.withColumn(part, F.pmod(F.xxhash64(body), F.lit(SALTS)))
        copies = dropped.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, [key, part], "left").drop(key, part)
    parts = F.split(body, "\n", -1)
    known = F.coalesce(F.col(gone), F.array().cast("array<bigint>"))
    kept = F.when(F.col(gone).isNull(), body).otherwise(F.array_join(F.filter(parts, lambda line: ~F.array_contains(known, mark(line))), "\n"))
    n_lines = F.size(F.filter(parts, lambda line: F.btrim(line, F.lit(AROUND)) != ""))
    n_dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(F.filter(parts, lambda line: F.array_contains(known, mark(line)))))
    return joined.withColumns(dict(zip(names, (kept, n_lines.cast("long"), n_dropped.cast("long")), strict=True))).drop(gone)


def dedup_page_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text left of every page.

    Null addresses have an empty host, null pages no text; repeated rows repeat
    and count as pages; pages are read whole; an empty table gives no rows; other
    columns are ignored. HTML entities stay as they are written. Lines are taken
    out of the markup once and stored.
    """
    rows = stored(pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("body")), "lines")
    cut = drop_site_lines(rows, F.col("host"), F.col("body"), max_ratio, least_pages)
    return cut.select("page_id", "host", "n_lines", "n_dropped", F.col("kept_text").alias("text"))
