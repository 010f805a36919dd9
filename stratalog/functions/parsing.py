"""Balanced parsing with column functions: signs by a regular expression, depth by running sums."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import ITEM_KEY, NON_SEMANTIC, OWN_VENDOR, VENDOR_KEY
from .text import strip

MACRO = re.compile(r"\\newcommand\{\\([A-Za-z0-9_]+)\}\{")
#: A string literal. Its escapes are matched in groups of groups, which a matcher
#: leaves again, so that literals of many escapes don't exhaust its stack.
ESCAPES = r"(?>(?>(?>\\.[^\"\\]*+){1,60}+){1,60}+)*+"
LITERAL = rf'"[^"\\]*+{ESCAPES}"'
#: A text is a row of these: literals, brackets and commas, and what lies between. A quote
#: without an end is what lies between, too.
TOKEN = rf'(?s){LITERAL}|[(\[{{)\]}},]|(?:[^"(\[{{)\]}},]++|"(?![^"\\]*+{ESCAPES}"))'
#: Tokens whose depths are added up together.
BLOCK = 64


def tokens_of(text: Column) -> Column:
    """A text cut into its tokens; together they are the text. Null for null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _steps(tokens: Column, opening: str, closing: str) -> Column:
    return F.transform(tokens, lambda t: F.when(t.isin(*opening), 1).when(t.isin(*closing), -1).otherwise(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _appended(numbers: Column, start: Column) -> Column:
    """Sums up to each place of a few numbers, on top of ``start``."""
    none = F.array().cast("array<int>")
    return F.aggregate(numbers, none, lambda out, x: F.array_append(out, F.coalesce(F.get(out, F.size(out) - 1), start) + x))


def _running(steps: Column) -> Column:
    """Sums up to each place: within blocks, on top of the sums of the blocks before.

    Within a block each sum is the one before and a step, so a place is visited once.
    """

    def blocks(own: Column) -> Column:
        starts = _range(F.ceil(F.size(own) / BLOCK).cast("int"))
        totals = F.transform(starts, lambda b: _total(F.slice(own, b * BLOCK + 1, BLOCK)))
        before = _named(totals, lambda t: F.transform(starts, lambda b: _total(F.slice(t, 1, b))))
        return _named(before, lambda start: F.flatten(F.transform(starts, lambda b: _appended(F.slice(own, b * BLOCK + 1, BLOCK), F.get(start, b)))))

    return _named(steps, lambda own: F.when(F.size(own) <= BLOCK, _appended(own, F.lit(0))).otherwise(blocks(own)))


def mask_literals(text: Column) -> Column:
    """The text with what string literals hold made neutral, length kept."""
    shown = F.transform(tokens_of(text), lambda t: F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1), F.concat(F.lit('"'), F.repeat(F.lit("."), F.length(t) - 2), F.lit('"'))).otherwise(t))
    return F.array_join(shown, "")


def annotation_items(text: Column) -> Column:
    """Items of an annotation's first bracket, cut at the commas that stand in no
    bracket and no literal; none if it is empty, unbalanced or null."""
    tokens = tokens_of(F.coalesce(text, F.lit("")))
    return _named(tokens, lambda t: _named(_running(_steps(t, "(", ")")), lambda depth: _items(t, depth)))


def _items(tokens: Column, depth: Column) -> Column:
    """Items between the first ``(`` and the place where the depth behind it is none again."""
    none = F.array().cast("array<string>")
    first = F.array_position(tokens, "(").cast("int")

    def inside(first: Column) -> Column:
        # Before the first bracket only closing ones can have changed the depth.
        level = F.get(depth, first - 1) - 1
        behind = F.array_position(F.slice(depth, first + 1, F.size(depth)), level).cast("int")
        return _named(behind, lambda n: F.when(n == 0, none).otherwise(_named(F.slice(tokens, first + 1, n - 1), _parts)))

    return _named(first, lambda at: F.when((at == 0) | F.get(depth, at - 1).isNull(), none).otherwise(inside(at)))


def _parts(body: Column) -> Column:
    """Parts of a row of tokens between its top-level commas; a last one that is blank is none."""
    return _named(_running(_steps(body, "([{", ")]}")), lambda depth: _cut(body, depth))


def _cut(body: Column, depth: Column) -> Column:
    places = F.when(F.size(body) > 0, F.sequence(F.lit(1), F.size(body))).otherwise(F.array().cast("array<int>"))
    commas = F.filter(places, lambda i: (F.get(body, i - 1) == ",") & (F.get(depth, i - 1) == 0))

    def between(cuts: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.size(body) + 1)), lambda a, b: strip(F.array_join(F.slice(body, a + 1, b - a - 1), "")))

    def kept(parts: Column) -> Column:
        return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return _named(_named(commas, between), kept)


def macro_of(line: str | None) -> tuple[str, str] | None:
    """Name and balanced body of a macro definition, whatever follows it."""
    found = MACRO.search(line or "")
    if not found:
        return None
    depth = 1
    for at in range(found.end(), len(line)):
        depth += {"{": 1, "}": -1}.get(line[at], 0)
        if depth == 0:
            return found[1], line[found.end() : at]
    return None


def tex_macro(line: Column) -> Column:
    @F.pandas_udf("struct<name:string,body:string>")
    def parsed(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([macro_of(line) or (None, None) for line in lines], columns=["name", "body"])

    return parsed(line)


def item_key(item: Column) -> Column:
    """Name that an item declares; empty if it is malformed."""
    return F.regexp_extract(item, ITEM_KEY, 1)


def non_semantic(key: Column) -> Column:
    """Whether an annotation has no effect: listed, or of another vendor."""
    return key.isin(NON_SEMANTIC) | ~F.coalesce(F.nullif(F.regexp_extract(key, VENDOR_KEY, 1), F.lit("")), F.lit(OWN_VENDOR)).isin(OWN_VENDOR)


def semantic_items(items: Column) -> Column:
    return F.filter(items, lambda item: ~_named(item_key(item), non_semantic))


def clean_annotation(text: Column) -> Column:
    """The annotation with its effective items only; empty if none is left."""
    kept = semantic_items(annotation_items(text))
    return F.when(F.size(kept) > 0, F.concat(F.lit("annotation("), F.array_join(kept, ", "), F.lit(")"))).otherwise("")
