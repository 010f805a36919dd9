"""Text helpers on columns, with the semantics of Unicode-aware string methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EMPTY_OUTPUT, TRUNCATED_OUTPUT

#: White space that ``strip`` takes away; \s alone lacks the separators U+001C to U+001F.
BLANK = r"[\s\x1c-\x1f]"
#: Bytes at the end of a canonical text that are looked at.
TAIL_BYTES = 4096
#: Line ends of ``splitlines``.
ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$(?!\n)", "")


def blank_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_line(text: Column) -> Column:
    """First line of a stripped text; empty for a blank one.

    Only the first line is read; white space behind it goes if nothing follows.
    """
    body = blank_to_empty(text)
    line = F.regexp_extract(body, rf"(?U)\A{BLANK}*([^{ENDS}]*)", 1)
    alone = body.rlike(rf"(?U)\A{BLANK}*[^{ENDS}]*{BLANK}*\z")
    return F.when(alone, strip(line)).otherwise(line)


def branch_name(ref: Column) -> Column:
    return F.regexp_replace(ref, "^origin/", "")


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; none for dot files and trailing dots."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"(?s)(?<=[^/])(\.[^./]+)$", 1))


def list_of(text: Column, separator: str = ";") -> Column:
    """Parts of a delimited setting, without empty ones."""
    return F.filter(F.split(blank_to_empty(text), separator), lambda p: p != "")


def load_targets(text: Column) -> Column:
    """``A=p,q;B=r`` as an array of (package, paths); a bare path names its package by its first segment."""
    entries = F.filter(F.transform(F.split(blank_to_empty(text), ";"), strip), lambda e: e != "")

    def parsed(entry: Column) -> Column:
        at = F.instr(entry, "=")
        named = F.struct(
            strip(F.substring(entry, F.lit(1), at - 1)).alias("package"),
            F.filter(F.transform(F.split(F.substring(entry, at + 1, F.length(entry)), ","), strip), lambda p: p != "").alias("paths"),
        )
        bare = F.struct(strip(F.split(entry, "/")[0]).alias("package"), F.array(entry).alias("paths"))
        return F.when(at > 0, named).otherwise(bare)

    return F.transform(entries, parsed)


def main_package(text: Column, source: Column) -> Column:
    """Package of the last load target, else the source's name."""
    targets = load_targets(text)
    return F.when(F.size(targets) > 0, F.element_at(targets, -1)["package"]).otherwise(source)


def class_file(name: Column) -> Column:
    return F.translate(name, ".", "_")


def under_segment(path: Column, segment: str = "canonical_models") -> Column:
    """The path behind the first occurrence of a segment; as it is without one."""
    parts = F.split(path, "/")
    at = F.array_position(parts, segment)
    return F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.size(parts)), "/")).otherwise(path)


def path_key(path: Column) -> Column:
    """(source, commit, class stem) of a stored path; null under three parts."""
    parts = F.filter(F.split(under_segment(path), "/"), lambda p: p != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.when(F.size(parts) >= 3, F.struct(F.get(parts, F.lit(0)).alias("source_name"), F.get(parts, F.lit(1)).alias("commit_hash"), stem.alias("class_stem")))


def dotted_prefixes(name: Column) -> Column:
    """The name and all that it lies in: ``a.b.c``, ``a.b``, ``a``."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def compiler_error(text: Column) -> Column:
    """Stripped and unquoted; empty quotes and null are empty."""
    bare = strip(blank_to_empty(text))
    quoted = bare.startswith('"') & bare.endswith('"')
    inside = strip(F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))))
    return F.when(bare.isin("", '""', "''"), "").when(quoted, inside).otherwise(bare)


def output_problem(text: Column) -> Column:
    """Why a canonical text isn't a complete model; empty if it is. Null counts as empty."""
    body = blank_to_empty(text)
    tail = F.substring(body.cast("binary"), -TAIL_BYTES, TAIL_BYTES).cast("string")
    lines = F.filter(F.split(tail, "\n"), lambda line: line.rlike(r"[^ \t\r\x0b\x0c]"))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    ended = F.coalesce(last.rlike(r"^\s*end\s+[A-Za-z_][A-Za-z0-9_.]*\s*;\s*$"), F.lit(False))
    return F.when(F.octet_length(body) == 0, EMPTY_OUTPUT).when(~ended, TRUNCATED_OUTPUT).otherwise("")


def references(text: Column) -> Column:
    """Numbers behind ``#``, unique and sorted; those beyond 64 bits name nothing and are left out."""
    found = F.transform(F.regexp_extract_all(blank_to_empty(text), F.lit(r"#(\d+)"), F.lit(1)), lambda n: n.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNotNull())))


def tex_number(number: Column) -> Column:
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("{,}"))


def parsed_int(text: Column) -> Column:
    """Digits with separators as a number; blank or odd ones are 0."""
    bare = F.regexp_replace(strip(blank_to_empty(text)), r",|\{,\}", "")
    return F.coalesce(bare.try_cast("bigint"), F.lit(0).cast("bigint"))


def parsed_flag(text: Column) -> Column:
    return F.lower(strip(blank_to_empty(text))).isin("1", "true", "yes", "on")


def metric_words(macro: Column) -> Column:
    """``\\StepOneInput`` as ``input``: words in lower case, without the step."""
    bare = F.regexp_replace(F.regexp_replace(macro, r"^\\", ""), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return strip(F.regexp_replace(F.lower(bare), r"^step (one|two|three|[0-9]+) ", ""))


def first_match(text: Column, cases: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first pattern found. ``.`` stops at \\n only, classes and case are Unicode."""
    found = [F.when(text.rlike(f"(?iduU){pattern}"), label) for pattern, label in cases]
    return F.coalesce(*found, F.lit(otherwise))


def contains_any(text: Column, parts: list[str]) -> Column:
    """First of the parts that occurs whatever its case; null if none."""
    found = [F.when(F.lower(text).contains(part.lower()), part) for part in parts]
    return reduce(lambda a, b: F.coalesce(a, b), found, F.lit(None).cast("string"))
