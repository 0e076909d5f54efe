"""Measures of source text as Columns.  Lines are separated by newlines; empty ones don't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The non-empty lines; lines of white space count."""
    return F.filter(F.split(text, "\n", -1), lambda x: x != "")


def line_of_code(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def char_of_code(text: Column, scope: str) -> Column:
    """Of a module all characters, of a function those but newlines."""
    return F.length(text if scope == "module" else F.replace(text, F.lit("\n"), F.lit(""))).cast("long")


def _whole(value: Column, text: Column) -> Column:
    return F.when(F.size(lines(text)) > 0, value).otherwise(F.raise_error(F.lit("the text has no line")).cast("long"))


def max_length_of_line(text: Column, strict: bool = True) -> Column:
    """The longest line; a text without lines raises, or gives null if not ``strict``."""
    value = F.array_max(F.transform(lines(text), F.length)).cast("long")
    return _whole(value, text) if strict else value


def average_length_of_line(text: Column, strict: bool = True) -> Column:
    """Whole characters to a line."""
    total = F.aggregate(lines(text), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    value = F.floor(total / F.nullif(F.size(lines(text)), F.lit(0))).cast("long")
    return _whole(value, text) if strict else value


def no_space_after_comma(text: Column, scope: str) -> Column:
    """Separators followed by the wrong character.  A module's separators are commas, and only a newline may follow;
    a function's are commas and semicolons, and a space, newline or tab may follow.  Separators in a row are one, and
    what stands before the first doesn't count."""
    joined = text if scope == "module" else F.translate(text, ";", ",")
    right = ["\n"] if scope == "module" else [" ", "\n", "\t"]
    rest = F.filter(F.split(joined, ",", -1), lambda x: x != "")
    return F.size(F.filter(F.slice(rest, F.lit(2), F.greatest(F.size(rest), F.lit(1))), lambda x: ~F.substring(x, 1, 1).isin(right))).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def dirname(path: Column) -> Column:
    """The directory of a path, ``Other`` for none."""
    return F.when(path.isNull() | ~F.contains(path, F.lit("/")), F.lit("Other")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def rootname(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)
