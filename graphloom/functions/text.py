"""Column expressions for paths, names and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def normalize(path: Column) -> Column:
    """A path without empty, . and .. parts; a .. that leads above the top stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    fold = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(fold, "/")


def slug(text: Column) -> Column:
    """A heading's anchor: punctuation leaves, other characters become single dashes; never empty."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"[`*_~\[\](){}:;,.!?/\\]+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", "section").otherwise(out)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def package_of(specifier: Column) -> Column:
    """The package that a bare import names: two parts where it has a scope."""
    parts = F.split(specifier, "/")
    return F.array_join(F.slice(parts, 1, F.when(specifier.startswith("@"), 2).otherwise(1)), "/")


def words(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: F.length(w) >= 2))


def line_at(text: Column, offset: Column) -> Column:
    """The line number, from 1, of a character offset, from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def unquote(literal: Column) -> Column:
    """The inside of a string literal, or null."""
    inside = F.regexp_extract(literal, r"""^\s*(?:"([^"]*)"|'([^']*)'|`([^`]*)`)\s*$""", 0)
    return F.when(inside != "", F.regexp_replace(F.trim(inside), r"""^["'`]|["'`]$""", ""))
