"""String helpers for paths, tensor names and number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_PATTERN = r"^encoder\.layers\.(\d+)\."


def group_key(path: Column) -> Column:
    """Third path component from the end; null for a shorter path."""

    return F.try_element_at(F.split(path, "/"), F.lit(-3))


def layer_index(name: Column) -> Column:
    """Layer number in a tensor name, null when there is none."""

    found = F.regexp_extract(name, LAYER_PATTERN, 1)
    return F.when(found != "", found.cast("bigint"))


def layer_suffix(name: Column) -> Column:
    """The name without its layer prefix."""

    return F.regexp_replace(name, LAYER_PATTERN, "")


def numbers(text: Column) -> Column:
    """Whitespace-separated numbers as ``ARRAY<DOUBLE>``."""

    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != "")
    return F.transform(parts, lambda s: s.cast("double"))


def has_any_suffix(name: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | name.endswith(suffix)
    return found
