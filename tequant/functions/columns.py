"""Column expressions of the model, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(tags: Column, name: str, *, split_on_colon: bool = True) -> Column:
    """A tag's value, empty where it is missing; up to its first colon if asked. Asked for in this way, a map that is made of columns in the
    same query is never made, and conditions on a tag go down to where its column comes from."""
    value = F.coalesce(tags.getItem(name), F.lit(""))
    return F.substring_index(value, ":", 1) if split_on_colon else value


def subfamily(feature: Column) -> Column:
    """The name before the first ``#``."""
    return F.regexp_replace(feature, "#.+", "")


def locus_name(feature: Column) -> Column:
    """The name without its class: the first ``#`` up to the next ``~``."""
    return F.regexp_replace(feature, "^(.*?)#[^~]+", "$1")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters, up to the end of the shorter string."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x != y).cast("int"), F.lit(0)))
    return F.aggregate(differs, F.lit(0), lambda s, v: s + v)


def round3(x: Column) -> Column:
    """Three decimals, halves to even."""
    return F.rint(x * 1000) / 1000
