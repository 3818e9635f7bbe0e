"""Column functions: seeded uniforms, inverse cumulative draw, shard labels and their natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the key alone: 32 bits of an MD5, so other engines can draw the same."""
    parts = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in key]
    digits = F.substring(F.md5(F.concat_ws(",", *(p.cast("string") for p in parts)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def draw(cumulative: Column, u: Column) -> Column:
    """Index of the first cumulative value above u, the last index if none is."""
    return F.least(F.size(F.filter(cumulative, lambda c: c <= u)), F.size(cumulative) - 1)


def running(values: Column) -> Column:
    """Cumulative sums of an array, from left to right."""
    empty = F.array().cast("array<double>")
    return F.aggregate(values, empty, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))


def shard_label(file_name: Column) -> Column:
    """`count_<label>.csv` or `.pq`, with or without folders, to the label."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"[.](csv|pq)$", ""), "count_", "")


def natural_key(label: Column) -> Column:
    """Sorts digits by value and the rest by text: array of (text before a number, number)."""
    parts = F.regexp_extract_all(label, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^0-9]*)", 1).alias("text"), F.coalesce(F.regexp_extract(p, r"([0-9]*)$", 1).try_cast("bigint"), F.lit(-1)).alias("number")))
