"""Metrics of a predicted against a true level list, as native columns (p, t: array<int>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(p: Column, t: Column) -> Column:
    return F.size(p) == F.size(t)


def _share(flags: Column) -> Column:
    """Mean of an array of doubles; null if empty."""
    return F.try_divide(F.aggregate(flags, F.lit(0.0), lambda a, x: a + x), F.size(flags))


def exact_match(p: Column, t: Column) -> Column:
    return (p == t).cast("double")


def per_heading_accuracy(p: Column, t: Column) -> Column:
    """0 if the lengths differ; null for two empty lists."""
    return F.when(~_same_length(p, t), F.lit(0.0)).otherwise(_share(F.zip_with(p, t, lambda a, b: (a == b).cast("double"))))


def _signs(c: Column) -> Column:
    return F.zip_with(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1), lambda hi, lo: F.signum((hi - lo).cast("double")))


def hierarchy_preservation(p: Column, t: Column) -> Column:
    """Share of neighbouring pairs that go up, down or along alike; 0 if the lengths differ or are below two."""
    alike = F.zip_with(_signs(p), _signs(t), lambda a, b: (a == b).cast("double"))
    return F.when(~_same_length(p, t) | (F.size(t) < 2), F.lit(0.0)).otherwise(_share(alike))


def mean_absolute_error(p: Column, t: Column) -> Column:
    """Infinite if the lengths differ; null for two empty lists."""
    return F.when(~_same_length(p, t), F.lit(float("inf"))).otherwise(_share(F.zip_with(p, t, lambda a, b: F.abs(a - b).cast("double"))))


def level_count_match(p: Column, t: Column) -> Column:
    return _same_length(p, t)


def constant_offset(p: Column, t: Column) -> Column:
    """All differences equal (zero too), lists of equal length and not empty."""
    return _same_length(p, t) & (F.size(p) > 0) & (F.size(F.array_distinct(F.zip_with(p, t, lambda a, b: a - b))) == 1)


def lost_in_middle(p: Column, t: Column) -> Column:
    """From eight headings on: both outer quarters above 0.7, the middle below 0.4."""
    n = F.size(p)
    q = F.floor(n / 4).cast("int")
    right = F.zip_with(p, t, lambda a, b: (a == b).cast("double"))
    first, last, middle = F.slice(right, F.lit(1), q), F.slice(right, n - q + 1, q), F.slice(right, q + 1, n - 2 * q)
    return F.when(_same_length(p, t) & (n >= 8), (_share(first) > 0.7) & (_share(last) > 0.7) & (_share(middle) < 0.4)).otherwise(F.lit(False))


ERROR_CLASSES = ["count_mismatch", "correct", "off_by_one", "flat_prediction", "inverted_hierarchy", "lost_in_middle", "other"]


def error_class(p: Column, t: Column) -> Column:
    """First that holds, in the order of ERROR_CLASSES; off_by_one is any constant offset."""
    return (
        F.when(~_same_length(p, t), "count_mismatch").when(p == t, "correct").when(constant_offset(p, t), "off_by_one").when(F.size(F.array_distinct(p)) == 1, "flat_prediction")
        .when(hierarchy_preservation(p, t) < 0.5, "inverted_hierarchy").when(lost_in_middle(p, t), "lost_in_middle").otherwise("other")
    )


def all_metrics(p: Column, t: Column) -> list[Column]:
    return [
        exact_match(p, t).alias("exact_match"), per_heading_accuracy(p, t).alias("per_heading_accuracy"), hierarchy_preservation(p, t).alias("hierarchy_preservation"),
        mean_absolute_error(p, t).alias("mean_absolute_error"), level_count_match(p, t).alias("level_count_match"),
    ]
