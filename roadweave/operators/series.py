"""Completion of yearly series kept as ARRAY<DOUBLE>, oldest first, one element a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def known(series: Column) -> Column:
    """Number of known slots."""
    return F.size(F.filter(series, lambda v: v.isNotNull()))


def _places(series: Column) -> Column:
    """1-based places of known slots."""
    return F.filter(F.transform(series, lambda v, i: F.when(v.isNotNull(), i + 1)), lambda i: i.isNotNull())


def interpolate(series: Column, places: Column | None = None) -> Column:
    """Interior gaps filled on the straight line between their known neighbours; edges stay null.

    ``places``: those of the known slots, as a column if they are at hand.
    The stretches from each known slot to the next are made one after another, so time grows with the slots.
    """
    places = _places(series) if places is None else places
    n = F.size(places)

    def stretch(p: Column, q: Column) -> Column:
        a, b = F.try_element_at(series, p), F.try_element_at(series, q)
        return F.transform(F.sequence(p, q - 1), lambda i: F.when(i == p, a).otherwise(a + (b - a) * ((i - p) / (q - p))))

    inner = F.flatten(F.zip_with(F.slice(places, F.lit(1), n - 1), F.slice(places, F.lit(2), n - 1), stretch))
    first, last = F.try_element_at(places, F.lit(1)), F.try_element_at(places, F.lit(-1))
    head, tail = F.slice(series, F.lit(1), first - 1), F.slice(series, last, F.size(series) - last + 1)
    return F.when(n > 0, F.concat(head, inner, tail)).otherwise(series)


def with_interpolated(df: DataFrame, series: str, out: str) -> DataFrame:
    """``df`` with ``series`` interpolated as ``out``; the known places are a column on the way, so that they are found once a row."""
    done = df.withColumn("_places", _places(F.col(series)))
    return done.withColumn(out, interpolate(F.col(series), F.col("_places"))).drop("_places")


def with_extrapolated(df: DataFrame, series: str, out: str, window: int = WINDOW) -> DataFrame:
    """Edges filled from the regression line of the ``window`` slots next to each, not below 0; a single value fills all.

    ``series`` must have no interior gaps, so these slots are consecutive and
    the least-squares line has a closed form: the mean of the slots, and for up
    to three of them the slope from first to last.  The terms of both lines
    are columns on the way.
    """
    if window > 3:
        raise ValueError("the closed form holds for windows of up to three slots")
    s, at = F.col(series), lambda i: F.try_element_at(F.col(series), i)
    done = df.withColumn("_places", _places(s))
    done = done.withColumns({"_first": F.array_min("_places"), "_last": F.array_max("_places")})
    done = done.withColumn("_w", F.least(F.lit(window), F.col("_last") - F.col("_first") + 1))
    done = done.withColumns({"_from0": F.col("_first"), "_from1": F.col("_last") - F.col("_w") + 1})
    terms = {}
    for k in "01":
        start = F.col(f"_from{k}")
        values = F.slice(s, F.greatest(start, F.lit(1)), F.greatest("_w", F.lit(1)))
        terms[f"_mean{k}"] = F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.col("_w")
        terms[f"_slope{k}"] = F.coalesce(F.try_divide(at(start + F.col("_w") - 1) - at(start), (F.col("_w") - 1).cast("double")), F.lit(0.0))
        terms[f"_mid{k}"] = start + (F.col("_w") - 1) / 2
    done = done.withColumns(terms)
    line = lambda k, i: F.greatest(F.col(f"_mean{k}") + F.col(f"_slope{k}") * (i + 1 - F.col(f"_mid{k}")), F.lit(0.0))
    single = F.when(F.col("_w") == 1, F.col("_mean0"))
    fill = lambda v, i: F.when(i + 1 < F.col("_first"), F.coalesce(single, line("0", i))).when(i + 1 > F.col("_last"), F.coalesce(single, line("1", i))).otherwise(v)
    done = done.withColumn(out, F.when(F.col("_first").isNotNull(), F.transform(s, fill)).otherwise(s))
    return done.drop("_places", "_first", "_last", "_w", "_from0", "_from1", *terms)


def label(series: Column) -> Column:
    """complet, geo_knn (nothing known), interpolation (both edges known) or extrapolation."""
    n = known(series)
    edges = F.try_element_at(series, F.lit(1)).isNotNull() & F.try_element_at(series, F.lit(-1)).isNotNull()
    return F.when(n == F.size(series), "complet").when(n == 0, "geo_knn").when(edges, "interpolation").otherwise("extrapolation")


def complete(df: DataFrame, series: str, out: str | None = None) -> DataFrame:
    """``series`` interpolated, then extrapolated, in place or as ``out``.  Row by row: nothing is shuffled."""
    out = out or series
    return with_extrapolated(with_interpolated(df, series, out), out, out)


def complete_counts(df: DataFrame, djma: str = "djma", cam: str = "cam") -> DataFrame:
    """Both series completed, with n_djma_original, n_cam_original, methode_djma, methode_cam.

    Where counts are known but no truck share is, methode_cam is ``mice``: left to the imputer.
    """
    n_djma, n_cam = known(F.col(djma)), known(F.col(cam))
    labels = {"n_djma_original": n_djma, "n_cam_original": n_cam, "methode_djma": label(F.col(djma)), "methode_cam": F.when((n_cam == 0) & (n_djma > 0), "mice").otherwise(label(F.col(cam)))}
    return complete(complete(df.withColumns(labels), djma), cam)


def row_fallback(value: Column, row: Column, overall: Column) -> Column:
    """A missing value becomes the mean of its row's known values, else the overall one."""
    some = F.filter(row, lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, v: s + v), F.size(some).cast("double"))
    return F.coalesce(value, mean, overall)


def wide(series: Column, prefix: str, slots: int = 10) -> dict[str, Column]:
    """Wide columns prefix1 (newest) .. prefixN (oldest)."""
    return {f"{prefix}{k}": F.try_element_at(series, F.lit(slots + 1 - k)) for k in range(1, slots + 1)}


def from_wide(prefix: str, slots: int = 10) -> Column:
    """The series of wide columns prefix1 (newest) .. prefixN (oldest)."""
    return F.array(*[F.col(f"{prefix}{k}").try_cast("double") for k in range(slots, 0, -1)])
