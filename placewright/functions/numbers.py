"""Numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from placewright import fixed_values as fv


def num(c, default: float = 0.0) -> Column:
    """Lenient number: anything unreadable becomes the default."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def safe_ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    out = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def max_share(x: Column, top: Column) -> Column:
    """x / max, clipped to 0..1; 0 when the maximum is not positive."""
    share = clamp01(F.coalesce(F.try_divide(x, top), F.lit(0.0)))
    return F.when(F.coalesce(top, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(share)


def min_max_mean(mean: Column, low: Column, high: Column) -> Column:
    """(mean-min)/(max-min) clamped; degenerate range falls back to the mean."""
    flat = low.isNull() | high.isNull() | (high <= low)
    scaled = F.try_divide(mean - low, high - low)
    return F.when(mean.isNull(), F.lit(None)).when(flat, clamp01(mean)).otherwise(clamp01(scaled))


def blend(*cols: Column) -> Column:
    """Mean of the values that are present; null when none is."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, count.cast("double"))


def aux_adjust(base: Column, aux: Column, strength: float = fv.AUX_STRENGTH) -> Column:
    return F.when(aux.isNull(), clamp01(base)).otherwise(clamp01(base + F.lit(strength) * (aux - F.lit(0.5))))


def log_area(c: Column) -> Column:
    return F.ln(F.greatest(c, F.lit(1.0)))


def overlap_ratio(left: Column, right: Column) -> Column:
    """|left ∩ right| / |left|; 0 when left is empty."""
    inter = F.size(F.array_intersect(left, right)).cast("double")
    return safe_ratio(inter, F.size(F.array_distinct(left)).cast("double"))


def fit_label(c: Column) -> Column:
    out = F.when(c.isNull() | F.isnan(c), fv.FIT_LABEL_NULL)
    for floor, label in fv.FIT_LABELS:
        out = out.when(c >= floor, label)
    return out.otherwise(fv.FIT_LABEL_OTHER)


def bounded(c: Column) -> Column:
    x = F.coalesce(c, F.lit(0.0))
    return F.when(x > 1, F.least(F.lit(1.0), x / 2)).otherwise(clamp01(x))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rad = lambda c: c * F.lit(math.pi) / F.lit(180.0)
    dlat, dlng = rad(lat2 - lat1), rad(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * fv.EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def route_minutes(km: Column, stops: Column) -> Column:
    """Minutes at 18 km/h plus 8 per further stop, at least 10; 0 without distance."""
    extra = F.greatest(stops - 1, F.lit(0)) * 8
    ride = F.round(km / F.lit(18.0) * F.lit(60.0)).cast("long")
    return F.when(km > 0, F.greatest(F.lit(10).cast("long"), ride + extra)).otherwise(F.lit(0).cast("long"))


def valid_coords(lat: Column, lng: Column, box=fv.VALID_BOX) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lng.between(box[2], box[3]), F.lit(False))


def first_numeric(*cols) -> Column:
    return F.coalesce(*[(F.col(c) if isinstance(c, str) else c).try_cast("double") for c in cols])


def dcg_gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel.cast("double")) - F.lit(1.0)) / F.log2(rank.cast("double") + F.lit(1.0))
