"""Small formulas used as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelight import fixed


def array_median(levels: Column) -> Column:
    """Median of a bounded array; the mean of the middle two for an even length."""
    s, n = F.array_sort(levels), F.size(levels)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo).cast("double") + F.get(s, hi).cast("double")) / 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def size_class(length_m: Column) -> Column:
    lo, hi = fixed.SIZE_EDGES_M
    a, b, c = fixed.SIZE_LABELS
    bad = length_m.isNull() | F.isnan(length_m) | (length_m < 0) | (length_m == float("inf"))
    return (
        F.when(bad, F.raise_error(F.lit("length must be finite and not negative")))
        .when(length_m < lo, a).when(length_m < hi, b).otherwise(c)
    )


def box_shape(w_m: Column, h_m: Column) -> dict[str, Column]:
    """Length, aspect and wake flag of a box."""
    length, short = F.greatest(w_m, h_m), F.greatest(F.least(w_m, h_m), F.lit(1e-6))
    aspect = length / short
    return {"length_m": length, "aspect_ratio": aspect, "wake_flag": (aspect >= fixed.WAKE_ASPECT).cast("int")}


def squash_snr(snr: Column) -> Column:
    return F.tanh(snr / 10.0)


def implied_radius_km(area_km2: Column) -> Column:
    return F.sqrt(area_km2 / F.pi())


def nyquist_hz(fs: Column) -> Column:
    return fs / 2


def support_grade(bright_px: Column) -> Column:
    return (F.when(bright_px == 0, "none").when(bright_px <= fixed.SUPPORT_WEAK_PX, "weak").otherwise("strong"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ndwi(green: Column, nir: Column) -> Column:
    return F.try_divide(green - nir, green + nir)


def reflectance(dn: Column, kind: Column, coefficient: Column) -> Column:
    """Surface products hold reflectance x 10000; sensor products need the band coefficient."""
    return F.when(kind == "sr", dn / fixed.REFLECTANCE_QUANT).otherwise(dn * coefficient)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL when either side is constant or there are no rows.

    Built from covariance, because ``corr`` itself divides by zero on constant input.
    """
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def line_fit(y: Column, x: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept of y on x; NULL when x is constant."""
    both = x.isNotNull() & y.isNotNull()
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(F.when(both, x)))
    return slope, F.avg(F.when(both, y)) - slope * F.avg(F.when(both, x))


def partial_r(rxy: Column, rxz: Column, ryz: Column) -> Column:
    rest = F.greatest(F.lit(0.0), (1 - rxz * rxz) * (1 - ryz * ryz))
    return F.try_divide(rxy - rxz * ryz, F.when(rxz.isNotNull() & ryz.isNotNull(), F.sqrt(rest)))


def scene_score(clear: Column, glint: Column, view: Column, detections: Column) -> Column:
    return (clear * 100 + F.least(glint, F.lit(60.0)) * 0.5 - F.abs(view)
            + F.least(detections, F.lit(5)) * 3.0)


def closeness(pred: Column, true: Column) -> Column:
    """1 - |pred - true| / max(true, 1), within [0, 1]."""
    return clip(1 - F.abs(pred - true) / F.greatest(true, F.lit(1)), 0.0, 1.0)
