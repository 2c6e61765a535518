"""Text, map and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelight import fixed


def scene_meta(path: Column) -> Column:
    """Scene file name -> struct(scene_id, acquired_text); the text is '' when no stamp is found."""
    base = F.element_at(F.split(path, "/"), -1)
    d, t = (F.regexp_extract(base, fixed.NAME_STAMP, i) for i in (1, 2))
    part = lambda s, i: F.substring(s, i, 2)
    stamp = F.concat(F.substring(d, 1, 4), F.lit("-"), part(d, 5), F.lit("-"), part(d, 7), F.lit("T"),
                     part(t, 1), F.lit(":"), part(t, 3), F.lit(":"), part(t, 5), F.lit("Z"))
    scene = F.element_at(F.split(base, fixed.NAME_END), 1)
    return F.struct(scene.alias("scene_id"), F.when(d != "", stamp).otherwise("").alias("acquired_text"))


def product_kind(path: Column, override: str = "auto") -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    if override != "auto":
        return F.lit(override)
    return F.when(base.contains("_AnalyticMS_SR"), F.lit("sr")).otherwise(F.lit("toa"))


def mask_sibling(path: Column, suffix: str = "udm2") -> Column:
    """Name of the clear-mask file delivered next to an image file."""
    return F.regexp_replace(path, fixed.MASKED_NAME, f"$1_{suffix}$2.tif")


def band_coefficients(xml: Column) -> Column:
    """Map of band number to reflectance coefficient; unequal or too few entries fail the job."""
    bands = F.regexp_extract_all(xml, F.lit(fixed.BAND_NUMBER), 1)
    coefs = F.regexp_extract_all(xml, F.lit(fixed.BAND_COEFFICIENT), 1)
    good = (F.size(bands) == F.size(coefs)) & (F.size(coefs) >= 4)
    built = F.map_from_arrays(bands.cast("array<int>"), coefs.cast("array<double>"))
    return F.when(good, built).otherwise(F.raise_error(F.lit("band numbers and coefficients do not pair up")))


def scene_prefix(scene_id: Column) -> Column:
    """The 13-character key that manual counts use."""
    return F.substring(F.trim(scene_id), 1, 13)


def notes(*parts: Column, sep: str = " ; ") -> Column:
    """Join the notes that apply, skipping NULL and empty ones."""
    return F.concat_ws(sep, F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes")


def pairs_to_map(key: Column, value: Column) -> Column:
    """Aggregate a bounded set of (key, value) rows into one map."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
