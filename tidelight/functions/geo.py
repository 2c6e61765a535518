"""Distances, bearings, map tiles and pixel coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight import fixed

# Explicit types: a type given as text needs a running session when the module is imported.
_RANGE = T.StructType([T.StructField("m", T.DoubleType()), T.StructField("azimuth_deg", T.DoubleType())])


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * fixed.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _vincenty(lon1, lat1, lon2, lat2):
    """Vincenty's inverse formula on arrays: (metres, forward azimuth in degrees)."""
    a, f = fixed.WGS84
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    big_l = np.radians(lon2 - lon1)
    lam = big_l.copy()
    for _ in range(60):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(cu1 * cu2 * sl, ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1 - sa**2
        c2m = cs - np.divide(2 * su1 * su2, c2a, out=np.zeros_like(ss), where=c2a != 0)
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        new = big_l + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        done = np.all(np.abs(new - lam) < 1e-13)
        lam = new
        if done:
            break
    k2 = c2a * (a**2 - b**2) / b**2
    aa = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    bb = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    ds = bb * ss * (c2m + bb / 4 * (cs * (2 * c2m**2 - 1) - bb / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    az = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
    return b * aa * (sigma - ds), az % 360


@F.pandas_udf(_RANGE)
def geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    """Distance and forward azimuth on the WGS84 ellipsoid."""
    m, az = _vincenty(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2)))
    return pd.DataFrame({"m": m, "azimuth_deg": az})


def local_metres(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Flat metre coordinates around latitude ``lat0``."""
    return lon * fixed.M_PER_DEG[0] * F.cos(F.radians(lat0)), lat * fixed.M_PER_DEG[1]


def affine_xy(col: Column, row: Column, t: dict[str, Column], centre: bool = True) -> tuple[Column, Column]:
    """Pixel to map coordinates with affine columns a..f; ``centre`` adds half a pixel."""
    c, r = (col + 0.5, row + 0.5) if centre else (col, row)
    return t["c"] + t["a"] * c + t["b"] * r, t["f"] + t["d"] * c + t["e"] * r


def utm_to_lonlat(x: Column | str, y: Column | str, zone: Column | str) -> Column:
    """Struct lon, lat of northern-hemisphere UTM metres, in degrees (Krueger series, third order in n)."""
    x, y, zone = (F.col(c) if isinstance(c, str) else c for c in (x, y, zone))
    a, f = fixed.WGS84
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def on_sphere(m: Column) -> Column:
        waves = [(b, 2 * j) for j, b in enumerate(beta, 1)]
        xi, eta = m["xi"], m["eta"]
        return F.struct(sum((-b * F.sin(j * xi) * F.cosh(j * eta) for b, j in waves), xi).alias("xi"), sum((-b * F.cos(j * xi) * F.sinh(j * eta) for b, j in waves), eta).alias("eta"))

    def geographic(s: Column) -> Column:
        chi = F.asin(F.sin(s["xi"]) / F.cosh(s["eta"]))
        lat = sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), chi)
        return F.struct((F.degrees(F.atan2(F.sinh(s["eta"]), F.cos(s["xi"]))) + zone * 6 - 183).alias("lon"), F.degrees(lat).alias("lat"))

    metres = F.struct((y.cast("double") / (0.9996 * radius)).alias("xi"), ((x.cast("double") - 500_000.0) / (0.9996 * radius)).alias("eta"))
    return F.transform(F.transform(F.array(metres), on_sphere), geographic)[0]


def box_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The corners UL, UR, LR, LL as an array of (corner, col, row)."""
    def one(name: str, c: Column, r: Column) -> Column:
        return F.struct(F.lit(name).alias("corner"), c.alias("col"), r.alias("row"))
    return F.array(one("ul", x1, y1), one("ur", x2, y1), one("lr", x2, y2), one("ll", x1, y2))


def map_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-map tile x and y. The value is cut toward zero, as an integer cast does."""
    n = float(2**zoom)
    x = ((lon + 180.0) / 360.0 * n).cast("bigint")
    y = ((1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * n).cast("bigint")
    return x, y


def tile_grid(boxes: DataFrame, zoom: int, keep: tuple[str, ...]) -> DataFrame:
    """All map tiles covering each (west, south, east, north) box."""
    x0, y0 = map_tile(F.col("west"), F.col("north"), zoom)
    x1, y1 = map_tile(F.col("east"), F.col("south"), zoom)
    return (
        boxes.select(*keep, F.explode(F.sequence(x0, x1)).alias("tile_x"), y0.alias("_a"), y1.alias("_b"))
        .select(*keep, "tile_x", F.explode(F.sequence("_a", "_b")).alias("tile_y"))
    )


def grid_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Persistence cell of about 50 m. Halves round to even."""
    dlat, dlon = fixed.PERSISTENCE_CELL_DEG
    return F.bround(lat / dlat, 0).cast("bigint"), F.bround(lon / dlon, 0).cast("bigint")


def tile_starts(extent: Column, size: int, overlap: float) -> Column:
    """Starts of overlapping tiles along one axis; the last one touches the edge."""
    step = max(1, round(size * (1.0 - overlap)))
    edge = F.greatest(F.lit(0).cast("bigint"), extent.cast("bigint") - size)
    return F.array_union(F.sequence(F.lit(0).cast("bigint"), edge, F.lit(step).cast("bigint")), F.array(edge))


def image_tiles(scenes: DataFrame, size: int, overlap: float, keep: tuple[str, ...]) -> DataFrame:
    """Overlapping scoring tiles of each (height, width) raster."""
    return (
        scenes.select(*keep, "height", F.explode(tile_starts(F.col("width"), size, overlap)).alias("x0"))
        .select(*keep, "x0", F.explode(tile_starts(F.col("height"), size, overlap)).alias("y0"))
    )


def glint_angle(sun_elevation: Column, view: Column, sat_azimuth: Column, sun_azimuth: Column) -> Column:
    """Angle in degrees between the view ray and the mirrored sun ray."""
    ts, tv = F.radians(90.0 - sun_elevation), F.radians(F.abs(view))
    dphi = F.radians(sat_azimuth - sun_azimuth)
    c = F.cos(tv) * F.cos(ts) - F.sin(tv) * F.sin(ts) * F.cos(dphi)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
