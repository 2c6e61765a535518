"""SQL of the ellipsoid formulas that the geodesic queries must equal."""

from __future__ import annotations

from tidelight import fixed

A, FLAT = fixed.WGS84
B = A * (1 - FLAT)


def inverse(source: str, lon1: str, lat1: str, lon2: str, lat2: str, steps: int = 8) -> str:
    """``source`` with ``m`` and ``azimuth_deg``: Vincenty's inverse formula, ``steps`` fixed steps (each gains two to three digits)."""

    def reduced(lat: str) -> str:
        return f"atan({1 - FLAT!r} * tan(radians({lat})))"

    sql = f"SELECT *, {reduced(lat1)} AS u1, {reduced(lat2)} AS u2, radians({lon2} - ({lon1})) AS big FROM {source}"
    sql = f"SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, big AS lam FROM ({sql})"
    for _ in range(steps):
        sql = f"SELECT * EXCLUDE (lam), lam AS lam, sqrt(power(cu2 * sin(lam), 2) + power(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM ({sql})"
        sql = f"SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(lam) / ss END AS sa FROM ({sql})"
        sql = f"SELECT *, 1 - sa * sa AS c2a, cs - CASE WHEN sa * sa = 1 THEN 0 ELSE 2 * su1 * su2 / (1 - sa * sa) END AS c2m FROM ({sql})"
        sql = f"SELECT *, {FLAT!r} / 16 * c2a * (4 + {FLAT!r} * (4 - 3 * c2a)) AS c FROM ({sql})"
        moved = f"big + (1 - c) * {FLAT!r} * sa * (sg + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))"
        last = sql
        sql = f"SELECT * EXCLUDE (lam, ss, cs, sg, sa, c2a, c2m, c), {moved} AS lam FROM ({sql})"
    moved = f"SELECT * EXCLUDE (lam), {moved} AS lam FROM ({last})"
    sql = f"SELECT *, c2a * {(A**2 - B**2) / B**2!r} AS k2 FROM ({moved})"
    sql = f"SELECT *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) AS aa, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) AS bb FROM ({sql})"
    ds = "bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))"
    azimuth = "degrees(atan2(cu2 * sin(lam), cu1 * su2 - su1 * cu2 * cos(lam)))"
    return f"SELECT *, {B!r} * aa * (sg - {ds}) AS m, CASE WHEN {azimuth} < 0 THEN {azimuth} + 360 ELSE {azimuth} END AS azimuth_deg FROM ({sql})"


def unproject(source: str, x: str, y: str, zone: int) -> str:
    """``source`` with ``lon`` and ``lat`` of northern UTM metres (Krueger's series, third order)."""
    n = FLAT / (2 - FLAT)
    radius = 0.9996 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    inner = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    outer = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    sql = f"SELECT *, ({y}) / {radius!r} AS xi, (({x}) - 500000.0) / {radius!r} AS eta FROM {source}"
    xp = " - ".join(["xi", *(f"{b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(inner, 1))])
    ep = " - ".join(["eta", *(f"{b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(inner, 1))])
    sql = f"SELECT *, {xp} AS xp, {ep} AS ep FROM ({sql})"
    sql = f"SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM ({sql})"
    lat = " + ".join(["chi", *(f"{d!r} * sin({2 * j} * chi)" for j, d in enumerate(outer, 1))])
    return f"SELECT *, degrees({lat}) AS lat, degrees(atan2(sinh(ep), cos(xp))) + {zone * 6 - 183} AS lon FROM ({sql})"
