"""Projection, distance and soft-constraint penalties as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RADIUS_KM = 6371.0


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Equirectangular (x east, y north) in km around an origin."""
    scale = F.lit(RADIUS_KM) * F.pi() / 180.0
    return (lon - lon0) * F.cos(F.radians(F.lit(lat0))) * scale, (lat - lat0) * scale


def unproject(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    scale = F.lit(RADIUS_KM) * F.pi() / 180.0
    return F.lit(lat0) + y / scale, F.lit(lon0) + x / (scale * F.cos(F.radians(F.lit(lat0))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def hinge(v: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.0), v), 2)


def compass_pair(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Where point 1 lies seen from point 2; ties count as south and west."""
    return (F.when(lat1 > lat2, "north_of").otherwise("south_of"),
            F.when(lon1 > lon2, "east_of").otherwise("west_of"))


def default(params: dict, name: str, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.coalesce(params[name], value)


# Fallbacks for constraint parameters that are not set.
DEFAULTS = {
    "epsilon_km": 1.0, "d_near_km": 10.0, "d_far_km": 50.0, "target_d_km": 10.0,
    "sigma_km": 5.0, "radius_km": 20.0,
}
ACROSS_NEAR_KM = 15.0     # fallback reach of "across" in the energy
ACROSS_EAST_WEIGHT = 0.3  # share of the eastward term in the energy of "across"


def penalty(kind: Column, x1: Column, y1: Column, x2: Column, y2: Column, params: dict,
            for_energy: bool = True) -> Column:
    """Unweighted penalty of one constraint at given end points.

    ``for_energy`` scores ``across`` with its eastward term and ``in_region``
    against the region; the satisfaction score uses the near term alone and
    counts every type it does not know as satisfied.
    """
    p = lambda name: default(params, name, DEFAULTS[name])
    d = euclidean(x1, y1, x2, y2)
    eps = p("epsilon_km")
    out = (
        F.when(kind == "north_of", hinge(y2 + eps - y1))
        .when(kind == "south_of", hinge(y1 - (y2 - eps)))
        .when(kind == "east_of", hinge(x2 + eps - x1))
        .when(kind == "west_of", hinge(x1 - (x2 - eps)))
        .when(kind.isin("near", "co_occurrence"), hinge(d - p("d_near_km")))
        .when(kind == "far", hinge(p("d_far_km") - d))
        .when(kind == "distance_approx",
              F.pow(d - p("target_d_km"), 2) / (F.lit(2.0) * F.pow(p("sigma_km"), 2)))
    )
    if not for_energy:
        return out.when(kind == "across", hinge(d - p("d_near_km"))).otherwise(F.lit(0.0))
    region = euclidean(x1, y1, default(params, "centroid_x_km", x2), default(params, "centroid_y_km", y2))
    return (
        out.when(kind == "across", hinge(d - default(params, "d_near_km", ACROSS_NEAR_KM))
                 + ACROSS_EAST_WEIGHT * hinge(x2 + eps - x1))
        .when(kind == "in_region", hinge(region - p("radius_km")))
        .otherwise(F.lit(0.0))
    )
