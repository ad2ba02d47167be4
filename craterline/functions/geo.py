"""Geodesy, solar angles, relief displacement and planar projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from craterline.constants import MOON_RADIUS_M, PARALLAX_SENSORS
from craterline.functions.common import clip, num


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the lunar sphere."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(MOON_RADIUS_M) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def azimuth_difference(a: Column, b: Column) -> Column:
    """Shortest circular difference in degrees, 0 to 180."""
    d = F.abs(a - b) % F.lit(360.0)
    return F.when(d > 180.0, F.lit(360.0) - d).otherwise(d)


def shadow_azimuth(azimuth: Column) -> Column:
    return (azimuth + F.lit(180.0)) % F.lit(360.0)


def phase_compatibility(a: Column, b: Column) -> Column:
    return clip(F.lit(1.0) - F.abs(a - b) / F.lit(90.0), 0.1, 1.0)


def sensor_constant(sensor: Column, position: int) -> Column:
    """Altitude m (0), GSD m (1), samples (2) or centre sample (3) of a known sensor, else null."""
    scale = 1000.0 if position == 0 else 1.0
    out = F.lit(None).cast("double")
    for name, values in PARALLAX_SENSORS.items():
        out = F.when(sensor == name, F.lit(float(values[position]) * scale)).otherwise(out)
    return out


def tan_look(sample: Column, altitude_m: Column | float, gsd_m: Column | float, center: Column | float) -> Column:
    return (sample - num(center)) * num(gsd_m) / num(altitude_m)


def look_angle(sample: Column, altitude_m: Column | float, gsd_m: Column | float, center: Column | float) -> Column:
    """Cross-track look angle in radians."""
    return F.atan(tan_look(sample, altitude_m, gsd_m, center))


def ground_displacement(elevation: Column, sample: Column, altitude_m, gsd_m, center) -> Column:
    """Horizontal relief displacement in metres; null when an input is null."""
    return -elevation * F.tan(look_angle(sample, altitude_m, gsd_m, center))


def pixel_displacement(elevation: Column, sample: Column, altitude_m, gsd_m, center) -> Column:
    return ground_displacement(elevation, sample, altitude_m, gsd_m, center) / num(gsd_m)


def parallax_corrected(lon: Column, lat: Column, displacement_m: Column, heading_deg: Column | float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude moved by a cross-track displacement for a ground-track heading."""
    across = F.radians(num(heading_deg) + F.lit(90.0))
    to_deg = 180.0 / math.pi
    east = displacement_m * F.sin(across)
    north = displacement_m * F.cos(across)
    new_lon = lon + east / (F.lit(MOON_RADIUS_M) * F.cos(F.radians(lat))) * F.lit(to_deg)
    new_lat = lat + north / F.lit(MOON_RADIUS_M) * F.lit(to_deg)
    return new_lon, new_lat


def max_displacement(elevation_abs: Column, altitude_m, gsd_m, samples, center) -> Column:
    """Largest displacement over the field of view: the last sample of the line."""
    return F.abs(ground_displacement(elevation_abs, num(samples) - F.lit(1.0), altitude_m, gsd_m, center))


def project(h: Column, x: Column, y: Column, guarded: bool = True) -> tuple[Column, Column, Column]:
    """(x', y', w) of a point under a row-major 3x3 transform held as an array of nine.

    ``guarded`` divides by max(|w|, 1e-7), the scoring form; otherwise by w itself.
    """
    k = [F.element_at(h, i + 1) for i in range(9)]
    w = k[6] * x + k[7] * y + k[8]
    d = F.greatest(F.abs(w), F.lit(1e-7)) if guarded else w
    return (k[0] * x + k[1] * y + k[2]) / d, (k[3] * x + k[4] * y + k[5]) / d, w


def dem_resolution_m(ppd: Column | float, radius_m: float = MOON_RADIUS_M) -> Column:
    return F.pi() * F.lit(radius_m) / F.lit(180.0) / num(ppd)


def inside_box(lon: Column, lat: Column, lon_min, lon_max, lat_min, lat_max) -> Column:
    return lon.between(num(lon_min), num(lon_max)) & lat.between(num(lat_min), num(lat_max))


def corridor_contains(valid: Column, p_min: Column, p_max: Column, s_min: Column, s_max: Column,
                      pixel: Column, scan: Column, tolerance: float = 1.0) -> Column:
    """Point within a valid corridor widened by a tolerance in pixels."""
    hit = pixel.between(p_min - tolerance, p_max + tolerance) & scan.between(s_min - tolerance, s_max + tolerance)
    return F.coalesce(valid & hit, F.lit(False))


def boxes_overlap(lat_lo_a, lat_hi_a, lon_lo_a, lon_hi_a, lat_lo_b, lat_hi_b, lon_lo_b, lon_hi_b, strict: bool) -> Column:
    """Interval overlap on both axes; ``strict`` leaves out boxes that only touch. Null when a bound is null."""
    def meet(lo_a, hi_a, lo_b, hi_b) -> Column:
        if strict:
            return (lo_a < hi_b) & (lo_b < hi_a) & (lo_a < hi_a) & (lo_b < hi_b)
        return (lo_a <= hi_b) & (lo_b <= hi_a)

    return meet(lat_lo_a, lat_hi_a, lat_lo_b, lat_hi_b) & meet(lon_lo_a, lon_hi_a, lon_lo_b, lon_hi_b)
