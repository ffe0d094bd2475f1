"""Sun, satellite and fixed-grid geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions.nulls import clip


def _rad(c: Column) -> Column:
    return F.radians(c)


def solar_angles(lat: Column, lon: Column, ts: Column) -> dict[str, Column]:
    """Declination and hour angle (radians), then zenith and azimuth (degrees)."""
    b = F.radians((F.dayofyear(ts) - 81) * F.lit(360.0 / 365.0))
    dec = F.radians(F.lit(23.45) * F.sin(b))
    minutes = F.lit(9.87) * F.sin(b * 2) - F.lit(7.53) * F.cos(b) - F.lit(1.5) * F.sin(b)
    hour = F.hour(ts) + F.minute(ts) / 60.0 + (lon * 4.0 + minutes) / 60.0
    angle = F.radians((hour - 12.0) * 15.0)
    cos_zenith = clip(F.sin(_rad(lat)) * F.sin(dec) + F.cos(_rad(lat)) * F.cos(dec) * F.cos(angle), -1.0, 1.0)
    return {"declination": dec, "hour_angle": angle, "solar_zenith": F.degrees(F.acos(cos_zenith))}


def solar_azimuth(lat: Column, declination: Column, hour_angle: Column, zenith: Column) -> Column:
    """Degrees from north, clockwise; the sign of the hour angle picks the quadrant."""
    z = F.radians(zenith)
    cos_az = (F.sin(_rad(lat)) * F.cos(z) - F.sin(declination)) / (
        F.cos(_rad(lat)) * F.greatest(F.sin(z), F.lit(1e-6))
    )
    az = F.degrees(F.acos(clip(cos_az, -1.0, 1.0)))
    return F.when(hour_angle > 0, F.pmod(az + 180.0, F.lit(360.0))).otherwise(F.pmod(F.lit(540.0) - az, F.lit(360.0)))


def earth_centred(lat: Column, lon: Column, height: Column, a: float, b: float) -> tuple[Column, Column, Column]:
    squash = (b * b) / (a * a)
    normal = F.lit(a) / F.sqrt(1 - F.lit(1 - squash) * F.pow(F.sin(_rad(lat)), 2))
    return (
        (normal + height) * F.cos(_rad(lat)) * F.cos(_rad(lon)),
        (normal + height) * F.cos(_rad(lat)) * F.sin(_rad(lon)),
        (normal * squash + height) * F.sin(_rad(lat)),
    )


def view_angles(lat: Column, lon: Column, sat_lon: float, height: float, a: float, b: float) -> dict[str, Column]:
    """Zenith and azimuth of the satellite seen from the pixel, degrees."""
    sat = earth_centred(F.lit(0.0), F.lit(sat_lon), F.lit(height), a, b)
    ground = earth_centred(lat, lon, F.lit(0.0), a, b)
    dx, dy, dz = (s - g for s, g in zip(sat, ground))
    sin_lat, cos_lat, sin_lon, cos_lon = F.sin(_rad(lat)), F.cos(_rad(lat)), F.sin(_rad(lon)), F.cos(_rad(lon))
    up = dx * cos_lat * cos_lon + dy * cos_lat * sin_lon + dz * sin_lat
    east = dy * cos_lon - dx * sin_lon
    north = dz * cos_lat - dx * sin_lat * cos_lon - dy * sin_lat * sin_lon
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    return {
        "view_zenith": F.degrees(F.acos(clip(up / distance, -1.0, 1.0))),
        "view_azimuth": F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)),
    }


def relative_azimuth(sat_azimuth: Column, sun_azimuth: Column) -> Column:
    return F.pmod(sat_azimuth - sun_azimuth, F.lit(360.0))


def glint_angle(solar_zenith: Column, view_zenith: Column, rel_azimuth: Column, sign: int = 1) -> Column:
    """Angle between the two directions; `sign=-1` gives the mirrored (specular) convention."""
    z, v = F.radians(solar_zenith), F.radians(view_zenith)
    inner = F.cos(z) * F.cos(v) + F.sin(z) * F.sin(v) * F.cos(F.radians(rel_azimuth)) * sign
    return F.degrees(F.acos(clip(inner, -1.0, 1.0)))


def fixed_grid_position(x: Column, y: Column, lon_0: float, height: float, a: float, b: float) -> dict[str, Column]:
    """Closed-form inverse of the geostationary projection (sweep x); off-disk gives NULL."""
    big = height + a
    flat = (a * a) / (b * b)
    cos_x, sin_x, cos_y, sin_y = F.cos(x), F.sin(x), F.cos(y), F.sin(y)
    qa = sin_x * sin_x + cos_x * cos_x * (cos_y * cos_y + sin_y * sin_y * flat)
    qb = cos_x * cos_y * (-2.0 * big)
    qc = F.lit(big * big - a * a)
    disc = qb * qb - qa * qc * 4.0
    dist = (-qb - F.sqrt(F.when(disc >= 0, disc))) / (qa * 2.0)
    sx, sy, sz = dist * cos_x * cos_y, -dist * sin_x, dist * cos_x * sin_y
    return {
        "lat": F.degrees(F.atan(sz * flat / F.sqrt((big - sx) * (big - sx) + sy * sy))),
        "lon": F.lit(lon_0) - F.degrees(F.atan(sy / (big - sx))),
    }


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    inner = F.sin(_rad(lat1)) * F.sin(_rad(lat2)) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(_rad(lon2 - lon1))
    return F.acos(clip(inner, -1.0, 1.0)) * radius
