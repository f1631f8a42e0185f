"""Coordinates: degrees, validity, distance and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, CELL = 6371.0, 0.01
#: What has to be said with any location, and altitude in metres that is plausible.
DISCLAIMER = "GPS coordinates record the location stored in the file's metadata; they do not prove where the photograph was taken."
ALTITUDE = (-1000.0, 12000.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(c: Column) -> Column:
    return F.floor(c / CELL).cast("long")


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """x * 10**digits rounded to a double, and the exact rest of the product (Dekker's splitting)."""
    power = F.lit(float(10**digits))
    product = x * power
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    return product, (high * power - product) + (x - high) * power


def rounded(x: Column, digits: int = 2) -> Column:
    """x rounded to so many decimals by its exact binary value, ties to even; the sign of zero stays.

    For decimals up to 6 and values below a billion. A tie of the product is a tie only if nothing is
    left of it; else the rest says on which side of it the value lies.
    """
    product, rest = _scaled(x, digits)
    tie = F.abs(product - F.rint(product)) == 0.5
    return F.when(tie & (rest > 0), F.rint(product + 0.25)).when(tie & (rest < 0), F.rint(product - 0.25)).otherwise(F.rint(product)) / F.lit(float(10**digits))


def fixed(x: Column, digits: int = 2) -> Column:
    """x as text with so many decimals, rounded like ``rounded``."""
    return F.format_string(f"%.{digits}f", rounded(x, digits))


def location_cell(lat: Column, lon: Column, valid: Column) -> tuple[Column, Column]:
    """(key, label) of the cell of about 1 km that valid coordinates lie in; else null."""
    some = lat.isNotNull() & lon.isNotNull() & valid
    a, b = fixed(lat), fixed(lon)
    return F.when(some, F.concat(a, F.lit(","), b)), F.when(some, F.concat(F.lit("~"), a, F.lit(", "), b, F.lit(" (approx. 1 km cell)")))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column, positive: str, negative: str) -> Column:
    """Signed decimal degrees; negative degrees count by size, minutes and seconds from 60 on are computed all the same."""
    sign = F.when(F.upper(F.trim(ref)) == positive, 1.0).when(F.upper(F.trim(ref)) == negative, -1.0)
    return sign * (F.abs(degrees) + minutes / 60.0 + seconds / 3600.0)


def dms_issues(degrees: Column, minutes: Column, seconds: Column) -> Column:
    flag = lambda c, text: F.when(c, F.lit(text))
    return F.array_compact(F.array(flag(degrees < 0, "degrees negative"), flag(~((minutes >= 0) & (minutes < 60)), "minutes out of range"), flag(~((seconds >= 0) & (seconds < 60)), "seconds out of range")))


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def altitude(value: Column, below: Column) -> Column:
    signed = F.when(below == 1, -value).otherwise(value)
    return F.when(signed.between(*ALTITUDE), signed + 0.0)  # no negative zero


def bearing(value: Column) -> Column:
    return F.pmod(value, F.lit(360.0)) + 0.0  # no negative zero


def osm_link(lat: Column, lon: Column, zoom: int = 15) -> Column:
    return F.format_string("https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=" + str(zoom) + "/%.6f/%.6f", lat, lon, lat, lon)


def near(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_km: float) -> Column:
    """Within a radius; a box that surely holds the circle comes first, so it can prune."""
    reach = radius_km / EARTH_KM * 180.0 / 3.141592653589793 * 1.001
    return lat.between(at_lat - reach, at_lat + reach) & (haversine(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= radius_km)
