"""Distances on the sphere and the cells of a grid for distance joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: A degree of latitude is longer than this.
DEGREE_KM = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, earth_km: float = EARTH_KM) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.when(a.isNotNull(), F.lit(2 * earth_km) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))  # least() passes nulls over


def band(lat: Column, km: float) -> Column:
    """Row of the grid whose rows are km high."""
    return F.floor(lat / F.lit(km / DEGREE_KM)).cast("int")


def columns_in(band: Column, km: float) -> Column:
    """How many columns, each at least km wide, a row and its two neighbours have."""
    degrees = km / DEGREE_KM
    far = F.greatest(F.abs((band - 1) * degrees), F.abs((band + 2) * degrees))
    wide = F.lit(1.01 * degrees) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(far, F.lit(90.0)))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / wide)).cast("int")


def column(lon: Column, band: Column, km: float) -> Column:
    n = columns_in(band, km)
    return F.pmod(F.floor((lon + 180) * n / 360).cast("int"), n)


def cell(lat: Column, lon: Column, km: float) -> Column:
    b = band(lat, km)
    return F.struct(b.alias("b"), column(lon, b, km).alias("c"))


def cells_around(lat: Column, lon: Column, km: float) -> Column:
    """All cells in which a point may have neighbours within km: three rows of three columns, around the date line too."""
    b = band(lat, km)

    def row(i: int) -> list[Column]:
        r = b + i
        n, c = columns_in(r, km), column(lon, r, km)
        return [F.struct(r.alias("b"), F.pmod(c + j, n).alias("c")) for j in (-1, 0, 1)]

    return F.array_distinct(F.array(*[x for i in (-1, 0, 1) for x in row(i)]))
