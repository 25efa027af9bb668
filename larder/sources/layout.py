"""Tables laid out for the scans that read them: prices by country, stores along a space-filling curve."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.measure import haversine_km

EARTH_KM = 6371.0
#: Bits of each coordinate in a key of the curve: cells of 0.6 km in latitude.
BITS = 15


def write_prices(prices: DataFrame, path: str) -> None:
    """Price rows as a table of files by country: a scan of one market reads its files only."""
    prices.repartition("country").write.partitionBy("country").parquet(path)


def read_prices(spark: SparkSession, path: str, country: str, city: str) -> DataFrame:
    """A country's rows that hold everywhere or in one city; the country prunes files, the city goes to the scan."""
    return spark.read.parquet(path).where((F.col("country") == country) & F.col("city").isin("*", city))


def read_markets(spark: SparkSession, path: str, markets: DataFrame) -> DataFrame:
    """The rows of the countries in markets (country, and what else it brings): which files are read is known once markets is."""
    return spark.read.parquet(path).join(F.broadcast(markets), "country")


def curve_key(lat: Column, lon: Column) -> Column:
    """The place of a spot on the curve: the bits of its latitude and longitude cells, taken in turns."""

    def spread(cell: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return cell

    def cell(share: Column) -> Column:
        return F.least(F.greatest(F.floor(share * 2**BITS), F.lit(0).cast("long")), F.lit(2**BITS - 1).cast("long"))

    return F.shiftleft(spread(cell((lat + 90) / 180)), 1).bitwiseOR(spread(cell((lon + 180) / 360)))


def boxes(lat: float, lon: float, radius_km: float) -> list[tuple[float, float, float, float]]:
    """Boxes (south, west, north, east) around a circle: one, or two at the date line; all longitudes where it holds a pole."""
    high = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9) + 1e-9
    south, north = lat - high, lat + high
    if south <= -90 or north >= 90:
        return [(max(south, -90.0), -180.0, min(north, 90.0), 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(high)) / math.cos(math.radians(lat))))) + 1e-9
    west, east = lon - wide, lon + wide
    if west < -180:
        return [(south, west + 360, north, 180.0), (south, -180.0, north, east)]
    return [(south, west, north, 180.0), (south, -180.0, north, east - 360)] if east > 180 else [(south, west, north, east)]


def curve_ranges(circles: Iterable[tuple[float, float, float]], most: int = 64) -> list[tuple[int, int]]:
    """Ranges of keys, `most` at most, that hold every spot inside one of the circles (lat, lon, km).

    Quarters of the curve that touch a box are halved until they are a quarter of its height; ranges that follow
    each other become one, and beyond `most` the narrowest gaps are closed.
    """
    found: list[tuple[int, int]] = []
    for circle in circles:
        for south, west, north, east in boxes(*circle):
            fine = max((north - south) / 4, 180 / 2**BITS)
            stack = [(0, -90.0, -180.0, 180.0)]  # first key, south, west, height; a quarter is twice as wide as high
            while stack:
                first, s, w, high = stack.pop()
                if s > north or s + high < south or w > east or w + 2 * high < west:
                    continue
                keys = 4 ** round(math.log2(2**BITS * high / 180))
                if high <= fine or (s >= south and s + high <= north and w >= west and w + 2 * high <= east):
                    found.append((first, first + keys - 1))
                else:
                    half = high / 2
                    stack += [(first + k * keys // 4, s + half * (k // 2), w + high * (k % 2), half) for k in range(4)]
    merged: list[list[int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    gaps = sorted(range(1, len(merged)), key=lambda k: merged[k][0] - merged[k - 1][1])
    closed = set(gaps[: max(0, len(merged) - most)])
    out: list[tuple[int, int]] = []
    for k, (low, high) in enumerate(merged):
        out = [*out[:-1], (out[-1][0], high)] if k in closed else [*out, (low, high)]
    return out


def write_stores(stores: DataFrame, path: str, lat: str = "plat", lon: str = "plon", group_bytes: int = 8 << 20) -> None:
    """Stores in the order of the curve, so that files, row groups and pages each hold a small area."""
    keyed = stores.withColumn("curve", curve_key(F.col(lat), F.col(lon)))
    keyed.repartitionByRange("curve").sortWithinPartitions("curve").write.option("parquet.block.size", group_bytes).parquet(path)


def stores_around(spark: SparkSession, path: str, circles: Sequence[tuple[float, float, float]]) -> DataFrame:
    """Every store inside a circle (lat, lon, km), and some beside: the scan skips what has no key in the circles' ranges."""
    stores = spark.read.parquet(path)
    ranges = [F.col("curve").between(low, high) for low, high in curve_ranges(circles)]
    return stores.where(reduce(lambda a, b: a | b, ranges, F.lit(False)))


def stores_within(spark: SparkSession, path: str, lat: float, lon: float, radius_km: float) -> DataFrame:
    """The stores within a radius, with km; null spots are in no circle."""
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("plat"), F.col("plon"))
    return stores_around(spark, path, [(lat, lon, radius_km)]).withColumn("km", km).where(F.col("km") <= radius_km)
