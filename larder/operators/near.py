"""The k nearest places of every point, by boxes of points and cells of places that halve together.

Points and places lie on a sphere in space, where distances are chords, so neither the poles nor the date line
are special. Boxes of points and cells of places are cubes whose side is the chord of the radius at level 0 and
halves at each level. A box meets the cells around it, and the nearest cells that hold k places together bound the
k-th distance of every point inside: cells beyond it go. A box that still meets many places, or holds many spots,
is halved with its cells until it meets few. So rows are pairs of a box and a cell, not of a point and a place.

Points at one spot ask once. A spot meets its box's places as one array, and only its k nearest of them (and
those as far as the k-th) become rows. So a task holds places in proportion to boxes, and k rows a spot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ranking import ranked
from larder.sources.scratch import kept, spread

EARTH_KM = 6371.0
#: Levels of halving below the radius; a box is halved while it meets more than MANY times k places or holds more than CROWD spots.
LEVELS, MANY, CROWD = 20, 16, 5000
BOX, CELL = ["bx", "by", "bz"], ["cx", "cy", "cz"]
SLACK, TIES = 1e-6, 1e-3  # km: for the rounding of coordinates, and for that of the caller's distance


def on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": EARTH_KM * F.cos(a) * F.cos(b), "y": EARTH_KM * F.cos(a) * F.sin(b), "z": EARTH_KM * F.sin(a)}


def _square(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (p * p for p in parts))


def _chord(radius_km: float) -> float:
    return 2 * EARTH_KM * math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2)) * (1 + 1e-9) + SLACK


def _located(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with a spot, and where it lies in space."""
    placed = df.withColumns(on_sphere(F.col(lat), F.col(lon)))
    return placed.where(reduce(lambda a, b: a & b, (F.col(v).isNotNull() & ~F.isnan(v) for v in "xyz")))


def _cubes(names: Sequence[str], side: Column | float) -> dict[str, Column]:
    return {name: F.floor(F.col(v) / side) for name, v in zip(names, "xyz", strict=True)}


def _up(names: Sequence[str]) -> dict[str, Column]:
    return {f"up_{name}": F.shiftright(name, 1) for name in names}


def _halved(df: DataFrame, names: Sequence[str], side: float, wider: DataFrame, count: str) -> DataFrame:
    """The cubes of this side inside those of twice the side that `wider` names, with their rows counted."""
    inside = wider.select(*[F.col(name).alias(f"up_{name}") for name in names]).distinct()
    cubes = df.select("x", "y", "z").withColumns(_cubes(names, side)).withColumns(_up(names))
    return cubes.join(inside, list(_up(names)), "left_semi").groupBy(*names, *_up(names)).agg(F.count("*").alias(count))


def _reached(pairs: DataFrame, k: int, side: float) -> DataFrame:
    """Pairs whose cell any point of the box may need: `bound` is how far its k-th place can be, `met` how many places are left."""
    apart = [F.abs(F.col(b) - F.col(c)) for b, c in zip(BOX, CELL, strict=True)]
    least = F.sqrt(_square([F.greatest(a - 1, F.lit(0)) for a in apart])) * side - SLACK
    most = F.sqrt(_square([a + 1 for a in apart])) * side + SLACK
    box = Window.partitionBy(*BOX)
    so_far = box.orderBy("most").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = pairs.withColumns({"least": least, "most": most}).where("least <= bound").withColumn("held", F.sum("n").over(so_far))
    bounded = held.withColumn("bound", F.least("bound", F.min(F.when(F.col("held") >= k, F.col("most"))).over(box)))
    return bounded.where("least <= bound").withColumn("met", F.sum("n").over(box)).select(*BOX, *CELL, "spots", "bound", "met")


def _meetings(points: DataFrame, places: DataFrame, k: int, radius_km: float) -> DataFrame:
    """Each spot of the points (lat, lon, x, y, z) with the array `met` of struct(place, x, y, z), among which its k nearest within the radius are sure to be."""
    chord = _chord(radius_km)
    spots = kept(_located(points.select("lat", "lon").distinct(), "lat", "lon"))
    first = ranked(_located(places, "plat", "plon"), ["plat", "plon"], [F.asc("place_id")], k, "__same").drop("__same")  # of places at one spot, only k can matter
    dealt = kept(first.select(F.struct(*places.columns).alias("place"), "x", "y", "z"))

    boxes = spots.withColumns(_cubes(BOX, chord)).groupBy(*BOX).agg(F.count("*").alias("spots"))
    cells = dealt.withColumns(_cubes(CELL, chord)).groupBy(*CELL).agg(F.count("*").alias("n"))
    around = boxes.withColumn("bound", F.lit(chord))
    for b, c in zip(BOX, CELL, strict=True):
        around = around.withColumn(c, F.explode(F.array(*[F.col(b) + step for step in (-1, 0, 1)])))
    found = kept(_reached(around.join(cells, CELL), k, chord))

    few, level, sides, settled = (F.col("met") <= MANY * k) & (F.col("spots") <= CROWD), 0, {}, []
    while True:
        some, others = found.agg(F.bool_or(few), F.bool_or(~few)).first()
        ended = not others or level == LEVELS
        if some or ended:
            sides[level] = chord / 2**level
            settled.append((found if ended else found.where(few)).select(F.lit(level).alias("level"), *BOX, *CELL))
        if ended:
            break
        level += 1
        side, wide = chord / 2**level, found.where(~few)
        pairs = wide.select(*[F.col(c).alias(f"up_{c}") for c in BOX + CELL], "bound")
        pairs = pairs.join(_halved(spots, BOX, side, wide, "spots"), list(_up(BOX))).join(_halved(dealt, CELL, side, wide, "n"), list(_up(CELL)))
        found = kept(_reached(pairs, k, side))

    levels = F.inline(F.array(*[F.struct(F.lit(at).alias("level"), F.lit(side).alias("side")) for at, side in sides.items()]))
    reached = dealt.select("*", levels).withColumns(_cubes(CELL, F.col("side"))).drop("side").join(reduce(DataFrame.unionByName, settled), ["level", *CELL])
    sets = reached.groupBy("level", *BOX).agg(F.collect_list(F.struct("place", "x", "y", "z")).alias("met"))
    boxed = spots.select("*", levels).withColumns(_cubes(BOX, F.col("side"))).drop("side")
    return spread(boxed, "level", *BOX).join(spread(sets, "level", *BOX), ["level", *BOX]).select("lat", "lon", "x", "y", "z", "met")


def _far(*place: Column) -> Column:
    """The square of the chord from the spot."""
    return _square([F.col(v) - at for v, at in zip("xyz", place, strict=True)])


def candidates(points: DataFrame, places: DataFrame, k: int, radius_km: float) -> DataFrame:
    """point_id, lat, lon and every place that the point meets."""
    met = _meetings(points, places, k, radius_km).select("lat", "lon", F.explode("met.place").alias("place")).select("lat", "lon", "place.*")
    return points.select("point_id", "lat", "lon").join(met, ["lat", "lon"]).select("point_id", "lat", "lon", *places.columns)


def nearest(points: DataFrame, places: DataFrame, distance: Column, most: int, radius_km: float) -> DataFrame:
    """For each point (point_id, lat, lon) up to `most` places (place_id, plat, plon) within the radius, nearest first, then by id.

    A point_id stands for one spot; a point given n times gets each place n times. Points and places without a spot (null or
    not a number) meet nothing; of places that share a spot and an id each counts. distance is in km, over lat, lon, plat, plon.
    """
    met = _meetings(points, places, most, radius_km)
    kth = F.when(F.size("met") >= most, F.sqrt(F.element_at(F.sort_array(F.transform("met", lambda p: _far(p["x"], p["y"], p["z"]))), most)))
    each = met.withColumn("reach", F.least(kth, F.lit(_chord(radius_km))) + TIES).select("*", F.explode("met").alias("at"))
    near = each.where(F.sqrt(_far(*[F.col(f"at.{v}") for v in "xyz"])) <= F.col("reach")).select("lat", "lon", "at.place.*")
    near = near.withColumn("km", distance).where(F.col("km") <= radius_km)
    best = ranked(near, ["lat", "lon"], [F.asc("km"), F.asc("place_id")], most)
    who = points.groupBy("point_id", "lat", "lon").agg(F.count("*").alias("copies"))
    start, end = (F.least(n * F.col("copies"), F.lit(most)).cast("int") for n in (F.col("rank") - 1, F.col("rank")))
    ranks = F.when(start < end, F.sequence(start + 1, end))
    met = who.join(best.hint("merge"), ["lat", "lon"])  # a file of few bytes may hold many points: no broadcast
    return met.select("point_id", "lat", "lon", *places.columns, "km", F.explode(ranks).alias("rank"))
