"""Joins of places within a radius, by cells of a grid on the sphere.

Rows of the grid are bands of latitude one radius high; a band is cut into whole cells at least one radius wide at its
own latitude, so two points within the radius lie in the same or in neighbouring cells, at the poles and at the 180th
meridian too. One side is repeated over its ring of at most nine cells, the other keeps its one cell, and the equi
join on the cell forms few pairs beyond the true ones. Positions that are null meet nothing.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlag.functions import scalars as X
from fleetlag.operators.segments import bucket
from fleetlag.session import cut_lineage

#: Cells are this much wider than the radius, far above the rounding of the distance formula.
SLACK = 1.0001


class Grid:
    """Cell numbers as columns, for one radius on a sphere."""

    def __init__(self, radius: float, earth: float):
        angle = min(radius / earth * SLACK + 1e-12, math.pi)
        self.half_sine = math.sin(angle / 2)
        self.step = math.degrees(angle)

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step).cast("long")

    def cells_in(self, row: Column) -> Column:
        """Cells of a band: a cell spans the longitudes that a radius can reach from the band or its neighbours."""
        south = (row - 1) * F.lit(self.step) - 90.0
        north = (row + 2) * F.lit(self.step) - 90.0
        steepest = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north)))
        reach = F.lit(self.half_sine) / F.greatest(F.cos(F.radians(steepest)), F.lit(1e-15))
        width = F.degrees(F.asin(F.least(F.lit(1.0), reach))) * (2 * SLACK)
        return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(360.0) / width).cast("long"))

    def with_cell(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """``df`` with ``__c``, the cell of each position."""
        row = self.row(F.col(lat))
        # a generator of one row: expressions of the position are computed below it, once
        placed = df.withColumn("__r", F.explode(F.array(row))).withColumn("__n", self.cells_in(F.col("__r")))
        return placed.withColumn("__c", self._number(F.floor((F.col(lon) + 180.0) / 360.0 * F.col("__n")))).drop("__r", "__n")

    def with_ring(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """``df`` repeated for every cell ``__c`` that can hold a point within the radius: three bands, and in each the
        position's own cell and its two neighbours, or all cells where there are fewer than three."""
        known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        row = self.row(F.col(lat))
        bands = known.withColumn("__r", F.explode(F.sequence(row - 1, row + 1))).withColumn("__n", self.cells_in(F.col("__r")))
        bands = bands.withColumn("__at", F.floor((F.col(lon) + 180.0) / 360.0 * F.col("__n")) - 1)
        beside = F.sequence(F.col("__at"), F.col("__at") + F.least(F.lit(2), F.col("__n") - 1))
        cells = bands.withColumn("__at", F.explode(beside))
        return cells.withColumn("__c", self._number(F.col("__at"))).drop("__r", "__n", "__at")

    def _number(self, column: Column) -> Column:
        return F.shiftleft(F.col("__r"), 32) + F.pmod(column, F.col("__n"))


def candidates(
    places: DataFrame, fixes: DataFrame, keys: list[str], low: Column, high: Column, t: str, width: float, grid: Grid,
    place_at: tuple[str, str] = ("s_lat", "s_lon"), fix_at: tuple[str, str] = ("lat", "lon"),
) -> DataFrame:
    """Pairs of equal keys in neighbouring cells whose fix lies in the place's time interval, each once.

    The time bucket stays in the key: a place where a vehicle stands all night is spread over its buckets. The join is a
    merge: the repeated places are many times what Spark expects of them, so a broadcast would outgrow the driver."""
    timed = places.withColumn("__lo", low.cast("double")).withColumn("__hi", high.cast("double"))
    timed = timed.withColumn("__b", F.explode(F.sequence(bucket("__lo", width), bucket("__hi", width))))
    ringed = grid.with_ring(timed, *place_at)
    held = grid.with_cell(fixes, *fix_at).withColumn("__b", bucket(t, width))
    met = ringed.hint("merge").join(held, [*keys, "__b", "__c"])
    return met.where(F.col(t).between(F.col("__lo"), F.col("__hi"))).drop("__b", "__c", "__lo", "__hi")


def within(
    places: DataFrame, fixes: DataFrame, keys: list[str], low: Column, high: Column, t: str, width: float,
    radius: float, earth: float,
) -> DataFrame:
    """:func:`candidates` within ``radius`` (in the unit of ``earth``, the sphere's radius), with the distance ``d``; places have ``s_lat, s_lon``, fixes ``lat, lon``."""
    met = candidates(places, fixes, keys, low, high, t, width, Grid(radius, earth))
    return met.withColumn("d", X.haversine_m("lat", "lon", "s_lat", "s_lon", earth)).where(F.col("d") <= radius)


def nearest(
    points: DataFrame, places: DataFrame, keys: list[str], name: str, earth: float, first: float,
    limit: float | None = None,
) -> DataFrame:
    """Points with ``name``, the distance to the nearest place of the same keys, in the unit of ``earth``.

    Grids of growing radius: a point whose nearest place in its ring is within the grid's radius has its answer, since
    nothing nearer can lie outside; the others go on to a radius eight times as wide. Each grid brings a point one short
    list, the places whose rings cover its cell. The last grid is the whole sphere; keys without places give NULL.
    With ``limit`` the search ends there, and a point without a place within it gets NULL."""
    spots = cut_lineage(places.select(*keys, "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct())
    last = limit or math.pi * earth
    radius, rest, found = min(first, last), points, []
    distance = lambda p: X.haversine_m("lat", "lon", p["lat"], p["lon"], earth)
    while True:
        grid = Grid(radius, earth)
        lists = grid.with_ring(spots, "lat", "lon").groupBy(*keys, "__c").agg(F.collect_list(F.struct("lat", "lon")).alias("__near"))
        met = grid.with_cell(rest, "lat", "lon").join(lists, [*keys, "__c"], "left")
        met = met.withColumn(name, F.array_min(F.transform("__near", distance))).drop("__c", "__near")
        if radius >= last:
            if limit:
                met = met.withColumn(name, F.when(F.col(name) <= limit, F.col(name)))
            found.append(met.select(*points.columns, name))
            break
        met = cut_lineage(met)
        sure = F.coalesce(F.col(name) <= radius, F.col("lat").isNull() | F.col("lon").isNull())
        found.append(met.where(sure).select(*points.columns, name))
        rest = met.where(~sure).drop(name)
        if rest.isEmpty():
            break
        radius = min(radius * 8, last)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
