"""Uniform grids: cells of side eps, nodes of g by g cells, halos, statistics and neighbours."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extent(points: DataFrame) -> DataFrame:
    """min_lon, max_lon, min_lat, max_lat in one pass."""
    return points.agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))


@dataclass(frozen=True)
class GridSpec:
    """Cell columns grow with lon from the least lon, rows grow downward from the largest lat."""

    eps: float
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float
    width: int = 10

    @classmethod
    def of(cls, points: DataFrame, eps: float, partitions: int = 100) -> GridSpec | None:
        """None if there are no points."""
        r = extent(points).first()
        return None if r["min_lon"] is None else cls(eps, *r, width=max(1, math.isqrt(partitions)))

    @property
    def cells(self) -> int:
        """Cells of the longer side; one at least, also where eps is larger than the extent."""
        return math.floor(max(self.max_lon - self.min_lon, self.max_lat - self.min_lat) / self.eps) + 1

    @property
    def side(self) -> int:
        """Cells of a node's side."""
        return max(1, math.ceil(self.cells / self.width))

    def cell_i(self, lon: str = "lon") -> Column:
        return F.floor((F.col(lon) - F.lit(self.min_lon)) / F.lit(self.eps)).cast("int")

    def cell_j(self, lat: str = "lat") -> Column:
        return F.floor((F.lit(self.max_lat) - F.col(lat)) / F.lit(self.eps)).cast("int")

    def node(self, cell: Column) -> Column:
        return F.floor(cell / F.lit(self.side)).cast("int")

    def with_cells(self, points: DataFrame) -> DataFrame:
        """Adds cell_i, cell_j, node_i, node_j, node (numbered from 1, row by row)."""
        cells = points.withColumns({"cell_i": self.cell_i(), "cell_j": self.cell_j()})
        nodes = cells.withColumns({"node_i": self.node(F.col("cell_i")), "node_j": self.node(F.col("cell_j"))})
        return nodes.withColumn("node", F.col("node_j") * self.width + F.col("node_i") + 1)

    def local(self, cells: DataFrame) -> DataFrame:
        """Adds local_i, local_j: the cell's place in its node."""
        return cells.withColumns({"local_i": F.col("cell_i") - F.col("node_i") * self.side, "local_j": F.col("cell_j") - F.col("node_j") * self.side})

    def is_border(self) -> Column:
        """Whether a cell touches its node's border."""
        return F.col("local_i").isin(0, self.side - 1) | F.col("local_j").isin(0, self.side - 1)

    def halo(self, points: DataFrame) -> DataFrame:
        """Points with to_i, to_j: their node, and copies for the left, upper and diagonal node from a node's first column and row."""
        local = self.local(self.with_cells(points))
        left, up = (F.col("local_i") == 0) & (F.col("node_i") > 0), (F.col("local_j") == 0) & (F.col("node_j") > 0)
        target = lambda di, dj: F.struct((F.col("node_i") - di).alias("to_i"), (F.col("node_j") - dj).alias("to_j"))
        wanted = F.array(target(0, 0), F.when(left, target(1, 0)), F.when(up, target(0, 1)), F.when(left & up, target(1, 1)))
        copies = local.withColumn("to", F.explode(F.filter(wanted, lambda t: t.isNotNull())))
        return copies.select(*points.columns, "node_i", "node_j", "to.to_i", "to.to_j")

    def coarsen(self, nodes: DataFrame, base: int, level: int = 1) -> DataFrame:
        """Adds parent_i, parent_j: the node's ancestor where each level joins base by base nodes."""
        step = base**level
        return nodes.withColumns({"parent_i": F.floor(F.col("node_i") / step).cast("int"), "parent_j": F.floor(F.col("node_j") / step).cast("int")})

    def widths(self, base: int) -> list[int]:
        """Nodes of a side at each level, down to one."""
        found = [self.width]
        while found[-1] > 1 and base > 1:
            found.append(-(-found[-1] // base))
        return found

    def corner(self, i: str = "node_i", j: str = "node_j") -> tuple[Column, Column]:
        """lon and lat of a node's upper left corner."""
        step = self.side * self.eps
        return F.lit(self.min_lon) + F.col(i) * F.lit(step), F.lit(self.max_lat) - F.col(j) * F.lit(step)


def square_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed polygon as text."""
    point = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", point(west, south), point(west, north), point(east, north), point(east, south), point(west, south))
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))


def hash_cells(points: DataFrame, eps: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds i, j: cells of side eps that grow with lon and lat from the origin."""
    cell = lambda c, o: F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(eps))).cast("bigint")
    return points.withColumns({"i": cell("lon", origin[0]), "j": cell("lat", origin[1])})


def cell_polygons(points: DataFrame, eps: float) -> DataFrame:
    """i, j, n, west, south, east, north, wkt of each cell with points."""
    e = F.lit(float(eps))
    cells = hash_cells(points, eps).groupBy("i", "j").agg(F.count("*").alias("n"))
    box = cells.withColumns({"west": F.col("i") * e, "south": F.col("j") * e, "east": (F.col("i") + 1) * e, "north": (F.col("j") + 1) * e})
    return box.withColumn("wkt", square_wkt(F.col("west"), F.col("south"), F.col("east"), F.col("north")))


def statistics(points: DataFrame, eps: float) -> DataFrame:
    """Extent, number of cells with points, and most points in a cell, by one aggregation of cells."""
    cells = hash_cells(points, eps).groupBy("i", "j").agg(F.count("*").alias("n"), F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    return cells.agg(F.min("a").alias("min_lon"), F.max("b").alias("max_lon"), F.min("c").alias("min_lat"), F.max("d").alias("max_lat"), F.count("*").alias("n_cells"), F.max("n").alias("max_cell"))


def neighbours(points: DataFrame, eps: float, others: DataFrame | None = None) -> DataFrame:
    """id, other: points within eps on both axes (borders count), without the point itself.

    An equi-join on cells (each point asks its cell and the eight around it) with the exact condition on top.
    """
    e, around = F.lit(float(eps)), F.sequence(F.lit(-1), F.lit(1))
    asked = hash_cells(points, eps).select("id", "lon", "lat", "i", "j").withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
    asked = asked.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    given = hash_cells(others if others is not None else points, eps).select(F.col("id").alias("other"), "lon", "lat", "i", "j")
    near = (F.abs(F.col("x") - F.col("lon")) <= e) & (F.abs(F.col("y") - F.col("lat")) <= e) & (F.col("id") != F.col("other"))
    return asked.join(given, ["i", "j"]).where(near).select("id", "other")


def shifted_copies(points: DataFrame, eps: float) -> DataFrame:
    """Each point four times: as it is and moved by half a cell on either and both axes, with the copy's number."""
    half = float(eps) / 2
    move = F.array(*(F.struct(F.lit(n).alias("shift"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, (dx, dy) in enumerate(((0.0, 0.0), (half, 0.0), (0.0, half), (half, half)))))
    copies = points.withColumn("m", F.explode(move))
    kept = [c for c in points.columns if c not in ("lon", "lat")]
    return copies.select(*kept, (F.col("lon") + F.col("m.dx")).alias("lon"), (F.col("lat") + F.col("m.dy")).alias("lat"), F.col("m.shift").alias("shift"))
