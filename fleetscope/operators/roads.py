"""Map matching: nearest road for every GPS point (N1-N4) as grid equi-joins.

The studied job asks a spatial index for the nearest road once per reading.
Spark has no k-NN join, so the search is a few equi-joins on grid cells:

* every road segment is cut into pieces no longer than a cell and listed once
  in each cell that its pieces touch;
* tiles (cells that hold a thousand segments or so): a point meets the segments
  of its own tile, all points of a tile together in arrays (``segment_search``).
  When its distance ends inside the tile it is done, which most points are;
* a point nearer than a tile's side to a road, but not to the border of its
  tile, looks at the tiles of the 3 x 3 block that start within its distance;
* far points (a position fix far from any road, such as (0, 0)) go down a
  pyramid of *occupied* cells: the farthest corner of one occupied cell bounds
  the distance from above, cells that start beyond the lowest bound are dropped
  at every level, and only the cells that are left meet their segments. The
  tiles come first; only the segments of the tiles left are listed in cells.

Results are exact, with no distance cap, no sampling and no cross join. Ties
go to the lowest ``osm_id`` at exactly the least distance; the road's attributes
are looked up last. For far points the minimum distance comes first (one double
per point, combined before its exchange) and a second join takes the ``osm_id``.
Cells with more than ``BLOCK_SEGMENTS`` segments (tiles: ``TILE_SEGMENTS``) are
split into blocks by a hash of the segment, and their points look at every
block; the points of a tile with more than ``TILE_POINTS`` are split too. So a
crowded city tile is spread over many tasks of bounded memory. Distances are
EPSG:3857 metres, the metric the original ranking used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import speed_limit, web_mercator_x, web_mercator_y
from ..session import materialize, stored
from .segment_search import NO_ROAD, nearest_segment

POINT = ["lat", "lon", "px", "py"]
CELL = ["cx", "cy"]
BLOCK_SEGMENTS = 256            # segments of one cell that are searched together
TILE_CELLS = 32                 # a tile's side in cells
TILE_SEGMENTS = 8_192           # segments and points of one tile that are searched together
TILE_POINTS = 65_536
DENSITY_CELL_M = 10_000.0       # side of the squares that measure the area the roads cover
BROADCAST_ROWS = 500_000        # a counted side of two longs (some 16 MB) is broadcast up to here
SLACK_M = 1e-3                  # covers the rounding of cell borders (coordinates are below 1e8 m)


def road_speed_limits(roads: DataFrame) -> DataFrame:
    """Speed limit of each road from ``tags['maxspeed']`` / ``highway``."""
    return roads.withColumn("limite_velocita",
                            speed_limit(F.try_element_at(F.col("tags"), F.lit("maxspeed")), F.col("highway")))


def road_segments(roads: DataFrame) -> DataFrame:
    """N3 input: one row per polyline segment (a one-vertex road is a zero-length segment)."""
    n = F.size("way")
    pairs = F.when(n == 1, F.array(F.struct(F.col("way")[0].alias("a"), F.col("way")[0].alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 2),
                    lambda i: F.struct(F.col("way")[i].alias("a"), F.col("way")[i + 1].alias("b"))))
    seg = roads.filter(n > 0).select("osm_id", F.explode(pairs).alias("s"))
    return seg.select("osm_id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
                      F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def segment_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Every (cx, cy) a segment touches, once per segment, via pieces no longer than ``cell``."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    s = segments.withColumn("_np", F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / cell)).cast("int"))

    def piece_cells(k):
        x0, x1 = F.col("ax") + k / F.col("_np") * dx, F.col("ax") + (k + 1) / F.col("_np") * dx
        y0, y1 = F.col("ay") + k / F.col("_np") * dy, F.col("ay") + (k + 1) / F.col("_np") * dy
        xs = F.sequence(F.floor(F.least(x0, x1) / cell), F.floor(F.greatest(x0, x1) / cell))
        ys = F.sequence(F.floor(F.least(y0, y1) / cell), F.floor(F.greatest(y0, y1) / cell))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))

    cells = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_np") - 1), piece_cells)))
    return s.withColumn("_c", F.explode(cells)).select("_c.cx", "_c.cy", "osm_id", "ax", "ay", "bx", "by")


def point_segment_distance(px, py) -> F.Column:
    """Euclidean distance from (px, py) to segment (ax, ay)-(bx, by), clamped projection."""
    ax, ay, bx, by = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / l2)))
    qx, qy = ax + t * dx, ay + t * dy
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


def project_points(points: DataFrame) -> DataFrame:
    """Distinct WGS84 coordinates with their EPSG:3857 position; those without a finite position are left out."""
    pts = _project(points.select(F.col("position_latitude").alias("lat"), F.col("position_longitude").alias("lon")).distinct())
    return pts.filter((F.abs("px") < float("inf")) & (F.abs("py") < float("inf")))


def _project(pts: DataFrame) -> DataFrame:
    return pts.withColumn("px", web_mercator_x(F.col("lon"))).withColumn("py", web_mercator_y(F.col("lat")))


def density_cell(segments: DataFrame, floor_m: float = 50.0, default: float = 1000.0) -> float:
    """First cell size = mean spacing of the segments, sqrt(covered area / count).

    The area is that of the 10 km squares that hold segments, so one road far
    away from the others does not inflate the cells. One aggregate, one row to
    the driver. Results never depend on it.
    """
    square = F.struct(F.floor(F.col("ax") / DENSITY_CELL_M).alias("x"), F.floor(F.col("ay") / DENSITY_CELL_M).alias("y"))
    r = segments.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(square)).alias("squares")).first()
    if not r["n"]:
        return default
    return max(floor_m, DENSITY_CELL_M * math.sqrt(r["squares"] / r["n"]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` are within the bound, else to be shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else _large(df)


def _large(df: DataFrame) -> DataFrame:
    """``df`` to be shuffled for its join: the planner's estimate does not see what ``explode`` adds, and would broadcast all cells of a small file."""
    return df.hint("merge")


def _cell_gap(width: float):
    """Distance from (px, py) to the square (cx, cy) of side ``width`` (0 inside)."""
    x0, y0 = F.col("cx") * F.lit(width), F.col("cy") * F.lit(width)
    gx = F.greatest(F.lit(0.0), x0 - F.col("px"), F.col("px") - (x0 + width))
    gy = F.greatest(F.lit(0.0), y0 - F.col("py"), F.col("py") - (y0 + width))
    return F.sqrt(gx * gx + gy * gy)


def _own(points: DataFrame, cell: float) -> DataFrame:
    """Every point with the cell it lies in."""
    return points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))


def _around(points: DataFrame, cell: float) -> DataFrame:
    """The 3 x 3 block of cells around every point, one row per cell."""
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    return (points.withColumn("_ox", F.explode(steps)).withColumn("_oy", F.explode(steps))
                  .withColumn("cx", F.floor(F.col("px") / cell) + F.col("_ox"))
                  .withColumn("cy", F.floor(F.col("py") / cell) + F.col("_oy")).drop("_ox", "_oy"))


def _crowded(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
    """Cells with over ``most`` rows, with the number of pieces they are split into (``name``), and how many such cells there are."""
    crowded = (rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
                   .select(*CELL, F.ceil(F.col("n") / most).cast("int").alias(name)))
    crowded = materialize(crowded)
    return crowded, crowded.count()


def _search_cell(points: pa.Table, segments: pa.Table) -> pa.Table:
    lat, lon, px, py = (points.column(c) for c in POINT)
    arrays = [c.to_numpy() for c in (px, py, *(segments.column(c) for c in ("osm_id", "ax", "ay", "bx", "by")))]
    dist, road = nearest_segment(*arrays)
    return pa.table({"lat": lat, "lon": lon, "dist": dist, "osm_id": pa.array(road, pa.int64(), mask=road == NO_ROAD)})


def _best(found: DataFrame) -> DataFrame:
    """The least distance of every point and the lowest ``osm_id`` at it."""
    return found.groupBy("lat", "lon").agg(F.min(F.struct("dist", "osm_id")).alias("_n")).select("lat", "lon", "_n.dist", "_n.osm_id")


class _Cells:
    """The segments by cell, with crowded cells split into hash blocks."""

    def __init__(self, cells: DataFrame, most: int = BLOCK_SEGMENTS):
        crowded, n = _crowded(cells, most, "_blocks")
        self.keys = [*CELL, "_block"] if n else CELL
        self.crowded = _small(crowded, n) if n else None
        if n:
            block = F.pmod(F.xxhash64("osm_id", "ax", "ay", "bx", "by"), F.coalesce("_blocks", F.lit(1))).cast("int")
            cells = cells.join(self.crowded, CELL, "left").withColumn("_block", block).drop("_blocks")
        self.rows = cells

    def _spread(self, looks: DataFrame) -> DataFrame:
        if self.crowded is None:
            return looks
        last = F.coalesce("_blocks", F.lit(1)) - 1
        return (looks.join(self.crowded, CELL, "left")
                     .withColumn("_block", F.explode(F.sequence(F.lit(0), last))).drop("_blocks"))

    def nearest(self, looks: DataFrame, counted: DataFrame | None = None) -> DataFrame:
        """Per row of ``looks`` (POINT, CELL) and block of the cell: ``lat, lon, dist, osm_id`` of the nearest segment (inf, null without one).

        ``counted``: rows with the cells of the points, at least as many as in ``looks``, if they are cheaper to count.
        """
        left, right, keys = self._spread(looks), self.rows, self.keys
        busy, n = _crowded(looks if counted is None else counted, TILE_POINTS, "_parts")
        if n:
            busy, parts = _small(busy, n), F.coalesce("_parts", F.lit(1))
            left = left.join(busy, CELL, "left").withColumn("_part", F.pmod(F.xxhash64("lat", "lon"), parts).cast("int")).drop("_parts")
            right = right.join(busy, CELL, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
            keys = [*keys, "_part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_cell, "lat double, lon double, dist double, osm_id long")

    def min_distance(self, looks: DataFrame) -> DataFrame:
        """Per point of ``looks`` (POINT, CELL): distance of the nearest segment in its cells, null without one."""
        d = F.when(F.col("osm_id").isNotNull(), point_segment_distance(F.col("px"), F.col("py")))
        return self._spread(looks).join(_large(self.rows), self.keys, "left").groupBy(*POINT).agg(F.min(d).alias("dist"))

    def lowest_road(self, looks: DataFrame) -> DataFrame:
        """Per point of ``looks`` (POINT, dist, CELL): the lowest ``osm_id`` at exactly ``dist``."""
        at = self._spread(looks).join(_large(self.rows), self.keys).filter(
            point_segment_distance(F.col("px"), F.col("py")) == F.col("dist"))
        return at.groupBy("lat", "lon", "dist").agg(F.min("osm_id").alias("osm_id"))


def _far_looks(points: DataFrame, cells: DataFrame, cell: float, factor: int) -> DataFrame | None:
    """For far points: the cells (POINT, CELL) that can hold their nearest segment; None without any segment.

    A cell listed for a piece lies within one cell of that piece, so the
    farthest corner of the square widened by ``cell`` bounds the distance.
    """
    occupied = materialize(cells.select(*CELL).distinct())
    top = occupied.agg(F.max(F.greatest(F.abs("cx"), F.abs("cy")))).first()[0]
    if top is None:
        return None
    n = occupied.count()
    levels = 0
    while factor ** levels <= top:
        levels += 1
    roots = F.array(*[F.struct(F.lit(x).cast("long").alias("cx"), F.lit(y).cast("long").alias("cy"))
                      for x in (-1, 0) for y in (-1, 0)])      # at this level all cells lie in these four
    looks = points.select(*POINT, F.explode(roots).alias("_c")).select(*POINT, "_c.cx", "_c.cy")
    for level in range(levels - 1, -1, -1):
        step, width = factor ** level, cell * factor ** level
        children = (occupied.select(F.floor(F.col("cx") / step).alias("cx"), F.floor(F.col("cy") / step).alias("cy"))
                            .distinct())
        parent = [F.floor(F.col(c) / factor).alias(f"_p{c}") for c in CELL]
        looks = (looks.withColumnsRenamed({c: f"_p{c}" for c in CELL})
                      .join(_small(children.select(*CELL, *parent), n), [f"_p{c}" for c in CELL]).select(*POINT, *CELL))
        x0, y0 = F.col("cx") * F.lit(width) - cell, F.col("cy") * F.lit(width) - cell
        wide = width + 2 * cell
        fx = F.greatest(F.abs(F.col("px") - x0), F.abs(F.col("px") - (x0 + wide)))
        fy = F.greatest(F.abs(F.col("py") - y0), F.abs(F.col("py") - (y0 + wide)))
        bound = F.min(F.sqrt(fx * fx + fy * fy)).over(Window.partitionBy("lat", "lon"))
        looks = (looks.withColumn("_bound", bound).filter(_cell_gap(width) <= F.col("_bound") + SLACK_M).drop("_bound"))
    return looks


def nearest_roads(points: DataFrame, roads: DataFrame, cell: float | None = None, factor: int = 4) -> DataFrame:
    """N1 per distinct coordinate: ``lat, lon, osm_id, highway, limite_velocita, distance_m``.

    Coordinates that are null or not finite, and all coordinates when there is
    no road, have no row. Ties go to the lowest ``osm_id``; several rows of one
    ``osm_id`` count as one road with the least of their attributes.
    """
    segs = road_segments(roads.filter(F.col("osm_id").isNotNull()))
    cell = cell or density_cell(segs)
    tile = cell * TILE_CELLS
    segs = segs.repartition("osm_id", "ax", "ay", "bx", "by")          # a small file of roads is one task otherwise
    tiles = stored(segment_cells(segs, tile), "road-tiles")
    grid = _Cells(tiles, TILE_SEGMENTS)
    readings = points.select(F.col("position_latitude").alias("lat"), F.col("position_longitude").alias("lon"))
    own = grid.nearest(_own(project_points(points), tile), counted=_own(_project(readings), tile))
    own = _own(_project(stored(_best(own) if grid.crowded is not None else own, "road-own-tile")), tile)
    x, y = F.col("px") - F.col("cx") * F.lit(tile), F.col("py") - F.col("cy") * F.lit(tile)
    inside = F.col("dist") < F.least(x, y, tile - x, tile - y) - SLACK_M
    result = ["lat", "lon", "dist", "osm_id"]
    found = [own.filter(inside).select(*result)]
    left = materialize(own.filter(~inside))
    near, far = (left.filter(c) for c in (F.col("dist") < tile - SLACK_M, F.col("dist") >= tile - SLACK_M))
    if not near.isEmpty():
        others = _around(near.withColumnsRenamed({c: f"_own_{c}" for c in CELL}), tile).filter(
            ((F.col("cx") != F.col("_own_cx")) | (F.col("cy") != F.col("_own_cy"))) & (_cell_gap(tile) <= F.col("dist") + SLACK_M))
        found.append(stored(_best(grid.nearest(others.select(*POINT, *CELL)).unionByName(near.select(*result))), "road-next-tiles"))
    looks = None if far.isEmpty() else _far_looks(far, tiles, tile, factor)
    if looks is not None:
        c = cell * factor
        wanted = materialize(looks.select(*CELL).distinct())
        segs = tiles.join(_small(wanted, wanted.count()), CELL, "left_semi").drop(*CELL).distinct()
        cells = stored(segment_cells(segs, c), "road-far-cells")
        looks = materialize(_far_looks(far, cells, c, factor))
        wanted = looks.select(*CELL).distinct()
        grid = _Cells(cells.join(_small(wanted, wanted.count()), CELL, "left_semi"))
        nearest = materialize(grid.min_distance(looks))
        found.append(grid.lowest_road(looks.join(nearest, POINT).filter(_cell_gap(c) <= F.col("dist") + SLACK_M)).select(*result))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    attributes = road_speed_limits(roads).groupBy("osm_id").agg(
        F.min(F.struct("highway", "limite_velocita")).alias("a"))
    return out.join(_large(attributes), "osm_id").select("lat", "lon", "osm_id", "a.highway", "a.limite_velocita",
                                                 F.col("dist").alias("distance_m"))


def match_points(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Back to readings: ``id, limite_velocita, tipo_strada, osm_id, distance_m``;
    (-1, 'unknown') when no road exists."""
    p = points.select("id", F.col("position_latitude").alias("lat"), F.col("position_longitude").alias("lon"))
    j = p.join(_large(matches), ["lat", "lon"], "left")
    return j.select("id", F.coalesce("limite_velocita", F.lit(-1)).cast("int").alias("limite_velocita"),
                    F.coalesce("highway", F.lit("unknown")).alias("tipo_strada"), "osm_id", "distance_m")
