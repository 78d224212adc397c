"""Nearest station per point, exact, ties kept.

Stations never meet points in a cross join. A registry whose size is checked to be
small travels as one array value inside the plan (a scalar subquery, no collect), and
each point folds over it in a narrow projection: no shuffle and no point key. A larger
registry is narrowed per grid square first: only the squares that hold points are
refined, level by level, each keeping the stations that can still be nearest to some
position inside it. A point then folds over its square's short list, and however many
points one square holds, they share a single list. Stations at one place are one entry, so
a list holds places only. Both ways give the same rows; NaN and infinite coordinates count
as missing on both inputs. Each level is written, so the plan stays as long as one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.geo import planar_distance, project
from emberday.session import written

SMALL_REGISTRY = 256
_STATIONS_PER_SQUARE = 16
_MAX_LEVEL = 30
# Squares are compared with a little slack so that rounding never drops a candidate.
_SLACK = 1e-9


def nearest_planar(
    points: DataFrame,
    stations: DataFrame,
    distance_col: str = "dist_m",
    one_per_point: bool = False,
    small_registry: int = SMALL_REGISTRY,
) -> DataFrame:
    """Left join each point (x, y) with its closest station (station_id, x, y).

    Equally close stations each give a row; ``one_per_point`` keeps the lowest id.
    Points without finite coordinates stay, with null station and distance; stations without
    take no part.
    """
    registry = stations.select("station_id", _finite("x").alias("x"), _finite("y").alias("y")).dropna(
        subset=["x", "y"]
    )
    located = points.withColumns({"_fx": _finite("x"), "_fy": _finite("y")})
    places = registry.groupBy("x", "y").agg(F.min("station_id").alias("station_id"), F.count("*").alias("n"))

    if registry.limit(small_registry + 1).count() <= small_registry:
        listed = places.select(F.collect_list(F.struct("station_id", "x", "y"))).scalar()
        with_lists = located.withColumn("_near", listed)
    else:
        with_lists = _with_square_lists(located, places)
    found = _fold(with_lists, distance_col, one_per_point)
    kept = [F.col(c) for c in points.columns]
    if one_per_point:
        return found.select(*kept, F.col("_place.station_id").alias("station_id"), distance_col)
    # only stations that share their place with others need the join
    shared = places.where("n > 1").select(F.col("x").alias("_px"), F.col("y").alias("_py"))
    at_place = registry.join(shared, (F.col("x") == F.col("_px")) & (F.col("y") == F.col("_py"))).select(
        F.col("station_id").alias("_other"), "_px", "_py"
    )
    same = (F.col("_place.x") == F.col("_px")) & (F.col("_place.y") == F.col("_py"))
    station = F.coalesce("_other", "_place.station_id").alias("station_id")
    return found.join(at_place, same, "left").select(*kept, station, distance_col)


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value + F.lit(0.0))


def nearest_station(points: DataFrame, stations: DataFrame, **options) -> DataFrame:
    """As ``nearest_planar`` for points in degrees (lon, lat), distance in metres.

    ``stations`` has station_id, stn_lon and stn_lat. Coordinates of the points are
    left as they are; the metric grid is used for the distance alone.
    """
    grid_points = points.withColumn("_xy", project(F.col("lon"), F.col("lat"))).select(
        "*", F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y")
    )
    grid_stations = stations.select(
        "station_id", project(F.col("stn_lon"), F.col("stn_lat")).alias("xy")
    ).select("station_id", "xy.x", "xy.y")
    return nearest_planar(grid_points, grid_stations, **options).drop("_xy", "x", "y")


def _fold(points: DataFrame, distance_col: str, one_per_point: bool) -> DataFrame:
    """Keep the closest entries of each row's list ``_near``, as ``_place``."""

    def distance(s: Column) -> Column:
        return planar_distance(F.col("_fx"), F.col("_fy"), s.getField("x"), s.getField("y"))

    measured = points.withColumn(
        "_near",
        F.transform(
            "_near",
            lambda s: F.struct(
                distance(s).alias("d"), s.getField("station_id").alias("station_id"),
                s.getField("x").alias("x"), s.getField("y").alias("y"),
            ),
        ),
    )
    if one_per_point:
        located = F.when(F.col("_fx").isNotNull() & F.col("_fy").isNotNull(), F.array_min("_near"))
        best = measured.withColumn("_place", located)
    else:
        least = measured.withColumn(
            "_least", F.array_min(F.transform("_near", lambda s: s.getField("d")))
        )
        best = least.withColumn(
            "_place",
            F.explode_outer(
                F.filter("_near", lambda s: s.getField("d") == F.col("_least"))
            ),
        )
    return best.withColumn(distance_col, F.col("_place.d"))


def _with_square_lists(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach to every point the stations that may be nearest within its grid square."""
    extent = _extent(points)
    if extent is None:
        kind = dict(registry.dtypes)["station_id"]
        empty = F.array().cast(f"array<struct<station_id:{kind},x:double,y:double>>")
        return points.withColumn("_near", empty)
    x0, y0, side = extent
    level = _depth(registry, x0, y0, side)

    def square(axis: str, origin: float) -> Column:
        step = F.floor((F.col(axis) - origin) / F.lit(side / 2**level))
        return F.greatest(F.least(step, F.lit(2**level - 1)), F.lit(0)).cast("int")

    placed = points.withColumns({"_sx": square("_fx", x0), "_sy": square("_fy", y0)})
    occupied = placed.select("_sx", "_sy").filter(
        F.col("_sx").isNotNull() & F.col("_sy").isNotNull()
    )
    occupied = written(occupied.distinct(), "nearest-squares")

    lists = registry.select(
        F.lit(0).alias("_px"), F.lit(0).alias("_py"), F.struct("station_id", "x", "y").alias("s")
    )
    for depth in range(1, level + 1):
        drop = level - depth
        children = occupied.select(
            F.shiftright("_sx", drop).alias("_cx"), F.shiftright("_sy", drop).alias("_cy")
        ).distinct()
        inherited = children.join(
            lists,
            (F.shiftright("_cx", 1) == F.col("_px")) & (F.shiftright("_cy", 1) == F.col("_py")),
        ).drop("_px", "_py")
        lists = _prune(written(inherited, "nearest-level"), x0, y0, side / 2**depth).withColumnsRenamed(
            {"_cx": "_px", "_cy": "_py"}
        )
    near = lists.groupBy("_px", "_py").agg(F.collect_list("s").alias("_near"))
    return (
        placed.join(
            near, (F.col("_sx") == F.col("_px")) & (F.col("_sy") == F.col("_py")), "left"
        )
        .drop("_sx", "_sy", "_px", "_py")
    )


def _prune(candidates: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Drop stations that some other station beats everywhere in the square."""
    half = F.lit(step / 2)
    mid_x = F.lit(x0) + (F.col("_cx") + 0.5) * F.lit(step)
    mid_y = F.lit(y0) + (F.col("_cy") + 0.5) * F.lit(step)
    off_x, off_y = F.abs(F.col("s.x") - mid_x), F.abs(F.col("s.y") - mid_y)
    gap_x, gap_y = F.greatest(off_x - half, F.lit(0.0)), F.greatest(off_y - half, F.lit(0.0))
    far_x, far_y = off_x + half, off_y + half
    measured = candidates.withColumns(
        {
            "_least": F.sqrt(gap_x * gap_x + gap_y * gap_y),
            "_most": F.sqrt(far_x * far_x + far_y * far_y),
        }
    )
    bound = measured.groupBy("_cx", "_cy").agg(F.min("_most").alias("_bound"))
    slack = F.lit(1.0 + _SLACK)
    return (
        measured.join(bound, ["_cx", "_cy"])
        .filter(F.col("_least") <= F.col("_bound") * slack)
        .select("_cx", "_cy", "s")
    )


def _extent(points: DataFrame) -> tuple[float, float, float] | None:
    """Lower corner and side of the square around the points."""
    box = points.select(
        *[F.expr(f"{f}(_f{c})").alias(f"{f}_{c}") for f in ("min", "max") for c in "xy"]
    ).first()
    if box.min_x is None or box.min_y is None:
        return None
    side = max(box.max_x - box.min_x, box.max_y - box.min_y)
    return box.min_x, box.min_y, side if side > 0 else 1.0


def _depth(registry: DataFrame, x0: float, y0: float, side: float) -> int:
    """Levels needed until the fullest square holds only a few places; one job for all levels."""
    level = F.explode(F.sequence(F.lit(1), F.lit(_MAX_LEVEL))).alias("level")
    step = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    squares = registry.select("x", "y", level).groupBy(
        "level", F.floor((F.col("x") - x0) / step).alias("sx"), F.floor((F.col("y") - y0) / step).alias("sy")
    ).agg(F.count("*").alias("n"))
    fullest = squares.groupBy("level").agg(F.max("n").alias("n")).where(F.col("n") <= _STATIONS_PER_SQUARE)
    return fullest.agg(F.min("level")).first()[0] or _MAX_LEVEL
