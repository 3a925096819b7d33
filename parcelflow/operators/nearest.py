"""The nearest of many hubs through a grid of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions.geo import hub_chord, nearest_hub
from parcelflow.network import DEFAULT, Network
from parcelflow.operators.joins import lookup_left

#: Up to so many hubs the distances to all of them are an expression on the row.
INLINE_HUBS = 100
#: Room for rounding, in radians (some centimetres on the ground).
SLACK = 1e-8
OUTSIDE = -1


def grid_depth(hubs: int) -> int:
    """Halvings of each side so that there are about four cells to a hub."""
    return max(1, math.ceil(math.log(4 * max(hubs, 1), 4)))


def candidate_grid(spark: SparkSession, network: Network = DEFAULT, depth: int | None = None) -> DataFrame:
    """``(cell_y, cell_x, candidates)``: of each cell of the network's box the hubs that are nearest to some point of it.

    The box is quartered ``depth`` times. Quarters inherit the candidates of their whole and keep those that can win: a
    hub whose distance from the middle is beyond the least one by more than twice the way from the middle to the
    farthest point of the quarter is nowhere the nearest. So the rings around a cell are searched as far as that bound
    needs and no farther, and a hub is measured against the quarters around it, not against all cells. The cell
    ``(-1, -1)`` is the world outside the box and has all hubs.
    """
    hubs = [(order, hub[0], float(hub[2]), float(hub[3])) for order, hub in enumerate(network.hubs)]
    listed = "array<struct<ord:int,hub_id:string,lat:double,lon:double>>"
    grid = spark.createDataFrame([(0, 0, hubs)], f"cell_y int, cell_x int, candidates {listed}")
    (south, north), (west, east) = network.lat_range, network.lon_range
    for level in range(1, (grid_depth(len(hubs)) if depth is None else depth) + 1):
        quarters = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1)]))
        grid = grid.select("*", quarters.alias("q")).select(
            (F.col("cell_y") * 2 + F.col("q.y")).alias("cell_y"), (F.col("cell_x") * 2 + F.col("q.x")).alias("cell_x"), "candidates"
        )
        tall, wide = (north - south) / 2**level, (east - west) / 2**level
        lat, lon = F.lit(south) + (F.col("cell_y") + 0.5) * tall, F.lit(west) + (F.col("cell_x") + 0.5) * wide
        # Along the parallel of the middle, then along a meridian: at least as long as the straight way to any point.
        reach = F.radians(F.lit(tall / 2)) + F.radians(F.lit(wide / 2)) * F.cos(F.radians(lat)) + SLACK
        if level % 3 == 1:
            grid = grid.repartition("cell_y", "cell_x")  # quarters are dealt out before they become many
        measured = F.transform("candidates", lambda hub: F.struct(_angle(lat, lon, hub).alias("angle"), hub.alias("hub")))
        grid = grid.select("cell_y", "cell_x", _near(measured, 2 * reach).alias("candidates"))
    world = spark.createDataFrame([(OUTSIDE, OUTSIDE, hubs)], grid.schema)
    return grid.unionByName(world)


def _near(measured: Column, room: Column) -> Column:
    """Hubs at most ``room`` farther than the closest. Arrays of one element bind values, so each is computed once."""
    bound = F.transform(
        F.array(measured), lambda all_hubs: F.struct(all_hubs.alias("hubs"), (F.array_min(all_hubs)["angle"] + room).alias("limit"))
    )
    kept = F.transform(
        bound, lambda b: F.transform(F.array(b["limit"]), lambda limit: F.filter(b["hubs"], lambda pair: pair["angle"] <= limit))[0]
    )
    return F.transform(kept[0], lambda pair: pair["hub"])


def _angle(lat: Column, lon: Column, hub: Column) -> Column:
    return 2 * F.asin(F.least(F.sqrt(hub_chord(lat, lon, hub["lat"], hub["lon"])), F.lit(1.0)))


def with_nearest_hub(
    points: DataFrame,
    network: Network = DEFAULT,
    lat_col: str = "lat",
    lon_col: str = "lon",
    out: str = "nearest_hub",
    inline: int = INLINE_HUBS,
    depth: int | None = None,
) -> DataFrame:
    """Adds the id of the closest hub to each row; the earlier hub of the network wins a tie.

    Null without coordinates. A network of at most ``inline`` hubs needs no join. Beyond that a row looks up the
    candidates of its cell, some hubs around it, and takes the closest: one lookup by cell, whose table the optimizer
    broadcasts or shuffles by its size; a cell with most of the rows is split. The answer is the same either way, for
    points outside the box too, which are compared with all hubs.
    """
    lat, lon = F.col(lat_col), F.col(lon_col)
    if len(network.hubs) <= inline:
        return points.withColumn(out, nearest_hub(lat, lon, network.hubs))
    depth = grid_depth(len(network.hubs)) if depth is None else depth
    (south, north), (west, east) = network.lat_range, network.lon_range
    inside = F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))
    last = F.lit(2**depth - 1)

    def cell(value: Column, low: float, high: float) -> Column:
        at = F.least(F.floor((value - low) / ((high - low) / 2**depth)).cast("int"), last)
        return F.when(inside, at).otherwise(OUTSIDE)

    key, found = "__cell", "__candidates"
    grid = candidate_grid(points.sparkSession, network, depth)
    grid = grid.select(F.struct("cell_y", "cell_x").alias(key), F.col("candidates").alias(found))
    keyed = points.withColumn(key, F.struct(cell(lat, south, north).alias("cell_y"), cell(lon, west, east).alias("cell_x")))
    ranked = F.transform(
        found, lambda hub: F.struct(hub_chord(lat, lon, hub["lat"], hub["lon"]).alias("chord"), hub["ord"].alias("ord"), hub["hub_id"].alias("hub_id"))
    )
    best = F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(ranked)["hub_id"])
    return lookup_left(keyed, grid, key).withColumn(out, best).drop(key, found)
