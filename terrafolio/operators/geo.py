"""Neighbours by distance. Places are compared within grid cells around them, not all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.expr import haversine_km
from terrafolio.functions.stats import first_rows
from terrafolio.params import DEFAULT, Params

KM_PER_DEGREE = 111.0


def nearest_places(places: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """id, vizinho, km, posto: the nearest few of each place within a distance.

    ``places`` has id, lat, lon. Cells are as wide as the distance, so a place's neighbours lie in its own cell or the eight
    around it; cells widen with latitude up to 80 degrees, beyond which pairs across cells may be missed.
    """
    step = p.neighbour_km / KM_PER_DEGREE
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    wide = step / 0.17
    located = places.select("id", "lat", "lon", cell("lat", step).alias("y"), cell("lon", wide).alias("x"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = located.select(F.col("id").alias("vizinho"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "y", "x", F.explode(around).alias("d"))
    spread = spread.select("vizinho", "lat2", "lon2", (F.col("y") + F.col("d.i")).alias("y"), (F.col("x") + F.col("d.j")).alias("x"))
    pairs = located.join(spread, ["y", "x"]).where(F.col("id") != F.col("vizinho"))
    near = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= p.neighbour_km)
    # distances that differ by less than a micrometre are ties, which go to the smaller id
    return first_rows(near.select("id", "vizinho", "km"), ["id"], [F.floor(F.col("km") * 1e9), "vizinho"], p.neighbours)
