"""Places that texts name, by a gazetteer, and regions near them by a grid over the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import dictionary, leftmost_longest, phrase_hits

#: Fixed value: degrees within which a region is near.
NEAR_DEGREES = 25.0


def named_places(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(id, at, size, place_id): every place that a text names, in the order of its words, longest name first.

    ``gazetteer`` holds (place_id, name, ...), with a row for every name of a place; places with one name in common go to
    the smallest place_id. A name inside a longer one that starts before it is not told.
    """
    known = dictionary(gazetteer, "place_id", "name")
    return leftmost_longest(phrase_hits(df, id_col, [text_col], known)).select("id", "at", "size", F.col("phrase_id").alias("place_id"))


def first_places(named: DataFrame) -> DataFrame:
    """(id, place_id): the first place of each text."""
    return named.groupBy("id").agg(F.min_by("place_id", "at").alias("place_id"))


def equirectangular(latitude: Column, longitude: Column, width: float, height: float) -> tuple[Column, Column]:
    """x and y on a canvas; coordinates beyond the globe are held at its edge."""
    return (_held(longitude, 180.0) + 180.0) / 360.0 * width, (90.0 - _held(latitude, 90.0)) / 180.0 * height


def mercator(latitude: Column, longitude: Column, width: float, height: float) -> tuple[Column, Column]:
    """x and y on a canvas between 85 degrees south and north."""
    up = F.ln(F.tan(F.pi() / 4 + F.radians(_held(latitude, 85.0)) / 2)) / F.pi()
    return (_held(longitude, 180.0) + 180.0) / 360.0 * width, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - up) / 2)) * height


def _held(x: Column, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def nearest_regions(points: DataFrame, regions: DataFrame, most: float = NEAR_DEGREES) -> DataFrame:
    """(point_id, region_id, degrees): each point's nearest region within ``most`` degrees; of equally near ones the largest region_id.

    Points (point_id, lat, lon) and regions (region_id, lat, lon) meet in cells of ``most`` degrees: a region stands in its
    own cell and the eight around it, across the date line too, so that the join is on equal cells and each pair
    meets once. Points without a region near have no row. Coordinates are held within the globe.
    """
    around = int(360 // most)
    row = lambda lat: F.floor((_held(lat, 90.0) + 90.0) / most).cast("int")
    # the last cell of a circle of cells also takes what ``most`` leaves of 360 degrees
    column = lambda lon: F.least(F.floor((_held(lon, 180.0) + 180.0) / most).cast("int"), F.lit(around - 1))
    p = points.select("point_id", "lat", "lon", row(F.col("lat")).alias("r"), column(F.col("lon")).alias("c"))
    near = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    q = regions.select("region_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), row(F.col("lat")).alias("r0"), column(F.col("lon")).alias("c0"))
    cells = F.array_distinct(F.array(*(F.struct((F.col("r0") + dr).alias("r"), F.pmod(F.col("c0") + dc, F.lit(around)).alias("c")) for dr, dc in near)))
    q = q.select("region_id", "rlat", "rlon", F.explode(cells).alias("cell")).select("region_id", "rlat", "rlon", "cell.*")
    apart = F.abs(F.col("rlon") - F.col("lon"))
    square = F.pow(F.col("rlat") - F.col("lat"), F.lit(2.0)) + F.pow(F.when(apart > 180, 360 - apart).otherwise(apart), F.lit(2.0))
    met = p.join(q, ["r", "c"]).select("point_id", "region_id", square.alias("square")).where(F.col("square") <= most * most)
    best = met.groupBy("point_id").agg(F.min_by(F.struct("region_id", "square"), F.struct("square", (-F.col("region_id")).alias("n"))).alias("b"))
    return best.select("point_id", "b.region_id", F.sqrt("b.square").alias("degrees"))
