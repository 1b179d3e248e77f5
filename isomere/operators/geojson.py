"""GeoJSON of flattened coverages: points, lines of trajectories, polygons; CRS choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomere.functions.systems import geographic_crs


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    """A Point as struct(type, coordinates); null without x or y, two-dimensional without z."""
    flat = F.array(x, y)
    position = flat if z is None else F.when(z.isNull(), flat).otherwise(F.array(x, y, z))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("Point").alias("type"), position.alias("coordinates")))


def linestring(vertices: DataFrame, keys: Sequence[str], order: Sequence[str], coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """(keys, geometry, n): one LineString a key, from at least two vertices; others have a null geometry."""
    each = F.struct(*order, F.array(*coordinates).alias("p"))
    line = F.transform(F.array_sort(F.collect_list(each)), lambda v: v["p"])
    out = vertices.groupBy(*keys).agg(line.alias("line"))
    geometry = F.when(F.size("line") >= 2, F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")))
    return out.select(*keys, geometry.alias("geometry"), F.size("line").alias("n"))


def line_parts(vertices: DataFrame, keys: Sequence[str], order: Sequence[str], at_most: int, coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """(keys, part, geometry, n): as linestring(), in parts of at most so many vertices, each starting where the last one ends."""
    if at_most < 2:
        raise ValueError("a line has two vertices at least")
    step, window = at_most - 1, Window.partitionBy(*keys).orderBy(*order)
    rows = vertices.withColumn("_at", F.row_number().over(window).cast("long") - 1).withColumn("_more", F.lead(F.lit(True)).over(window).isNotNull())
    own = F.floor(F.col("_at") / step)
    # A vertex between two parts is in both; the last one of a line ends its part.
    between = (F.col("_at") % step == 0) & (F.col("_at") > 0)
    parts = F.when(between & F.col("_more"), F.array(own - 1, own)).when(between, F.array(own - 1)).otherwise(F.array(own))
    return linestring(rows.withColumn("part", F.explode(parts)), [*keys, "part"], ["_at"], coordinates)


def polygon(rings: Column, order: Sequence[int] = (0, 1)) -> Column:
    """A Polygon from rings of positions, the first the shell; order: the places of x, y (and z) in a position."""
    pick = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(*[F.get(p, F.lit(i)) for i in order])))
    return F.struct(F.lit("Polygon").alias("type"), pick.alias("coordinates"))


def feature(geometry: Column, properties: Column) -> Column:
    """A Feature's text; null members of properties are kept."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def feature_collection(features: DataFrame, keys: Sequence[str], feature_column: str, order: Sequence[str]) -> DataFrame:
    """(keys, collection): the features of each key in order as one FeatureCollection's text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(feature_column).alias("_f")))), lambda s: s["_f"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))
    return features.groupBy(*keys).agg(text.alias("collection"))


def crs(systems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, crs): the first geographic system, or projected one with an id, of each coverage's systems (keys, conn_idx, kind, id)."""
    usable = systems.filter("kind = 'GeographicCRS' or (kind = 'ProjectedCRS' and id is not null)")
    first = F.min_by(F.when(F.col("kind") == "GeographicCRS", geographic_crs(F.col("id"))).otherwise(F.col("id")), "conn_idx")
    return usable.groupBy(*keys).agg(first.alias("crs"))
