"""Builders of the domain types as documents' axes, from rows: one domain a key, as (keys, domain_type, axes map of JSON)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(values: Column) -> Column:
    return F.to_json(F.struct(values.alias("values")))


def regular(start: Column, stop: Column, num: Column) -> Column:
    return F.to_json(F.struct(start.alias("start"), stop.alias("stop"), num.alias("num")))


def tuples(values: Column, coordinates: Sequence[str], data_type: str = "tuple") -> Column:
    return F.to_json(F.struct(F.lit(data_type).alias("dataType"), F.array(*map(F.lit, coordinates)).alias("coordinates"), values.alias("values")))


def _axis(column: str) -> Column:
    return listed(F.array_sort(F.collect_set(column)))


def of_axes(df: DataFrame, keys: Sequence[str], domain_type: str, **columns: str) -> DataFrame:
    """Grid, Point, PointSeries and VerticalProfile: every axis lists the distinct values of its column."""
    pairs = [x for a, c in columns.items() for x in (F.lit(a), _axis(c))]
    return df.groupBy(*keys).agg(F.create_map(*pairs).alias("axes")).select(*keys, F.lit(domain_type).alias("domain_type"), "axes")


def of_tuples(df: DataFrame, keys: Sequence[str], domain_type: str, coordinates: Sequence[str], order: Sequence[str], **columns: str) -> DataFrame:
    """Trajectory, MultiPoint, MultiPointSeries and Section: a composite axis of the rows in order, and listed axes beside it."""
    each = F.struct(*order, F.array(*[F.col(c).cast("double") for c in coordinates]).alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(each)), lambda s: s["v"])
    pairs = [F.lit("composite"), tuples(rows, coordinates)] + [x for a, c in columns.items() for x in (F.lit(a), _axis(c))]
    return df.groupBy(*keys).agg(F.create_map(*pairs).alias("axes")).select(*keys, F.lit(domain_type).alias("domain_type"), "axes")


def of_polygons(df: DataFrame, keys: Sequence[str], domain_type: str, rings: str, order: Sequence[str], **columns: str) -> DataFrame:
    """Polygon, PolygonSeries, MultiPolygon and MultiPolygonSeries: a composite axis of polygons (arrays of rings) in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, rings))), lambda s: s[rings])
    pairs = [F.lit("composite"), tuples(rows, ("x", "y"), "polygon")] + [x for a, c in columns.items() for x in (F.lit(a), _axis(c))]
    return df.groupBy(*keys).agg(F.create_map(*pairs).alias("axes")).select(*keys, F.lit(domain_type).alias("domain_type"), "axes")


def document(domains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, body): each domain's text, the type first and its axes in order."""
    entries = F.transform(F.map_entries("axes"), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    plain = F.array_join(F.transform(entries, lambda s: F.regexp_replace(s, r'^\["(.*?)"\]:', r'"$1":')), ",")
    return domains.select(*keys, F.concat(F.lit('{"type":"Domain","domainType":"'), F.col("domain_type"), F.lit('","axes":{'), plain, F.lit("}}")).alias("body"))
