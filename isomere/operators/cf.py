"""CF metadata of coverages as relations: attributes, flags, roles of columns, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.systems import flag_meaning, standard_name, vertical_name, vertical_positive

# Fixed: names and standard names that tell a coordinate's role, and how units of two of them begin.
ROLE_NAMES = {"x": ("x", "lon", "longitude"), "y": ("y", "lat", "latitude"), "z": ("z", "depth", "height", "altitude", "level", "elevation"), "t": ("t", "time")}
ROLE_STANDARD = {"x": ("longitude",), "y": ("latitude",), "z": ("depth", "height", "altitude"), "t": ()}
ROLE_UNITS = {"x": "degrees_e", "y": "degrees_n"}


def role(name: Column, standard: Column, units: Column, positive: Column | None = None, is_time: Column | None = None) -> Column:
    """x, y, z or t: the first role of which the standard name, the units or the name tells; else null.

    A positive attribute tells of z, values that are times of t.
    """
    out = F.lit(None).cast("string")
    for k in ("t", "z", "y", "x"):
        told = F.lower(name).isin(*ROLE_NAMES[k])
        if ROLE_STANDARD[k]:
            told = told | F.coalesce(F.lower(standard).isin(*ROLE_STANDARD[k]), F.lit(False))
        if k in ROLE_UNITS:
            told = told | F.coalesce(F.startswith(F.lower(units), F.lit(ROLE_UNITS[k])), F.lit(False))
        more = {"z": None if positive is None else positive.isNotNull(), "t": is_time}.get(k)
        if more is not None:
            told = told | F.coalesce(more, F.lit(False))
        out = F.when(told, k).otherwise(out)
    return out


def coordinate_attributes(kind: Column, identifier: Column, place: Column, axis: Column) -> Column:
    """map of CF attributes of a coordinate: its system's kind and id, its place among the system's coordinates, its axis."""
    horizontal = F.when(place == 0, F.create_map(F.lit("standard_name"), F.lit("longitude"), F.lit("units"), F.lit("degrees_east"))).when(
        place == 1, F.create_map(F.lit("standard_name"), F.lit("latitude"), F.lit("units"), F.lit("degrees_north"))
    ).when(place == 2, F.create_map(F.lit("standard_name"), F.lit("height")))
    projected = F.when(place == 0, F.create_map(F.lit("standard_name"), F.lit("projection_x_coordinate"))).when(place == 1, F.create_map(F.lit("standard_name"), F.lit("projection_y_coordinate")))
    vertical = F.map_filter(F.create_map(F.lit("standard_name"), vertical_name(identifier), F.lit("positive"), vertical_positive(identifier)), lambda _, v: v.isNotNull())
    own = F.when(kind == "GeographicCRS", horizontal).when(kind == "ProjectedCRS", projected).when(kind == "VerticalCRS", vertical).when(kind == "TemporalRS", F.create_map(F.lit("standard_name"), F.lit("time")))
    letter = F.create_map(F.lit("axis"), F.upper(axis))
    return F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), F.when(axis.isin("x", "y", "z", "t"), letter).otherwise(F.create_map().cast("map<string,string>")))


def variable_attributes(label: Column, observed: Column, unit: Column) -> Column:
    made = F.create_map(F.lit("long_name"), label, F.lit("standard_name"), standard_name(observed), F.lit("units"), unit)
    return F.map_filter(made, lambda _, v: v.isNotNull())


def flags(categories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, flag_values, flag_meanings) of categories (keys, pos, code, label), in order; without a code a category has no flag."""
    each = F.array_sort(F.collect_list(F.struct("pos", "code", flag_meaning(F.col("label")).alias("meaning"))))
    out = categories.filter("code is not null").groupBy(*keys).agg(each.alias("e"))
    return out.select(*keys, F.transform("e", lambda x: x["code"]).alias("flag_values"), F.array_join(F.transform("e", lambda x: x["meaning"]), " ").alias("flag_meanings"))


def is_bounds(name: Column) -> Column:
    return F.regexp_like(name, F.lit("_(bnds|bounds)$"))


def domain_type(axes: Column, composite: Column, sizes: Column) -> Column:
    """The type that the axes' names, composite coordinates and sizes (map) suggest; null if none does."""
    has = lambda a: F.array_contains(axes, a)
    many = lambda a: F.coalesce(F.try_element_at(sizes, F.lit(a)), F.lit(0)) > 1
    tuple_ = F.when(F.array_contains(composite, "t"), F.when(many("z"), "Section").otherwise("Trajectory")).when(has("t"), "MultiPointSeries").otherwise("MultiPoint")
    flat = has("x") & has("y")
    single = ~many("x") & ~many("y")
    plain = (
        F.when(flat & single & many("z") & ~many("t"), "VerticalProfile").when(flat & single & ~many("z") & many("t"), "PointSeries")
        .when(flat & single & ~many("z") & ~many("t"), "Point").when(flat, "Grid")
    )
    return F.when(F.size(composite) > 0, tuple_).otherwise(plain)
