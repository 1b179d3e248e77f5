"""Whole coverages to GeoJSON features: a row a feature, with its geometry and properties as JSON texts.

The domain type says what an element is: of polygons and their series each polygon at each time, of a trajectory with
`trajectories="lines"` the whole line, of all others each place of the domain, in row-major order (a composite axis first, then
t, z, y, x and others by name). Properties are the coordinates and the ranges' values there; a range without one of the axes is
repeated along it, a range named as a coordinate stands in its place. Features of collections begin with `coverage`, the
member's id or else its number. Times stay as written.

All of it comes from the coverage's row, in one pass without joins or shuffles; elements are spread one a row.

What has no features stands in the quarantine (doc_id, path, error): domains and ranges elsewhere, no x and y, no composite axis
or one of another kind, lines of fewer than two vertices, polygons at several z. A position that isn't of numbers gives a null
geometry. Repeated documents give repeated rows; a domain without values gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.systems import geographic_crs
from isomere.functions.text import json_string
from isomere.operators.geojson import feature_collection
from isomere.sources.model import is_number, is_text, sub
from isomere.sources.parts import parts

POLYGONS = ("Polygon", "PolygonSeries", "MultiPolygon", "MultiPolygonSeries")
ORDER = ("composite", "t", "z", "y", "x")


def _let(value: Column, then) -> Column:
    """then(value), which is computed once whatever the number of places that use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _first(rows: Column, name: Column | str) -> Column:
    return F.get(F.filter(rows, lambda a: a["name"] == name), F.lit(0))


def _number(v: Column) -> Column:
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def _token(v: Column, integer: Column | None = None) -> Column:
    """A value's JSON text: numbers as decimal ones, or as whole ones where integer holds."""
    decimal = F.try_variant_get(v, "$", "double").cast("string")
    number = decimal if integer is None else F.when(integer, F.try_variant_get(v, "$", "bigint").cast("string")).otherwise(decimal)
    text = F.when(is_number(v), number).when(is_text(v), json_string(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
    return F.coalesce(text, F.lit("null"))


def _members(pairs: Column) -> Column:
    """An object's text from (name, token) in order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_string(p["name"]), F.lit(":"), p["token"])), ","), F.lit("}"))


def _layout(axes: Column) -> Column:
    """axes in row-major order, each with its stride and the step of its regular form."""
    rank = lambda a: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), a["name"]), F.lit(0)), F.lit(len(ORDER) + 1))
    start, stop, num = ((lambda a, m=m, k=k: sub(a["axis"], m, k)) for m, k in (("start", "double"), ("stop", "double"), ("num", "int")))
    each = F.transform(axes, lambda a: F.struct(
        rank(a).alias("rank"), a["name"].alias("name"), F.coalesce(a["size"], F.lit(0)).alias("size"), F.coalesce(a["data_type"], F.lit("")).alias("kind"), a["coordinates"].alias("names"), start(a).alias("start"),
        F.coalesce((stop(a) - start(a)) / F.nullif(num(a) - 1, F.lit(0)), F.lit(0.0)).alias("step"),
    ))
    # Values can't be compared, so they are looked up after the order is known.
    values = lambda name: F.get(F.filter(axes, lambda a: a["name"] == name), F.lit(0))["values"]
    after = lambda o, k: F.aggregate(F.slice(o, k + 2, F.size(o)), F.lit(1).cast("long"), lambda n, b: n * b["size"])
    return _let(F.array_sort(each), lambda o: F.transform(o, lambda a, k: F.struct(*[a[c].alias(c) for c in ("name", "size", "kind", "names", "start", "step")], after(o, k).alias("stride"), values(a["name"]).alias("values"))))


def _ranges(ranges: Column, layout: Column) -> Column:
    """Inline ranges as (name, integer, values, dims); dims: the length, size and stride of the axis of each dimension."""

    def one(e: Column) -> Column:
        names, shape = F.coalesce(sub(e["value"], "axisNames", "array<string>"), F.array().cast("array<string>")), sub(e["value"], "shape", "array<int>")
        dims = F.zip_with(names, F.coalesce(shape, F.array().cast("array<int>")), lambda n, length: _let(_first(layout, n), lambda a: F.struct(
            length.cast("long").alias("length"), F.coalesce(a["size"], F.lit(1)).cast("long").alias("size"), F.coalesce(a["stride"], F.lit(1)).cast("long").alias("stride"))))
        return F.struct(e["key"].alias("name"), (sub(e["value"], "dataType", "string") == "integer").alias("integer"), sub(e["value"], "values", "array<variant>").alias("values"), dims.alias("dims"))

    held = F.filter(F.map_entries(ranges), lambda e: F.coalesce(sub(e["value"], "type", "string") == "NdArray", F.lit(False)))
    return F.coalesce(F.transform(held, one), F.array().cast("array<struct<name:string,integer:boolean,values:array<variant>,dims:array<struct<length:bigint,size:bigint,stride:bigint>>>>"))


def _position(items: Column, names: Column) -> Column:
    """x, y and, where it is named, z of a composite value's items."""
    at = lambda n: F.get(items, F.array_position(names, n).cast("int") - 1)
    flat = F.array(at("x"), at("y"))
    return F.when(F.array_contains(names, "z"), F.array(at("x"), at("y"), at("z"))).otherwise(flat)


def _geometry(kind: str, coordinates: Column, whole: Column) -> Column:
    return F.when(whole, F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))))


def _numbers(v: Column) -> Column:
    """A position's items as numbers; items that are none are null."""
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), _number)


def _polygon(v: Column, names: Column) -> Column:
    rings = F.transform(F.try_variant_get(v, "$", "array<array<variant>>"), lambda ring: F.transform(ring, lambda p: _position(_numbers(p), names)))
    return _let(rings, lambda r: _geometry("Polygon", r, F.forall(r, lambda ring: F.forall(ring, lambda p: F.forall(p, lambda x: x.isNotNull())))))


def _line(axis: Column) -> Column:
    points = F.transform(axis["values"], lambda v: _position(_numbers(v), axis["coordinates"]))
    return _let(points, lambda r: _geometry("LineString", r, F.forall(r, lambda p: F.forall(p, lambda x: x.isNotNull()))))


def _at(a: Column, pos: Column) -> Column:
    """(name, token, number) of the coordinates that an axis has at a position."""
    part = lambda n, v: F.struct(n.alias("name"), _token(v).alias("token"), _number(v).alias("number"))
    counted = a["start"] + pos * a["step"]
    plain = F.when(a["values"].isNull(), F.struct(a["name"].alias("name"), counted.cast("string").alias("token"), counted.alias("number"))).otherwise(part(a["name"], F.get(a["values"], pos)))
    inner = F.arrays_zip(a["names"].alias("n"), F.try_variant_get(F.get(a["values"], pos), "$", "array<variant>").alias("v"))
    none = F.array().cast("array<struct<name:string,token:string,number:double>>")
    return F.when(a["kind"] == "polygon", none).when(a["kind"] == "tuple", F.transform(inner, lambda p: part(p["n"], p["v"]))).otherwise(F.array(plain))


def _element(i: Column, layout: Column, data: Column, polygons: Column, label: Column) -> Column:
    place = lambda size, stride: F.floor(i / stride) % size
    coordinates = F.flatten(F.transform(layout, lambda a: _at(a, place(a["size"], a["stride"]).cast("int"))))
    flat = lambda r: F.aggregate(r["dims"], F.lit(0).cast("long"), lambda n, d: n * d["length"] + place(d["size"], d["stride"]))
    cells = F.transform(data, lambda r: F.struct(r["name"].alias("name"), _token(F.get(r["values"], flat(r).cast("int")), r["integer"]).alias("token")))

    def whole(c: Column) -> Column:
        x, y, z = (_first(c, n)["number"] for n in "xyz")
        third = F.exists(c, lambda p: p["name"] == "z")
        point = _geometry("Point", F.when(third, F.array(x, y, z)).otherwise(F.array(x, y)), x.isNotNull() & y.isNotNull() & (~third | z.isNotNull()))
        own = F.transform(F.filter(c, lambda p: ~F.exists(data, lambda r: r["name"] == p["name"])), lambda p: F.struct(p["name"].alias("name"), p["token"].alias("token")))
        first = _first(layout, "composite")
        area = F.get(polygons, place(first["size"], first["stride"]).cast("int"))
        return F.struct(i.alias("idx"), F.when(polygons.isNull(), point).otherwise(area).alias("geometry"), _members(F.concat(label, own, cells)).alias("properties"))

    return _let(coordinates, whole)


def features(decoded: DataFrame, trajectories: str = "points") -> tuple[DataFrame, DataFrame]:
    """(features, quarantine) of the coverages of decoded documents.

    features: doc_id, path (the pointer to the coverage), domain_type, crs (of the first geographic system, or projected one with
    an id), idx, geometry, properties. trajectories: points or lines.
    """
    if trajectories not in ("points", "lines"):
        raise ValueError(f"trajectories are points or lines, not {trajectories!r}")
    rows = parts(decoded).filter("kind = 'Coverage'")
    area, line = F.col("domain_type").isin(*POLYGONS), (F.col("domain_type") == "Trajectory") & F.lit(trajectories == "lines")
    rows = rows.withColumn("area", F.coalesce(area, F.lit(False))).withColumn("line", F.coalesce(line, F.lit(False))).withColumn("joint", _first(F.col("axes"), "composite"))
    joint, named = F.col("joint"), F.flatten(F.transform("axes", lambda a: F.when(F.coalesce(a["data_type"], F.lit("")) == "tuple", a["coordinates"]).otherwise(F.array(a["name"]))))
    elsewhere = F.array_join(F.filter(F.map_keys("ranges"), lambda k: ~F.exists("arrays", lambda a: a["key"] == k)), ", ")
    lacks = lambda names: ~F.coalesce(F.array_contains(names, "x") & F.array_contains(names, "y"), F.lit(False))
    composite = F.col("area") | F.col("line")
    wanted = F.when(F.col("area"), "polygon").otherwise("tuple")
    wrong = F.array(
        F.when(F.col("domain_at").isNull(), "the domain is elsewhere"), F.when((F.coalesce(elsewhere, F.lit("")) != "") & ~F.col("line"), F.concat(F.lit("ranges elsewhere: "), elsewhere)),
        F.when(F.col("domain_at").isNotNull() & composite & joint.isNull(), "no composite axis"), F.when(composite & joint.isNotNull() & ~joint["data_type"].eqNullSafe(wanted), F.concat(F.lit("the composite axis is not one of the kind "), wanted)),
        F.when(F.col("domain_at").isNotNull() & F.when(composite, joint.isNotNull() & lacks(joint["coordinates"])).otherwise(lacks(named)), "no x and y"),
        F.when(F.col("line") & (F.coalesce(joint["size"], F.lit(0)) < 2) & joint.isNotNull(), "fewer than two vertices"), F.when(F.col("area") & (F.coalesce(_first(F.col("axes"), "z")["size"], F.lit(1)) > 1), "polygons at several z"),
    )
    rows = rows.withColumn("errors", F.filter(wrong, lambda e: e.isNotNull()))
    usable = F.filter("referencing", lambda c: F.coalesce((_system(c, "type") == "GeographicCRS") | ((_system(c, "type") == "ProjectedCRS") & _system(c, "id").isNotNull()), F.lit(False)))
    crs = _let(F.get(usable, F.lit(0)), lambda c: F.when(_system(c, "type") == "GeographicCRS", geographic_crs(_system(c, "id"))).otherwise(_system(c, "id")))
    member = F.coalesce(json_string(sub(F.col("own"), "id", "string")), F.regexp_extract("path", "[0-9]+$", 0))
    label = F.when(F.col("many"), F.array(F.struct(F.lit("coverage").alias("name"), member.alias("token")))).otherwise(F.array().cast("array<struct<name:string,token:string>>"))
    seen = F.filter("axes", lambda a: ~F.col("area") | a["name"].isin("composite", "t", "z"))
    polygons = F.when(F.col("area"), F.transform(joint["values"], lambda v: _polygon(v, joint["coordinates"])))

    def spread(layout: Column) -> Column:
        total = F.aggregate(layout, F.lit(1).cast("long"), lambda n, a: n * a["size"])
        held = F.struct(_ranges(F.col("ranges"), layout).alias("data"), polygons.alias("polygons"), label.alias("label"), total.alias("total"))
        each = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["total"] - 1), lambda i: _element(i, layout, s["data"], s["polygons"], s["label"]))
        return _let(held, lambda s: F.when(s["total"] > 0, each(s)))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("idx"), _line(joint).alias("geometry"), _members(label).alias("properties")))
    # A condition here, not a filter: pushed below, it would compute the parts that it reads once more.
    elements = F.when(F.size("errors") > 0, None).when(F.col("line"), whole).otherwise(_let(_layout(seen), spread))
    out = rows.select("doc_id", "path", "domain_type", crs.alias("crs"), F.inline(elements))
    return out, rows.select("doc_id", "path", F.explode("errors").alias("error"))


def _system(c: Column, name: str) -> Column:
    return F.try_variant_get(c, f"$.system.{name}", "string")


def collections(rows: DataFrame) -> DataFrame:
    """(doc_id, collection): the text of a FeatureCollection of each document's features, members in order."""
    each = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), F.col("properties"), F.lit("}"))
    number = F.coalesce(F.nullif(F.regexp_extract("path", "[0-9]+$", 0), F.lit("")), F.lit("0")).cast("int")
    return feature_collection(rows.select("doc_id", number.alias("_member"), "idx", each.alias("_text")), ["doc_id"], "_text", ["_member", "idx"])
