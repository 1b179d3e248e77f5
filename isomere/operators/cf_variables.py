"""Coverage documents to variables with CF metadata, as the long tables that cf_documents reads: its inverse.

Each coverage is a dataset, `ds_id`: the document's id, followed by the pointer to the coverage within a collection. Its axes are
coordinates, of one value without a dimension unless a range has it; the coordinates of a tuple axis are coordinates of their
own along that axis. Ranges are data variables. All of a dataset stands in its coverage's row, so the tables come by spreading
that row, without joins; values are spread one a row and never gathered. Rows are decoded once, and kept in the shared
checkpoint folder for the tables.

variables (ds_id, ord, name, dims, attrs, is_coord, is_time), cells (ds_id, name, idx, number, text), sizes (ds_id, dim, size),
attributes (ds_id, attrs). What has no such form stands in the quarantine (ds_id, error): domains and ranges elsewhere, polygons,
times that are none, dimensions of two lengths. Repeated documents give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.calendars import is_moment
from isomere.functions.systems import flag_meaning, refine, standard_name, vertical_name, vertical_positive
from isomere.functions.temporal import is_standard_calendar, iso_time, resolve
from isomere.functions.text import display
from isomere.sources.model import is_text, present, sub
from isomere.sources.parts import parts
from isomere.sources.stored import stored

#: Fixed: what a geographic system's coordinates are, in their order.
GEOGRAPHIC = (("longitude", {"units": "degrees_east"}), ("latitude", {"units": "degrees_north"}), ("height", {"positive": "up"}))
TEXTS = "map<string,string>"


@dataclass
class Variables:
    variables: DataFrame
    cells: DataFrame
    sizes: DataFrame
    attributes: DataFrame
    quarantine: DataFrame


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _attributes(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _systems(row: Column) -> Column:
    """The connections as (coordinates, kind, id, calendar), kinds refined."""

    def one(c: Column) -> Column:
        get = lambda m: F.try_variant_get(c, f"$.system.{m}", "string")
        target = F.to_json(F.try_variant_get(c, "$.system.targetConcept", "variant"))
        return F.struct(sub(c, "coordinates", "array<string>").alias("coordinates"), refine(get("type"), get("calendar"), target).alias("kind"), get("id").alias("id"), get("calendar").alias("calendar"))

    return F.coalesce(F.transform(row, one), F.array().cast("array<struct<coordinates:array<string>,kind:string,id:string,calendar:string>>"))


def _of(systems: Column, name: Column) -> Column:
    """The last connection that names a coordinate."""
    return F.try_element_at(F.filter(systems, lambda c: F.array_contains(c["coordinates"], name)), F.lit(-1))


def _coordinate_attributes(systems: Column, own: Column, name: Column) -> Column:
    """own: the connection that _of() finds."""
    geographic = F.try_element_at(F.filter(systems, lambda c: (c["kind"] == "GeographicCRS") & F.array_contains(c["coordinates"], name)), F.lit(-1))
    vertical = F.when(own["kind"] == "VerticalCRS", _attributes(("standard_name", vertical_name(own["id"])), ("positive", vertical_positive(own["id"]))))

    def placed(place: Column) -> Column:
        out = vertical
        for k, (standard, more) in enumerate(GEOGRAPHIC):
            out = F.when(place == k + 1, _attributes(("standard_name", F.lit(standard)), *[(m, F.lit(v)) for m, v in more.items()])).otherwise(out)
        return out

    calendar = _attributes(("calendar", F.when(~is_standard_calendar(own["calendar"]), own["calendar"])))
    return F.coalesce(F.when(own["kind"] == "TemporalRS", calendar).otherwise(_let(F.array_position(geographic["coordinates"], name), placed)), F.create_map().cast(TEXTS))


def _number(v: Column) -> Column:
    return F.when(~is_text(v), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def _with_attributes(data: DataFrame) -> DataFrame:
    """data (name, parameters, crs, data_type) with attrs; what several attributes read is a column before they do."""
    texts = lambda v, path: F.nullif(_let(F.try_variant_get(v, path, TEXTS), display), F.lit(""))
    p, encoding, flags, symbol = F.col("p"), F.col("encoding"), F.col("flags"), F.col("symbol")
    codes = lambda c: _let(F.try_element_at(encoding, sub(c, "id", "string")), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<bigint>"), F.array(F.try_variant_get(v, "$", "bigint"))))
    flag = lambda c: F.transform(codes(c), lambda n: F.struct(n.cast("string").alias("value"), flag_meaning(F.coalesce(texts(c, "$.label"), sub(c, "id", "string"))).alias("meaning")))
    data = data.withColumn("p", F.try_element_at("parameters", F.col("name"))).withColumns({"encoding": F.try_variant_get(p, "$.categoryEncoding", "map<string,variant>"), "symbol": F.try_variant_get(p, "$.unit.symbol", "variant")})
    listed = F.filter(F.flatten(F.transform(F.try_variant_get(p, "$.observedProperty.categories", "array<variant>"), flag)), lambda x: x["value"].isNotNull())
    data = data.withColumn("flags", F.when(encoding.isNotNull(), listed))
    some = lambda part, by: F.when(F.size(flags) > 0, F.array_join(F.transform(flags, lambda x: x[part]), by))
    unit = F.when(is_text(symbol), F.try_variant_get(symbol, "$", "string")).otherwise(sub(symbol, "value", "string"))
    return data.withColumn("attrs", _attributes(
        ("long_name", F.coalesce(texts(p, "$.label"), texts(p, "$.observedProperty.label"))), ("standard_name", standard_name(F.try_variant_get(p, "$.observedProperty.id", "string"))), ("units", unit),
        ("flag_values", some("value", ",")), ("flag_meanings", some("meaning", " ")), ("dtype", F.when(F.col("data_type") == "integer", "int64")), ("grid_mapping", F.when(F.col("crs").isNotNull(), "crs")),
    ))


def variables(decoded: DataFrame) -> Variables:
    """The tables of all coverages of decoded documents."""
    rows = parts(decoded).filter("kind = 'Coverage'").withColumn("ds_id", F.concat(F.col("doc_id").cast("string"), F.col("path"))).withColumn("systems", _systems(F.col("referencing")))
    cell = lambda v: F.struct(_number(v).alias("number"), _text(v).alias("text"))
    arrays = F.transform(F.filter(F.map_entries("ranges"), lambda e: sub(e["value"], "type", "string") == "NdArray"), lambda e: F.struct(
        e["key"].alias("name"), F.coalesce(sub(e["value"], "axisNames", "array<string>"), F.array().cast("array<string>")).alias("dims"),
        F.coalesce(sub(e["value"], "shape", "array<int>"), F.array().cast("array<int>")).alias("shape"), sub(e["value"], "dataType", "string").alias("data_type"),
        F.transform(sub(e["value"], "values", "array<variant>"), cell).alias("values"),
    ))
    crs = F.get(F.filter("systems", lambda c: c["kind"].isin("GeographicCRS", "ProjectedCRS")), F.lit(0))
    used = F.flatten(F.transform("data", lambda d: d["dims"]))

    def coordinate(a: Column, name: Column, dims: Column, pick) -> Column:
        """pick: from an item of the axis to the coordinate's value."""
        values = F.transform(a["values"], lambda whole: _let(pick(whole), lambda v: F.struct(_number(v).alias("number"), _text(v).alias("text"), present(v).alias("there"))))
        own = _let(_of(F.col("systems"), name), lambda own: F.struct(
            F.coalesce(own["kind"] == "TemporalRS", F.lit(False)).alias("is_time"), own["calendar"].alias("calendar"), _coordinate_attributes(F.col("systems"), own, name).alias("attrs")
        ))
        start, stop, num = (sub(a["axis"], m, k).alias(m) for m, k in (("start", "double"), ("stop", "double"), ("num", "int")))
        return F.struct(name.alias("name"), dims.alias("dims"), own.alias("told"), values.alias("values"), a["size"].alias("size"), start, stop, num)

    def coordinates(a: Column) -> Column:
        alone = F.when((a["size"] == 1) & ~F.array_contains(F.col("used"), a["name"]), F.array().cast("array<string>")).otherwise(F.array(a["name"]))
        plain = F.array(coordinate(a, a["name"], alone, lambda whole: whole))
        inner = F.transform(a["coordinates"], lambda c, k: coordinate(a, c, F.array(a["name"]), lambda whole: F.get(F.try_variant_get(whole, "$", "array<variant>"), k)))
        return F.when(a["data_type"].eqNullSafe("tuple"), inner).otherwise(plain)

    # All that a coverage tells is worked out once, in its row; the tables below only spread it.
    rows = rows.withColumn("data", arrays).withColumn("used", used)
    curved = F.exists("axes", lambda a: a["data_type"].eqNullSafe("polygon"))
    elsewhere = F.array_join(F.filter(F.map_keys("ranges"), lambda k: ~F.exists("data", lambda d: d["name"] == k)), ", ")
    coords = F.flatten(F.transform("axes", coordinates))
    rows = stored(rows.select("ds_id", "domain_at", "domain_type", "parameters", "data", crs.alias("crs"), sub(F.col("own"), "id", "string").alias("id"), coords.alias("coords"), curved.alias("curved"), elsewhere.alias("elsewhere")))
    each = rows.select("ds_id", F.posexplode("coords").alias("ord", "c")).select("ds_id", "ord", "c.*").select("*", "told.*").drop("told")
    of_coords = each.select("ds_id", "ord", "name", "dims", "attrs", F.lit(True).alias("is_coord"), "is_time")
    grid = rows.filter("crs is not null").select("ds_id", F.size("coords").alias("ord"), F.lit("crs").alias("name"), F.array().cast("array<string>").alias("dims"), _attributes(
        ("reference_system_type", F.col("crs.kind")), ("grid_mapping_name", F.when(F.col("crs.kind") == "GeographicCRS", "latitude_longitude")), ("reference_system_id", F.col("crs.id"))
    ).alias("attrs"), F.lit(True).alias("is_coord"), F.lit(False).alias("is_time"))
    data = rows.select("ds_id", F.posexplode("data").alias("k", "d"))
    named = rows.select("ds_id", "crs", "parameters", F.size("coords").alias("n"), F.posexplode(F.transform("data", lambda d: F.struct(d["name"].alias("name"), d["dims"].alias("dims"), d["data_type"].alias("data_type")))).alias("k", "d"))
    named = _with_attributes(named.select("ds_id", "crs", "parameters", (F.col("n") + 1 + F.col("k")).alias("ord"), "d.*"))
    of_data = named.select("ds_id", "ord", "name", "dims", "attrs", F.lit(False).alias("is_coord"), F.lit(False).alias("is_time"))

    listed = each.filter("values is not null").select("ds_id", "name", "is_time", "calendar", F.posexplode("values").alias("idx", "v")).select("ds_id", "name", "is_time", "calendar", "idx", "v.*")
    # Positions of a regular axis are counted, and each value follows from its position.
    regular = each.filter("values is null").select("ds_id", "name", "is_time", "calendar", "start", "stop", "num")
    regular = regular.select("*", F.explode(F.sequence(F.lit(0), F.col("num") - 1)).alias("idx"))
    step = F.coalesce((F.col("stop") - F.col("start")) / F.nullif(F.col("num") - 1, F.lit(0)), F.lit(0.0))
    regular = regular.select("ds_id", "name", "is_time", "calendar", "idx", (F.col("start") + F.col("idx") * step).alias("number"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("there"))
    spread = listed.unionByName(regular).withColumn("when", F.when(F.col("is_time") & is_standard_calendar(F.col("calendar")), resolve(F.col("text"))))
    time = F.when(F.col("when").isNull(), F.col("text")).otherwise(iso_time(F.col("when.when")))
    of_axes = spread.select("ds_id", "name", "idx", "number", time.alias("text"))
    of_crs = rows.filter("crs is not null").select("ds_id", F.lit("crs").alias("name"), F.lit(0).alias("idx"), F.lit(0.0).alias("number"), F.lit(None).cast("string").alias("text"))
    of_values = data.select("ds_id", "d.name", F.posexplode("d.values").alias("idx", "v")).select("ds_id", "name", "idx", "v.*")

    lengths = each.filter("size(dims) > 0").select("ds_id", F.get("dims", F.lit(0)).alias("dim"), "size").unionByName(
        data.select("ds_id", F.inline(F.arrays_zip(F.col("d.dims").alias("dim"), F.col("d.shape").alias("size"))))
    )
    by_dim = lengths.groupBy("ds_id", "dim").agg(F.min("size").alias("size"), F.max("size").alias("most"))

    wrong = F.filter(F.array(
        F.when(F.col("domain_at").isNull(), "the domain is elsewhere"), F.when(F.col("domain_type").isin("Polygon", "PolygonSeries", "MultiPolygon", "MultiPolygonSeries") | F.col("curved"), "a domain of polygons"),
        F.when(F.col("elsewhere") != "", F.concat(F.lit("ranges elsewhere: "), "elsewhere")),
    ), lambda e: e.isNotNull())
    right_time = F.when(is_standard_calendar(F.col("calendar")), F.col("when.kind") == "moment").otherwise(is_moment(F.col("text"), F.col("calendar")))
    untimely = spread.filter(F.col("is_time") & F.col("there") & ~F.coalesce(right_time, F.lit(False))).groupBy("ds_id", "name").agg(F.count("*").alias("n"))
    quarantine = rows.select("ds_id", F.explode(wrong).alias("error")).unionByName(untimely.select("ds_id", F.concat(F.lit("times that are none: "), "name").alias("error")))
    quarantine = quarantine.unionByName(by_dim.filter("size <> most").select("ds_id", F.concat(F.lit("dimension of two lengths: "), "dim").alias("error")))
    attributes = rows.select("ds_id", _attributes(("Conventions", F.lit("CF-1.10")), ("domain_type", F.col("domain_type")), ("id", F.col("id"))).alias("attrs"))
    return Variables(
        of_coords.unionByName(grid).unionByName(of_data), of_axes.unionByName(of_crs).unionByName(of_values), by_dim.select("ds_id", "dim", "size"), attributes, quarantine
    )
