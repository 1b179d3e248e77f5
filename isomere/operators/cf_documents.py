"""From variables with CF metadata, as long tables, to coverage documents.

variables: ds_id, ord, name, dims (array of names), attrs (map of texts), is_coord, is_time. cells: ds_id, name, idx (row-major,
from 0), number, text; a time is a text of ISO form. An attribute dtype that begins with int makes integers. sizes: ds_id, dim, size. attributes: ds_id, attrs of the whole dataset.

Roles of coordinates come from their metadata, the first coordinate of a role in order winning. Coordinates of two roles or
more along one dimension that is none of theirs make a composite tuple axis. A dataset whose coordinates have no form in a
document is in the quarantine: a role coordinate of more than one dimension, a time without value, two dimensions for one
axis, or two roles for one dimension. Bounds and grid mappings give no ranges. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions import axes as fx
from isomere.functions.text import json_string, object_text
from isomere.operators.cf import role
from isomere.sources.stored import shuffled, stored

ROLES = ("x", "y", "z", "t")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _object(*members: tuple[str, Column]) -> Column:
    """The text of an object of those members that are not null, in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in members]), F.lit("}"))


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def roles(variables: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(ds_id, role, name, dims): the first coordinate of each role; overrides (ds_id, role, name) come first.

    A role that is overridden isn't looked for, and a coordinate that an override names takes no other role.
    """
    coords = variables.filter("is_coord")
    told = role(F.col("name"), _attr("standard_name"), _attr("units"), _attr("positive"), F.col("is_time"))
    found = coords.withColumn("role", told).filter("role is not null")
    if overrides is not None:
        found = found.join(overrides.select("ds_id", "role"), ["ds_id", "role"], "left_anti").join(overrides.select("ds_id", "name"), ["ds_id", "name"], "left_anti")
        found = found.unionByName(coords.join(overrides.select("ds_id", "role", "name"), ["ds_id", "name"]))
    return found.groupBy("ds_id", "role").agg(F.min_by(F.struct("name", "dims"), "ord").alias("c")).select("ds_id", "role", "c.name", "c.dims")


def composite(found: DataFrame) -> DataFrame:
    """(ds_id, dim, composite): the dimension that several roles vary along, and these roles in the order t, x, y, z."""
    along = found.filter((F.size("dims") == 1) & (F.get("dims", F.lit(0)) != F.col("name"))).select("ds_id", F.get("dims", F.lit(0)).alias("dim"), "role")
    many = along.groupBy("ds_id", "dim").agg(F.array_sort(F.collect_set("role")).alias("composite")).filter(F.size("composite") >= 2)
    return many.groupBy("ds_id").agg(F.min_by(F.struct("dim", "composite"), F.array_position(F.array(*map(F.lit, ROLES)), F.get(F.array_intersect(F.array(*map(F.lit, ROLES)), "composite"), F.lit(0)))).alias("c")).select("ds_id", "c.dim", "c.composite")


def kept(variables: DataFrame) -> DataFrame:
    """The data variables that become ranges."""
    declared = variables.select("ds_id", _attr("bounds").alias("name")).filter("name is not null").distinct()
    data = variables.filter(~F.col("is_coord") & ~F.map_contains_key("attrs", "grid_mapping_name") & ~F.regexp_like("name", F.lit("_(bnds|bounds)$")))
    return data.join(declared, ["ds_id", "name"], "left_anti")


def _tokens(cells: DataFrame) -> DataFrame:
    """cells with their JSON text; not-a-number is null."""
    number = F.when(~F.isnan("number"), F.btrim(F.to_json(F.array("number")), F.lit("[]")))
    return cells.withColumn("token", F.coalesce(json_string(F.col("text")), number, F.lit("null")))


def _lists(cells: DataFrame) -> DataFrame:
    """(ds_id, name, tokens, numbers, whole): the values of each variable in order; of data and axes that a document holds."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "token", "number", "text")))
    return cells.groupBy("ds_id", "name").agg(rows.alias("r")).select(
        "ds_id", "name", F.transform("r", lambda x: x["token"]).alias("tokens"), F.transform("r", lambda x: x["number"]).alias("numbers"), F.forall("r", lambda x: x["number"].isNotNull()).alias("whole")
    )


def axes(variables: DataFrame, cells: DataFrame, sizes: DataFrame, compact: bool = True, overrides: DataFrame | None = None) -> DataFrame:
    """(ds_id, key, dim, text): each axis, the dimension that it belongs to (null for a single value), and its JSON text."""
    found, lists = roles(variables, overrides), _lists(_tokens(cells))
    return _axes(variables, found, composite(found), lists, sizes, compact)


def _axes(variables: DataFrame, found: DataFrame, joint: DataFrame, lists: DataFrame, sizes: DataFrame, compact: bool) -> DataFrame:
    along = found.join(joint, "ds_id", "left").withColumn("inside", F.coalesce(F.array_contains("composite", F.col("role")), F.lit(False)))
    valued = along.join(lists, ["ds_id", "name"])
    regular = fx.compact(F.col("numbers"))
    short = F.col("whole") & regular["num"].isNotNull() & F.lit(compact)
    text = F.when(short, _object(*[(m, regular[m].cast("string")) for m in ("start", "stop", "num")])).otherwise(_object(("values", _list(F.col("tokens")))))
    alone = valued.filter("not inside").select("ds_id", F.col("role").alias("key"), F.get("dims", F.lit(0)).alias("dim"), text.alias("text"))
    columns = valued.filter("inside").groupBy("ds_id", "dim", "composite").agg(F.map_from_entries(F.collect_list(F.struct("role", "tokens"))).alias("by"))
    rows = F.transform(F.sequence(F.lit(0), F.size(F.get(F.map_values("by"), F.lit(0))) - 1), lambda i: _list(F.transform("composite", lambda r: F.get(F.col("by")[r], i))))
    tuples = columns.select("ds_id", F.lit("composite").alias("key"), "dim", _object(("dataType", F.lit('"tuple"')), ("coordinates", F.to_json("composite")), ("values", _list(rows))).alias("text"))
    taken = alone.unionByName(tuples)
    dims = kept(variables).select("ds_id", F.explode("dims").alias("dim")).distinct()
    rest = dims.join(shuffled(taken.select("ds_id", "dim")), ["ds_id", "dim"], "left_anti").join(shuffled(sizes), ["ds_id", "dim"])
    own = lists.join(variables.filter("is_coord").select("ds_id", "name"), ["ds_id", "name"]).withColumnRenamed("name", "dim")
    counted = _object(("values", _list(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: i.cast("string")))))
    left = rest.join(shuffled(own), ["ds_id", "dim"], "left").select("ds_id", F.col("dim").alias("key"), "dim", F.when(F.col("tokens").isNull(), counted).otherwise(text).alias("text"))
    return taken.unionByName(left)


def quarantine(variables: DataFrame, cells: DataFrame, found: DataFrame, every: DataFrame) -> DataFrame:
    """(ds_id, error) of datasets without a document; found: roles(), every: axes()."""
    curved = found.filter(F.size("dims") > 1).select("ds_id", F.concat(F.lit("coordinate "), "name", F.lit(" has more than one dimension")).alias("error"))
    times = variables.filter("is_coord and is_time").select("ds_id", "name").join(cells, ["ds_id", "name"]).filter("text is null")
    missing = times.select("ds_id", F.concat(F.lit("time "), "name", F.lit(" has a missing value")).alias("error")).distinct()
    twice = every.groupBy("ds_id", "key").count().filter("count > 1").select("ds_id", F.concat(F.lit("axis "), "key", F.lit(" has two dimensions")).alias("error"))
    hosts = every.filter("dim is not null").groupBy("ds_id", "dim").count().filter("count > 1").select("ds_id", F.concat(F.lit("dimension "), "dim", F.lit(" has two axes")).alias("error"))
    return curved.unionByName(missing).unionByName(twice).unionByName(hosts)


def domain_type(found: DataFrame, joint: DataFrame) -> DataFrame:
    """(ds_id, inferred, present): the domain type by the roles that have a dimension, and all roles of the dataset."""
    by = found.groupBy("ds_id").agg(F.collect_set(F.when(F.size("dims") > 0, F.col("role"))).alias("along"), F.collect_set("role").alias("present"))
    by = by.join(joint.select("ds_id", "composite"), "ds_id", "left")
    along, has = (lambda r: F.array_contains("along", r)), (lambda r: F.array_contains("present", r))
    kind = F.when(F.col("composite").isNotNull(), "Trajectory").when(along("x") & along("y"), "Grid").when(
        has("x") & has("y"), F.when(along("t") & ~along("z"), "PointSeries").when(along("z") & ~along("t"), "VerticalProfile").when(~along("t") & ~along("z"), "Point")
    )
    return by.select("ds_id", kind.alias("inferred"), "present")


def parameter(name: Column) -> Column:
    """The text of a variable's parameter: of categories for flags, of a unit, else null."""
    label = F.coalesce(_attr("long_name"), _attr("standard_name"), name)
    named = lambda c: F.concat(F.lit('{"und":'), json_string(c), F.lit("}"))
    codes = F.regexp_extract_all(_attr("flag_values"), F.lit("-?[0-9]+"), F.lit(0))
    meanings = F.split(F.trim(_attr("flag_meanings")), r"\s+")
    pairs = F.filter(F.zip_with(codes, meanings, lambda c, m: F.struct(c.alias("c"), m.alias("m"))), lambda p: p["c"].isNotNull() & p["m"].isNotNull())
    categories = _list(F.transform(pairs, lambda p: F.concat(F.lit('{"id":'), json_string(p["c"]), F.lit(',"label":'), named(F.replace(p["m"], F.lit("_"), F.lit(" "))), F.lit("}"))))
    encoding = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_string(p["c"]), F.lit(":"), p["c"])), ","), F.lit("}"))
    flags = _object(("type", F.lit('"Parameter"')), ("observedProperty", _object(("label", named(label)), ("categories", categories))), ("categoryEncoding", encoding))
    plain = _object(("type", F.lit('"Parameter"')), ("observedProperty", _object(("label", named(label)))), ("unit", _object(("symbol", json_string(_attr("units"))))))
    return F.when(_attr("flag_values").isNotNull() & _attr("flag_meanings").isNotNull(), flags).when(_attr("units").isNotNull(), plain)


def referencing(variables: DataFrame, found: DataFrame) -> DataFrame:
    """(ds_id, referencing): the systems of the roles present; a crs coordinate names the horizontal one, else it is geographic."""
    crs = variables.filter("is_coord and name = 'crs'").select("ds_id", _attr("reference_system_id").alias("id"), _attr("reference_system_type").alias("kind"))
    calendar = variables.select("ds_id", "name", _attr("calendar").alias("calendar"))
    times = found.filter("role = 't'").join(calendar, ["ds_id", "name"]).select("ds_id", F.coalesce("calendar", F.lit("Gregorian")).alias("calendar"))
    by = found.groupBy("ds_id").agg(F.collect_set("role").alias("r")).join(shuffled(crs), "ds_id", "left").join(shuffled(times), "ds_id", "left")
    kind = F.when(F.col("kind") == "ProjectedCRS", '"ProjectedCRS"').otherwise('"GeographicCRS"')
    system = lambda on, *members: _object(("coordinates", F.lit(on)), ("system", _object(*members)))
    has = lambda r: F.array_contains("r", r)
    listed = F.array(
        F.when(has("x") & has("y"), system('["x","y"]', ("type", kind), ("id", json_string(F.col("id"))))), F.when(has("z"), system('["z"]', ("type", F.lit('"VerticalCRS"')))),
        F.when(has("t"), system('["t"]', ("type", F.lit('"TemporalRS"')), ("calendar", json_string(F.col("calendar"))))),
    )
    return by.select("ds_id", _list(F.filter(listed, lambda x: x.isNotNull())).alias("referencing"))


def documents(variables: DataFrame, cells: DataFrame, sizes: DataFrame, attributes: DataFrame, compact: bool = True, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, body) of a Coverage a dataset, quarantine (ds_id, error)); attributes id and domain_type of a dataset win.

    overrides: (ds_id, role, name), the coordinates that fill roles whatever their attributes say. Tables, roles, axes and the
    lists of values are written once to the shared checkpoint folder, and all rules read these.
    """
    variables, cells, sizes = (stored(df) for df in (variables, cells, sizes))
    found, lists = stored(roles(variables, overrides)), stored(_lists(_tokens(cells)))
    joint = composite(found)
    every = stored(_axes(variables, found, joint, lists, sizes, compact))
    bad = quarantine(variables, cells, found, every)
    if overrides is not None:
        unknown = overrides.join(variables.filter("is_coord").select("ds_id", "name"), ["ds_id", "name"], "left_anti")
        bad = bad.unionByName(unknown.select("ds_id", F.concat(F.lit("no coordinate "), "name").alias("error")))
    bad = stored(bad)
    by_axis = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text"))))
    of_axes = every.join(bad.select("ds_id").distinct(), "ds_id", "left_anti").groupBy("ds_id").agg(by_axis.alias("axes"))
    named = every.filter("dim is not null").groupBy("ds_id").agg(F.collect_list(F.struct("dim", "key")).alias("pairs"))
    length = sizes.groupBy("ds_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("size").cast("string")))).alias("lengths"))
    data = kept(variables).join(lists, ["ds_id", "name"]).join(shuffled(named), "ds_id", "left").join(shuffled(length), "ds_id", "left")
    key_of = F.transform("dims", lambda d: F.coalesce(F.get(F.filter("pairs", lambda p: p["dim"] == d), F.lit(0))["key"], d))
    texts = F.exists("tokens", lambda t: F.startswith(t, F.lit('"')))
    integers = F.coalesce(F.startswith(_attr("dtype"), F.lit("int")), F.lit(False))
    tokens = F.when(integers, F.transform("numbers", lambda x: F.coalesce(x.cast("bigint").cast("string"), F.lit("null")))).otherwise(F.col("tokens"))
    array = _object(
        ("type", F.lit('"NdArray"')), ("dataType", F.when(texts, '"string"').when(integers, '"integer"').otherwise('"float"')), ("axisNames", F.when(F.size("dims") > 0, F.to_json(key_of))),
        ("shape", F.when(F.size("dims") > 0, _list(F.transform("dims", lambda d: F.col("lengths")[d])))), ("values", _list(tokens)),
    )
    data = data.select("ds_id", "ord", "name", array.alias("range"), parameter(F.col("name")).alias("parameter"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", "name", F.col(c).alias("text"))))), lambda x: F.struct(x["name"], x["text"]))
    ranges = data.groupBy("ds_id").agg(F.map_from_entries(in_order("range")).alias("ranges"), F.map_from_entries(in_order("parameter")).alias("parameters"))
    whole = of_axes
    for more in (ranges, domain_type(found, joint), referencing(variables, found), attributes.select("ds_id", "attrs")):
        whole = whole.join(shuffled(more), "ds_id", "left")
    kind = F.coalesce(_attr("domain_type"), "inferred")
    domain = _object(("type", F.lit('"Domain"')), ("domainType", json_string(kind)), ("axes", object_text(F.col("axes"))), ("referencing", F.coalesce("referencing", F.lit("[]"))))
    body = _object(
        ("type", F.lit('"Coverage"')), ("id", json_string(_attr("id"))), ("domain", domain), ("parameters", F.when(F.size("parameters") > 0, object_text(F.col("parameters")))),
        ("ranges", F.coalesce(object_text(F.col("ranges")), F.lit("{}"))),
    )
    return whole.select(F.col("ds_id").alias("doc_id"), body.alias("body")), bad
