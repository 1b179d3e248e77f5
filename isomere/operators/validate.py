"""Conformance findings as rows: (keys, code, severity, at, detail), one function a group of rules.

Structure rules read axes and ranges tables as isomere.sources.documents makes them; value rules read cells. All are
anti-joins, windows and expressions; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isomere.functions import axes as ax
from isomere.functions.arrays import product, template_variables
from isomere.functions.temporal import resolve
from isomere.functions.text import json_pointer, valid_language_tag

# Fixed rules of the twelve domain types: required, optional and single-valued axes, composite type, allowed coordinates.
RULES = {
    "Grid": (["x", "y"], ["z", "t"], [], None, []),
    "VerticalProfile": (["x", "y", "z"], ["t"], ["x", "y", "t"], None, []),
    "PointSeries": (["x", "y", "t"], ["z"], ["x", "y", "z"], None, []),
    "Point": (["x", "y"], ["z", "t"], ["x", "y", "z", "t"], None, []),
    "MultiPointSeries": (["composite", "t"], [], [], "tuple", ["x,y,z", "x,y"]),
    "MultiPoint": (["composite"], ["t"], ["t"], "tuple", ["x,y,z", "x,y"]),
    "Trajectory": (["composite"], ["z"], ["z"], "tuple", ["t,x,y,z", "t,x,y"]),
    "Section": (["composite", "z"], [], [], "tuple", ["t,x,y"]),
    "Polygon": (["composite"], ["z", "t"], ["composite", "z", "t"], "polygon", ["x,y"]),
    "PolygonSeries": (["composite", "t"], ["z"], ["composite", "z"], "polygon", ["x,y"]),
    "MultiPolygon": (["composite"], ["z", "t"], ["z", "t"], "polygon", ["x,y"]),
    "MultiPolygonSeries": (["composite", "t"], ["z"], ["z"], "polygon", ["x,y"]),
}

WARNINGS = ("domain.missing-domain-type", "coverage.domain-type-not-omitted", "temporal.lexical-form")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(k, *rule) for k, rule in RULES.items()]
    return spark.createDataFrame(rows, "domain_type string, required array<string>, optional array<string>, single array<string>, composite string, allowed array<string>")


def finding(rows: DataFrame, keys: Sequence[str], code: str, at: Column | None = None, detail: Column | None = None) -> DataFrame:
    severity = "warning" if code in WARNINGS else "error"
    at = F.lit("") if at is None else at
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity"), at.alias("at"), detail.alias("detail"))


def report(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def verdicts(coverages: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each coverage: errors, warnings, and whether it is valid (no errors)."""
    n = issues.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = coverages.select(*keys).distinct().join(n, list(keys), "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings")], (F.coalesce("errors", F.lit(0)) == 0).alias("valid"))


def domain_issues(domains: DataFrame, axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """domains: keys, domain_type, referencing (array or null). axes: keys, name, size, data_type, coordinates."""
    keys = list(keys)
    spark = domains.sparkSession
    known = domains.join(F.broadcast(rules(spark)), "domain_type")  # twelve rows
    at = json_pointer(F.lit("domain"), F.lit("axes"), F.col("name"))
    have = axes.select(*keys, "name", "size", "data_type", "coordinates")
    missing = known.select(*keys, F.explode("required").alias("name")).join(have, [*keys, "name"], "left_anti")
    single = known.select(*keys, F.explode("single").alias("name")).join(have, [*keys, "name"]).filter("size <> 1")
    expected = known.select(*keys, F.explode(F.concat("required", "optional")).alias("name"))
    extra = have.join(known.select(*keys), keys, "left_semi").join(expected, [*keys, "name"], "left_anti").filter("size <> 1")
    composite = have.filter("name = 'composite'").join(known.filter("composite is not null").select(*keys, "composite", "allowed"), keys)
    wrong = composite.filter(~F.col("data_type").eqNullSafe(F.col("composite")))
    named = composite.filter(F.col("data_type") == F.col("composite")).filter(~F.array_contains("allowed", F.array_join(F.coalesce("coordinates", F.array().cast("array<string>")), ",")))
    none = F.coalesce(F.nullif("domain_type", F.lit(""))).isNull()
    return report([
        finding(missing, keys, "domain.missing-axis", at, F.col("name")),
        finding(single, keys, "domain.axis-not-single", at, F.col("name")),
        finding(wrong, keys, "domain.composite-data-type", at, F.col("composite")),
        finding(named, keys, "domain.composite-coordinates", at, F.array_join("coordinates", ",")),
        finding(extra, keys, "domain.extra-axis-not-single", at, F.col("name")),
        finding(domains.filter("referencing is null or size(referencing) = 0"), keys, "domain.missing-referencing", F.lit("/domain/referencing")),
        finding(domains.filter(none), keys, "domain.missing-domain-type", F.lit("/domain/domainType")),
    ])


def axis_form_issues(axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """axes: keys, name, axis as in the documents source."""
    at = json_pointer(F.lit("domain"), F.lit("axes"), F.col("name"))
    size = ax.length(F.col("axis.values"), F.col("axis.num"))
    members = F.filter(F.array(*[F.when(F.col(f"axis.{m}").isNotNull(), m) for m in ("start", "stop", "num")]), lambda x: x.isNotNull())
    plain = F.coalesce(F.col("axis.dataType"), F.lit("")).isin("tuple", "polygon")
    return report([
        finding(axes.filter(F.size("axis.bounds") != 2 * size), keys, "axis.bounds-length", F.concat(at, F.lit("/bounds")), F.size("axis.bounds")),
        finding(axes.filter(F.col("axis.values").isNotNull() & (F.size(members) > 0)), keys, "axis.form-conflict", at, F.array_join(members, ",")),
        finding(axes.filter(~plain & (F.col("axis.coordinates") == F.array("name"))), keys, "axis.coordinates-not-omitted", F.concat(at, F.lit("/coordinates")), F.col("name")),
    ])


def monotonic_issues(values: DataFrame, keys: Sequence[str], axis: Sequence[str] = ("name",), strict: bool = False) -> DataFrame:
    """values: keys, axis columns, pos, value (number; null and NaN are skipped). The first place where an axis turns back.

    The first unequal pair sets the direction. Equal neighbours break the order only if strict, and then even before that pair.
    """
    by = Window.partitionBy(*keys, *axis).orderBy("pos")
    rows = values.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    rows = rows.withColumn("sg", F.sign(F.col("value") - F.lag("value").over(by)))
    rows = rows.withColumn("dir", F.first(F.nullif("sg", F.lit(0.0)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    turned = (F.col("sg") != 0) & (F.col("sg") != F.col("dir"))
    broken = rows.filter(turned | (F.col("sg") == 0) if strict else turned).groupBy(*keys, *axis).agg(F.min("pos").alias("pos"))
    at = json_pointer(F.lit("domain"), F.lit("axes"), *[F.col(a) for a in axis], F.lit("values"), F.col("pos"))
    return finding(broken, keys, "axis.not-monotonic", at, F.col("pos"))


def polygon_issues(rings: DataFrame, keys: Sequence[str], arity: Column) -> DataFrame:
    """rings: keys, ring (array of positions)."""
    wrong = rings.select(*keys, F.explode(F.array_distinct(F.transform("ring", lambda p: F.size(p)))).alias("got"), arity.alias("expected")).filter("got <> expected")
    return report([
        finding(wrong, keys, "axis.polygon-position-arity", detail=F.col("got")),
        finding(rings.filter(ax.ring_too_short(F.col("ring"))), keys, "axis.polygon-ring-too-short", detail=F.size("ring")),
        finding(rings.filter(F.size("ring") > 0).filter(ax.ring_open(F.col("ring"))), keys, "axis.polygon-ring-not-closed"),
    ])


def tuple_issues(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values: keys, name, value (array or null), coordinates."""
    at = json_pointer(F.lit("domain"), F.lit("axes"), F.col("name"))
    return report([
        finding(values.filter("value is null"), keys, "axis.composite-value-shape", at, F.lit("tuple")),
        finding(values.filter(F.size("value") != F.size("coordinates")), keys, "axis.composite-arity", at, F.size("value")),
    ])


def ndarray_issues(arrays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """arrays: keys, key, shape, axis_names, n_values."""
    at = json_pointer(F.lit("ranges"), F.col("key"))
    return report([
        finding(arrays.filter(F.size("shape") != F.size("axis_names")), keys, "ndarray.shape-rank", F.concat(at, F.lit("/shape"))),
        finding(arrays.filter(product(F.col("shape")) != F.col("n_values")), keys, "ndarray.value-count", F.concat(at, F.lit("/values")), F.col("n_values")),
    ])


def range_issues(ranges: DataFrame, axes: DataFrame, parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ranges: keys, key, shape, axis_names. axes: keys, name, size. parameters: keys, key."""
    keys = list(keys)
    each = ranges.select(*keys, "key", F.posexplode(F.arrays_zip(F.col("axis_names").alias("name"), F.col("shape").alias("n"))).alias("k", "x")).select(*keys, "key", "k", "x.name", "x.n")
    at = json_pointer(F.lit("ranges"), F.col("key"))
    place = lambda member: json_pointer(F.lit("ranges"), F.col("key"), F.lit(member), F.col("k"))
    unknown = each.join(axes.select(*keys, "name"), [*keys, "name"], "left_anti")
    unequal = each.join(axes.select(*keys, "name", "size"), [*keys, "name"]).filter("n <> size")
    lacking = ranges.join(parameters.select(*keys).distinct(), keys, "left_semi").join(parameters.select(*keys, "key"), [*keys, "key"], "left_anti")
    return report([
        finding(lacking, keys, "coverage.range-without-parameter", at, F.col("key")),
        finding(unknown, keys, "coverage.range-axis-not-in-domain", place("axisNames"), F.col("name")),
        finding(unequal, keys, "coverage.range-shape-mismatch", place("shape"), F.col("name")),
    ])


def parameter_issues(coverages: DataFrame, parameters: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """coverages: keys, has_parameters. parameters: keys, key, categories, encoding (map or null). groups: keys, group_idx, members."""
    keys = list(keys)
    ids = parameters.select(*keys, "key", "categories", F.explode(F.map_keys("encoding")).alias("id"))
    unknown = ids.filter(~F.array_contains(F.coalesce("categories", F.array().cast("array<string>")), F.col("id")))
    named = groups.select(*keys, "group_idx", F.explode("members").alias("key"))
    strange = named.join(parameters.select(*keys, "key"), [*keys, "key"], "left_anti")
    return report([
        finding(coverages.filter("not has_parameters"), keys, "coverage.missing-parameters"),
        finding(strange, keys, "parameter-group.unknown-member", json_pointer(F.lit("parameterGroups"), F.col("group_idx")), F.col("key")),
        finding(unknown, keys, "parameter.category-encoding-unknown-id", json_pointer(F.lit("parameters"), F.col("key")), F.col("id")),
    ])


def value_issues(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values: keys, key, data_type, class (as written), token. Missing values fit every type; integers are no floats, nor the other way round."""
    fits = (F.col("class") == "null") | (F.col("class") == F.col("data_type")) | ((F.col("data_type") == "float") & (F.col("class") == "integer"))
    return finding(values.filter(~fits), keys, "range.value-type-mismatch", json_pointer(F.lit("ranges"), F.col("key")), F.col("token"))


def code_issues(cells: DataFrame, codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cells: keys, key, value. codes: key, value: the codes of known categories."""
    wrong = cells.filter("value is not null").join(codes.select("key", "value"), ["key", "value"], "left_anti")
    return finding(wrong, keys, "range.invalid-category-code", json_pointer(F.lit("ranges"), F.col("key")), F.col("value"))


def domain_type_issues(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """members: keys, own_type, has_type, inner_type, shared_type, of coverages of a collection."""
    shared = members.filter("nullif(shared_type, '') is not null")
    own = F.coalesce(F.nullif("inner_type", F.lit("")), F.nullif("own_type", F.lit("")))
    return report([
        finding(shared.filter("has_type and own_type = shared_type"), keys, "coverage.domain-type-not-omitted", detail=F.col("own_type")),
        finding(shared.filter(own != F.col("shared_type")), keys, "coverage.domain-type-conflict", detail=own),
    ])


def system_issues(systems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """systems: keys, conn_idx, kind, calendar, target."""
    at = lambda member: json_pointer(F.lit("domain"), F.lit("referencing"), F.col("conn_idx"), F.lit("system"), F.lit(member))
    return report([
        finding(systems.filter("kind = 'TemporalRS' and calendar is null"), keys, "temporal.missing-calendar", at("calendar")),
        finding(systems.filter("kind = 'IdentifierRS' and target is null"), keys, "identifier.missing-target-concept", at("targetConcept")),
    ])


def lexical_issues(times: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return finding(times.filter(resolve(F.col(value))["kind"] == "malformed"), keys, "temporal.lexical-form", detail=F.col(value))


def language_issues(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """texts: keys, at, i18n (map of language to text, or null where there is none)."""
    tags = texts.select(*keys, "at", F.explode(F.map_keys("i18n")).alias("lang"))
    return report([
        finding(tags.filter(~valid_language_tag(F.col("lang"))), keys, "i18n.invalid-language-tag", F.col("at"), F.col("lang")),
        finding(texts.filter("i18n is not null and size(i18n) = 0"), keys, "i18n.empty", F.col("at")),
    ])


def tile_issues(arrays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """arrays: keys, set_idx, shape, axis_names, tile_shape, url_template."""
    at = json_pointer(F.lit("tileSets"), F.col("set_idx"))
    dims = arrays.select("*", F.posexplode("tile_shape").alias("k", "tile")).withColumn("dim", F.get("shape", F.col("k")))
    variables = template_variables(F.col("url_template"))
    divided = F.filter(F.zip_with("axis_names", "tile_shape", lambda a, t: F.when(t.isNotNull(), a)), lambda x: x.isNotNull())
    same = F.size("shape") == F.size("axis_names")
    return report([
        finding(arrays.filter(~same), keys, "tiled-ndarray.shape-rank", at),
        finding(dims.filter("tile > dim"), keys, "tiled-ndarray.tile-shape-too-large", at, F.col("tile")),
        finding(dims.filter("tile < 1"), keys, "tiled-ndarray.tile-shape-not-positive", at, F.col("tile")),
        finding(arrays.select("*", F.explode(F.array_except(divided, variables)).alias("v")), keys, "tiled-ndarray.url-template-missing-variable", at, F.col("v")),
        finding(arrays.filter(same).select("*", F.explode(F.array_except(variables, divided)).alias("v")), keys, "tiled-ndarray.url-template-unknown-variable", at, F.col("v")),
    ])
