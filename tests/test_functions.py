import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isomere.functions import arrays, axes, systems, temporal, text
from isomere.operators import cf, summary
from isomere.sources import schemas


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def ints(*x):
    return F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")


def test_strides_and_indices(spark):
    assert one(spark, arrays.strides(ints(2, 3, 4)), arrays.strides(ints(5)), arrays.strides(ints())) == ([12, 4, 1], [1], [])
    assert one(spark, arrays.ravel_index(ints(1, 2, 3), arrays.strides(ints(2, 3, 4)))) == (23,)
    assert one(spark, arrays.unravel_index(F.lit(23), ints(2, 3, 4))) == ([1, 2, 3],)


def test_tiles_and_templates(spark):
    assert one(spark, arrays.tile_count(ints(2, 5, 10), F.array(F.lit(None).cast("int"), F.lit(2), F.lit(3)))) == (12,)
    assert one(spark, arrays.template_variables(F.lit("a/{y}-{x}"))) == (["y", "x"],)
    assert one(spark, arrays.expand_template(F.lit("a/{y}-{x}"), F.array(F.lit("y"), F.lit("x")), ints(1, 2))) == ("a/1-2",)


def test_missing_values(spark):
    got = one(spark, *[arrays.finite_or_null(F.lit(x)) for x in (1.5, float("nan"), float("inf"))], arrays.as_float(F.lit(None).cast("double"), -1.0))
    assert got == (1.5, None, None, -1.0)


@settings(max_examples=8, deadline=None)
@given(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6), st.integers(1, 30))
def test_regular_values(spark, start, stop, num):
    (got,) = one(spark, axes.coordinate_values(F.lit(None).cast("array<double>"), F.lit(start), F.lit(stop), F.lit(num)))
    assert got == ([start] if num == 1 else [start + i * ((stop - start) / (num - 1)) for i in range(num)])


def test_axis_forms(spark):
    values = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, axes.is_regular(values(0, 1, 2)), axes.is_regular(values(0, 1, 3)), axes.is_regular(values(2, 2)), axes.is_regular(values(1))) == (True, False, False, False)
    c = one(spark, axes.compact(values(0, 90, 180)), axes.compact(values(0, 1, 5)))
    assert (c[0].start, c[0].stop, c[0].num, c[0]["values"]) == (0.0, 180.0, 3, None) and c[1]["values"] == [0.0, 1.0, 5.0]
    assert one(spark, axes.bounds_of(ints(0, 1, 2, 3, 4, 5), ints(2, 0))) == ([4, 5, 0, 1],)
    assert one(spark, axes.length(F.lit(None).cast("array<int>"), F.lit(4)), axes.length(ints(1, 2), F.lit(None).cast("int"))) == (4, 2)


def test_rings(spark):
    ring = lambda *p: F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in p])
    closed = ring((0, 0), (1, 0), (1, 1), (0, 0))
    assert one(spark, axes.ring_open(closed), axes.ring_open(ring((0, 0), (1, 1))), axes.ring_open(ring((math.nan, 0), (math.nan, 0))), axes.ring_too_short(closed)) == (False, True, True, False)


@pytest.mark.parametrize("value, kind, precision", [
    ("2020", "moment", "year"), ("2020-02", "moment", "month"), ("2020-02-29", "moment", "day"), ("2020-01-01T00:00:00Z", "moment", "second"), ("2020-01-01T00:00:00.25+05:30", "moment", "second"),
    ("0000-01-01", "unrepresentable", None), ("12020", "malformed", None), ("+12345", "unrepresentable", None), ("2016-12-31T23:59:60Z", "unrepresentable", None),
    ("2020-01-01T00:00:00", "malformed", None), ("2021-02-29", "malformed", None), ("2010-13-99", "malformed", None), ("x", "malformed", None), ("", "malformed", None), ("٢٠٢٠-01", "malformed", None),
])
def test_resolve(spark, value, kind, precision):
    (r,) = one(spark, temporal.resolve(F.lit(value)))
    assert (r.kind, r.precision, r.when is not None) == (kind, precision, kind == "moment")


def test_times(spark):
    assert one(spark, temporal.iso_duration(F.lit(90.0)), temporal.iso_duration(F.lit(-0.25)), temporal.iso_duration(F.lit(0))) == ("PT90S", "-PT0.25S", "PT0S")
    assert one(spark, temporal.iso_time(F.lit(dt.datetime(2020, 1, 2, 3, 4, 5))), temporal.iso_time(F.lit(dt.datetime(2020, 1, 2, 3, 4, 5, 250000)))) == ("2020-01-02T03:04:05Z", "2020-01-02T03:04:05.250000Z")
    assert one(spark, *[temporal.is_standard_calendar(F.lit(c)) for c in ("Gregorian", "http://x/uom/ISO-8601/Gregorian", "noleap")]) == (True, True, False)


def test_texts(spark):
    assert text.media_type("a", "b") == 'application/prs.coverage+json; profile="a b"'
    assert one(spark, *[text.is_media_type(F.lit(v)) for v in (text.media_type(), " APPLICATION/prs.coverage+json ; q=1", "text/plain", None)]) == (True, True, False, False)
    assert one(spark, text.json_pointer(F.lit("a/b~c"), F.lit(0))) == ("/a~1b~0c/0",)
    assert one(spark, *[text.valid_language_tag(F.lit(t)) for t in ("en", "de-AT", "zh-Hant-TW", "und", "x", "en_US", "")]) == (True, True, True, True, False, False, False)
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    assert one(spark, text.display(m("de", "a", "und", "b", "en", "c")), text.display(m("de", "a")), text.display(F.lit(None).cast("map<string,string>"))) == ("b", "a", "")


def test_systems(spark):
    null = F.lit(None).cast("string")
    assert one(spark, systems.refine(F.lit("TemporalRS"), null, null), systems.refine(F.lit("TemporalRS"), F.lit("Gregorian"), null), systems.refine(F.lit("MyRS"), null, null)) == ("Opaque", "TemporalRS", "Opaque")
    assert one(spark, systems.geographic_crs(F.lit("http://www.opengis.net/def/crs/EPSG/0/4326")), systems.geographic_crs(F.lit("mine")), systems.geographic_crs(null)) == ("http://www.opengis.net/def/crs/EPSG/0/4326", "OGC:CRS84", "OGC:CRS84")
    assert one(spark, systems.vertical_positive(F.lit("Sea Depth")), systems.vertical_positive(F.lit("altitude")), systems.vertical_positive(F.lit("x"))) == ("down", "up", None)
    assert one(spark, systems.standard_name(F.lit("http://v/standard_name/sea_ice/")), systems.standard_name(F.lit("other"))) == ("sea_ice", None)


def test_cf_and_cards(spark):
    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    sizes = lambda **k: F.create_map(*[F.lit(v) for p in k.items() for v in p])
    got = one(
        spark, cf.domain_type(names("x", "y", "t"), names(), sizes(x=1, y=1, t=9)), cf.domain_type(names("x", "y"), names(), sizes(x=4, y=1)),
        cf.domain_type(names(), names("t", "x", "y"), sizes(z=1)), cf.domain_type(names("z"), names("t", "x", "y"), sizes(z=5)), cf.domain_type(names("t"), names("x", "y"), sizes(t=2)), cf.domain_type(names("a"), names(), sizes(a=1)),
    )
    assert got == ("PointSeries", "Grid", "Trajectory", "Section", "MultiPointSeries", None)
    (html,) = one(spark, summary.card(F.lit("A & B"), F.create_map(F.lit("n"), F.lit("<1>"))))
    assert html == "<div><strong>A &amp; B</strong><table><tr><th>n</th><td>&lt;1&gt;</td></tr></table></div>"


def test_schemas():
    made = schemas.component_schemas()
    assert schemas.schema_ref("NdArray")["$ref"].split("/")[-1] in made and made["CoverageJSON.NdArray"]["required"] == ["type", "dataType", "values"]


def test_resolve_looks_for_each_form_once(spark):
    """Also under a condition, where the engine shares nothing."""
    rows = spark.createDataFrame([("2020-01-02T03:04:05+01:00", True), ("2020-02-29", True), ("x", True), (None, True), ("2020", False)], "v string, c boolean")
    found = rows.select(F.when(F.col("c"), temporal.resolve(F.col("v"))).alias("r"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[0-9]{4}-[0-9]{2}-[0-9]{2}T") == 1
    assert [r.r and (r.r.kind, r.r.precision) for r in found.collect()] == [("moment", "second"), ("moment", "day"), ("malformed", None), ("malformed", None), None]


def test_text_in_brackets_keeps_them(spark):
    row = spark.range(1).select(text.json_string(F.lit("[a]")).alias("a"), text.json_string(F.lit('"]')).alias("b"), text.json_string(F.lit("")).alias("c"), text.json_string(F.lit(None).cast("string")).alias("d")).head()
    assert tuple(row) == ('"[a]"', '"\\"]"', '""', None)
