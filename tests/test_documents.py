import json

import pytest
from pyspark.sql import functions as F

from isomere.functions.text import MEDIA_TYPE
from isomere.operators import domains, validate
from isomere.sources import documents

COVERAGE = {
    "type": "Coverage", "id": "c1",
    "domain": {"type": "Domain", "domainType": "PointSeries", "axes": {"z": {"values": [1]}, "x": {"values": [1, 2.5]}, "t": {"start": 0, "stop": 4, "num": 3}}, "referencing": []},
    "ranges": {"b": {"type": "NdArray", "dataType": "float", "axisNames": ["t"], "shape": [3], "values": [1, 1.0, None]}, "a": "http://x/r", "domain": "http://x/d"},
    "parameters": {"b": {"type": "Parameter", "observedProperty": {"label": {"en": "b"}}}},
}
COLLECTION = {
    "type": "CoverageCollection", "domainType": "Grid", "parameters": {"p": {"observedProperty": {"label": {}}}}, "referencing": [{"coordinates": ["t"], "system": {"type": "TemporalRS"}}],
    "coverages": [
        {"type": "Coverage", "domain": {"type": "Domain", "axes": {}}, "ranges": {}}, {"type": "Coverage", "domain": "http://x/d", "ranges": {}, "parameters": {}, "domainType": "Grid"},
    ],
}


@pytest.fixture(scope="module")
def decoded(spark):
    bodies = [json.dumps(COVERAGE), json.dumps(COLLECTION), '{"type":"Nope"}', "{", "[]", None, "{}"]
    return documents.decode(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string"))


def test_quarantine(decoded):
    good, bad = decoded
    assert sorted(r.doc_id for r in good.collect()) == [0, 1]
    assert {r.doc_id: r.error for r in bad.collect()} == {2: "unexpected type Nope", 3: "not JSON", 4: "not an object", 5: "not JSON", 6: "no type"}


def test_orders_and_classes(decoded):
    eff = documents.effective(documents.coverages(decoded[0]))
    first = documents.axes(eff).filter("doc_id = 0").orderBy("axis_ord").collect()
    assert [r.name for r in first] == ["z", "x", "t"] and first[2].axis.num == 3
    ranges = documents.ranges(eff).filter("doc_id = 0")
    assert [(r.key, r.kind) for r in ranges.orderBy("range_ord").collect()] == [("b", "NdArray"), ("a", "url"), ("domain", "url")]
    assert [r["class"] for r in documents.values(ranges).orderBy("flat_idx").collect()] == ["integer", "float", "null"]


def test_inheritance(decoded):
    eff = {r.cov_idx: r for r in documents.effective(documents.coverages(decoded[0])).filter("doc_id = 1").collect()}
    assert eff[0].parameters == '{"p":{"observedProperty":{"label":{}}}}' and eff[1].parameters == "{}"  # present but empty is not inherited
    assert eff[0].referencing and eff[1].referencing is None  # only into an inline domain
    assert eff[1].has_type and not eff[0].has_type


def test_collection_findings(decoded):
    eff = documents.effective(documents.coverages(decoded[0])).filter("doc_id = 1")
    keys = ["doc_id", "cov_idx"]
    kinds = [(r.cov_idx, r.code, r.severity) for r in validate.domain_type_issues(eff, keys).collect()]
    assert kinds == [(1, "coverage.domain-type-not-omitted", "warning")]
    systems = documents.referencing(eff)
    assert [r.code for r in validate.system_issues(systems, keys).collect()] == ["temporal.missing-calendar"]


def test_axis_form_findings(spark):
    axes = {"x": {"values": [1, 2], "bounds": [0, 1, 2]}, "y": {"values": [1], "num": 1}, "t": {"values": ["a"], "coordinates": ["t"]}}
    body = json.dumps({"type": "Coverage", "domain": {"type": "Domain", "axes": axes}, "ranges": {}})
    good, _ = documents.decode(spark.createDataFrame([(0, body)], "doc_id int, body string"))
    rows = documents.axes(documents.effective(documents.coverages(good)))
    got = {(r.code, r.at, r.detail) for r in validate.axis_form_issues(rows, ["doc_id"]).collect()}
    assert got == {("axis.bounds-length", "/domain/axes/x/bounds", "3"), ("axis.form-conflict", "/domain/axes/y", "num"), ("axis.coordinates-not-omitted", "/domain/axes/t/coordinates", "t")}


@pytest.mark.parametrize("values, at, strict", [
    ([1, 1, 3, 2, 9], 3, 1), ([1, 2, 3], None, None), ([3, 1], None, None), ([5, 5], None, 1), ([1, 2, 1], 2, 2), ([1, 2, 2], None, 2), ([None, 1, 2, 0], 3, 3), ([float("nan"), 3, 2, 2.5], 3, 3),
])
def test_monotonic(spark, values, at, strict):
    rows = spark.createDataFrame([(0, "x", i, None if v is None else float(v)) for i, v in enumerate(values)], "doc_id int, name string, pos int, value double")
    for flag, want in ((False, at), (True, strict)):
        assert [(int(r.detail), r.at) for r in validate.monotonic_issues(rows, ["doc_id"], strict=flag).collect()] == ([] if want is None else [(want, f"/domain/axes/x/values/{want}")])


def test_responses(spark):
    body = '{"type":"Domain","axes":{}}'
    rows = spark.createDataFrame([(0, body, MEDIA_TYPE.upper()), (1, body, "text/html"), (2, body, None)], "doc_id int, body string, content_type string")
    good, bad = documents.decode_response(rows)
    assert sorted(r.doc_id for r in good.collect()) == [0, 2] and [r.doc_id for r in bad.collect()] == [1]


def test_encoding(spark):
    values = F.array(F.lit(1.0), F.lit(None), F.lit(float("nan")), F.lit(2.5))
    shape, names = F.array(F.lit(4)), F.array(F.lit("x"))
    (text,) = spark.range(1).select(documents.encode_ndarray("float", shape, names, values)).head()
    assert text == '{"type":"NdArray","dataType":"float","axisNames":["x"],"shape":[4],"values":[1.0,null,null,2.5]}'


def test_domain_builders(spark):
    rows = spark.createDataFrame([("k", 2, 1.0, 5.0), ("k", 1, 3.0, 4.0)], "key string, t int, x double, y double")
    text = domains.document(domains.of_tuples(rows, ["key"], "Trajectory", ["t", "x", "y"], ["t"]), ["key"]).head().body
    assert json.loads(text) == {"type": "Domain", "domainType": "Trajectory", "axes": {"composite": {"dataType": "tuple", "coordinates": ["t", "x", "y"], "values": [[1.0, 3.0, 4.0], [2.0, 1.0, 5.0]]}}}
    text = domains.document(domains.of_axes(rows, ["key"], "Grid", x="x", y="y"), ["key"]).head().body
    assert json.loads(text)["axes"] == {"x": {"values": [1.0, 3.0]}, "y": {"values": [4.0, 5.0]}}


def test_stream(spark, tmp_path):
    from isomere.streaming.documents import decoded_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.covjson").write_text('{"type":"Domain","axes":{}}')
    (source / "b.covjson").write_text("{")
    good, bad = decoded_stream(spark, str(source))
    for name, df in (("good", good.select("type")), ("bad", bad)):
        q = df.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("stream_good").count() == 1 and spark.table("stream_bad").head().error == "not JSON"
