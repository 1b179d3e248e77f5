import json

import pytest
from pyspark.sql import functions as F

from isomere.operators import conformance, geojson, parameters, references, tiles
from isomere.sources.documents import decode, encode, encode_response

GOOD = {"type": "Domain", "axes": {"x": {"values": [1]}}}
ARRAY = {"type": "NdArray", "dataType": "float", "values": [1]}
TILED = {"type": "TiledNdArray", "dataType": "float", "axisNames": ["y"], "shape": [4], "tileSets": [{"tileShape": [None], "urlTemplate": "u"}]}
NAMED = {"label": {"en": "n"}}


def axis(**members):
    return {"type": "Domain", "axes": {"a/b": members}}


def cov(**members):
    return {"type": "Coverage", "domain": "http://d", "ranges": {}, **members}


def parameter(**members):
    return cov(parameters={"p": {"type": "Parameter", "observedProperty": NAMED, **members}})


#: A document, and the pointer and reason of what is wrong with it.
BROKEN = [
    (axis(), "/axes/a~1b", "neither values nor a whole regular form"), (axis(start=0, stop=1), "/axes/a~1b", "neither values nor a whole regular form"), (axis(values=[]), "/axes/a~1b", "no values"),
    (axis(start=0, stop=1, num=0), "/axes/a~1b", "num below 1"), (axis(start=0, stop=1, num=1), "/axes/a~1b", "one value with start other than stop"), (axis(values=[True]), "/axes/a~1b/values/0", "neither a number, a text nor a list"),
    (axis(values=[1], dataType="tuple"), "/axes/a~1b", "a composite axis needs values and coordinates"), (axis(values=[1], dataType="polygon", coordinates=["x"]), "/axes/a~1b", "polygons need two coordinates"),
    (axis(values=[1], coordinates=[]), "/axes/a~1b", "no coordinates"), (axis(start=0, stop=1, num=2.0), "/axes/a~1b/num", "not a whole number"), (axis(values=[1], bounds=[None]), "/axes/a~1b/bounds/0", "neither a number nor a text"),
    ({"type": "Domain"}, "/axes", "missing"), ({**GOOD, "domainType": 1}, "/domainType", "not a text"), ({**GOOD, "referencing": None}, "/referencing", "not a list"),
    ({**GOOD, "referencing": [{"coordinates": ["x"], "system": {"id": "i"}}]}, "/referencing/0/system/type", "missing"), ({**GOOD, "referencing": [{"coordinates": ["x"], "system": {"type": "t", "targetConcept": {}}}]}, "/referencing/0/system/targetConcept/label", "missing"),
    ({**ARRAY, "dataType": "double"}, "/dataType", "not a data type"), ({**ARRAY, "values": [[1]]}, "/values/0", "neither a number, a text nor null"), ({**ARRAY, "shape": ["1"]}, "/shape/0", "not a whole number"),
    ({**TILED, "shape": [], "axisNames": []}, "", "no shape"), ({**TILED, "tileSets": []}, "", "no tile sets"), ({**TILED, "tileSets": [{"tileShape": [1, 1], "urlTemplate": "u"}]}, "", "a tile set of another rank"),
    ({**TILED, "tileSets": [{"tileShape": [1]}]}, "/tileSets/0/urlTemplate", "missing"), (cov(domain=ARRAY), "/domain/type", "another type"), (cov(domain=None), "/domain", "neither an object nor a text"),
    (cov(ranges={"r": {"dataType": "float", "values": []}}), "/ranges/r/type", "missing"), (cov(ranges={"r": GOOD}), "/ranges/r/type", "another type"), (cov(domainType=None), "/domainType", "not a text"), ({"type": "Coverage", "ranges": {}}, "/domain", "missing"),
    (parameter(unit={"id": "u"}), "/parameters/p/unit", "a unit needs a label or a symbol"), (parameter(unit={"symbol": {"value": "K"}}), "/parameters/p/unit/symbol/type", "missing"), (parameter(label={"en": 1}), "/parameters/p/label/en", "not a text"),
    (parameter(observedProperty={**NAMED, "categories": []}), "/parameters/p/observedProperty", "no categories"), (parameter(categoryEncoding={"a": 1}), "/parameters/p", "an encoding without categories"),
    (parameter(observedProperty={**NAMED, "categories": [{"id": "a", **NAMED}]}, unit={"symbol": "m"}), "/parameters/p", "categories with a unit"),
    (cov(parameterGroups=[{"members": [], **NAMED}]), "/parameterGroups/0", "no members"), (cov(parameterGroups=[{"members": ["p"]}]), "/parameterGroups/0", "a group needs a label or an observed property"),
    ({"type": "CoverageCollection", "coverages": [cov(), cov(ranges=[])]}, "/coverages/1/ranges", "not an object"), ({"type": "CoverageCollection", "coverages": [cov()], "parameters": {"p": {}}}, "/parameters/p/observedProperty", "missing"),
]
SOUND = [
    GOOD, ARRAY, TILED, cov(), parameter(unit={"symbol": {"value": "K", "type": "t"}}), axis(values=[1], num=0), axis(start=1, stop=1, num=1), axis(start=0, stop=1, num=2), {**GOOD, "@context": [1, None], "more": {"of": [1]}},
    cov(domain={"axes": {}}, id=None), parameter(observedProperty={**NAMED, "categories": [{"id": "a", **NAMED}]}, categoryEncoding={"a": [1, 2]}, unit=None), {"type": "CoverageCollection", "coverages": []},
]


def test_structure(spark):
    bodies = [json.dumps(b) for b in [*(b for b, _, _ in BROKEN), *SOUND]]
    good, bad = decode(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string"))
    assert {r.doc_id: (r.at, r.error) for r in bad.collect()} == {i: (at, reason) for i, (_, at, reason) in enumerate(BROKEN)}
    assert sorted(r.doc_id for r in good.collect()) == list(range(len(BROKEN), len(bodies)))


def test_repeated_documents(spark):
    """Three copies of a document under one id give its findings three times."""
    body = json.dumps({"type": "Domain", "domainType": "Grid", "axes": {"x": {"values": [3, 1, 2]}}})
    rows = spark.createDataFrame([(1, body)] * 3 + [(None, body)] * 2, "doc_id int, body string")
    found = conformance.validate(rows, check_values=True).collect()
    once = ["domain.missing-axis", "domain.missing-referencing"]
    assert sorted(r.code for r in found if r.doc_id == 1) == sorted(once * 3) and len(found) == 10


def test_canonical(spark):
    """Decoding what encoding wrote, and encoding that again, gives the same text, for all five roots."""
    wild = [
        ({"ranges": {"q": "u", "p": {"values": [1, 2.0, None, "x"], "dataType": "string", "type": "NdArray", "shape": [], "axisNames": []}}, "type": "Coverage", "id": None, "more": 1, "domain": {"axes": {"z": {"num": 3, "start": 1, "stop": 2.5}, "b": {"bounds": [0, 1], "values": [1]}}, "type": "Domain", "referencing": []}},
         '{"type":"Coverage","domain":{"type":"Domain","axes":{"z":{"start":1.0,"stop":2.5,"num":3},"b":{"values":[1],"bounds":[0.0,1.0]}}},"ranges":{"q":"u","p":{"type":"NdArray","dataType":"string","values":[1,2.0,null,"x"]}}}'),
        ({"parameters": {}, "coverages": [], "type": "CoverageCollection", "referencing": [], "@context": None}, '{"type":"CoverageCollection","coverages":[],"parameters":{},"@context":null}'),
        ({"domainType": None, "axes": {"é": {"values": ["a"]}}, "type": "Domain"}, '{"type":"Domain","axes":{"é":{"values":["a"]}}}'),
        ({"axisNames": ["x"], "values": [1.50], "shape": [1], "type": "NdArray", "dataType": "float"}, '{"type":"NdArray","dataType":"float","values":[1.5],"shape":[1],"axisNames":["x"]}'),
        (dict(reversed(TILED.items())), '{"type":"TiledNdArray","dataType":"float","axisNames":["y"],"shape":[4],"tileSets":[{"tileShape":[null],"urlTemplate":"u"}]}'),
    ]
    first = encode(decode(spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(wild)], "doc_id int, body string"))[0])
    assert {r.doc_id: r.body for r in first.collect()} == {i: t for i, (_, t) in enumerate(wild)}
    again = encode_response(decode(first.select("doc_id", "body"))[0], "http://p").collect()
    assert {r.doc_id: r.body for r in again} == {i: t for i, (_, t) in enumerate(wild)} and {r.content_type for r in again} == {'application/prs.coverage+json; profile="http://p"'}


def test_builders(spark):
    label = F.create_map(F.lit("en"), F.lit("Land"))
    text = spark.range(1).select(
        parameters.categorical(parameters.observed(label), F.create_map(F.lit("a"), F.lit(1))).alias("c"), parameters.continuous(parameters.observed(label), F.struct(F.lit("m").alias("symbol"))).alias("p"),
        F.to_json(parameters.connection(F.array(F.lit("t")), parameters.system("TemporalRS", calendar=F.lit("Gregorian")))).alias("r"), parameters.group(F.array(F.lit("a")), label).alias("g"),
    ).head()
    assert json.loads(text.c) == {"type": "Parameter", "observedProperty": {"label": {"en": "Land"}}, "categoryEncoding": {"a": 1}}
    assert json.loads(text.p)["unit"] == {"symbol": "m"} and json.loads(text.g)["members"] == ["a"]
    assert json.loads(text.r) == {"coordinates": ["t"], "system": {"type": "TemporalRS", "calendar": "Gregorian"}}


def test_halting(spark):
    rows = spark.createDataFrame([(0, 1, "transient", "u1"), (0, 2, "unrecoverable", "u2"), (0, 3, "transient", "u3")], "g int, ord int, kind string, url string")
    seen = lambda s, n=1: [r.ord for r in tiles.halted(rows, ["g"], ["ord"], s, n).orderBy("ord").collect()]
    assert seen("fail_fast") == [1] and seen("collect_all") == [1, 2, 3] and seen("halt_on_unrecoverable") == [1, 2] and seen("stop_after", 5) == [1, 2, 3]
    with pytest.raises(ValueError):
        tiles.halted(rows, ["g"], ["ord"], "stop_after", 0)
    with pytest.raises(tiles.FetchError, match="transient fetching u1"):
        tiles.raise_if_halted(tiles.halted(rows, ["g"], ["ord"], "fail_fast"))
    tiles.raise_if_halted(tiles.halted(rows, ["g"], ["ord"], "collect_all"))


def test_references(spark):
    sites = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "site int, url string")
    docs = spark.createDataFrame([("a", "Domain", "x"), ("b", "NdArray", "y")], "url string, type string, body string")
    good, bad = references.resolve(sites, docs, ["Domain"])
    assert {r.site: r.body for r in good.collect()} == {0: "x", 1: None, 2: None}
    assert {r.site: r.kind for r in bad.collect()} == {1: "unrecoverable", 2: "transient"}


def test_linestring_needs_two(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 2, 3.0, 4.0), ("b", 1, 5.0, 6.0)], "k string, t int, x double, y double")
    got = {r.k: r.geometry and r.geometry.coordinates for r in geojson.linestring(rows, ["k"], ["t"]).collect()}
    assert got == {"a": None, "b": [[5.0, 6.0], [3.0, 4.0]]}


def test_right_documents_need_no_pointers(monkeypatch):
    from isomere.sources import model

    def none(*_):
        raise AssertionError("a pointer without an error")

    monkeypatch.setattr(model, "_below", none)
    right = {"type": "Domain", "axes": {"x": {"values": [1, "a"], "bounds": [0, 2]}}, "referencing": [{"coordinates": ["x"], "system": {"type": "GeographicCRS"}}]}
    assert model.first_error(right, "Domain") is None
