"""Cards of whole documents."""

import json

from isomere.operators import summary
from isomere.sources.documents import decode

PARAMETER = {"type": "Parameter", "observedProperty": {"label": {"en": "Heat & <more>"}}, "unit": {"label": {"en": "kelvin"}}}
DOMAIN = {"type": "Domain", "domainType": "Grid", "axes": {"x": {"start": 0, "stop": 8, "num": 9}, "y": {"values": [5, "b"]}}}
COVERAGE = {"type": "Coverage", "domain": DOMAIN, "parameters": {"p": PARAMETER}, "ranges": {"p": {"type": "NdArray", "dataType": "float", "axisNames": ["y", "x"], "shape": [2, 9], "values": [None, *range(17)]}, "q": "http://x/<q>"}}


def test_cards(spark):
    rows = [(1, json.dumps(COVERAGE)), (2, json.dumps(DOMAIN)), (3, json.dumps({"type": "NdArray", "dataType": "float", "values": [4.5]})), (4, json.dumps({"type": "CoverageCollection", "coverages": [COVERAGE, COVERAGE]}))]
    decoded, _ = decode(spark.createDataFrame(rows, "doc_id bigint, body string"))
    got = {(r.doc_id, r.path): r.html for r in summary.document_cards(decoded).collect()}
    assert set(got) == {(1, ""), (2, ""), (3, ""), (4, "/coverages/0"), (4, "/coverages/1")}
    card = got[1, ""]
    assert "<strong>Coverage Grid</strong>" in card and "<td>Heat &amp; &lt;more&gt;</td><td>kelvin</td>" in card and "<td>y: 2 × x: 9</td><td>null, 0, 1, …, 14, 15, 16</td>" in card
    assert "<td>url</td>" in card and "http://x/&lt;q&gt;" in card and "<td>0.0, 1.0, 2.0, …, 6.0, 7.0, 8.0</td>" in card and "<td>5, b</td>" in card
    assert got[4, "/coverages/1"] == card.replace("Coverage Grid", "Coverage Grid") and "Parameters" not in got[2, ""] and "<td>scalar</td><td>4.5</td>" in got[3, ""]
    assert summary.document_cards(decoded.limit(0)).count() == 0


def test_other_cards(spark):
    coded = {"type": "Parameter", "observedProperty": {"label": {"en": "cover"}, "categories": [{"id": "a", "label": {"en": "Ice"}}]}, "categoryEncoding": {"a": [1, 2]}}
    tiled = {"type": "TiledNdArray", "dataType": "float", "axisNames": ["y"], "shape": [4], "tileSets": [{"tileShape": [2], "urlTemplate": "http://x/{y}"}]}
    whole = {"type": "CoverageCollection", "domainType": "Point", "parameters": {"c": coded}, "coverages": [{"type": "Coverage", "id": "<1>", "domain": "http://d", "ranges": {"p": "u", "c": "u"}}, COVERAGE]}
    decoded, bad = decode(spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(tiled))], "doc_id bigint, body string"))
    assert bad.count() == 0
    (card,) = summary.collection_cards(decoded).collect()
    assert card.doc_id == 1 and "<strong>CoverageCollection Point (2)</strong>" in card.html and "<td>0</td><td>&lt;1&gt;</td><td>Point</td><td>c, p</td>" in card.html and "<td>1</td><td></td><td>Grid</td>" in card.html
    got = {(r.path, r.key): r.html for r in summary.parameter_cards(decoded).collect()}
    assert set(got) == {("/coverages/0", "c"), ("/coverages/1", "p")} and "<td>a</td><td>Ice</td><td>[1,2]</td>" in got["/coverages/0", "c"]
    assert any("<td>y: 4</td><td>http://x/{y} [2]</td>" in r.html for r in summary.document_cards(decoded).filter("doc_id = 2").collect())
