"""Subsets of documents against plain Python."""

import itertools
import json

import pytest

from isomere.operators import subset_documents as sd
from isomere.sources.documents import decode

X, Y, T = [1, 2.5, 4, 4], [0.0, 5.0, 10.0], ["2020", "2021"]
COVERAGE = {
    "type": "Coverage", "id": "c", "parameters": {"p": {"type": "Parameter", "observedProperty": {"label": {"en": "P"}}}},
    "domain": {"type": "Domain", "domainType": "Grid", "axes": {"x": {"values": X, "bounds": [0, 1, 2, 3, 4, 5, 6, 7], "coordinates": ["x"]}, "y": {"start": 0, "stop": 10, "num": 3}, "t": {"values": T}}},
    "ranges": {"p": {"type": "NdArray", "dataType": "float", "shape": [2, 3, 4], "axisNames": ["t", "y", "x"], "values": [None if i == 5 else i + 0.5 for i in range(24)]}, "s": {"type": "NdArray", "dataType": "string", "values": ["only"]}},
}


def plain(at):
    """The coverage at positions (a list, or a number that takes the axis out of ranges) by axis."""
    want = json.loads(json.dumps(COVERAGE))
    values = {"x": X, "y": Y, "t": T}
    for name, p in at.items():
        each = p if isinstance(p, list) else [p]
        old = want["domain"]["axes"][name]
        new = {"values": [values[name][i] for i in each]}
        if "bounds" in old:
            new |= {"coordinates": old["coordinates"], "bounds": [old["bounds"][k] for i in each for k in (2 * i, 2 * i + 1)]}
        want["domain"]["axes"][name] = new
    r = want["ranges"]["p"]
    taken = {n: at.get(n, list(range(s))) for n, s in zip(r["axisNames"], r["shape"], strict=True)}
    lists = [p if isinstance(p, list) else [p] for p in taken.values()]
    left = [n for n, p in taken.items() if isinstance(p, list)]
    out = {"type": "NdArray", "dataType": "float", "values": [r["values"][(a * 3 + b) * 4 + c] for a, b, c in itertools.product(*lists)]}
    want["ranges"]["p"] = out | ({"shape": [len(taken[n]) for n in left], "axisNames": left} if left else {})
    return want


@pytest.fixture(scope="module")
def decoded(spark):
    return decode(spark.createDataFrame([(1, json.dumps(COVERAGE))], "doc_id int, body string"))[0]


@pytest.mark.parametrize("how, selection, at", [
    ("isel", {"x": 1}, {"x": 1}), ("isel", {"x": -1, "t": 0, "y": 2}, {"x": 3, "t": 0, "y": 2}), ("isel", {"y": slice(None, None, -1), "x": slice(1, -1)}, {"y": [2, 1, 0], "x": [1, 2]}),
    ("isel", {"x": slice(3, None, -2), "t": slice(0, 99)}, {"x": [3, 1], "t": [0, 1]}), ("sel", {"x": 4}, {"x": 2}), ("sel", {"y": 5, "t": "2021"}, {"y": 1, "t": 1}),
    ("sel", {"x": slice(2, 4), "y": slice(None, 7)}, {"x": [1, 2, 3], "y": [0, 1]}), ("sel", {"t": slice("2020", "2020"), "x": slice(None, None)}, {"t": [0], "x": [0, 1, 2, 3]}),
    ("nearest", {"x": 3.25, "y": 7.5}, {"x": 1, "y": 1}), ("nearest", {"y": -50}, {"y": 0}), ("nearest", {"y": 99, "x": 3.3}, {"y": 2, "x": 2}), ("nearest", {"y": 7.6}, {"y": 2}),
])
def test_subset(decoded, how, selection, at):
    good, bad = sd.isel(decoded, selection) if how == "isel" else sd.sel(decoded, selection, method="nearest" if how == "nearest" else None)
    (row,) = good.collect()
    assert json.loads(row.body) == plain(at) and list(json.loads(row.body)["domain"]["axes"]) == ["x", "y", "t"] and bad.count() == 0
    assert decode(good.select("doc_id", "body"))[1].count() == 0


def test_quarantine(spark):
    tuples = {"type": "Coverage", "domain": {"axes": {"x": {"dataType": "tuple", "coordinates": ["a", "b"], "values": [[1, 2]]}}}, "ranges": {}}
    short = {"type": "Coverage", "domain": {"axes": {"x": {"values": [1, 2], "bounds": [1, 2]}}}, "ranges": {}}
    far = {"type": "Coverage", "domain": {"axes": {"x": {"values": [1, 2]}}}, "ranges": {"p": "http://p"}}
    few = {"type": "Coverage", "domain": {"axes": {"x": {"values": [1]}}}, "ranges": {}}
    bodies = [{"type": "Coverage", "domain": "http://d", "ranges": {}}, tuples, short, far, few, {"type": "Coverage", "domain": {"axes": {}}, "ranges": {}}, {"type": "CoverageCollection", "coverages": [few, short]}]
    decoded, broken = decode(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "doc_id int, body string"))
    good, bad = sd.isel(decoded, x=1)
    assert broken.count() == 0 and good.count() == 0
    assert {(r.doc_id, r.path): r.error for r in bad.collect()} == {
        (0, ""): "the domain is elsewhere", (1, ""): "axis x is a composite of tuple", (2, ""): "axis x has bounds of a wrong length", (3, ""): "ranges elsewhere: p", (4, ""): "axis x has no such place",
        (5, ""): "no axis x", (6, "/coverages/0"): "axis x has no such place", (6, "/coverages/1"): "axis x has bounds of a wrong length",
    }
    assert {r.error for r in sd.sel(decoded.filter("doc_id = 4"), x=9)[1].collect()} == {"axis x has no such place"}


def test_indexers():
    with pytest.raises(ValueError, match="'x' given both"):
        sd.merged({"x": 1}, {"x": 2})
    with pytest.raises(TypeError, match="numeric label for axis 't'"):
        sd.sel(None, t="2020", method="nearest")
    assert sd.merged({"x": 1}, {"y": 2}) == {"x": 1, "y": 2}
