"""Features of whole coverages against plain loops."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from isomere.operators import features, geojson
from isomere.sources.documents import decode

CRS = {"coordinates": ["x", "y"], "system": {"type": "GeographicCRS"}}


def coverage(kind, axes, ranges, referencing=(), **more):
    return {"type": "Coverage", "domain": {"type": "Domain", **({"domainType": kind} if kind else {}), "axes": axes, "referencing": list(referencing)}, "ranges": ranges, **more}


def array(names, shape, values, kind="float"):
    return {"type": "NdArray", "dataType": kind, "axisNames": names, "shape": shape, "values": values}


def run(spark, documents, trajectories="points"):
    df = spark.createDataFrame([(i, json.dumps(d), "x") for i, d in enumerate(documents)], "doc_id int, body string, path string").select("doc_id", "body")
    out, bad = features.features(decode(df)[0], trajectories)
    return out.orderBy("doc_id", "path", "idx").collect(), sorted(map(tuple, bad.collect()))


def loop(cov):
    """Each place's (geometry, properties) by nested loops."""
    axes = cov["domain"]["axes"]
    order = sorted(axes, key=lambda n: (["composite", "t", "z", "y", "x"].index(n) if n in ("composite", "t", "z", "y", "x") else 9, n))
    values = {n: a.get("values") or [a["start"] + i * ((a["stop"] - a["start"]) / (a["num"] - 1) if a["num"] > 1 else 0) for i in range(a["num"])] for n, a in axes.items()}
    for at in itertools.product(*[range(len(values[n])) for n in order]):
        place, props = dict(zip(order, at, strict=True)), {}
        for n in order:
            v = values[n][place[n]]
            props |= dict(zip(axes[n]["coordinates"], v, strict=True)) if axes[n].get("dataType") == "tuple" else {n: v}
        point = [props[c] for c in "xyz" if c in props]
        for key, r in cov["ranges"].items():
            flat = 0
            for name, n in zip(r["axisNames"], r["shape"], strict=True):
                flat = flat * n + place.get(name, 0)
            props[key] = r["values"][flat]
        yield {"type": "Point", "coordinates": point}, props


def test_places_equal_nested_loops(spark):
    draw, documents = random.Random(5), []
    for _ in range(12):
        axes = {n: draw.choice([{"values": [draw.randint(-9, 9) / 4 for _ in range(draw.randint(1, 3))]}, {"start": 0, "stop": draw.randint(1, 9), "num": draw.randint(2, 3)}]) for n in draw.choice(["xy", "xyz", "xyzt", "xykt"])}
        if draw.random() < 0.4:
            axes["composite"] = {"dataType": "tuple", "coordinates": ["y", "x"], "values": [[draw.randint(0, 9), draw.random()] for _ in range(3)]}
            del axes["x"], axes["y"]
        size = {n: len(a["values"]) if "values" in a else a["num"] for n, a in axes.items()}
        ranges = {}
        for key in ("p", "q"):
            names = draw.sample(sorted(axes), draw.randint(0, len(axes)))
            total = 1
            for n in names:
                total *= size[n]
            ranges[key] = array(names, [size[n] for n in names], [draw.choice([None, draw.randint(0, 99)]) for _ in range(total)], draw.choice(["float", "integer"]))
        documents.append(coverage(draw.choice([None, "Grid", "Trajectory"]), axes, ranges, [CRS]))
    rows, bad = run(spark, documents)
    assert bad == []
    got = {}
    for r in rows:
        assert r.crs == "OGC:CRS84" and r.idx == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((json.loads(r.geometry), json.loads(r.properties)))
    assert got == {i: list(loop(d)) for i, d in enumerate(documents)}


def test_polygons_lines_and_members(spark):
    rings = [[[0, 1], [2, 3], [4, 5], [0, 1]], [[1, 1], [1, 2], [2, 2], [1, 1]]]
    area = coverage("PolygonSeries", {"composite": {"dataType": "polygon", "coordinates": ["y", "x"], "values": [rings]}, "t": {"values": ["2020", "2021"]}}, {"p": array(["t"], [2], [1, 2])})
    path = coverage("Trajectory", {"composite": {"dataType": "tuple", "coordinates": ["t", "z", "x", "y"], "values": [["2020", 5, 1, 2], ["2021", 6, 3, 4]]}}, {"p": "http://elsewhere"}, id='a "b"')
    point = coverage("Point", {"x": {"values": [1]}, "y": {"values": ["east"]}}, {"y": array([], [], [None])})
    rows, bad = run(spark, [{"type": "CoverageCollection", "coverages": [area, path, point]}], "lines")
    assert bad == []
    assert [(r.path, r.idx, json.loads(r.geometry or "null"), json.loads(r.properties)) for r in rows] == [
        ("/coverages/0", 0, {"type": "Polygon", "coordinates": [[p[::-1] for p in r] for r in rings]}, {"coverage": 0, "t": "2020", "p": 1}),
        ("/coverages/0", 1, {"type": "Polygon", "coordinates": [[p[::-1] for p in r] for r in rings]}, {"coverage": 0, "t": "2021", "p": 2}),
        ("/coverages/1", 0, {"type": "LineString", "coordinates": [[1, 2, 5], [3, 4, 6]]}, {"coverage": 'a "b"'}),
        ("/coverages/2", 0, None, {"coverage": 2, "x": 1, "y": None}),
    ]


def test_quarantine(spark):
    one = {"dataType": "tuple", "coordinates": ["x", "y"], "values": [[1, 2]]}
    documents = [
        coverage("Trajectory", {"composite": one}, {}), coverage("Trajectory", {"x": {"values": [1]}, "y": {"values": [1]}}, {}), coverage("Polygon", {"composite": one}, {}),
        {"type": "Coverage", "domain": "http://x", "ranges": {"p": "http://y"}}, coverage("Trajectory", {"composite": {**one, "coordinates": ["a", "b"]}}, {}), {"type": "CoverageCollection", "coverages": []},
    ]
    assert run(spark, documents, "lines") == ([], [
        (0, "", "fewer than two vertices"), (1, "", "no composite axis"), (2, "", "the composite axis is not one of the kind polygon"), (3, "", "ranges elsewhere: p"), (3, "", "the domain is elsewhere"),
        (4, "", "fewer than two vertices"), (4, "", "no x and y"),
    ])
    rows, bad = run(spark, documents)
    assert [(r.doc_id, r.idx) for r in rows] == [(0, 0), (1, 0)] and [b[0] for b in bad] == [2, 3, 3, 4]
    with pytest.raises(ValueError):
        run(spark, documents, "curves")


def test_repeated_and_empty(spark):
    doc = coverage("Point", {"x": {"values": [1]}, "y": {"values": [2]}}, {})
    df = spark.createDataFrame([(1, json.dumps(doc))] * 3, "doc_id int, body string")
    assert features.features(decode(df)[0])[0].count() == 3
    none = features.features(decode(df.limit(0))[0])
    assert none[0].count() == none[1].count() == features.collections(none[0]).count() == 0


def test_lines_in_parts(spark):
    rows = spark.range(10).select(F.lit("k").alias("k"), "id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([("one", 0, 1.0, 1.0)], "k string, id long, x double, y double"))
    got = geojson.line_parts(rows, ["k"], ["id"], 4).orderBy("k", "part").collect()
    ends = [(r.k, r.part, r.n, r.geometry and [p[0] for p in r.geometry.coordinates]) for r in got]
    assert ends == [("k", 0, 4, [0, 1, 2, 3]), ("k", 1, 4, [3, 4, 5, 6]), ("k", 2, 4, [6, 7, 8, 9]), ("one", 0, 1, None)]
