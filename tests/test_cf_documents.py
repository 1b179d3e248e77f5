"""Variables with CF metadata to documents: grids, series, trajectories, flags, and what has no form in a document."""

import json

import pytest
from pyspark.sql import functions as F

from isomere.operators import cf_documents, conformance

VARIABLES = "ds_id string, ord int, name string, dims array<string>, attrs map<string,string>, is_coord boolean, is_time boolean"
CELLS = "ds_id string, name string, idx int, number double, text string"


def _dataset(ds, coords, data, sizes):
    """coords, data: name to (dims, attrs, values)."""
    variables, cells = [], []
    for k, (name, (dims, attrs, values)) in enumerate([*coords.items(), *data.items()]):
        times = name in coords and any(isinstance(v, str) for v in values)
        variables.append((ds, k, name, dims, attrs, name in coords, times))
        cells += [(ds, name, i, None if isinstance(v, str) or v is None else float(v), v if isinstance(v, str) else None) for i, v in enumerate(values)]
    return variables, cells, [(ds, d, n) for d, n in sizes.items()]


DATASETS = [
    _dataset("grid", {"lon": (["lon"], {}, [1, 2, 3]), "lat": (["lat"], {"units": "degrees_north"}, [5, 9]), "time": ([], {}, ["2020-01-01T00:00:00Z"])}, {"v": (["lat", "lon"], {"units": "K", "long_name": "Heat"}, [1, 2, None, 4, 5, 6]), "lat_bnds": (["lat", "nv"], {}, [0] * 4), "m": ([], {"grid_mapping_name": "x"}, [0])}, {"lon": 3, "lat": 2, "nv": 2}),
    _dataset("series", {"x": ([], {}, [1]), "y": ([], {}, [2]), "t": (["t"], {"calendar": "360_day"}, ["2020-01-01", "2020-01-02"])}, {"f": (["t", "band"], {"dtype": "int32", "flag_values": "1, 2", "flag_meanings": "dry_land sea"}, [1, 2, 1, 1])}, {"t": 2, "band": 2}),
    _dataset("track", {"lon": (["obs"], {}, [1, 4]), "lat": (["obs"], {}, [2, 5]), "when": (["obs"], {}, ["2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z"])}, {"v": (["obs"], {}, [7, 8])}, {"obs": 2}),
    _dataset("curved", {"lon": (["j", "i"], {}, [1, 2, 3, 4]), "lat": (["j", "i"], {}, [1, 2, 3, 4])}, {"v": (["j", "i"], {}, [1, 2, 3, 4])}, {"j": 2, "i": 2}),
]


@pytest.fixture(scope="module")
def made(spark):
    parts = [sum((d[k] for d in DATASETS), []) for k in range(3)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(parts, (VARIABLES, CELLS, "ds_id string, dim string, size int"), strict=True)]
    attributes = spark.createDataFrame([("series", {"id": "s 1"}), ("grid", {})], "ds_id string, attrs map<string,string>")
    good, bad = cf_documents.documents(*frames, attributes)
    return spark.createDataFrame(good.collect(), "doc_id string, body string"), bad


def test_documents(made):
    docs = {r.doc_id: json.loads(r.body) for r in made[0].collect()}
    assert set(docs) == {"grid", "series", "track"}
    grid = docs["grid"]
    assert grid["domain"]["domainType"] == "Grid" and grid["domain"]["axes"]["x"] == {"start": 1.0, "stop": 3.0, "num": 3} and grid["domain"]["axes"]["y"] == {"start": 5.0, "stop": 9.0, "num": 2}
    assert grid["domain"]["axes"]["t"] == {"values": ["2020-01-01T00:00:00Z"]}
    assert grid["ranges"] == {"v": {"type": "NdArray", "dataType": "float", "axisNames": ["y", "x"], "shape": [2, 3], "values": [1.0, 2.0, None, 4.0, 5.0, 6.0]}}
    assert grid["parameters"]["v"] == {"type": "Parameter", "observedProperty": {"label": {"und": "Heat"}}, "unit": {"symbol": "K"}}
    series = docs["series"]
    assert series["id"] == "s 1" and series["domain"]["domainType"] == "PointSeries" and series["domain"]["axes"]["band"] == {"values": [0, 1]}
    assert series["parameters"]["f"]["categoryEncoding"] == {"1": 1, "2": 2} and series["parameters"]["f"]["observedProperty"]["categories"][0] == {"id": "1", "label": {"und": "dry land"}}
    assert series["domain"]["referencing"][1]["system"] == {"type": "TemporalRS", "calendar": "360_day"}
    track = docs["track"]["domain"]
    assert track["domainType"] == "Trajectory" and track["axes"] == {"composite": {"dataType": "tuple", "coordinates": ["t", "x", "y"], "values": [["2020-01-01T00:00:00Z", 1.0, 2.0], ["2020-01-02T00:00:00Z", 4.0, 5.0]]}}
    assert docs["track"]["ranges"]["v"]["axisNames"] == ["composite"]


def test_documents_are_valid(made):
    found = conformance.validate(made[0], True).filter(F.col("severity") == "error").collect()
    assert {(r.doc_id, r.code) for r in found} == {("track", "coverage.missing-parameters"), ("series", "domain.extra-axis-not-single")}


def test_quarantine(made):
    assert {(r.ds_id, "dimension" in r.error) for r in made[1].collect()} == {("curved", True)}
