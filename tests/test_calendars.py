"""Calendars against counting days one by one, and documents as variables."""

import json

import pytest
from pyspark.sql import functions as F

from isomere.functions import calendars
from isomere.operators import cf_documents, cf_variables
from isomere.sources.documents import decode

MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
LEAP = {"noleap": lambda y: False, "all_leap": lambda y: True, "julian": lambda y: y % 4 == 0}


def days(kind, first, last):
    """(year, month, day) of all days, counted on."""
    for y in range(first, last + 1):
        for m in range(1, 13):
            n = 30 if kind == "360_day" else MONTHS[m - 1] + (m == 2 and LEAP[kind](y))
            for d in range(1, n + 1):
                yield y, m, d


@pytest.mark.parametrize("kind", ["360_day", "noleap", "all_leap", "julian"])
def test_days_follow_each_other(spark, kind):
    every = [f"{y:04d}-{m:02d}-{d:02d}T23:59:59Z" for y, m, d in days(kind, 0, 9)]
    rows = spark.createDataFrame(list(enumerate(every)), "n long, t string").withColumn("c", F.lit(f"http://x/{kind.upper()}"))
    rows = rows.withColumn("m", calendars.micros(F.col("t"), F.col("c"))).withColumn("back", calendars.text(F.col("m"), F.col("c")))
    got = rows.orderBy("n").collect()
    assert [r.m for r in got] == [(n * 86400 + 86399) * 1_000_000 for n in range(len(every))] and [r.back for r in got] == every


def test_forms(spark):
    wrong = ["2020-02-30", "2020-13", "2020-00-01", "2020-01-01T24:00:00Z", "2020-01-01T00:00:00+01:00", "now", "", "2020\n", None]
    rows = [(t, "noleap") for t in [*wrong, "2020-02-29"]] + [("2020-02-30", "360_day"), ("2020", "360_day"), ("2020-01-01T00:00:00.25Z", "360_day"), ("2020", "mars")]
    got = [r.m for r in spark.createDataFrame(rows, "t string, c string").coalesce(1).select(calendars.micros(F.col("t"), F.col("c")).alias("m")).collect()]
    day = 86_400_000_000
    assert got == [None] * 10 + [(2020 * 360 + 59) * day, 2020 * 360 * day, 2020 * 360 * day + 250_000, None]


TRAJECTORY = {
    "type": "Coverage", "domain": {"type": "Domain", "domainType": "Trajectory", "axes": {"composite": {"dataType": "tuple", "coordinates": ["t", "x", "y"], "values": [["2020-01-01T00:00:00Z", 1, 2], ["2020-01-02T01:00:00+02:00", 3, 4.5]]}},
        "referencing": [{"coordinates": ["x", "y"], "system": {"type": "GeographicCRS"}}, {"coordinates": ["t"], "system": {"type": "TemporalRS", "calendar": "Gregorian"}}]},
    "ranges": {"v": {"type": "NdArray", "dataType": "string", "axisNames": ["composite"], "shape": [2], "values": ["a", None]}},
}


def test_variables(spark):
    depth = {"type": "Coverage", "domain": {"axes": {"z": {"start": 0, "stop": 10, "num": 3}, "x": {"values": [7]}}, "referencing": [{"coordinates": ["z"], "system": {"type": "VerticalCRS", "id": "http://x/depth"}}]},
             "ranges": {"v": {"type": "NdArray", "dataType": "float", "axisNames": ["z", "x"], "shape": [3, 1], "values": [1, 2, 3]}}}
    bodies = [(1, json.dumps(TRAJECTORY)), (2, json.dumps({"type": "CoverageCollection", "coverages": [depth, {**depth, "id": "two"}]})), (3, '{"type":"Domain","axes":{}}')]
    v = cf_variables.variables(decode(spark.createDataFrame(bodies, "doc_id int, body string"))[0])
    told = {(r.ds_id, r.name): (r.dims, r.attrs, r.is_coord, r.is_time) for r in v.variables.collect()}
    assert told["1", "t"] == (["composite"], {}, True, True) and told["1", "x"][1] == {"standard_name": "longitude", "units": "degrees_east"} and told["1", "v"] == (["composite"], {"grid_mapping": "crs"}, False, False)
    assert told["1", "crs"] == ([], {"reference_system_type": "GeographicCRS", "grid_mapping_name": "latitude_longitude"}, True, False)
    assert told["2/coverages/1", "z"] == (["z"], {"standard_name": "depth", "positive": "down"}, True, False) and told["2/coverages/0", "x"][0] == ["x"] and ("2/coverages/0", "crs") not in told
    cells = {(r.ds_id, r.name, r.idx): r.text if r.number is None else r.number for r in v.cells.collect()}
    assert [cells["2/coverages/0", "z", i] for i in range(3)] == [0.0, 5.0, 10.0] and cells["1", "t", 1] == "2020-01-01T23:00:00Z" and cells["1", "y", 1] == 4.5 and cells["1", "v", 1] is None
    assert {(r.ds_id, r.dim): r.size for r in v.sizes.collect()} == {("1", "composite"): 2, **{(f"2/coverages/{k}", d): n for k in (0, 1) for d, n in (("z", 3), ("x", 1))}}
    assert v.quarantine.count() == 0
    back = {r.doc_id: json.loads(r.body) for r in cf_documents.documents(v.variables, v.cells, v.sizes, v.attributes)[0].collect()}
    assert back["1"]["domain"]["axes"]["composite"] == {"dataType": "tuple", "coordinates": ["t", "x", "y"], "values": [["2020-01-01T00:00:00Z", 1.0, 2.0], ["2020-01-01T23:00:00Z", 3.0, 4.5]]}
    assert back["2/coverages/1"]["id"] == "two" and back["2/coverages/0"]["ranges"]["v"]["values"] == [1.0, 2.0, 3.0]


def test_overrides(spark):
    """A coordinate that an override names fills that role only, and an overridden role isn't looked for."""
    none = {}
    rows = [("a", 0, "lon", ["i"], none, True, False), ("a", 1, "x", ["j"], none, True, False), ("a", 2, "lat", ["k"], none, True, False), ("a", 3, "when", [], none, True, True)]
    variables = spark.createDataFrame(rows, "ds_id string, ord int, name string, dims array<string>, attrs map<string,string>, is_coord boolean, is_time boolean")
    found = lambda *o: {r.role: r.name for r in cf_documents.roles(variables, spark.createDataFrame(list(o), "ds_id string, role string, name string") if o else None).collect()}
    assert found() == {"x": "lon", "y": "lat", "t": "when"}
    assert found(("a", "x", "x")) == {"x": "x", "y": "lat", "t": "when"} and found(("a", "y", "lon")) == {"x": "x", "y": "lon", "t": "when"} and found(("a", "z", "lat")) == {"x": "lon", "z": "lat", "t": "when"}
