"""Whole documents to findings: each case alone, odd inputs, own order rules, raising."""

import json

import pytest
from pyspark.sql import functions as F

from isomere.operators import conformance
from isomere.plans import cases


def test_each_case(spark):
    frame = spark.createDataFrame([(i, b.replace(cases.KEY, str(7 + i))) for i, b in enumerate(cases.bodies())], "doc_id bigint, body string")
    got = sorted(tuple(r) for r in conformance.validate(frame, check_values=True).select("doc_id", "code", "severity", "at", F.coalesce("detail", F.lit("-"))).collect())
    assert got == sorted((i, code, severity, at, detail or "-") for i, code, severity, at, detail in cases.findings())


def test_every_kind_has_a_case():
    assert len({code for _, code, _, _, _ in cases.findings()}) == 38


def test_odd_documents(spark):
    frame = spark.createDataFrame([(None, None, 1), (2, "", 1), (3, "[]", 1), (3, '{"type":"Coverage"}', 1)], "doc_id bigint, body string, type int")
    assert {(r.doc_id, r.code) for r in conformance.validate(frame, True).collect()} <= {(3, "coverage.missing-parameters")}
    assert conformance.validate(frame.limit(0), True).count() == 0


def test_own_order(spark):
    """A checker takes the place of the usual order: here, each value must be above the one before."""
    from pyspark.sql import Window

    body = json.dumps(cases._domain("Grid", {"x": cases._values(1, 1, 2), "y": cases._values(1)}, cases.CRS))
    frame = spark.createDataFrame([(1, body)], "doc_id bigint, body string")

    def rising(rows):
        number = F.try_variant_get("v", "$", "double")
        by = Window.partitionBy("doc_id", "path", "name").orderBy("pos")
        rows = rows.withColumn("rises", number > F.lag(number).over(by)).filter("not rises")
        return rows.groupBy("doc_id", "path", "name").agg(F.min("pos").alias("pos"))

    assert conformance.validate(frame, True).count() == 0
    assert [r.at for r in conformance.validate(frame, True, rising).collect()] == ["/axes/x/values/1"]


def test_require_valid(spark):
    bodies = [b.replace(cases.KEY, "5") for b in cases.bodies()]
    warned = spark.createDataFrame([(9, bodies[9]), (0, bodies[0])], "doc_id bigint, body string")
    conformance.require_valid(warned, True)
    with pytest.raises(conformance.ValidationError, match="2/axes/y: domain.missing-axis") as e:
        conformance.require_valid(spark.createDataFrame([(2, bodies[2])], "doc_id bigint, body string"))
    assert [x.code for x in e.value.errors] == ["domain.missing-axis"]
