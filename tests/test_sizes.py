"""What plans must not do on larger tables."""

import re

from pyspark.sql import functions as F

from isomere.operators import fetching, subset_documents
from isomere.plans import catalogue, whole_documents
from isomere.sources.documents import decode
from isomere.sources.stored import stored


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_dealt_over_tasks(spark, tmp_path):
    n = 5000
    spark.range(n).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id AS doc_id").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = [whole_documents.documents(spark, str(tmp_path)), whole_documents.linked(spark, str(tmp_path))[0], whole_documents.tiled(spark, str(tmp_path))[0], whole_documents.of_kinds(spark, str(tmp_path), ["%s"])]
    for df in made:
        assert df.rdd.getNumPartitions() >= n / catalogue.ROWS_A_TASK
        assert df.count() == n


def test_subset_filters_read_settled_columns(spark):
    decoded = decode(spark.createDataFrame([(1, "{}")], "doc_id int, body string"))[0]
    for df in (*subset_documents.sel(decoded, y=slice(0.25, None)), *subset_documents.isel(decoded, x=0)):
        conditions = re.findall(r"Filter (.*)", optimized(df))
        assert conditions and not any("lambda" in c or "variant_get" in c for c in conditions)


def test_documents_are_judged_once_for_their_sites(spark):
    decoded = decode(spark.createDataFrame([(1, "{}")], "doc_id int, body string"))[0]
    assert optimized(fetching.reference_sites(decoded)).count("ArrowEvalPython") + optimized(fetching.reference_sites(decoded)).count("errors(") <= 2
    assert "Union" not in optimized(fetching.reference_sites(decoded))


def test_stored_tables_are_not_broadcast(spark):
    # Two texts that repeat: some bytes as a file, however many rows.
    left, right = (stored(spark.range(1000).selectExpr("id", "'a text' AS a", "'another text' AS b")) for _ in range(2))
    for joined in (left.join(right, "id"), left.join(right.filter("id > 5").select("id").distinct(), "id", "left_anti"), left.join(right.groupBy("id").count(), "id", "left")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in left.join(F.broadcast(right), "id")._jdf.queryExecution().sparkPlan().toString()


def test_tiles_are_dealt_by_number_and_not_broadcast(spark, tmp_path, monkeypatch):
    n = 100
    spark.range(n).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(fetching, "ARRAYS_A_TASK", 10)
    monkeypatch.setattr(fetching, "TILES_A_TASK", 20)
    for df, rows in zip(fetching.assemble(*whole_documents.tiled(spark, str(tmp_path)), ["doc_id"]), (12 * n, sum((c + k) % 7 == 0 for c in range(n) for k in range(4))), strict=True):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
        numbers = set(map(int, re.findall(r"RepartitionByExpression \[.*\], (\d+)", optimized(df))))
        assert {n // 10, 4 * n // 20} <= numbers
        assert df.count() == rows


def test_failures_of_tiles_meet_no_values(spark, tmp_path):
    spark.range(5).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    failures = fetching.assemble(*whole_documents.tiled(spark, str(tmp_path)), ["doc_id"])[1]
    assert "_values" not in optimized(failures)


def test_repeated_and_no_arrays(spark):
    body = '{"type":"TiledNdArray","dataType":"float","axisNames":["x"],"shape":[2],"tileSets":[{"tileShape":[1],"urlTemplate":"u{x}"},{"tileShape":[2],"urlTemplate":"w{x}"}]}'
    arrays, none = spark.createDataFrame([(1, body), (1, body), (2, "{}")], "doc_id int, body string"), spark.createDataFrame([], "url string, body string")
    for tileset, found in ((None, [(1, "w0")]), (0, [(1, "u0"), (1, "u0"), (1, "u1"), (1, "u1")]), (7, [])):
        failures = fetching.assemble(arrays, none, ["doc_id"], tileset)[1]
        assert sorted((r.doc_id, r.url) for r in failures.collect()) == found
    assert fetching.assemble(arrays.limit(0), none, ["doc_id"])[0].count() == 0
