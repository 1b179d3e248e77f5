"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from isomere.plans import catalogue

from .compare import same_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    same_rows(got, con.sql(catalogue.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert {"decode_props", "validate_documents"} <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_filters_reach_the_scan(spark, con):
    plan = catalogue.QUERIES["pointseries_sel_slice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_type" not in plan


def test_entry(spark, con):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "t", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_references_keep_whole_bodies(spark, con):
    bodies = catalogue._references(spark, SF)[0].filter("body is not null")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    both = bodies.select("page_id", "body").join(pages, "page_id").collect()
    assert both and all(r.body == r.html for r in both)
