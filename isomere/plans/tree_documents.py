"""Queries on trees of datasets: collections to trees and back, and a tree of each region's nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from isomere.operators import cf_variables, trees
from isomere.plans.catalogue import query, table
from isomere.plans.whole_documents import SERIES_COVERAGE, of_kinds
from isomere.sources.documents import decode

#: A collection of a series and of a point with what both share.
POINT = '{"type":"Coverage","id":"p%s","domain":{"type":"Domain","domainType":"Point","axes":{"x":{"values":[%s.0]},"y":{"values":[1.5]}},"referencing":[{"coordinates":["x","y"],"system":{"type":"GeographicCRS"}}]}'
SHARED = '"parameters":{"w":{"type":"Parameter","observedProperty":{"label":{"und":"Wind"}},"unit":{"symbol":"m/s"}}}'
CELL = '"ranges":{"w":{"type":"NdArray","dataType":"float","values":[%s.5]}}}'


@query(f"""SELECT doc_id::VARCHAR AS doc_id, replace('{{"type":"CoverageCollection","coverages":[{SERIES_COVERAGE},{POINT},{SHARED},{CELL}]}}', '%s', doc_id::VARCHAR) AS body FROM documents""")
def tree_round_trip(spark, sf_dir):
    """Collections to trees and back; what members share comes to each of them."""
    texts = of_kinds(spark, sf_dir, [f'{{"type":"CoverageCollection",{SHARED},"coverages":[{SERIES_COVERAGE},{POINT},{CELL}]}}'])
    return trees.to_collections(trees.of_collections(cf_variables.variables(decode(texts)[0])))[0]


@query("""WITH c AS (SELECT n_regionkey, c_custkey, n_nationkey AS n, '{"type":"Coverage","domain":{"type":"Domain","axes":{"t":{"values":["2020-01-01T00:00:00Z","2021-01-01T00:00:00Z"]},"z":{'
|| CASE WHEN c_custkey % 3 = 0 THEN '"values":[0.0,1.0,5.0]' WHEN n_nationkey = 20 THEN '"start":20.0,"stop":60.0,"num":3' ELSE '"values":[' || n_nationkey || '.0,40.0,60.0]' END || '}},"referencing":[{"coordinates":["z"],"system":{"type":"VerticalCRS"}},{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"Gregorian"}}]},"ranges":{"v":{"type":"NdArray","dataType":"float","axisNames":["t","z"],"shape":[2,3],"values":['
|| array_to_string([c_custkey || '.0', '1.0', '2.0', '3.0', '4.0', '5.0'], ',') || ']}}}' AS body FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT r_regionkey::VARCHAR AS doc_id, '{"type":"CoverageCollection","coverages":[' || coalesce(string_agg(body, ',' ORDER BY c_custkey), '') || ']}' AS body FROM region LEFT JOIN c ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def tree_nested(spark, sf_dir):
    """Times at the region, heights at the nation, data at the customer, a third of which have heights of their own."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("tree"), F.lit("").alias("path"), F.lit(-2).cast("long").alias("ord"))
    places = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("tree"), F.concat(F.lit("/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(-1).cast("long").alias("ord"), "n_nationkey")
    own = F.col("c_custkey") % 3 == 0
    people = places.drop("ord").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select("tree", F.concat("path", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").cast("long").alias("ord"), "c_custkey", own.alias("own"))
    nodes = r.unionByName(places.drop("n_nationkey")).unionByName(people.drop("c_custkey", "own"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    variable = lambda rows, name, dims, coord, time: rows.select("tree", "path", F.lit(0 if coord else 1).alias("ord"), F.lit(name).alias("name"), F.array(*map(F.lit, dims)).alias("dims"), none.alias("attrs"), F.lit(coord).alias("is_coord"), F.lit(time).alias("is_time"))
    variables = variable(r, "t", ["t"], True, True).unionByName(variable(places, "z", ["z"], True, False)).unionByName(variable(people.filter("own"), "z", ["z"], True, False)).unionByName(variable(people, "v", ["t", "z"], False, False))
    number, null = (lambda rows, name, *v: rows.select("tree", "path", F.lit(name).alias("name"), F.posexplode(F.array(*[F.lit(x).cast("double") if not hasattr(x, "cast") else x.cast("double") for x in v])).alias("idx", "number"), F.lit(None).cast("string").alias("text"))), F.lit(None).cast("double")
    times = r.select("tree", "path", F.lit("t").alias("name"), F.posexplode(F.array(F.lit("2020-01-01T00:00:00Z"), F.lit("2021-01-01T00:00:00Z"))).alias("idx", "text"), null.alias("number"))
    cells = number(places, "z", F.col("n_nationkey"), 40, 60).unionByName(number(people.filter("own"), "z", 0, 1, 5)).unionByName(number(people, "v", F.col("c_custkey"), 1, 2, 3, 4, 5)).unionByName(times)
    size = lambda rows, dim, n: rows.select("tree", "path", F.lit(dim).alias("dim"), F.lit(n).alias("size"))
    sizes = size(r, "t", 2).unionByName(size(places, "z", 3)).unionByName(size(people, "t", 2)).unionByName(size(people, "z", 3))
    return trees.to_collections(trees.Tree(nodes, variables, cells, sizes, nodes.select("tree", "path", none.alias("attrs"))), nested=True)[0]
