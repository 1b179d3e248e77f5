"""The query catalogue: each coverage operator over the test tables, with the same result in DuckDB's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isomere.functions import arrays as fa
from isomere.functions import axes as fx
from isomere.functions import systems as fs
from isomere.functions import temporal as ft
from isomere.functions import text as fm
from isomere.operators import cf, coverage, folds, geojson, references, subset, tiles, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that become one task's documents.
ROWS_A_TASK = 2000


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over tasks by their number: making and judging a document costs far more than the few bytes of its key."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)))


def _events(spark: SparkSession, sf_dir: str) -> coverage.Coverage:
    """One PointSeries a user: times in order, equal times apart."""
    return coverage.series(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], {"value": "value"})


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def decode_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ts AS t, value FROM events")
def pointseries_flatten(spark, sf_dir):
    return coverage.flatten(_events(spark, sf_dir), positions=True).withColumnRenamed("p_t", "pos")


@query("""WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, ts AS t, value FROM r WHERE pos = 2""")
def pointseries_isel(spark, sf_dir):
    return coverage.flatten(subset.isel(_events(spark, sf_dir), t=2))


@query("""WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, ts AS t, value FROM r WHERE pos = n - 1""")
def pointseries_isel_negative(spark, sf_dir):
    return coverage.flatten(subset.isel(_events(spark, sf_dir), t=-1))


@query("""WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, CAST((pos - 1) / 3 AS BIGINT) AS pos, ts AS t, value FROM r WHERE pos >= 1 AND pos < 20 AND (pos - 1) % 3 = 0""")
def pointseries_isel_slice(spark, sf_dir):
    cov = subset.isel(_events(spark, sf_dir), t=slice(1, 20, 3))
    return coverage.flatten(cov, positions=True).select("user_id", F.col("p_t").cast("long").alias("pos"), "t", "value")


@query("SELECT user_id, ts AS t, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def pointseries_sel_slice(spark, sf_dir):
    import datetime as dt

    return coverage.flatten(subset.sel(_events(spark, sf_dir), t=slice(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))))


@query("""WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS pos FROM events),
n AS (SELECT user_id, arg_min(pos, {'d': abs(value - 50.0), 'p': pos}) AS pos FROM r GROUP BY user_id)
SELECT user_id, value AS v, ts FROM r JOIN n USING (user_id, pos)""")
def pointseries_sel_nearest(spark, sf_dir):
    cov = coverage.series(table(spark, sf_dir, "events"), "user_id", "value", ["value", "event_id"], {"ts": "ts"}, axis="v")
    return coverage.flatten(subset.sel(cov, method="nearest", v=50.0))


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) - 1 AS pos FROM events),
n AS (SELECT user_id, min(pos) AS pos FROM r WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, event_type AS kind, ts FROM r JOIN n USING (user_id, pos)""")
def pointseries_sel_exact(spark, sf_dir):
    cov = coverage.series(table(spark, sf_dir, "events"), "user_id", "event_type", ["event_type", "event_id"], {"ts": "ts"}, axis="kind")
    return coverage.flatten(subset.sel(cov, kind="click"))


def _orders(spark: SparkSession, sf_dir: str) -> coverage.Coverage:
    sums = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return coverage.grid(sums, {"x": "o_orderpriority", "y": "o_orderstatus"}, {"n": "n"})


GRID = """SELECT x.v AS x, y.v AS y, g.n FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) x CROSS JOIN (SELECT DISTINCT o_orderstatus AS v FROM orders) y
LEFT JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) g ON g.o_orderpriority = x.v AND g.o_orderstatus = y.v"""


@query(GRID)
def grid_flatten(spark, sf_dir):
    return coverage.flatten(_orders(spark, sf_dir))


@query(GRID)
def grid_transpose(spark, sf_dir):
    return coverage.flatten(coverage.transposed(_orders(spark, sf_dir), "n", ["y", "x"]))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)
SELECT x.v AS x, CAST(t.v AS VARCHAR) AS t, CAST(g.n AS VARCHAR) AS n FROM (SELECT DISTINCT user_id AS v FROM g) x CROSS JOIN (SELECT DISTINCT d AS v FROM g) t LEFT JOIN g ON g.user_id = x.v AND g.d = t.v""")
def grid_holes(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    flat = coverage.flatten(coverage.grid(counts, {"x": "user_id", "t": "d"}, {"n": "n"}))
    return flat.withColumns({"t": F.col("t").cast("string"), "n": F.col("n").cast("string")})


@query(f"SELECT g.*, m.total FROM ({GRID}) g LEFT JOIN (SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1) m ON m.o_orderpriority = g.x")
def grid_broadcast(spark, sf_dir):
    cov = _orders(spark, sf_dir)
    sums = cov.ranges["n"].cells.groupBy("p_x").agg(F.sum("value").alias("value"))
    return coverage.flatten(coverage.replace(cov, ranges=cov.ranges | {"total": coverage.Range(("x",), sums)}))


@query(f"SELECT x, y, n FROM ({GRID}) WHERE x = '3-MEDIUM'")
def grid_sel(spark, sf_dir):
    return coverage.flatten(subset.sel(_orders(spark, sf_dir), x="3-MEDIUM"))


@query(f"""WITH g AS (SELECT dense_rank() OVER (ORDER BY x) - 1 AS px, dense_rank() OVER (ORDER BY y) - 1 AS py, * FROM ({GRID}))
SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY px, py) AS cells, max(px) + 1 AS nx, max(py) + 1 AS ny FROM g""")
def grid_to_arrays(spark, sf_dir):
    a = coverage.to_arrays(_orders(spark, sf_dir), "n")
    return a.select(F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("cells"), F.get("shape", F.lit(0)).cast("long").alias("nx"), F.get("shape", F.lit(1)).cast("long").alias("ny"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as arrays of 8 by 8."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"), F.array(F.lit(8), F.lit(8)).alias("shape"))


CELLS = "SELECT vec_id, label, i - 1 AS i, embedding[i] AS value FROM embeddings, range(1, 65) r(i)"


@query(f"SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, value FROM ({CELLS})")
def ndarray_unravel(spark, sf_dir):
    r = coverage.from_arrays(_vectors(spark, sf_dir), ["vec_id"], ["y", "x"])
    return r.cells.withColumnsRenamed({"p_y": "y", "p_x": "x"})


@query(f"SELECT vec_id, i AS flat_idx, value FROM ({CELLS})")
def ndarray_flatten(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "shape", F.posexplode("values").alias("at", "value"))
    index = fa.unravel_index(F.col("at"), F.col("shape"))
    return rows.select("vec_id", fa.ravel_index(index, fa.strides(F.col("shape"))).alias("flat_idx"), "value")


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def ndarray_rebuild(spark, sf_dir):
    r = coverage.from_arrays(_vectors(spark, sf_dir), ["vec_id"], ["y", "x"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("p_y", "p_x", "value"))), lambda s: s["value"])
    out = r.cells.groupBy("vec_id").agg(values.alias("v"))
    return out.select("vec_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"))


@query("SELECT p_partkey, i, CASE WHEN p_size = 1 THEN 0.0 ELSE 0.0 + i * (100.0::DOUBLE / (p_size - 1)) END AS value FROM part, LATERAL (SELECT unnest(range(0, p_size)) AS i)")
def axis_regular_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    values = fx.coordinate_values(F.lit(None).cast("array<double>"), F.lit(0.0), F.lit(100.0), F.col("p_size").cast("int"))
    return part.select("p_partkey", F.posexplode(values).alias("i", "value")).select("p_partkey", F.col("i").cast("long").alias("i"), "value")


@query("""WITH v AS (SELECT user_id, list(event_id::DOUBLE ORDER BY event_id) AS v FROM events GROUP BY 1), s AS (SELECT user_id, v, v[2] - v[1] AS step FROM v)
SELECT user_id, len(v) >= 2 AND coalesce(list_bool_and([abs((v[i + 1] - v[i]) - step) <= greatest(1e-9 * greatest(abs(v[i + 1] - v[i]), abs(step)), 1e-12) FOR i IN range(1, len(v))]), false) AND coalesce(step, 0) <> 0 AS regular FROM s""")
def axis_is_regular(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("event_id").cast("double"))).alias("v"))
    return lists.select("user_id", fx.is_regular(F.col("v")).alias("regular"))


@query("SELECT o_orderpriority AS x, CAST(min(i) AS DOUBLE) AS start, CAST(max(i) AS DOUBLE) AS stop, CAST(count(*) AS INTEGER) AS num FROM (SELECT DISTINCT o_orderpriority FROM orders) o, range(0, 10) r(i) GROUP BY 1")
def axis_compact(spark, sf_dir):
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("x")).distinct()
    values = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("double"))
    c = kinds.select("x", fx.compact(values).alias("c"))
    return c.select("x", "c.start", "c.stop", "c.num")


@query("SELECT DISTINCT p_size, p_size * 2 - 1 AS low, p_size * 2 AS high FROM part")
def axis_bounds_pairs(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    bounds = F.transform(F.sequence(F.lit(-1), F.lit(200)), lambda i: i)
    pair = fx.bounds_of(bounds, F.array(F.col("p_size").cast("int")))
    return sizes.select("p_size", F.get(pair, F.lit(0)).cast("long").alias("low"), F.get(pair, F.lit(1)).cast("long").alias("high"))


def _tile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation an array of 8 by 8 with three tile sets: whole rows, quarters, single columns."""
    nation = table(spark, sf_dir, "nation")
    sets = F.array(*[F.struct(F.array(a, b).alias("tile_shape"), F.lit(u).alias("url_template")) for a, b, u in (
        (F.lit(1), F.lit(None).cast("int"), "rows/{y}"), (F.lit(4), F.lit(4), "quarters/{y}-{x}"), (F.lit(None).cast("int"), F.lit(1), "columns/{x}"))])
    rows = nation.select("n_nationkey", F.array(F.lit(8), F.lit(8)).alias("shape"), F.posexplode(sets).alias("pos", "s"))
    return rows.select("n_nationkey", "shape", "pos", F.concat(F.lit("n"), F.col("n_nationkey"), F.lit("/"), F.col("s.url_template")).alias("url_template"), "s.tile_shape")


@query("SELECT n_nationkey, pos, n FROM nation, (VALUES (0, 8), (1, 4), (2, 8)) v(pos, n)")
def tile_count(spark, sf_dir):
    return _tile_sets(spark, sf_dir).select("n_nationkey", "pos", fa.tile_count(F.col("shape"), F.col("tile_shape")).cast("int").alias("n"))


@query("SELECT n_nationkey, 1 AS pos, 'n' || n_nationkey || '/quarters/{y}-{x}' AS url_template FROM nation")
def tile_select(spark, sf_dir):
    return tiles.select_tile_set(_tile_sets(spark, sf_dir), ["n_nationkey"]).select("n_nationkey", "pos", "url_template")


@query("SELECT n_nationkey, 'n' || n_nationkey || '/quarters/' || y || '-' || x AS url, CAST(y * 4 AS INTEGER) AS oy, CAST(x * 4 AS INTEGER) AS ox FROM nation, range(0, 2) a(y), range(0, 2) b(x)")
def tile_layout(spark, sf_dir):
    best = tiles.select_tile_set(_tile_sets(spark, sf_dir), ["n_nationkey"])
    return tiles.layout(best, ["n_nationkey"], ["y", "x"]).select("n_nationkey", "url", F.get("offsets", F.lit(0)).alias("oy"), F.get("offsets", F.lit(1)).alias("ox"))


def _stitched(spark: SparkSession, sf_dir: str, holes: bool) -> tuple[DataFrame, DataFrame]:
    """Vectors cut into four tiles of 4 by 4 and put together again; with holes, vectors of label 0 lack their last tile."""
    cells = coverage.from_arrays(_vectors(spark, sf_dir), ["vec_id"], ["y", "x"]).cells
    name = F.format_string("v%d/%d-%d", "vec_id", F.floor(F.col("p_y") / 4), F.floor(F.col("p_x") / 4))
    values = F.transform(F.array_sort(F.collect_list(F.struct("p_y", "p_x", "value"))), lambda s: s["value"])
    documents = cells.groupBy(name.alias("url"), "vec_id").agg(values.alias("values"))
    if holes:
        labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
        documents = documents.join(labels, "vec_id").filter((F.col("label") != 0) | ~F.endswith("url", F.lit("1-1")))
    documents = documents.select("url", F.array(F.lit(4), F.lit(4)).alias("tile_shape"), "values")
    sets = _vectors(spark, sf_dir).select("vec_id", "shape", F.array(F.lit(4), F.lit(4)).alias("tile_shape"), F.format_string("v%d/{y}-{x}", "vec_id").alias("url_template"))
    return tiles.stitch(tiles.layout(sets, ["vec_id"], ["y", "x"]), documents, ["vec_id"])


@query(f"SELECT vec_id, i AS flat_idx, value FROM ({CELLS})")
def tile_assemble(spark, sf_dir):
    return _stitched(spark, sf_dir, False)[0]


@query(f"SELECT vec_id, i AS flat_idx, CASE WHEN label = 0 AND i // 8 >= 4 AND i % 8 >= 4 THEN NULL ELSE value END AS value FROM ({CELLS})")
def tile_assemble_holes(spark, sf_dir):
    return _stitched(spark, sf_dir, True)[0]


@query("SELECT vec_id, 'v' || vec_id || '/1-1' AS url, 'transient' AS kind, '4,4' AS offsets FROM embeddings WHERE label = 0")
def tile_failures(spark, sf_dir):
    failed = _stitched(spark, sf_dir, True)[1]
    return failed.select("vec_id", "url", "kind", F.array_join(F.transform("offsets", lambda o: o.cast("string")), ",").alias("offsets"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sites that point at pages: those without a label have no document, those labelled toxic one of another type."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    url = F.concat("page_id", F.lit(":"), "url").alias("url")
    kind = F.when(F.col("toxic") == 1, "Other").otherwise("Domain").alias("type")
    documents = pages.join(labels, pages.page_id == labels.doc_id).select(url, kind, F.col("html").alias("body"))
    return references.resolve(pages.select("page_id", url), documents, ["Domain"])


SITES = "(SELECT page_id, page_id || ':' || url AS url, html, toxic FROM pages LEFT JOIN labels ON page_id = doc_id)"


@query(f"SELECT page_id, url, CASE WHEN toxic = 0 THEN left(html, 20) END AS body FROM {SITES}")
def resolve_refs(spark, sf_dir):
    return _references(spark, sf_dir)[0].select("page_id", "url", F.substring("body", 1, 20).alias("body"))


@query(f"SELECT page_id, url, CASE WHEN toxic = 0 THEN length(html) END AS n_chars, CASE WHEN toxic = 0 THEN sha256(html) END AS body_sha256 FROM {SITES}")
def resolve_refs_whole(spark, sf_dir):
    out = _references(spark, sf_dir)[0]
    return out.select("page_id", "url", F.length("body").cast("long").alias("n_chars"), F.sha2(F.encode("body", "UTF-8"), 256).alias("body_sha256"))


FAILED = f"(SELECT page_id, url, CASE WHEN toxic IS NULL THEN 'transient' ELSE 'unrecoverable' END AS kind FROM {SITES} WHERE toxic IS NULL OR toxic <> 0)"


@query(f"SELECT page_id, url, kind FROM {FAILED}")
def resolve_failures(spark, sf_dir):
    return _references(spark, sf_dir)[1].select("page_id", "url", "kind")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures, in ten groups."""
    return _references(spark, sf_dir)[1].select((F.col("page_id") % 10).alias("g"), "page_id", "kind")


FAILURES = f"(SELECT page_id % 10 AS g, page_id, kind FROM {FAILED})"


@query(f"SELECT g, page_id, kind, n = 3 AS halt FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY page_id) AS n FROM {FAILURES}) WHERE n <= 3")
def strategy_stop_after(spark, sf_dir):
    return tiles.halted(_failures(spark, sf_dir), ["g"], ["page_id"], "stop_after", 3)


@query(f"SELECT f.g, f.page_id, f.kind, f.kind = 'unrecoverable' AS halt FROM {FAILURES} f LEFT JOIN (SELECT g, min(page_id) AS stop FROM {FAILURES} WHERE kind = 'unrecoverable' GROUP BY g) s USING (g) WHERE f.page_id <= coalesce(s.stop, f.page_id)")
def strategy_halt_on_unrecoverable(spark, sf_dir):
    return tiles.halted(_failures(spark, sf_dir), ["g"], ["page_id"], "halt_on_unrecoverable")


@query(f"SELECT g, min(page_id) AS page_id, arg_min(kind, page_id) AS kind, true AS halt FROM {FAILURES} GROUP BY g")
def strategy_fail_fast(spark, sf_dir):
    return tiles.halted(_failures(spark, sf_dir), ["g"], ["page_id"], "fail_fast")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, event_type = lag(event_type) OVER w AND event_type = lag(event_type, 2) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, coalesce(third, FALSE) AS halt, count(*) FILTER (third) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, ts, event_id, event_type, halt FROM s WHERE n = 0 OR (n = 1 AND halt)""")
def strategy_with_state(spark, sf_dir):
    """Each user's events up to the third in a row of one type."""

    def third(state, row):
        last, n = state
        n = n + 1 if row["event_type"] == last else 1
        return (row["event_type"], n), n == 3

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return folds.fold(events, ["user_id"], ["ts", "event_id"], third, lambda: (None, 0), chunk=25_000)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE n_name END AS parameters FROM customer JOIN nation ON c_nationkey = n_nationkey")
def collection_inherit(spark, sf_dir):
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return members.select("c_custkey", references.inherited(own, F.col("n_name"), F.col("c_custkey") % 3 < 2).alias("parameters"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN n_name WHEN n_nationkey % 2 = 0 THEN r_name END AS domain_type FROM nation JOIN region ON n_regionkey = r_regionkey")
def effective_domain_type(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inline = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, F.col("n_name"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("")
    return both.select("n_nationkey", references.effective_domain_type(inline, own).alias("domain_type"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(event_id AS DOUBLE) AS x, value AS y FROM events")
def composite_columns(spark, sf_dir):
    each = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.array(F.col("event_id").cast("double"), "value").alias("v"))))
    axis = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(each, lambda s: s["v"]).alias("v"))
    x, y = fx.components(F.col("v"), 2)
    rows = axis.select("user_id", F.posexplode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("pos", "p"))
    return rows.select("user_id", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")


@query("SELECT user_id, count(*) AS n, count(*) >= 2 AS line, CASE WHEN count(*) >= 2 THEN arg_min(value, {'t': ts, 'e': event_id}) END AS first_y, CASE WHEN count(*) >= 2 THEN arg_max(value, {'t': ts, 'e': event_id}) END AS last_y FROM events GROUP BY user_id")
def trajectory_linestring(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("x", F.col("event_id").cast("double")).withColumn("y", F.col("value"))
    out = geojson.linestring(rows, ["user_id"], ["ts", "event_id"])
    c = F.col("geometry.coordinates")
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.col("geometry").isNotNull().alias("line"), F.get(F.get(c, F.lit(0)), F.lit(1)).alias("first_y"), F.element_at(F.element_at(c, -1), 2).alias("last_y"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts' sizes: every fourth is open, every fifth has three positions."""
    s = F.col("p_size").cast("double")
    box = F.array(*[F.array(a, b) for a, b in ((F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (s, s), (F.lit(0.0), F.lit(0.0)))])
    open_ = F.array(*[F.array(a, b) for a, b in ((F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (s, s), (F.lit(0.0), s))])
    ring = F.when(F.col("p_partkey") % 5 == 0, F.slice(box, 2, 3)).when(F.col("p_partkey") % 4 == 0, open_).otherwise(box)
    return table(spark, sf_dir, "part").select("p_partkey", ring.alias("ring"))


@query("""SELECT p_partkey, 'axis.polygon-ring-too-short' AS code, '3' AS detail FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'axis.polygon-ring-not-closed', NULL FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 4 = 0""")
def polygon_checks(spark, sf_dir):
    return validate.polygon_issues(_rings(spark, sf_dir), ["p_partkey"], F.lit(2)).select("p_partkey", "code", "detail")


MONOTONIC = """WITH v AS (SELECT user_id, floor(value / 10) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
s AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS sg FROM v),
d AS (SELECT *, first_value(nullif(sg, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS dir FROM s)
SELECT user_id, 'axis.not-monotonic' AS code, CAST(min(pos) AS VARCHAR) AS detail FROM d WHERE (sg <> 0 AND sg <> dir)"""


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis a user: its values in order of time, in tens, so that equal neighbours occur."""
    cells = _events(spark, sf_dir).ranges["value"].cells
    return cells.select("user_id", F.lit("v").alias("name"), F.col("p_t").alias("pos"), F.floor(F.col("value") / 10).alias("value"))


@query(f"{MONOTONIC} GROUP BY user_id")
def validate_monotonic(spark, sf_dir):
    return validate.monotonic_issues(_coarse(spark, sf_dir), ["user_id"]).select("user_id", "code", "detail")


@query(f"{MONOTONIC} OR sg = 0 GROUP BY user_id")
def validate_monotonic_strict(spark, sf_dir):
    return validate.monotonic_issues(_coarse(spark, sf_dir), ["user_id"], strict=True).select("user_id", "code", "detail")


@query("SELECT vec_id, 'ndarray.value-count' AS code, CAST(64 - label % 3 AS VARCHAR) AS detail FROM embeddings WHERE label % 3 <> 0")
def validate_value_count(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("v").alias("key"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.array(F.lit("y"), F.lit("x")).alias("axis_names"), F.size(F.slice("embedding", F.lit(1), (64 - F.col("label") % 3).cast("int"))).alias("n_values"))
    return validate.ndarray_issues(rows, ["vec_id"]).select("vec_id", "code", "detail")


@query("SELECT vec_id, 'ndarray.shape-rank' AS code FROM embeddings WHERE label % 2 = 1")
def validate_shape(spark, sf_dir):
    names = F.when(F.col("label") % 2 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("v").alias("key"), F.array(F.lit(8), F.lit(8)).alias("shape"), names.alias("axis_names"), F.size("embedding").alias("n_values"))
    return validate.ndarray_issues(rows, ["vec_id"]).select("vec_id", "code")


def _domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A PointSeries a user: y is missing for users divisible by 4, x has two values for those divisible by 5, and w, an extra axis, has two for those divisible by 7."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    size = lambda k: F.when(F.col("user_id") % k == 0, 2).otherwise(1)
    each = F.array(
        F.struct(F.lit("t").alias("name"), F.col("n").alias("size")), F.struct(F.lit("x").alias("name"), size(5).alias("size")),
        F.struct(F.when(F.col("user_id") % 4 != 0, "y").alias("name"), F.lit(1).alias("size")), F.struct(F.lit("w").alias("name"), size(7).alias("size")),
    )
    axes = users.select("user_id", F.explode(each).alias("a")).select("user_id", "a.name", "a.size", F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("array<string>").alias("coordinates")).filter("name is not null")
    domains = users.select("user_id", F.when(F.col("user_id") % 11 == 0, "").otherwise("PointSeries").alias("domain_type"), F.when(F.col("user_id") % 9 != 0, F.array(F.lit("crs"))).alias("referencing"))
    return domains, axes


DOMAIN = """WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT * FROM u WHERE user_id % 11 <> 0),
i AS (SELECT user_id, 'domain.missing-axis' AS code, 'error' AS severity, 'y' AS detail FROM k WHERE user_id % 4 = 0
UNION ALL SELECT user_id, 'domain.axis-not-single', 'error', 'x' FROM k WHERE user_id % 5 = 0
UNION ALL SELECT user_id, 'domain.extra-axis-not-single', 'error', 'w' FROM k WHERE user_id % 7 = 0
UNION ALL SELECT user_id, 'domain.missing-referencing', 'error', NULL FROM u WHERE user_id % 9 = 0
UNION ALL SELECT user_id, 'domain.missing-domain-type', 'warning', NULL FROM u WHERE user_id % 11 = 0)"""


@query(f"{DOMAIN} SELECT * FROM i")
def validate_domain_axes(spark, sf_dir):
    return validate.domain_issues(*_domains(spark, sf_dir), ["user_id"]).select("user_id", "code", "severity", "detail")


@query(f"{DOMAIN} SELECT user_id, count(i.code) FILTER (severity = 'error') AS errors, count(i.code) FILTER (severity = 'warning') AS warnings, count(i.code) FILTER (severity = 'error') = 0 AS valid FROM u LEFT JOIN i USING (user_id) GROUP BY user_id")
def validate_report(spark, sf_dir):
    domains, axes = _domains(spark, sf_dir)
    return validate.verdicts(domains, validate.domain_issues(domains, axes, ["user_id"]), ["user_id"])


@query("SELECT doc_id, 'range.invalid-category-code' AS code, CAST(quality AS VARCHAR) AS detail FROM labels WHERE quality NOT IN (1) UNION ALL SELECT doc_id, 'range.invalid-category-code', CAST(toxic AS VARCHAR) FROM labels WHERE toxic NOT IN (0)")
def validate_category_codes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    cells = labels.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("quality", "toxic")])).alias("c")).select("doc_id", "c.*")
    codes = spark.createDataFrame([("quality", 1), ("toxic", 0)], "key string, value int")
    return validate.code_issues(cells, codes, ["doc_id"]).select("doc_id", "code", "detail")


@query("SELECT DISTINCT event_type, 'parameter.category-encoding-unknown-id' AS code, 'none' AS detail FROM events")
def validate_encoding_ids(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    parameters = kinds.select("event_type", F.col("event_type").alias("key"), F.array("event_type").alias("categories"), F.create_map(F.col("event_type"), F.lit(1), F.lit("none"), F.lit(2)).alias("encoding"))
    groups = kinds.limit(0).select("event_type", F.lit(0).alias("group_idx"), F.array("event_type").alias("members"))
    coverages = kinds.select("event_type", F.lit(True).alias("has_parameters"))
    return validate.parameter_issues(coverages, parameters, groups, ["event_type"]).select("event_type", "code", "detail")


@query("SELECT user_id, 'parameter-group.unknown-member' AS code, 'click' AS detail FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') = 0")
def validate_group_members(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    none = F.lit(None).cast("array<string>")
    parameters = events.select("user_id", F.col("event_type").alias("key")).distinct().select("*", none.alias("categories"), F.lit(None).cast("map<string,int>").alias("encoding"))
    users = events.select("user_id").distinct()
    groups = users.select("user_id", F.lit(0).alias("group_idx"), F.array(F.lit("click")).alias("members"))
    return validate.parameter_issues(users.withColumn("has_parameters", F.lit(True)), parameters, groups, ["user_id"]).select("user_id", "code", "detail")


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, 'coverage.range-without-parameter' AS code, 'value' AS detail FROM a WHERE user_id % 3 = 0
UNION ALL SELECT user_id, 'coverage.range-axis-not-in-domain', 'z' FROM a UNION ALL SELECT user_id, 'coverage.range-shape-mismatch', 't' FROM a WHERE user_id % 2 = 0""")
def validate_ranges(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    ranges = users.select("user_id", F.lit("value").alias("key"), F.array(F.col("n") + F.when(F.col("user_id") % 2 == 0, 1).otherwise(0), F.lit(1)).alias("shape"), F.array(F.lit("t"), F.lit("z")).alias("axis_names"))
    axes = users.select("user_id", F.lit("t").alias("name"), F.col("n").alias("size"))
    parameters = users.select("user_id", F.when(F.col("user_id") % 3 == 0, "other").otherwise("value").alias("key"))
    return validate.range_issues(ranges, axes, parameters, ["user_id"]).select("user_id", "code", "detail")


@query("SELECT event_id, 'range.value-type-mismatch' AS code, CASE event_id % 4 WHEN 1 THEN k || '.0' WHEN 2 THEN '\"' || k || '\"' END AS token FROM (SELECT event_id, props->>'k' AS k FROM events) WHERE event_id % 4 IN (1, 2)")
def validate_value_types(spark, sf_dir):
    from isomere.sources import documents

    k = F.get_json_object("props", "$.k")
    token = F.when(F.col("event_id") % 4 == 1, F.concat(k, F.lit(".0"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), k, F.lit('"'))).when(F.col("event_id") % 4 == 3, "null").otherwise(k)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("cov_idx"), F.lit("v").alias("key"), F.lit("NdArray").alias("kind"), F.concat(F.lit('{"values":['), token, F.lit("]}")).alias("body"), token.alias("raw"))
    written = documents.values(rows).join(rows.select("doc_id", "raw"), "doc_id").withColumn("data_type", F.lit("integer")).withColumn("token", F.col("raw"))
    return validate.value_issues(written, ["doc_id"]).select(F.col("doc_id").alias("event_id"), "code", F.col("detail").alias("token"))


@query("SELECT doc_id, 'i18n.invalid-language-tag' AS code, lang || '_' || source AS detail FROM documents WHERE doc_id % 3 = 0")
def validate_i18n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "lang", "source")).otherwise(F.col("lang"))
    texts = docs.select("doc_id", F.lit("/label").alias("at"), F.create_map(tag, F.lit("x")).alias("i18n"))
    return validate.language_issues(texts, ["doc_id"]).select("doc_id", "code", "detail")


@query("""SELECT n_nationkey, code, detail FROM nation, (VALUES ('tiled-ndarray.tile-shape-too-large', '9', 0), ('tiled-ndarray.tile-shape-not-positive', '0', 1),
('tiled-ndarray.url-template-missing-variable', 'x', 2), ('tiled-ndarray.url-template-unknown-variable', 'w', 2)) v(code, detail, m) WHERE n_nationkey % 3 = m""")
def validate_tiles(spark, sf_dir):
    m = F.col("n_nationkey") % 3
    first = F.when(m == 0, 9).when(m == 1, 0).otherwise(4)
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lit(0).alias("set_idx"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.array(F.lit("y"), F.lit("x")).alias("axis_names"),
        F.array(first, F.lit(4)).alias("tile_shape"), F.when(m == 2, "{y}/{w}").otherwise("{y}/{x}").alias("url_template"),
    )
    return validate.tile_issues(rows, ["n_nationkey"]).select("n_nationkey", "code", "detail")


@query("SELECT n_nationkey, 'temporal.missing-calendar' AS code FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'identifier.missing-target-concept' FROM nation WHERE n_nationkey % 2 = 1")
def validate_systems(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(0).alias("conn_idx"), F.when(F.col("n_nationkey") % 2 == 0, "TemporalRS").otherwise("IdentifierRS").alias("kind"), F.lit(None).cast("string").alias("calendar"), F.lit(None).cast("string").alias("target"))
    return validate.system_issues(rows, ["n_nationkey"]).select("n_nationkey", "code")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as written in each form, and broken ones."""
    d, m = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(m == 0, F.date_format(d, "yyyy")).when(m == 1, F.date_format(d, "yyyy-MM")).when(m == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(m == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T12:30:00Z"))).when(m == 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:59:60Z")))
        .when(m == 5, F.lit("2010-13-99")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.alias("value"))


@query("""SELECT o_orderkey, CASE WHEN m < 4 THEN 'moment' WHEN m = 4 THEN 'unrepresentable' ELSE 'malformed' END AS kind,
CASE m WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'second' END AS "precision",
CASE m WHEN 0 THEN date_trunc('year', d)::TIMESTAMP WHEN 1 THEN date_trunc('month', d)::TIMESTAMP WHEN 2 THEN d::TIMESTAMP WHEN 3 THEN d::TIMESTAMP + INTERVAL 750 MINUTE END AS "when"
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 7 AS m FROM orders)""")
def temporal_resolve(spark, sf_dir):
    r = _times(spark, sf_dir).select("o_orderkey", ft.resolve(F.col("value")).alias("r"))
    return r.select("o_orderkey", "r.kind", "r.precision", F.col("r.when").cast("timestamp_ntz").alias("when"))


@query("SELECT o_orderkey, 'temporal.lexical-form' AS code, CASE WHEN o_orderkey % 7 = 5 THEN '2010-13-99' ELSE strftime(o_orderdate::DATE, '%m/%d/%Y') END AS detail FROM orders WHERE o_orderkey % 7 >= 5")
def validate_temporal(spark, sf_dir):
    return validate.lexical_issues(_times(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "code", "detail")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'not a time' ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') END AS v FROM orders)
SELECT o_orderkey, CASE WHEN bool_and(try_cast(v AS TIMESTAMP) IS NOT NULL) OVER (PARTITION BY o_custkey) THEN try_cast(v AS TIMESTAMP) END AS t FROM t""")
def maybe_datetime(spark, sf_dir):
    value = F.when(F.col("o_custkey") % 5 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", value.alias("v"))
    return orders.select("o_orderkey", ft.maybe_datetime(F.col("v"), Window.partitionBy("o_custkey")).cast("timestamp_ntz").alias("t"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || 'PT' || CAST(l_quantity AS INTEGER) || '.5S' AS duration FROM lineitem")
def iso_duration(spark, sf_dir):
    seconds = (F.col("l_quantity").cast("double") + 0.5) * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ft.iso_duration(seconds).alias("duration"))


@query("""SELECT event_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || event_id || ',' || user_id || ']},"properties":{"kind":"' || event_type || '"}}' AS feature FROM events""")
def geojson_points(spark, sf_dir):
    text = geojson.feature(geojson.point(F.col("event_id"), F.col("user_id")), F.struct(F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("feature"))


@query("""SELECT p_partkey, '{"type":"Polygon","coordinates":[[[0,0],[0,' || p_size || '],[' || p_size || ',' || p_size || '],[0,0]]]}' AS geometry FROM part""")
def geojson_polygons(spark, sf_dir):
    s, zero = F.col("p_size").cast("int"), F.lit(0)
    rings = F.array(F.array(F.array(zero, zero), F.array(s, zero), F.array(s, s), F.array(zero, zero)))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(geojson.polygon(rings, (1, 0))).alias("geometry"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'OGC:CRS84' ELSE 'http://www.opengis.net/def/crs/EPSG/0/' || (4326 + n_nationkey) END AS crs FROM nation")
def geojson_crs(spark, sf_dir):
    key = F.col("n_nationkey")
    listed = F.array(
        F.struct(F.lit(0).alias("conn_idx"), F.lit("ProjectedCRS").alias("kind"), F.lit(None).cast("string").alias("id")),
        F.struct(F.lit(1).alias("conn_idx"), F.lit("GeographicCRS").alias("kind"), F.when(key % 2 == 0, "local").otherwise(F.concat(F.lit("http://www.opengis.net/def/crs/EPSG/0/"), (key + 4326).cast("string"))).alias("id")),
    )
    systems = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(listed).alias("s")).select("n_nationkey", "s.*")
    return geojson.crs(systems, ["n_nationkey"])


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'z' WHEN 4 THEN 't' ELSE CASE WHEN l_returnflag = 'R' THEN 'z' END END AS role FROM lineitem""")
def cf_roles(spark, sf_dir):
    """Coordinates named by line number; those of other lines with a positive attribute where a line was returned."""
    number = F.col("l_linenumber")
    name = F.coalesce(F.get(F.array(*map(F.lit, ("", "Lon", "latitude", "depth", "TIME"))), number.cast("int")), F.lit("other"))
    positive = F.when((F.col("l_returnflag") == "R") & (number > 4), "up")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cf.role(name, none, none, positive).alias("role"))


@query("SELECT user_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY event_type) AS flag_values, string_agg('type_' || event_type, ' ' ORDER BY event_type) AS flag_meanings FROM (SELECT DISTINCT user_id, event_type, length(event_type) AS code FROM events) GROUP BY user_id")
def cf_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("pos"), F.char_length("event_type").alias("code"), F.concat(F.lit(" type  "), "event_type").alias("label")).distinct()
    out = cf.flags(rows, ["user_id"])
    return out.select("user_id", F.array_join(F.transform("flag_values", lambda v: v.cast("string")), ",").alias("flag_values"), "flag_meanings")


@query("SELECT n_nationkey, lower(n_name) AS standard_name FROM nation")
def cf_standard_name(spark, sf_dir):
    uri = F.concat(F.lit("http://vocab.example.org/standard_name/"), F.lower("n_name"), F.lit("/"))
    return table(spark, sf_dir, "nation").select("n_nationkey", fs.standard_name(F.regexp_replace(uri, "/$", "")).alias("standard_name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Opaque' WHEN n_nationkey % 3 = 1 THEN 'TemporalRS' ELSE 'GeographicCRS' END AS kind FROM nation")
def refine_systems(spark, sf_dir):
    m = F.col("n_nationkey") % 3
    kind, calendar = F.when(m < 2, "TemporalRS").otherwise("GeographicCRS"), F.when(m == 1, "Gregorian")
    return table(spark, sf_dir, "nation").select("n_nationkey", fs.refine(kind, calendar, F.lit(None).cast("string")).alias("kind"))


@query("SELECT doc_id, '/ranges/' || replace(replace(source || '/' || lang || '~', '~', '~0'), '/', '~1') AS pointer FROM documents")
def json_pointer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fm.json_pointer(F.lit("ranges"), F.concat("source", F.lit("/"), "lang", F.lit("~"))).alias("pointer"))


@query("SELECT doc_id, doc_id % 3 <> 2 AS right FROM documents".replace("right", '"right"'))
def media_type(spark, sf_dir):
    m = F.col("doc_id") % 3
    value = F.when(m == 0, fm.media_type("a", "b")).when(m == 1, F.lit(" Application/PRS.coverage+json ;q=1")).otherwise("application/json")
    return table(spark, sf_dir, "documents").select("doc_id", fm.is_media_type(value).alias("right"))


@query("SELECT page_id, 'http://x/' || page_id || '/' || (page_id % 7) AS url FROM pages")
def url_template(spark, sf_dir):
    names, values = F.array(F.lit("a"), F.lit("b")), F.array("page_id", F.col("page_id") % 7)
    return table(spark, sf_dir, "pages").select("page_id", fa.expand_template(F.lit("http://x/{a}/{b}"), names, values).alias("url"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'text' END AS shown FROM documents")
def i18n_display(spark, sf_dir):
    texts = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("de"), F.lit("first"), F.lit("fr"), F.lit("second"))).otherwise(F.create_map(F.lit("de"), F.lit("first"), F.lit("en"), F.lit("text")))
    return table(spark, sf_dir, "documents").select("doc_id", fm.display(texts).alias("shown"))


@query("SELECT n_nationkey, 0 AS cov_idx, 'x' AS name, 3 AS size FROM nation UNION ALL SELECT n_nationkey, 0, 't', 1 FROM nation")
def document_axes(spark, sf_dir):
    from isomere.sources import documents

    body = F.concat(
        F.lit('{"type":"Coverage","domain":{"type":"Domain","domainType":"PointSeries","axes":{"x":{"start":0,"stop":2,"num":3},"t":{"values":["'), "n_name", F.lit('"]}}},"ranges":{}}')
    )
    good, _ = documents.decode(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), body.alias("body")))
    axes = documents.axes(documents.effective(documents.coverages(good)))
    return axes.select(F.col("doc_id").alias("n_nationkey"), "cov_idx", "name", fx.length(F.col("axis.values"), F.col("axis.num")).alias("size"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN 'unexpected type Other' WHEN n_nationkey % 4 = 2 THEN 'not JSON' ELSE 'no type' END AS error FROM nation WHERE n_nationkey % 4 <> 0")
def document_quarantine(spark, sf_dir):
    from isomere.sources import documents

    m = F.col("n_nationkey") % 4
    body = F.when(m == 0, '{"type":"Domain","axes":{}}').when(m == 1, '{"type":"Other"}').when(m == 2, '{"type":').otherwise("{}")
    _, bad = documents.decode(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), body.alias("body")))
    return bad.select(F.col("doc_id").alias("n_nationkey"), "error")


from isomere.plans import feature_documents, tree_documents, whole_documents  # noqa: E402, F401 their queries are added to these
