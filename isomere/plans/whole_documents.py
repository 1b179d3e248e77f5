"""Queries over whole documents, one a customer, each of the kinds in cases; they are added to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isomere.functions import calendars
from isomere.functions import temporal as ft
from isomere.operators import cf, cf_documents, cf_variables, conformance, fetching, subset_documents
from isomere.plans import cases
from isomere.plans.catalogue import ORACLE_SQL, query, spread, table
from isomere.sources.documents import decode, encode

N = len(cases.CASES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): a customer's document, of the kind that the key's remainder names."""
    kinds = spark.createDataFrame(list(enumerate(cases.bodies())), "kind int, template string")
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % N).cast("int").alias("kind"))
    return keys.join(F.broadcast(kinds), "kind").select("doc_id", F.replace("template", F.lit(cases.KEY), F.col("doc_id").cast("string")).alias("body"))


VALUE_CODES = ("axis.composite", "axis.polygon", "axis.not-monotonic", "temporal.lexical", "range.")
FOUND = f"""SELECT c_custkey AS doc_id, code, severity, "at", detail FROM customer
JOIN (VALUES {cases.sql_values(cases.findings())}) v(kind, code, severity, "at", detail) ON c_custkey % {N} = kind"""


@query(FOUND)
def validate_documents(spark, sf_dir):
    return conformance.validate(documents(spark, sf_dir), check_values=True)


@query(f"SELECT * FROM ({FOUND}) f WHERE NOT ({' OR '.join(f"starts_with(code, '{c}')" for c in VALUE_CODES)})")
def validate_documents_structure(spark, sf_dir):
    return conformance.validate(documents(spark, sf_dir))


#: Times with their kind, moment and precision.
TIMES = [
    ("2020", "moment", "2020-01-01 00:00:00", "year"), ("+002020", "moment", "2020-01-01 00:00:00", "year"), ("+2020", "malformed", None, None), ("-2020", "malformed", None, None),
    ("12345", "malformed", None, None), ("+12345", "unrepresentable", None, None), ("-00001", "unrepresentable", None, None), ("0000", "unrepresentable", None, None), ("+99999999999999999999", "unrepresentable", None, None),
    ("2020-02", "moment", "2020-02-01 00:00:00", "month"), ("0000-12", "unrepresentable", None, None), ("0000-13", "malformed", None, None), ("2020-00", "malformed", None, None),
    ("2020-02-29", "moment", "2020-02-29 00:00:00", "day"), ("2021-02-29", "malformed", None, None), ("1900-02-29", "malformed", None, None), ("0000-02-29", "unrepresentable", None, None), ("0000-02-30", "malformed", None, None),
    ("2020-01-02T03:04:05Z", "moment", "2020-01-02 03:04:05", "second"), ("2020-01-02T03:04:05.5+01:00", "moment", "2020-01-02 02:04:05.5", "second"), ("2020-01-02T03:04:05", "malformed", None, None),
    ("2016-12-31T23:59:60Z", "unrepresentable", None, None), ("2016-13-31T23:59:60Z", "unrepresentable", None, None), ("2016-12-31T25:99:60Z", "unrepresentable", None, None), ("2016-12-31T24:00:00Z", "malformed", None, None),
    ("0000-01-01T00:00:00Z", "unrepresentable", None, None), ("0000-01-01T00:61:00Z", "malformed", None, None), ("", "malformed", None, None), ("now", "malformed", None, None),
    ("2020-01-02T03:04:05+19:00", "moment", "2020-01-01 08:04:05", "second"), ("2020-01-02T03:04:05.25-23:59", "moment", "2020-01-03 03:03:05.25", "second"), ("2020-01-02T03:04:05+24:00", "malformed", None, None), ("2020-01-02T03:04:05+01:60", "malformed", None, None),
    ("2020\n", "malformed", None, None), ("2020-01\n", "malformed", None, None), ("2020-01-02\n", "malformed", None, None), ("2020-01-02T03:04:05Z\n", "malformed", None, None), ("+002020\n", "malformed", None, None),
]


@query(f"""SELECT c_custkey, value, kind, "when"::TIMESTAMP AS "when", "precision" FROM customer
JOIN (VALUES {cases.sql_values([(i, *t) for i, t in enumerate(TIMES)])}) v(i, value, kind, "when", "precision") ON c_custkey % {len(TIMES)} = i""")
def temporal_forms(spark, sf_dir):
    forms = F.array(*[F.lit(t[0]) for t in TIMES])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(forms, (F.col("c_custkey") % len(TIMES)).cast("int")).alias("value"))
    r = rows.withColumn("r", ft.resolve(F.col("value")))
    return r.select("c_custkey", "value", "r.kind", F.col("r.when").cast("timestamp_ntz").alias("when"), "r.precision")


#: Name, standard name, units, positive attribute, whether values are times, and the role.
ROLES = [
    ("lon", None, None, None, False, "x"), ("east", None, "degrees_E", None, False, "x"), ("a", "longitude", None, None, False, "x"), ("Latitude", None, None, None, False, "y"), ("b", None, "degrees_north", None, False, "y"),
    ("level", None, None, None, False, "z"), ("elevation", None, None, None, False, "z"), ("c", None, None, "up", False, "z"), ("d", "depth", None, None, False, "z"), ("e", "altitude", None, None, False, "z"),
    ("time", None, None, None, False, "t"), ("f", "time", None, None, False, None), ("g", None, "m", None, False, None), ("h", None, None, None, True, "t"), ("lon", "latitude", None, None, False, "x"),
    ("x", None, None, "down", True, "x"), ("i", None, "degree_east", None, False, None), ("depth", None, "degrees_north", "down", False, "y"), ("t", None, None, "up", True, "z"),
]


@query(f"""SELECT c_custkey, role FROM customer
JOIN (VALUES {cases.sql_values([(i, r[-1]) for i, r in enumerate(ROLES)])}) v(i, role) ON c_custkey % {len(ROLES)} = i""")
def cf_coordinate_roles(spark, sf_dir):
    known = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(ROLES)], "i int, name string, standard string, units string, positive string, is_time boolean")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(ROLES)).cast("int").alias("i")).join(F.broadcast(known), "i")
    return rows.select("c_custkey", cf.role(*[F.col(c) for c in ("name", "standard", "units", "positive", "is_time")]).alias("role"))


def linked(spark: SparkSession, sf_dir: str, of: str = "customer", named: str = "c_custkey") -> tuple[DataFrame, DataFrame]:
    """(doc_id, body) of a coverage a customer (or a row of another table) that refers to two URLs, within a collection for even keys; (url, body)."""
    rows = spread(table(spark, sf_dir, of).select(F.col(named).alias("c_custkey")))
    key = F.col("c_custkey").cast("string")
    cov = F.concat(F.lit('{"type":"Coverage","id":"'), key, F.lit('","domain":"http://x/d/'), key, F.lit('","ranges":{"p":"http://x/r/'), key, F.lit('","q":{"type":"NdArray","dataType":"float","values":[2.0]}}}'))
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"type":"CoverageCollection","coverages":['), cov, F.lit("]}"))).otherwise(cov)
    domain = rows.filter("c_custkey % 3 <> 0").select(F.concat(F.lit("http://x/d/"), key).alias("url"), F.concat(F.lit('{"type":"Domain","axes":{"b":{"values":['), key, F.lit("]}}}")).alias("body"))
    kind = F.when(F.col("c_custkey") % 5 == 1, "Feature").otherwise("NdArray")
    text = F.when(F.col("c_custkey") % 7 == 2, "{broken").otherwise(F.concat(F.lit('{"type":"'), kind, F.lit('","dataType":"float","values":['), key, F.lit("]}")))
    ranges = rows.filter("c_custkey % 11 <> 0").select(F.concat(F.lit("http://x/r/"), key).alias("url"), text.alias("body"))
    return rows.select(F.col("c_custkey").alias("doc_id"), body.alias("body")), domain.unionByName(ranges)


SITES = """WITH k AS (SELECT c_custkey AS doc_id, c_custkey::VARCHAR AS k, c_custkey % 3 <> 0 AS d,
CASE WHEN c_custkey % 11 = 0 THEN 'no document' WHEN c_custkey % 7 = 2 THEN 'not JSON' WHEN c_custkey % 5 = 1 THEN 'unexpected type Feature' END AS r FROM customer)"""


@query(SITES + """ SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"type":"CoverageCollection","coverages":[' || cov || ']}' ELSE cov END AS body FROM (SELECT doc_id,
'{"type":"Coverage","id":"' || k || '","domain":' || CASE WHEN d THEN '{"type":"Domain","axes":{"b":{"values":[' || k || ']}}}' ELSE '"http://x/d/' || k || '"' END
|| ',"ranges":{"p":' || CASE WHEN r IS NULL THEN '{"type":"NdArray","dataType":"float","values":[' || k || ']}' ELSE '"http://x/r/' || k || '"' END || ',"q":{"type":"NdArray","dataType":"float","values":[2.0]}}}' AS cov FROM k)""")
def resolve_documents(spark, sf_dir):
    bodies, others = linked(spark, sf_dir)
    return fetching.resolve_references(decode(bodies)[0], others)[0]


@query(SITES + """ SELECT doc_id, 0 AS cov_idx, -1 AS slot_ord, 'domain' AS slot, 'http://x/d/' || k AS url, 'transient' AS kind, 'no document' AS message FROM k WHERE NOT d
UNION ALL SELECT doc_id, 0, 0, 'p', 'http://x/r/' || k, CASE r WHEN 'no document' THEN 'transient' ELSE 'unrecoverable' END, r FROM k WHERE r IS NOT NULL""")
def resolve_documents_failures(spark, sf_dir):
    bodies, others = linked(spark, sf_dir)
    return fetching.resolve_references(decode(bodies)[0], others)[1]


@query(ORACLE_SQL["resolve_documents"].replace("customer", "documents").replace("c_custkey", "doc_id"))
def resolve_fetched(spark, sf_dir):
    """As resolve_documents over the ids of documents, with a user's function in place of a table of what is referred to."""

    def fetch(url: str) -> bytes:
        what, key = url.split("/")[-2:]
        n = int(key)
        if what == "d" and n % 3 == 0 or what == "r" and n % 11 == 0:
            raise FileNotFoundError(url)
        if what == "d":
            return f'{{"type":"Domain","axes":{{"b":{{"values":[{n}]}}}}}}'.encode()
        return b"{broken" if n % 7 == 2 else f'{{"type":"{"Feature" if n % 5 == 1 else "NdArray"}","dataType":"float","values":[{n}]}}'.encode()

    return fetching.resolve_with(decode(linked(spark, sf_dir, "documents", "doc_id")[0])[0], fetch, retries=0)[0]


def tiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body) of a tiled array of 3 x 4 a customer, and its tiles of 2 x 3 (url, body), one in seven of them lost."""
    rows, key = spread(table(spark, sf_dir, "customer").select("c_custkey")), F.col("c_custkey").cast("string")
    body = F.concat(F.lit('{"type":"TiledNdArray","dataType":"float","axisNames":["y","x"],"shape":[3,4],"tileSets":[{"tileShape":[1,1],"urlTemplate":"http://x/'), key, F.lit('/{y}/{x}"},{"tileShape":[2,3],"urlTemplate":"http://x/'), key, F.lit('/{y}-{x}"}]}'))
    parts = rows.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).filter("(c_custkey + n) % 7 <> 0")
    y, x = F.floor(F.col("n") / 2).cast("int"), (F.col("n") % 2).cast("int")
    h, w = F.when(y == 0, 2).otherwise(1), F.when(x == 0, 3).otherwise(1)
    cell = lambda i: (F.col("c_custkey") * 100 + (y * 2 + F.floor(i / w)) * 4 + x * 3 + i % w).cast("string")
    values = F.array_join(F.transform(F.sequence(F.lit(0), h * w - 1), cell), ",")
    text = F.concat(F.lit('{"type":"NdArray","dataType":"float","axisNames":["y","x"],"shape":['), h.cast("string"), F.lit(","), w.cast("string"), F.lit('],"values":['), values, F.lit("]}"))
    return rows.select(F.col("c_custkey").alias("doc_id"), body.alias("body")), parts.select(F.concat(F.lit("http://x/"), key, F.lit("/"), y.cast("string"), F.lit("-"), x.cast("string")).alias("url"), text.alias("body"))


@query("""SELECT c_custkey AS doc_id, i AS flat_idx, CASE WHEN (c_custkey + (i // 8) * 2 + (i % 4) // 3) % 7 <> 0 THEN CAST(c_custkey * 100 + i AS VARCHAR) END AS value FROM customer, range(0, 12) r(i)""")
def assemble_documents(spark, sf_dir):
    bodies, others = tiled(spark, sf_dir)
    return fetching.assemble(bodies, others, ["doc_id"])[0].select("doc_id", "flat_idx", "value")


@query("""SELECT c_custkey AS doc_id, 'http://x/' || c_custkey || '/' || n // 2 || '-' || n % 2 AS url, 'transient' AS kind FROM customer, range(0, 4) r(n) WHERE (c_custkey + n) % 7 = 0""")
def assemble_documents_failures(spark, sf_dir):
    bodies, others = tiled(spark, sf_dir)
    return fetching.assemble(bodies, others, ["doc_id"])[1].select("doc_id", "url", "kind")


@query("""SELECT c_custkey::VARCHAR AS doc_id, '{"type":"Coverage","domain":{"type":"Domain","domainType":"PointSeries","axes":{"t":{"values":["2020-01-01T00:00:00Z","2020-01-02T00:00:00Z"]},"x":{"values":[' || c_custkey || '.0]},"y":{"values":[2.0]}},"referencing":[{"coordinates":["x","y"],"system":{"type":"GeographicCRS"}},{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"Gregorian"}}]},"parameters":{"v":{"type":"Parameter","observedProperty":{"label":{"und":"v"}},"unit":{"symbol":"m"}}},"ranges":{"v":{"type":"NdArray","dataType":"float","axisNames":["t"],"shape":[2],"values":[' || c_custkey || '.0,' || c_custkey || '.5]}}}' AS body FROM customer WHERE c_custkey % 5 <> 0""")
def cf_to_documents(spark, sf_dir):
    ds, key = F.col("c_custkey").cast("string").alias("ds_id"), F.col("c_custkey").cast("double")
    rows = table(spark, sf_dir, "customer")
    lost = F.col("c_custkey") % 5 == 0
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    unit = F.create_map(F.lit("units"), F.lit("m"))
    no_dims, one_dim = F.array().cast("array<string>"), F.array(F.lit("t"))
    told = [("lon", no_dims, none, True, False), ("lat", no_dims, none, True, False), ("t", one_dim, none, True, True), ("v", one_dim, unit, False, False)]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), d.alias("dims"), a.alias("attrs"), F.lit(c).alias("is_coord"), F.lit(t).alias("is_time")) for k, (n, d, a, c, t) in enumerate(told)])
    cell = lambda name, idx, number, text: F.struct(F.lit(name).alias("name"), F.lit(idx).alias("idx"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    null = F.lit(None)
    cells = F.array(
        cell("lon", 0, key, null), cell("lat", 0, F.lit(2), null), cell("t", 0, null, F.lit("2020-01-01T00:00:00Z")), cell("t", 1, null, F.when(~lost, "2020-01-02T00:00:00Z")),
        cell("v", 0, key, null), cell("v", 1, key + 0.5, null),
    )
    variables, values = (rows.select(ds, F.inline(x)) for x in (each, cells))
    sizes = rows.select(ds, F.lit("t").alias("dim"), F.lit(2).alias("size"))
    return cf_documents.documents(variables, values, sizes, rows.select(ds, none.alias("attrs")))[0]


#: Documents with a structural error each, the pointer to it and its reason; %s stands for the id of a row of documents.
BROKEN = [
    ('{"type":"Domain","axes":{"x":{"start":%s,"stop":1}}}', "/axes/x", "neither values nor a whole regular form"), ('{"type":"Domain","axes":{"x":{"values":[%s]},"y":{"values":[]}}}', "/axes/y", "no values"),
    ('{"type":"Domain","axes":{"x":{"start":%s,"stop":1,"num":0}}}', "/axes/x", "num below 1"), ('{"type":"Domain","axes":{"x":{"values":[[%s]],"dataType":"tuple"}}}', "/axes/x", "a composite axis needs values and coordinates"),
    ('{"type":"TiledNdArray","dataType":"float","axisNames":["x"],"shape":[%s],"tileSets":[]}', "", "no tile sets"), ('{"type":"TiledNdArray","dataType":"float","axisNames":["x"],"shape":[%s],"tileSets":[{"tileShape":[1,1],"urlTemplate":"u"}]}', "", "a tile set of another rank"),
    ('{"type":"Coverage","domain":"u","ranges":{},"parameters":{"%s":{"observedProperty":{"label":{}},"unit":{}}}}', "/parameters/%s/unit", "a unit needs a label or a symbol"), ('{"type":"Coverage","domain":"u","ranges":{},"parameters":{"%s":{"observedProperty":{"label":{}},"categoryEncoding":{"a":1}}}}', "/parameters/%s", "an encoding without categories"),
    ('{"type":"Coverage","domain":"u","ranges":{},"parameterGroups":[{"members":["%s"]}]}', "/parameterGroups/0", "a group needs a label or an observed property"), ('{"type":"CoverageCollection","coverages":[{"domain":"u","ranges":{"%s":1}}]}', "/coverages/0/ranges/%s", "neither an object nor a text"),
    ('{"type":"NdArray","dataType":"float","values":[%s]}', None, None),
]


def of_kinds(spark: SparkSession, sf_dir: str, bodies: list[str]) -> DataFrame:
    """(doc_id, body): for each row of documents a document of the kind that its id's remainder names, with the id for %s."""
    body = F.replace(F.get(F.array(*map(F.lit, bodies)), (F.col("doc_id") % len(bodies)).cast("int")), F.lit("%s"), F.col("doc_id").cast("string"))
    return spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", body.alias("body"))


@query(f"""SELECT doc_id, error, replace("at", '%s', doc_id::VARCHAR) AS "at" FROM documents
JOIN (VALUES {cases.sql_values([(i, at, error) for i, (_, at, error) in enumerate(BROKEN)])}) v(i, "at", error) ON doc_id % {len(BROKEN)} = i WHERE error IS NOT NULL""")
def structure_quarantine(spark, sf_dir):
    return decode(of_kinds(spark, sf_dir, [b for b, _, _ in BROKEN]))[1]


#: Documents of the five roots as they may come, and in canonical form.
WRITTEN = [
    ('{"ranges":{"q":"u","p":{"values":[%s,2.50,null],"dataType":"float","type":"NdArray","shape":[],"axisNames":[]}},"type":"Coverage","id":null,"more":1,"domain":{"axes":{"z":{"num":3,"start":1,"stop":2.5},"b":{"bounds":[0,1],"values":[%s]}},"referencing":[],"type":"Domain"}}',
     '{"type":"Coverage","domain":{"type":"Domain","axes":{"z":{"start":1.0,"stop":2.5,"num":3},"b":{"values":[%s],"bounds":[0.0,1.0]}}},"ranges":{"q":"u","p":{"type":"NdArray","dataType":"float","values":[%s,2.5,null]}}}'),
    ('{"coverages":[{"type":"Coverage","ranges":{},"domain":"u"}], "parameters":{"k%s":{"observedProperty":{"id":"i","label":{"b":"1","a":"2"}},"type":"Parameter","unit":{"symbol":{"type":"t","value":"K"}}}},"type":"CoverageCollection","referencing":[]}',
     '{"type":"CoverageCollection","coverages":[{"type":"Coverage","domain":"u","ranges":{}}],"parameters":{"k%s":{"type":"Parameter","observedProperty":{"label":{"b":"1","a":"2"},"id":"i"},"unit":{"symbol":{"value":"K","type":"t"}}}}}'),
    ('{"domainType":null,"type":"Domain","axes":{"x":{"values":["%s"]}},"@context":["c"]}', '{"type":"Domain","axes":{"x":{"values":["%s"]}},"@context":["c"]}'),
    ('{"values":[%s],"axisNames":["x"],"shape":[1],"type":"NdArray","dataType":"integer"}', '{"type":"NdArray","dataType":"integer","values":[%s],"shape":[1],"axisNames":["x"]}'),
    ('{"tileSets":[{"urlTemplate":"u","tileShape":[null]}],"shape":[%s],"axisNames":["x"],"dataType":"float","type":"TiledNdArray"}', '{"type":"TiledNdArray","dataType":"float","axisNames":["x"],"shape":[%s],"tileSets":[{"tileShape":[null],"urlTemplate":"u"}]}'),
]


@query(f"""SELECT doc_id, replace(body, '%s', doc_id::VARCHAR) AS body FROM documents
JOIN (VALUES {cases.sql_values([(i, body) for i, (_, body) in enumerate(WRITTEN)])}) v(i, body) ON doc_id % {len(WRITTEN)} = i""")
def encode_documents(spark, sf_dir):
    """Decoded, encoded, decoded and encoded again."""
    once = encode(decode(of_kinds(spark, sf_dir, [b for b, _ in WRITTEN]))[0])
    return encode(decode(once.select("doc_id", "body"))[0]).select("doc_id", "body")


#: A series a document: a time axis, a regular axis, a range along both with a missing value, and one of codes.
SERIES_COVERAGE = (
    '{"type":"Coverage","id":"c%s","domain":{"type":"Domain","domainType":"Grid","axes":{"t":{"values":["2020-01-01T00:00:00Z","2020-01-02T00:00:00.500000Z"]},"x":{"values":[%s.0,2.5,2.75]},'
    '"y":{"start":0.0,"stop":1.0,"num":3},"z":{"values":[%s.0]}},"referencing":[{"coordinates":["x","y"],"system":{"type":"GeographicCRS","id":"http://www.opengis.net/def/crs/OGC/1.3/CRS84"}},'
    '{"coordinates":["z"],"system":{"type":"VerticalCRS"}},{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"Gregorian"}}]},'
    '"parameters":{"ice":{"type":"Parameter","observedProperty":{"label":{"und":"Ice"},"categories":[{"id":"1","label":{"und":"thin ice"}},{"id":"2","label":{"und":"thick"}}]},"categoryEncoding":{"1":1,"2":2}},'
    '"v":{"type":"Parameter","observedProperty":{"label":{"und":"Speed"}},"unit":{"symbol":"m/s"}}},'
    '"ranges":{"ice":{"type":"NdArray","dataType":"integer","axisNames":["x"],"shape":[3],"values":[1,2,1]},"v":{"type":"NdArray","dataType":"float","axisNames":["t","y"],"shape":[2,3],"values":[%s.0,1.5,null,0.0,2.0,3.0]}}}'
)


@query(f"""SELECT doc_id::VARCHAR AS doc_id, replace('{SERIES_COVERAGE}', '%s', doc_id::VARCHAR) AS body FROM documents""")
def cf_round_trip(spark, sf_dir):
    """Documents to variables and back."""
    v = cf_variables.variables(decode(of_kinds(spark, sf_dir, [SERIES_COVERAGE]))[0])
    return cf_documents.documents(v.variables, v.cells, v.sizes, v.attributes)[0]


#: What of a document's coverages has no form as variables.
NOT_VARIABLES = [
    ('{"type":"Coverage","domain":"http://x/%s","ranges":{}}', "the domain is elsewhere"), ('{"type":"Coverage","domain":{"axes":{"x":{"values":[%s]}}},"ranges":{"p":"http://x","q":"http://y"}}', "ranges elsewhere: p, q"),
    ('{"type":"Coverage","domain":{"domainType":"Polygon","axes":{"composite":{"dataType":"polygon","coordinates":["x","y"],"values":[[[[%s,0],[1,1],[1,0],[%s,0]]]]}}},"ranges":{}}', "a domain of polygons"),
    ('{"type":"Coverage","domain":{"axes":{"t":{"values":["2020-%s-50"]}},"referencing":[{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"Gregorian"}}]},"ranges":{}}', "times that are none: t"),
    ('{"type":"Coverage","domain":{"axes":{"t":{"values":["2020-02-30"]}},"referencing":[{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"360_day"}}]},"ranges":{}}', None),
    ('{"type":"Coverage","domain":{"axes":{"t":{"values":["2020-02-29"]}},"referencing":[{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"noleap"}}]},"ranges":{}}', "times that are none: t"),
    ('{"type":"Coverage","domain":{"axes":{"x":{"values":[1,2]}}},"ranges":{"p":{"type":"NdArray","dataType":"float","axisNames":["x"],"shape":[3],"values":[1,2,%s]}}}', "dimension of two lengths: x"),
]


@query(f"""SELECT doc_id::VARCHAR AS ds_id, error FROM documents JOIN (VALUES {cases.sql_values([(i, e) for i, (_, e) in enumerate(NOT_VARIABLES)])}) v(i, error) ON doc_id % {len(NOT_VARIABLES)} = i WHERE error IS NOT NULL""")
def cf_variables_quarantine(spark, sf_dir):
    return cf_variables.variables(decode(of_kinds(spark, sf_dir, [b for b, _ in NOT_VARIABLES]))[0]).quarantine


@query("""WITH w AS (SELECT doc_id, DATE '1990-01-01' + (doc_id % 10000)::INTEGER AS o FROM documents), o AS (SELECT doc_id, year(o) AS y, month(o) AS m, least(day(o), 28) AS d FROM w)
SELECT doc_id, ((y * 360 + (m - 1) * 30 + d - 1) * 86400 + doc_id % 86400) * 1000000 AS days_360, ((y * 365 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][m] + d - 1) * 86400 + doc_id % 86400) * 1000000 AS no_leap, TRUE AS comes_back FROM o""")
def calendar_times(spark, sf_dir):
    """A day and a second for each id, as times of other calendars, as whole numbers and back."""
    date, second = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 10000).cast("int")), (F.col("doc_id") % 86400).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    day = two(F.least(F.dayofmonth(date), F.lit(28)))
    text = F.concat(F.date_format(date, "yyyy-MM-"), day, F.lit("T"), F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60)), F.lit("Z"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    kinds = {k: F.lit(k) for k in ("360_day", "noleap", "julian", "all_leap")}
    rows = rows.select("doc_id", "text", *[calendars.micros(F.col("text"), c).alias(k) for k, c in kinds.items()])
    back = F.forall(F.array(*[calendars.text(F.col(k), c) for k, c in kinds.items()]), lambda t: t == F.col("text"))
    return rows.select("doc_id", F.col("360_day").alias("days_360"), F.col("noleap").alias("no_leap"), back.alias("comes_back"))


def _changed(*pairs: tuple[str, str]) -> str:
    """SERIES_COVERAGE as a text of SQL, with parts of it in another form."""
    text = SERIES_COVERAGE
    for old, new in pairs:
        text = text.replace(old, new)
    return f"SELECT doc_id, '' AS path, replace('{text}', '%s', doc_id::VARCHAR) AS body FROM documents"


@query(_changed(
    ('{"values":["2020-01-01T00:00:00Z","2020-01-02T00:00:00.500000Z"]}', '{"values":["2020-01-02T00:00:00.500000Z"]}'), ('{"values":[%s.0,2.5,2.75]}', '{"values":[2.75,%s.0]}'),
    ('"axisNames":["x"],"shape":[3],"values":[1,2,1]', '"values":[1,1],"shape":[2],"axisNames":["x"]'), ('"axisNames":["t","y"],"shape":[2,3],"values":[%s.0,1.5,null,0.0,2.0,3.0]', '"values":[0.0,2.0,3.0],"shape":[3],"axisNames":["y"]'),
))
def documents_isel(spark, sf_dir):
    return subset_documents.isel(decode(of_kinds(spark, sf_dir, [SERIES_COVERAGE]))[0], {"x": slice(None, None, -2)}, t=-1)[0]


@query(_changed(
    ('{"start":0.0,"stop":1.0,"num":3}', '{"values":[0.5,1.0]}'), ('"axisNames":["x"],"shape":[3],"values":[1,2,1]', '"values":[1,2,1],"shape":[3],"axisNames":["x"]'),
    ('"axisNames":["t","y"],"shape":[2,3],"values":[%s.0,1.5,null,0.0,2.0,3.0]', '"values":[1.5,null,2.0,3.0],"shape":[2,2],"axisNames":["t","y"]'),
))
def documents_sel(spark, sf_dir):
    return subset_documents.sel(decode(of_kinds(spark, sf_dir, [SERIES_COVERAGE]))[0], y=slice(0.25, None))[0]
