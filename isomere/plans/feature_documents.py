"""Queries on features of whole coverages: for each row of documents a coverage of every domain type in turn."""

from __future__ import annotations

from isomere.operators import features
from isomere.plans import cases
from isomere.plans.catalogue import query
from isomere.plans.whole_documents import of_kinds
from isomere.sources.documents import decode

CRS = '"referencing":[{"coordinates":["t"],"system":{"type":"TemporalRS","calendar":"Gregorian"}},{"coordinates":["x","y"],"system":{"type":"GeographicCRS"}}]'


def _day(k: int) -> str:
    return f'"2020-01-0{k + 1}"'


def _list(texts) -> str:
    return f"[{','.join(map(str, texts))}]"


def _coverage(kind: str, axes: dict[str, str], lengths: dict[str, int]) -> str:
    """A coverage with a range along these axes, whose values are the row's id between digits."""
    total = 1
    for n in lengths.values():
        total *= n
    names = _list(f'"{n}"' for n in lengths)
    array = f'{{"type":"NdArray","dataType":"integer","axisNames":{names},"shape":{_list(lengths.values())},"values":{_list(f"1%s{i:02d}" for i in range(total))}}}'
    of_axes = ",".join(f'"{n}":{{{a}}}' for n, a in axes.items())
    return f'{{"type":"Coverage","domain":{{"type":"Domain","domainType":"{kind}","axes":{{{of_axes}}},{CRS}}},"ranges":{{"v":{array}}}}}'


#: Domain type, and numbers of times, heights, rows and columns.
PLAIN = [("Point", 1, 1, 1, 1), ("PointSeries", 3, 1, 1, 1), ("VerticalProfile", 1, 3, 1, 1), ("Grid", 2, 1, 3, 2)]
#: Domain type, components of a place, and numbers of times and heights at each of three places.
COMPOSITE = [("MultiPoint", "xy", 1, 1), ("MultiPointSeries", "xy", 2, 1), ("Trajectory", "txy", 1, 1), ("Section", "txy", 1, 2)]
#: Domain type, and numbers of polygons and times.
AREAS = [("Polygon", 1, 1), ("PolygonSeries", 1, 2), ("MultiPolygon", 2, 1), ("MultiPolygonSeries", 2, 2)]


def _plain(kind: str, nt: int, nz: int, ny: int, nx: int) -> str:
    axes = {"x": f'"values":{_list(["%s", "0.5"][:nx])}', "y": f'"start":0,"stop":{ny - 1},"num":{ny}'}
    axes |= {"z": f'"values":{_list(range(nz))}'} if nz > 1 else {}
    axes |= {"t": f'"values":{_list(map(_day, range(nt)))}'} if nt > 1 else {}
    lengths = {n: k for n, k in (("x", nx), ("y", ny), ("z", nz), ("t", nt)) if n in axes}
    return _coverage(kind, axes, lengths)


def _composite(kind: str, components: str, nt: int, nz: int) -> str:
    place = lambda k: {"t": _day(k), "x": f"%s.{k}", "y": k}
    values = _list(_list(place(k)[c] for c in components) for k in range(3))
    axes = {"composite": f'"dataType":"tuple","coordinates":{_list(f'"{c}"' for c in components)},"values":{values}'}
    axes |= {"z": f'"values":{_list(range(nz))}'} if nz > 1 else {}
    axes |= {"t": f'"values":{_list(map(_day, range(nt)))}'} if nt > 1 else {}
    return _coverage(kind, axes, {n: k for n, k in (("t", nt), ("z", nz)) if n in axes} | {"composite": 3})


def _areas(kind: str, n: int, nt: int) -> str:
    values = _list(f"[[[{k},%s],[{k + 1},%s],[{k + 1},0],[{k},%s]]]" for k in range(n))
    axes = {"composite": f'"dataType":"polygon","coordinates":["y","x"],"values":{values}'} | ({"t": f'"values":{_list(map(_day, range(nt)))}'} if nt > 1 else {})
    return _coverage(kind, axes, ({"t": nt} if nt > 1 else {}) | {"composite": n})


def _rows(table: list[tuple]) -> str:
    return f"documents JOIN (VALUES {cases.sql_values([(i, *r) for i, r in enumerate(table)])})"


HEAD = "doc_id, '' AS path, kind AS domain_type, 'OGC:CRS84' AS crs, i AS idx"
POINT = """'{"type":"Point","coordinates":[' || x || ',' || y || CASE WHEN z IS NULL THEN '' ELSE ',' || z END || ']}' AS geometry"""


@query(f"""WITH e AS (SELECT *, i // (nz * ny * nx) AS a, i // (ny * nx) % nz AS b, i // nx % ny AS c, i % nx AS d FROM {_rows(PLAIN)} v(n, kind, nt, nz, ny, nx) ON doc_id % 4 = n, range(12) r(i) WHERE i < nt * nz * ny * nx),
f AS (SELECT *, CASE WHEN d = 0 THEN doc_id || '.0' ELSE '0.5' END AS x, c || '.0' AS y, CASE WHEN nz > 1 THEN b || '.0' END AS z FROM e)
SELECT {HEAD}, {POINT}, '{{' || CASE WHEN nt > 1 THEN '"t":"2020-01-0' || (a + 1) || '",' ELSE '' END || CASE WHEN z IS NULL THEN '' ELSE '"z":' || z || ',' END
|| '"y":' || y || ',"x":' || x || ',"v":' || '1' || doc_id || lpad((((d * ny + c) * nz + b) * nt + a)::VARCHAR, 2, '0') || '}}' AS properties FROM f""")
def features_plain(spark, sf_dir):
    return features.features(decode(of_kinds(spark, sf_dir, [_plain(*k) for k in PLAIN]))[0])[0]


@query(f"""WITH e AS (SELECT *, i // (nt * nz) AS k, i % (nt * nz) AS j FROM {_rows(COMPOSITE)} v(n, kind, part, nt, nz) ON doc_id % 4 = n, range(6) r(i) WHERE i < 3 * nt * nz),
f AS (SELECT *, doc_id || '.' || k AS x, k || '.0' AS y, CASE WHEN nz > 1 THEN j || '.0' END AS z FROM e)
SELECT {HEAD}, {POINT}, '{{' || CASE WHEN part = 'txy' THEN '"t":"2020-01-0' || (k + 1) || '",' ELSE '' END || '"x":' || x || ',"y":' || y
|| CASE WHEN nt > 1 THEN ',"t":"2020-01-0' || (j + 1) || '"' WHEN nz > 1 THEN ',"z":' || z ELSE '' END || ',"v":' || '1' || doc_id || lpad((j * 3 + k)::VARCHAR, 2, '0') || '}}' AS properties FROM f""")
def features_composite(spark, sf_dir):
    return features.features(decode(of_kinds(spark, sf_dir, [_composite(*k) for k in COMPOSITE]))[0])[0]


@query(f"""WITH e AS (SELECT *, i // nt AS k, i % nt AS j, doc_id || '.0,' AS x FROM {_rows(AREAS)} v(n, kind, many, nt) ON doc_id % 4 = n, range(4) r(i) WHERE i < many * nt)
SELECT {HEAD}, '{{"type":"Polygon","coordinates":[[[' || x || k || '.0],[' || x || (k + 1) || '.0],[0.0,' || (k + 1) || '.0],[' || x || k || '.0]]]}}' AS geometry,
'{{' || CASE WHEN nt > 1 THEN '"t":"2020-01-0' || (j + 1) || '",' ELSE '' END || '"v":' || '1' || doc_id || lpad((j * many + k)::VARCHAR, 2, '0') || '}}' AS properties FROM e""")
def features_areas(spark, sf_dir):
    return features.features(decode(of_kinds(spark, sf_dir, [_areas(*k) for k in AREAS]))[0])[0]


#: A trajectory with an id and a point without one.
MIXED = f'{{"type":"CoverageCollection","coverages":[{_composite(*COMPOSITE[2]).replace('"domain":', '"id":"m%s","domain":')},{_plain(*PLAIN[0])}]}}'


@query("""SELECT doc_id, '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || (SELECT string_agg('[' || doc_id || '.' || k || ',' || k || '.0]', ',' ORDER BY k) FROM range(3) r(k))
|| ']},"properties":{"coverage":"m' || doc_id || '"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[' || doc_id || '.0,0.0]},"properties":{"coverage":1,"y":0.0,"x":' || doc_id || '.0,"v":' || '1' || doc_id || '00}}]}' AS collection FROM documents""")
def feature_collections(spark, sf_dir):
    """Collections as texts, trajectories as lines."""
    return features.collections(features.features(decode(of_kinds(spark, sf_dir, [MIXED]))[0], "lines")[0])


#: Coverages without features, and why.
BROKEN = [
    ('{"type":"Coverage","domain":"http://x/%s","ranges":{}}', "the domain is elsewhere"), (_plain(*PLAIN[0]).replace('"v":{', '"u":"http://x/%s","v":{'), "ranges elsewhere: u"),
    (_plain(*PLAIN[0]).replace("Point", "Polygon"), "no composite axis"), (_composite(*COMPOSITE[0]).replace("MultiPoint", "Polygon"), "the composite axis is not one of the kind polygon"),
    (_plain(*PLAIN[0]).replace('"y":{"start', '"k":{"start').replace('["x","y"]', '["x","k"]'), "no x and y"), (_areas(*AREAS[1]).replace('"t":{"values":', '"z":{"values":').replace('["t",', '["z",'), "polygons at several z"),
    (_plain(*PLAIN[3]), None),
]


@query(f"SELECT doc_id, '' AS path, error FROM {_rows([(e,) for _, e in BROKEN])} v(n, error) ON doc_id % {len(BROKEN)} = n WHERE error IS NOT NULL")
def features_quarantine(spark, sf_dir):
    return features.features(decode(of_kinds(spark, sf_dir, [b for b, _ in BROKEN]))[0])[1]
