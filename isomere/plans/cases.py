"""Small documents of all kinds with the findings they must give; @KEY@ stands for a row's key, so that documents differ."""

from __future__ import annotations

import json

CRS = {"coordinates": ["x", "y"], "system": {"type": "GeographicCRS", "id": "http://www.opengis.net/def/crs/OGC/1.3/CRS84"}}
TIME = {"coordinates": ["t"], "system": {"type": "TemporalRS", "calendar": "Gregorian"}}
NAMED = {"en": "a name"}
PARAMETER = {"type": "Parameter", "observedProperty": {"label": NAMED}}


def _values(*v):
    return {"values": list(v)}


def _domain(kind, axes, *refs):
    return {"type": "Domain", **({"domainType": kind} if kind else {}), "axes": axes, **({"referencing": list(refs)} if refs else {})}


def _array(shape, names, values, kind="float"):
    return {"type": "NdArray", "dataType": kind, "axisNames": names, "shape": shape, "values": values}


def _tiled(shape, names, *sets):
    return {"type": "TiledNdArray", "dataType": "float", "axisNames": names, "shape": shape, "tileSets": [{"tileShape": t, "urlTemplate": u} for t, u in sets]}


def _coverage(domain, ranges, **more):
    return {"type": "Coverage", "domain": domain, "parameters": {k: PARAMETER for k in ranges}, "ranges": ranges, **more}


KEY = "@KEY@"
POINT = {"x": _values(KEY), "y": _values(2)}
GRID = {"x": _values(1, 2), "y": _values(1, 2, KEY)}
SERIES = lambda *t: _domain("PointSeries", {**POINT, "t": _values(*t)}, CRS, TIME)
RING = [[0, 0], [1, 0], [1, 1], [0, 0.0]]

#: Each: the document, and its findings (code, pointer, detail), all rules on.
CASES: list[tuple[dict | list | str, list[tuple[str, str, str | None]]]] = [
    (_coverage(SERIES("2020-01-01", "2020-01-02"), {"p": _array([2], ["t"], [1, None])}), []),
    (_domain(None, POINT), [("domain.missing-domain-type", "/domainType", None), ("domain.missing-referencing", "/referencing", None)]),
    (_domain("Grid", {"x": _values(KEY)}, CRS), [("domain.missing-axis", "/axes/y", "y")]),
    (_domain("Point", {"x": _values(1, 2), "y": _values(KEY)}, CRS), [("domain.axis-not-single", "/axes/x", "x")]),
    (_domain("Trajectory", {"composite": {"dataType": "polygon", "coordinates": ["x", "y"], "values": [[RING]]}}, CRS), [("domain.composite-data-type", "/axes/composite", "tuple")]),
    (_domain("Trajectory", {"composite": {"dataType": "tuple", "coordinates": ["x", "y"], "values": [[KEY, 2]]}}, CRS), [("domain.composite-coordinates", "/axes/composite", "x,y")]),
    (_domain("Grid", {**GRID, "a/b~": _values(1, 2)}, CRS), [("domain.extra-axis-not-single", "/axes/a~1b~0", "a/b~")]),
    (_domain("Grid", {"x": _values(1, 3, 3, 2), "y": _values(KEY)}, CRS), [("axis.not-monotonic", "/axes/x/values/3", "3")]),
    (SERIES("2020-01-01T00:00:00Z", "2020-01-03T00:00:00Z", "2020-01-02T00:00:00Z"), [("axis.not-monotonic", "/axes/t/values/2", "2")]),
    (SERIES("2020-13", "+2020", "+002020", "2016-12-31T25:99:60Z"), [("temporal.lexical-form", "/axes/t/values/0", "2020-13"), ("temporal.lexical-form", "/axes/t/values/1", "+2020")]),
    (_domain("Trajectory", {"composite": {"dataType": "tuple", "coordinates": ["t", "x", "y"], "values": ["a", [1, 2], ["b", KEY, 3]]}}, CRS), [("axis.composite-value-shape", "/axes/composite/values/0", "tuple"), ("axis.composite-arity", "/axes/composite/values/1", "2")]),
    (_domain("MultiPolygon", {"composite": {"dataType": "polygon", "coordinates": ["x", "y"], "values": [KEY, [RING], []]}}, CRS), [("axis.composite-value-shape", "/axes/composite/values/0", "polygon"), ("axis.composite-value-shape", "/axes/composite/values/2", "polygon")]),
    (
        _domain("Polygon", {"composite": {"dataType": "polygon", "coordinates": ["x", "y"], "values": [[RING, [[0, 0], [1, KEY], [1, 1, 9]]]]}}, CRS),
        [("axis.polygon-position-arity", "/axes/composite/values/0/1/2", "3"), ("axis.polygon-ring-too-short", "/axes/composite/values/0/1", "3"), ("axis.polygon-ring-not-closed", "/axes/composite/values/0/1", None)],
    ),
    (_domain("Grid", {"x": {"values": [1, 2], "bounds": [0, 1, KEY]}, "y": _values(1)}, CRS), [("axis.bounds-length", "/axes/x/bounds", "3")]),
    (_domain("Grid", {"x": {"values": [1, KEY], "num": 2}, "y": {"start": 0, "stop": 5, "num": 6}}, CRS), [("axis.form-conflict", "/axes/x", "num")]),
    (_domain("Grid", {"x": {"values": [KEY], "coordinates": ["x"]}, "y": _values(1)}, CRS), [("axis.coordinates-not-omitted", "/axes/x/coordinates", "x")]),
    (
        _domain("Point", POINT, CRS, {"coordinates": ["t"], "system": {"type": "TemporalRS"}}, {"coordinates": ["i"], "system": {"type": "IdentifierRS"}}),
        [("temporal.missing-calendar", "/referencing/1/system/calendar", None), ("identifier.missing-target-concept", "/referencing/2/system/targetConcept", None)],
    ),
    (_array([2, 2], ["y"], [1, KEY, 3]), [("ndarray.shape-rank", "/shape", None), ("ndarray.value-count", "/values", "3")]),
    (_array([4], ["y"], [KEY, 1.5, "a", None], "integer"), [("range.value-type-mismatch", "/values/1", "1.5"), ("range.value-type-mismatch", "/values/2", "a")]),
    (
        _tiled([4, 4], ["y"], ([8, 2], "http://x/@KEY@/{y}"), ([None, 2], "http://x/{q}")),
        [("tiled-ndarray.shape-rank", "/shape", None), ("tiled-ndarray.tile-shape-too-large", "/tileSets/0/tileShape/0", "8")],
    ),
    (
        _tiled([4, 4], ["y", "x"], ([0, None], "http://x/@KEY@/{y}-{z}"), ([2, 2], "http://x/{y}")),
        [
            ("tiled-ndarray.tile-shape-not-positive", "/tileSets/0/tileShape/0", "0"), ("tiled-ndarray.url-template-unknown-variable", "/tileSets/0/urlTemplate", "z"),
            ("tiled-ndarray.url-template-missing-variable", "/tileSets/1/urlTemplate", "x"),
        ],
    ),
    ({"type": "Coverage", "domain": _domain("Point", POINT, CRS), "ranges": {"p": _array([], [], [KEY])}}, [("coverage.missing-parameters", "/parameters", None)]),
    (
        {**_coverage(_domain("Grid", GRID, CRS), {"p": _array([3, 2], ["y", "x"], [1, 2, 3, 4, 5, 6])}), "ranges": {"q": _array([2, 1], ["y", "z"], [KEY, 2])}},
        [("coverage.range-without-parameter", "/ranges/q", "q"), ("coverage.range-shape-mismatch", "/ranges/q/shape/0", "y"), ("coverage.range-axis-not-in-domain", "/ranges/q/axisNames/1", "z")],
    ),
    (
        {
            **_coverage(SERIES("2020", "2021", "2022", "2023"), {"p": _array([4], ["t"], [1, 9, None, 2.0])}),
            "parameters": {"p": {"type": "Parameter", "observedProperty": {"label": NAMED, "categories": [{"id": "c1", "label": NAMED}]}, "categoryEncoding": {"c1": [1, 2], "zz": 9}}},
        },
        [("parameter.category-encoding-unknown-id", "/parameters/p/categoryEncoding/zz", "zz"), ("range.invalid-category-code", "/ranges/p/values/1", "9"), ("range.invalid-category-code", "/ranges/p/values/3", "2.0")],
    ),
    (_coverage(_domain("Point", POINT, CRS), {"p": _array([], [], [KEY])}, parameterGroups=[{"type": "ParameterGroup", "label": NAMED, "members": ["p", "nope"]}]), [("parameter-group.unknown-member", "/parameterGroups/0", "nope")]),
    (
        {
            **_coverage(_domain("Point", POINT, CRS), {"p": _array([], [], [KEY])}),
            "parameters": {"p": {"type": "Parameter", "label": {}, "observedProperty": {"label": {"english!": "x", "de": "y"}, "categories": [{"id": "c", "label": NAMED, "description": {"a b": "z"}}]}}},
        },
        [("i18n.empty", "/parameters/p/label", None), ("i18n.invalid-language-tag", "/parameters/p/observedProperty/label/english!", "english!"), ("i18n.invalid-language-tag", "/parameters/p/observedProperty/categories/0/description/a b", "a b")],
    ),
    (
        {
            "type": "CoverageCollection", "domainType": "Point", "referencing": [CRS], "parameters": {"p": PARAMETER},
            "coverages": [
                {"type": "Coverage", "domainType": "Point", "domain": _domain(None, POINT), "ranges": {"p": _array([], [], [KEY])}},
                {"type": "Coverage", "domain": _domain("Grid", POINT), "ranges": {"p": _array([1], ["x"], [KEY, 2])}},
                {"type": "Coverage", "domain": _domain(None, {"x": _values(1)}), "ranges": {"p": "http://x/p"}},
                {"type": "Coverage", "domain": "http://x/domain", "ranges": {}},
            ],
        },
        [
            ("coverage.domain-type-not-omitted", "/coverages/0/domainType", "Point"), ("coverage.domain-type-conflict", "/coverages/1/domain/domainType", "Grid"),
            ("ndarray.value-count", "/coverages/1/ranges/p/values", "2"), ("domain.missing-axis", "/coverages/2/domain/axes/y", "y"),
        ],
    ),
    (
        _domain("Point", POINT, CRS, {"coordinates": ["i"], "system": {"type": "IdentifierRS", "label": {"?": "x"}, "targetConcept": {"label": {}}, "identifiers": {"k": {"label": {"e": "y"}}}}}),
        [("i18n.invalid-language-tag", "/referencing/1/system/label/?", "?"), ("i18n.empty", "/referencing/1/system/targetConcept/label", None), ("i18n.invalid-language-tag", "/referencing/1/system/identifiers/k/label/e", "e")],
    ),
    ("not JSON @KEY@", []),
    ({"type": "Feature", "id": KEY}, []),
]

WARNINGS = ("domain.missing-domain-type", "coverage.domain-type-not-omitted", "temporal.lexical-form")


def bodies() -> list[str]:
    return [b if isinstance(b, str) else json.dumps(b).replace(f'"{KEY}"', KEY) for b, _ in CASES]


def findings() -> list[tuple[int, str, str, str, str | None]]:
    """(case, code, severity, pointer, detail)."""
    return [(i, code, "warning" if code in WARNINGS else "error", at, detail) for i, (_, found) in enumerate(CASES) for code, at, detail in found]


def sql_values(rows: list[tuple]) -> str:
    """rows as the text of VALUES."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)
