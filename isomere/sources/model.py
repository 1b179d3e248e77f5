"""The members of every object in a coverage document, in one table that decoding and writing both read.

A document nests lists of objects of some sixteen types, so it is judged and written by walking its tree beside the table. That
walk is the one piece of Python here: it runs in tasks on Arrow batches of documents, one pass each, and what it says of a
document depends on that document alone. The same as column expressions is thousands of nested lambdas, which take minutes to
plan. Rules on decoded parts are expressions; see operators.conformance.

Members that the table doesn't name are ignored, and not written.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers get these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Array:
    of: object


@dataclass(frozen=True)
class Map:
    of: object


@dataclass(frozen=True)
class Either:
    """An object of one of these types, or a text."""

    types: tuple[str, ...]


@dataclass(frozen=True)
class Member:
    name: str
    kind: object
    required: bool = False
    #: Null stands for the member being left out.
    nullable: bool = False
    #: An empty list is the default.
    empty: bool = False


def _need(name: str, kind: object) -> Member:
    return Member(name, kind, required=True)


def _may(name: str, kind: object) -> Member:
    return Member(name, kind, nullable=True)


#: Fixed: members by type, in the order in which they are written; a present type member comes first.
TEXTS, REFERENCING = Map("string"), Array("Connection")
CONTEXT = Member("@context", "any")
LABELS = (_may("label", TEXTS), _may("description", TEXTS))
SHARED = (Member("domainType", "string"), Member("parameters", Map("Parameter")), Member("parameterGroups", Array("ParameterGroup")))
MODEL: dict[str, tuple[Member, ...]] = {
    "Coverage": (_need("domain", Either(("Domain",))), _need("ranges", Map(Either(("NdArray", "TiledNdArray")))), _may("id", "string"), *SHARED, CONTEXT),
    "CoverageCollection": (_need("coverages", Array("Coverage")), *SHARED, Member("referencing", REFERENCING, empty=True), CONTEXT),
    "Domain": (_need("axes", Map("Axis")), _may("domainType", "string"), Member("referencing", REFERENCING, empty=True), CONTEXT),
    "NdArray": (_need("dataType", "data type"), _need("values", Array("scalar")), Member("shape", Array("integer"), empty=True), Member("axisNames", Array("string"), empty=True), CONTEXT),
    "TiledNdArray": (_need("dataType", "data type"), _need("axisNames", Array("string")), _need("shape", Array("integer")), _need("tileSets", Array("TileSet")), CONTEXT),
    "TileSet": (_need("tileShape", Array("integer or null")), _need("urlTemplate", "string")),
    "Axis": (_may("values", Array("value")), _may("start", "number"), _may("stop", "number"), _may("num", "integer"), _may("dataType", "string"), _may("coordinates", Array("string")), _may("bounds", Array("bound"))),
    "Parameter": (_need("observedProperty", "ObservedProperty"), _may("id", "string"), *LABELS, _may("unit", "Unit"), _may("categoryEncoding", Map("codes"))),
    "ObservedProperty": (_need("label", TEXTS), _may("id", "string"), _may("description", TEXTS), _may("categories", Array("Category"))),
    "Category": (_need("id", "string"), _need("label", TEXTS), _may("description", TEXTS)),
    "Unit": (_may("id", "string"), _may("label", TEXTS), _may("symbol", Either(("Symbol",)))),
    "Symbol": (_need("value", "string"), _need("type", "string")),
    "ParameterGroup": (_need("members", Array("string")), _may("id", "string"), *LABELS, _may("observedProperty", "ObservedProperty")),
    "Connection": (_need("coordinates", Array("string")), _need("system", "System")),
    "System": (
        _need("type", "string"), _may("id", "string"), _may("description", TEXTS), _may("calendar", "string"), _may("timeScale", "string"), _may("targetConcept", "Concept"), _may("label", TEXTS),
        _may("identifiers", Map("Concept")),
    ),
    "Concept": (_need("label", TEXTS), _may("id", "string"), _may("description", TEXTS)),
}
#: Fixed: types that carry their name as a type member. Where several are possible, the member must be there.
TAGGED = ("Coverage", "CoverageCollection", "Domain", "NdArray", "TiledNdArray", "Parameter", "ParameterGroup")
DATA_TYPES = ("float", "integer", "string")


# Errors

#: Fixed: what plain values are called where they are of another kind.
SCALARS = {
    "string": "not a text", "number": "not a number", "integer": "not a whole number", "integer or null": "neither a whole number nor null", "scalar": "neither a number, a text nor null",
    "value": "neither a number, a text nor a list", "bound": "neither a number nor a text", "data type": "not a data type", "codes": "neither a whole number nor a list of such",
}


def _whole_number(x: object) -> bool:
    return type(x) is int


def _number(x: object) -> bool:
    return type(x) is int or type(x) is float


#: Fixed: the test of each plain kind.
PLAIN = {
    "string": lambda x: isinstance(x, str), "number": _number, "integer": _whole_number, "integer or null": lambda x: x is None or _whole_number(x), "scalar": lambda x: x is None or _number(x) or isinstance(x, str),
    "value": lambda x: _number(x) or isinstance(x, str | list), "bound": lambda x: _number(x) or isinstance(x, str), "data type": lambda x: isinstance(x, str) and x in DATA_TYPES,
    "codes": lambda x: _whole_number(x) or isinstance(x, list) and all(map(_whole_number, x)),
}


def _below(at: str, part: object) -> str:
    return f"{at}/{str(part).replace('~', '~0').replace('/', '~1')}"


#: Fixed: the types of which _whole() has rules.
WITH_RULES = ("Axis", "TiledNdArray", "Unit", "ObservedProperty", "Parameter", "ParameterGroup")


def _whole(kind: str, o: dict) -> str | None:
    """What is wrong with an object whose members are right each; the first rule broken."""
    if kind not in WITH_RULES:
        return None
    get, size = o.get, lambda m: len(o.get(m) or ())
    rules: list[tuple[bool, str]] = []
    if kind == "Axis":
        values, regular, composite = get("values"), all(get(m) is not None for m in ("start", "stop", "num")), get("dataType") in ("tuple", "polygon")
        rules = [
            (values is None and not regular, "neither values nor a whole regular form"), (values == [], "no values"), (values is None and regular and o["num"] < 1, "num below 1"),
            (values is None and regular and o["num"] == 1 and o["start"] != o["stop"], "one value with start other than stop"),
            (composite and (values is None or get("coordinates") is None), "a composite axis needs values and coordinates"), (get("coordinates") == [], "no coordinates"),
            (get("dataType") == "polygon" and size("coordinates") < 2, "polygons need two coordinates"),
        ]
    elif kind == "TiledNdArray":
        rules = [
            (not o["shape"], "no shape"), (not o["tileSets"], "no tile sets"),
            (any(len(t["tileShape"]) != len(o["shape"]) for t in o["tileSets"]), "a tile set of another rank"),
        ]
    elif kind == "Unit":
        rules = [(get("label") is None and get("symbol") is None, "a unit needs a label or a symbol")]
    elif kind == "ObservedProperty":
        rules = [(get("categories") == [], "no categories")]
    elif kind == "Parameter":
        categories = o["observedProperty"].get("categories")
        rules = [
            (categories is not None and get("unit") is not None, "categories with a unit"),
            (categories is None and get("categoryEncoding") is not None, "an encoding without categories"),
        ]
    elif kind == "ParameterGroup":
        rules = [(not o["members"], "no members"), (get("label") is None and get("observedProperty") is None, "a group needs a label or an observed property")]
    return next((reason for wrong, reason in rules if wrong), None)


#: MODEL for judging: name, required, nullable, kind and, of a plain kind, its test.
TESTED = {k: tuple((m.name, m.required, m.nullable, m.kind, PLAIN.get(m.kind) if isinstance(m.kind, str) else None) for m in members) for k, members in MODEL.items()}


def _first(x: object, kind: object) -> tuple[tuple, str] | None:
    """first_error with the parts of the pointer, which only a document with an error needs."""
    if isinstance(kind, str):
        if test := PLAIN.get(kind):
            return None if test(x) else ((), SCALARS[kind])
        if kind == "any":
            return None
        if not isinstance(x, dict):
            return (), "not an object"
        if kind in TAGGED and x.get("type", kind) != kind:
            return ("type",), "another type"
        for name, required, nullable, of, test in TESTED[kind]:
            if name not in x:
                if required:
                    return (name,), "missing"
                continue
            v = x[name]
            if test(v) if test else v is None and nullable:
                continue
            if not (nullable and v is None) and (e := _first(v, of)):
                return (name, *e[0]), e[1]
        reason = _whole(kind, x)
        return reason and ((), reason)
    if isinstance(kind, Either):
        if isinstance(x, str):
            return None
        if not isinstance(x, dict):
            return (), "neither an object nor a text"
        if len(kind.types) > 1 and x.get("type") not in kind.types:
            return ("type",), "another type" if "type" in x else "missing"
        return _first(x, kind.types[0] if len(kind.types) == 1 else x["type"])
    if not isinstance(x, list if isinstance(kind, Array) else dict):
        return (), "not a list" if isinstance(kind, Array) else "not an object"
    if (test := isinstance(kind.of, str) and PLAIN.get(kind.of)) and all(map(test, x if isinstance(kind, Array) else x.values())):
        return None
    for k, v in enumerate(x) if isinstance(kind, Array) else x.items():
        if e := _first(v, kind.of):
            return (k, *e[0]), e[1]
    return None


def first_error(x: object, kind: object, at: str = "") -> tuple[str, str] | None:
    """(pointer, reason) of the first thing, in the table's order, that keeps x from being of that kind."""
    if e := _first(x, kind):
        for part in e[0]:
            at = _below(at, part)
        return at, e[1]
    return None


# Writing


def canonical(x: object, kind: object) -> object:
    """x with its members in the table's order, without defaults; numbers that are decimal by kind as such."""
    if isinstance(kind, Array):
        return [canonical(v, kind.of) for v in x]
    if isinstance(kind, Map):
        return {k: canonical(v, kind.of) for k, v in x.items()}
    if isinstance(kind, Either):
        return x if isinstance(x, str) else canonical(x, x["type"] if len(kind.types) > 1 else kind.types[0])
    if kind in ("number", "bound") and type(x) is int:
        return float(x)
    if kind not in MODEL:
        return x
    out = {"type": kind} if kind in TAGGED else {}
    for m in MODEL[kind]:
        if m.name in x and not (m.nullable and x[m.name] is None) and not (m.empty and not x[m.name]):
            out[m.name] = canonical(x[m.name], m.kind)
    return out


# On columns


def _loaded(body: str | None) -> object:
    def refuse(name: str) -> None:
        raise ValueError(name)  # NaN and infinities are not JSON

    return json.loads(body, parse_constant=refuse)


def _judged(roots: tuple[str, ...]):
    def judge(body: str | None) -> tuple[str, str] | None:
        try:
            x = _loaded(body)
        except (ValueError, TypeError, RecursionError):
            return "", "not JSON"
        if not isinstance(x, dict):
            return "", "not an object"
        kind = x.get("type")
        if not isinstance(kind, str):
            return "", "no type"
        return first_error(x, kind) if kind in roots else ("", f"unexpected type {kind}")

    return judge


def structure_error(body: Column, roots: tuple[str, ...]) -> Column:
    """struct(at, reason) of what keeps a text from being a document of one of these roots, else null."""
    judge = _judged(roots)

    @F.arrow_udf("struct<at:string,reason:string>")
    def errors(bodies: pa.Array, missing: pa.Array) -> pa.Array:
        found = [judge(None if m else b) for b, m in zip(bodies.to_pylist(), missing.to_pylist(), strict=True)]
        return pa.array([e and {"at": e[0], "reason": e[1]} for e in found], pa.struct([("at", pa.string()), ("reason", pa.string())]))

    # Not deterministic: evaluated where it stands, once a row, and never moved into other filters. A text used twice stays a
    # column of its own: calls whose argument is a large expression are not handed to Python by this engine.
    return errors.asNondeterministic()(body, body.isNull())


def canonical_text(body: Column) -> Column:
    """The canonical text of a document that has no structural error."""

    @F.arrow_udf("string")
    def texts(bodies: pa.Array) -> pa.Array:
        each = ((x, x["type"]) for x in (_loaded(b.as_py()) for b in bodies))
        return pa.array([json.dumps(canonical(x, kind), ensure_ascii=False, separators=(",", ":")) for x, kind in each], pa.string())

    return texts.asNondeterministic()(body)


# Variants


def sub(v: Column, name: str, kind: str = "variant") -> Column:
    """A member of an object; null if it is absent or of another kind."""
    return F.try_variant_get(v, f"$['{name}']", kind)


def listed(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def mapped(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def is_integer(v: Column) -> Column:
    """Written without a point or exponent; 2.0 has a short decimal type without decimals."""
    return F.regexp_like(F.schema_of_variant(v), F.lit(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$"))


def is_number(v: Column) -> Column:
    return F.regexp_like(F.schema_of_variant(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
