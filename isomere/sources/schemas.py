"""JSON Schema components of the document types, for API descriptions, made from Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

PREFIX = "CoverageJSON."
MAP = T.MapType(T.StringType(), T.StringType())

TYPES = {
    "Coverage": {"domain": MAP, "ranges": MAP, "id": T.StringType(), "domainType": T.StringType(), "parameters": MAP, "parameterGroups": T.ArrayType(MAP)},
    "CoverageCollection": {"coverages": T.ArrayType(MAP), "domainType": T.StringType(), "parameters": MAP, "parameterGroups": T.ArrayType(MAP), "referencing": T.ArrayType(MAP)},
    "Domain": {"axes": MAP, "domainType": T.StringType(), "referencing": T.ArrayType(MAP)},
    "NdArray": {"dataType": T.StringType(), "values": T.ArrayType(T.VariantType()), "shape": T.ArrayType(T.IntegerType()), "axisNames": T.ArrayType(T.StringType())},
    "TiledNdArray": {"dataType": T.StringType(), "axisNames": T.ArrayType(T.StringType()), "shape": T.ArrayType(T.IntegerType()), "tileSets": T.ArrayType(MAP)},
}
REQUIRED = {"Coverage": ["domain", "ranges"], "CoverageCollection": ["coverages"], "Domain": ["axes"], "NdArray": ["dataType", "values"], "TiledNdArray": ["dataType", "axisNames", "shape", "tileSets"]}


def _schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object"}
    if isinstance(kind, T.StringType):
        return {"type": "string"}
    return {"type": "integer"} if isinstance(kind, T.IntegerType) else {"type": ["number", "string", "null"]}


def component_schemas() -> dict[str, dict]:
    return {
        PREFIX + name: {"type": "object", "properties": {"type": {"const": name}} | {k: _schema(v) for k, v in members.items()}, "required": ["type", *REQUIRED[name]]}
        for name, members in TYPES.items()
    }


def schema_ref(name: str) -> dict[str, str]:
    return {"$ref": f"#/components/schemas/{PREFIX}{name}"}
