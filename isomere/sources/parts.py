"""The typed parts of decoded documents: one row a coverage, or a document that is a domain or an array, made in one pass.

Findings and cards read these rows. All that a rule needs of its coverage stands in the row, so no rule joins or sorts:
repeated documents are rows of their own, and nothing meets by document ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions import axes as ax
from isomere.functions.text import json_pointer
from isomere.sources.model import listed, mapped, present, sub


def units(decoded: DataFrame) -> DataFrame:
    """(doc_id, path, kind, own, text, shared): each coverage with its collection's object, and documents of other roots.

    path: the pointer to it. own: the object as a variant, text: as written. shared: null for what is in no collection.
    """
    v = F.try_parse_json("body")
    none = F.lit(None).cast("variant")
    alone = F.array(F.struct(F.lit("").alias("path"), F.col("type").alias("kind"), v.alias("own"), F.col("body").alias("text"), none.alias("shared")))
    texts = F.from_json(F.try_element_at("members", F.lit("coverages")), "array<string>")
    both = F.arrays_zip(sub(v, "coverages", "array<variant>").alias("own"), texts.alias("text"))
    many = F.transform(
        both, lambda x, i: F.struct(json_pointer(F.lit("coverages"), i).alias("path"), F.lit("Coverage").alias("kind"), x["own"].alias("own"), x["text"].alias("text"), v.alias("shared"))
    )
    return decoded.select("doc_id", F.inline(F.when(F.col("type") == "CoverageCollection", many).otherwise(alone)))


def _text(v: Column, name: str) -> Column:
    """A member's text; null where it is empty."""
    return F.nullif(sub(v, name, "string"), F.lit(""))


def _filled(v: Column) -> Column:
    return F.when(F.size(v) > 0, v)


def parts(decoded: DataFrame) -> DataFrame:
    """units() with their parts, inheritance applied.

    domain_at: the pointer to an inline domain, else null; domain_type; referencing: array of connections. axes: array of
    (name, axis, values, size, data_type, coordinates). ranges: map of objects and URLs. arrays, tiled: arrays of (key, path,
    array, text). parameters: map, null where there are none to know; groups. own_type, inner_type, shared_type: the domain
    types as written.
    """
    rows = units(decoded)
    is_cov = F.col("kind") == "Coverage"
    rows = rows.withColumn("domain", F.when(is_cov, sub(F.col("own"), "domain")).when(F.col("kind") == "Domain", F.col("own")))
    rows = rows.withColumn("domain", F.when(mapped(F.col("domain")).isNotNull(), F.col("domain")))
    own, shared, domain = F.col("own"), F.col("shared"), F.col("domain")
    inherited = lambda name, kind: F.when(is_cov, F.when(sub(own, name).isNotNull(), sub(own, name, kind)).otherwise(sub(shared, name, kind)))
    names = lambda a: F.coalesce(sub(a, "coordinates", "array<string>"))

    def axis(e: Column) -> Column:
        a = e["value"]
        values = F.when(present(sub(a, "values")), sub(a, "values", "array<variant>"))
        return F.struct(
            e["key"].alias("name"), a.alias("axis"), values.alias("values"), ax.length(values, sub(a, "num", "int")).alias("size"), sub(a, "dataType", "string").alias("data_type"),
            F.coalesce(names(a), F.array(e["key"])).alias("coordinates"),
        )

    rows = rows.select(
        "doc_id", "path", "kind", "own", "text", shared.isNotNull().alias("many"), "domain",
        F.when(domain.isNotNull(), F.concat("path", F.when(is_cov, "/domain").otherwise(""))).alias("domain_at"),
        F.coalesce(_text(domain, "domainType"), F.when(is_cov, F.coalesce(_text(own, "domainType"), _text(shared, "domainType")))).alias("domain_type"),
        F.coalesce(_filled(sub(domain, "referencing", "array<variant>")), F.when(domain.isNotNull(), _filled(sub(shared, "referencing", "array<variant>")))).alias("referencing"),
        F.transform(F.map_entries(sub(domain, "axes", "map<string,variant>")), axis).alias("axes"),
        F.when(is_cov, sub(own, "ranges", "map<string,variant>")).alias("ranges"), inherited("parameters", "map<string,variant>").alias("parameters"), inherited("parameterGroups", "array<variant>").alias("groups"),
        F.when(is_cov, sub(own, "domainType", "string")).alias("own_type"), F.when(is_cov, sub(domain, "domainType", "string")).alias("inner_type"), sub(shared, "domainType", "string").alias("shared_type"),
    )
    texts = F.from_json(F.get_json_object("text", "$.ranges"), "map<string,string>")

    def of(kind: str) -> Column:
        held = F.filter(F.map_entries("ranges"), lambda e: F.coalesce(sub(e["value"], "type", "string") == kind, F.lit(False)))
        inner = F.transform(held, lambda e: F.struct(e["key"].alias("key"), F.concat("path", json_pointer(F.lit("ranges"), e["key"])).alias("path"), e["value"].alias("array")))
        alone = F.array(F.struct(F.lit("").alias("key"), F.col("path").alias("path"), F.col("own").alias("array")))
        return F.when(F.col("kind") == kind, alone).when(F.col("kind") == "Coverage", inner)

    texts = F.when(F.col("kind") == "Coverage", texts).otherwise(F.create_map(F.lit(""), F.col("text")))
    return rows.select("*", of("NdArray").alias("arrays"), of("TiledNdArray").alias("tiled"), texts.alias("range_texts"))


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with these columns, each computed once: what follows reads values, and no filter takes their expressions below."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def entries(objects: Column) -> Column:
    """A map's entries, none for null."""
    return F.coalesce(F.map_entries(objects), F.array().cast("array<struct<key:string,value:variant>>"))


def items(v: Column) -> Column:
    """The items of a list, none for anything else."""
    return F.coalesce(listed(v), F.array().cast("array<variant>"))
