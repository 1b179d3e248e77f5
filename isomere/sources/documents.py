"""Coverage documents: decoding JSON text into normalized tables, with a quarantine of broken ones, and encoding.

A document is never parsed into one wide type, since its arrays mix numbers and texts. Member maps keep the order and the
raw text of their values, and only typed parts (shapes, names, numbers) are parsed further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isomere.functions.arrays import finite_or_null
from isomere.functions.text import MEDIA_TYPE, is_media_type, media_type
from isomere.sources import model

ROOTS = ("Coverage", "CoverageCollection", "Domain", "NdArray", "TiledNdArray")
MEMBERS = "map<string,string>"
AXIS = "struct<values:array<variant>,start:double,stop:double,num:int,dataType:string,coordinates:array<string>,bounds:array<variant>>"
NDARRAY = "struct<dataType:string,shape:array<int>,axisNames:array<string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, body) of the files of a folder, one document a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("body"))


def members(text: Column) -> Column:
    return F.from_json(text, MEMBERS)


def is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("{")), F.lit(False))


def decode(documents: DataFrame, *types: str) -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantine) of (doc_id, body): decoded has type and members; quarantine has error and at. types: those accepted.

    Each document is judged alone: that it is an object of an accepted type, and that all its objects have the members and
    kinds that model.MODEL names. at: the pointer to the first thing wrong.
    """
    rows = documents.withColumn("_found", model.structure_error(F.col("body"), types or ROOTS))
    bad = rows.filter("_found is not null").select("doc_id", F.col("_found.reason").alias("error"), "_found.at")
    good = rows.filter("_found is null").drop("_found").withColumn("members", members("body"))
    return good.withColumn("type", F.try_element_at("members", F.lit("type"))), bad


def encode(decoded: DataFrame) -> DataFrame:
    """decoded with `body` in canonical form: members in the order of model.MODEL, without defaults and unknown members."""
    return decoded.withColumn("body", model.canonical_text(F.col("body")))


def encode_response(decoded: DataFrame, *profiles: str) -> DataFrame:
    """(doc_id, body, content_type) of decoded documents, as responses carry them."""
    return encode(decoded).select("doc_id", "body", F.lit(media_type(*profiles)).alias("content_type"))


def decode_response(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As decode for (doc_id, body, content_type); a wrong content type is an error, a null one is not checked."""
    right = F.col("content_type").isNull() | is_media_type(F.col("content_type"))
    good, bad = decode(responses.filter(right))
    wrong = responses.filter(~right).select("doc_id", F.concat(F.lit("content type is not "), F.lit(MEDIA_TYPE)).alias("error"), F.lit("").alias("at"))
    return good, bad.unionByName(wrong)


def coverages(decoded: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, own, shared): each coverage's members and those of its collection, null for a single coverage."""
    none = F.lit(None).cast(MEMBERS)
    single = F.array(F.struct(F.lit(0).alias("cov_idx"), F.col("members").alias("own"), none.alias("shared")))
    listed = F.from_json(F.col("members")["coverages"], "array<string>")
    many = F.transform(listed, lambda one, i: F.struct(i.alias("cov_idx"), members(one).alias("own"), F.col("members").alias("shared")))
    # One pass: documents are judged as they are read, so two would judge them twice.
    return decoded.select("doc_id", F.inline(F.when(F.col("type") == "Coverage", single).when(F.col("type") == "CoverageCollection", many)))


def effective(covs: DataFrame) -> DataFrame:
    """Coverages with domain, ranges, parameters, groups, referencing and domain types as texts, inheritance applied.

    A member that is present on the coverage, even if empty, is not inherited; referencing reaches only an inline domain
    that has none.
    """
    own, shared = F.col("own"), F.col("shared")
    has = lambda k: F.map_contains_key(own, k)
    take = lambda k: F.when(has(k), own[k]).otherwise(F.try_element_at(shared, F.lit(k)))
    domain = F.try_element_at(own, F.lit("domain"))
    inner = members(F.when(is_object(domain), domain))
    refs = F.try_element_at(inner, F.lit("referencing"))
    no_refs = refs.isNull() | (F.regexp_replace(F.coalesce(refs, F.lit("")), r"\s", "") == "[]")
    return covs.select(
        "doc_id", "cov_idx", F.try_element_at(own, F.lit("id")).alias("id"), domain.alias("domain"), F.try_element_at(own, F.lit("ranges")).alias("ranges"),
        take("parameters").alias("parameters"), take("parameterGroups").alias("groups"), F.try_element_at(own, F.lit("domainType")).alias("own_type"),
        F.try_element_at(inner, F.lit("domainType")).alias("inner_type"), F.try_element_at(shared, F.lit("domainType")).alias("shared_type"), has("domainType").alias("has_type"),
        F.when(is_object(domain) & no_refs, F.coalesce(F.try_element_at(shared, F.lit("referencing")), refs)).otherwise(refs).alias("referencing"),
    )


def axes(effective_: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, axis_ord, name, axis) of all inline domains, in document order."""
    inline = effective_.filter(is_object(F.col("domain")))
    of = F.map_entries(F.from_json(members("domain")["axes"], MEMBERS))
    rows = inline.select("doc_id", "cov_idx", F.posexplode(of).alias("axis_ord", "e"))
    return rows.select("doc_id", "cov_idx", "axis_ord", F.col("e.key").alias("name"), F.from_json("e.value", AXIS).alias("axis"))


def ranges(effective_: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, range_ord, key, kind, body, array): kind is NdArray, TiledNdArray or url; raw values stay in body."""
    of = F.map_entries(F.from_json("ranges", MEMBERS))
    rows = effective_.select("doc_id", "cov_idx", F.posexplode(of).alias("range_ord", "e"))
    inline = is_object(F.col("e.value"))
    kind = F.when(inline, F.get_json_object("e.value", "$.type")).otherwise("url")
    return rows.select("doc_id", "cov_idx", "range_ord", F.col("e.key").alias("key"), kind.alias("kind"), F.col("e.value").alias("body"), F.when(inline, F.from_json("e.value", NDARRAY)).alias("array"))


def values(ranges_: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, key, flat_idx, token, class): each value's text as written and its class.

    class: null, string, boolean, integer or float, as written: 1.0 is a float.
    """
    raw = F.from_json(F.get_json_object("body", "$"), "struct<values:array<string>>")["values"]
    typed = F.from_json("body", "struct<values:array<variant>>")["values"]
    both = F.arrays_zip(raw.alias("token"), typed.alias("v"))
    rows = ranges_.filter("kind = 'NdArray'").select("doc_id", "cov_idx", "key", F.posexplode(both).alias("flat_idx", "x"))
    kind = F.schema_of_variant(F.col("x.v"))
    written = (
        F.when(F.col("x.v").isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(F.regexp_like("x.token", F.lit("[.eE]")), "float").otherwise("integer")
    )
    return rows.select("doc_id", "cov_idx", "key", "flat_idx", F.col("x.token").alias("token"), written.alias("class"))


def parameters(effective_: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, param_ord, key, body) in document order."""
    rows = effective_.select("doc_id", "cov_idx", F.posexplode(F.map_entries(F.from_json("parameters", MEMBERS))).alias("param_ord", "e"))
    return rows.select("doc_id", "cov_idx", "param_ord", F.col("e.key").alias("key"), F.col("e.value").alias("body"))


def referencing(effective_: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, conn_idx, coordinates, kind, id, calendar, target) of each reference system connection."""
    schema = "array<struct<coordinates:array<string>,system:struct<type:string,id:string,calendar:string,targetConcept:string>>>"
    rows = effective_.select("doc_id", "cov_idx", F.posexplode(F.from_json("referencing", schema)).alias("conn_idx", "c"))
    return rows.select("doc_id", "cov_idx", "conn_idx", "c.coordinates", F.col("c.system.type").alias("kind"), "c.system.id", "c.system.calendar", F.col("c.system.targetConcept").alias("target"))


def encode_ndarray(data_type: str, shape: Column, axis_names: Column, values_: Column) -> Column:
    """The text of an inline array: the type first, members in order, missing values as null, defaults left out."""
    clean = F.transform(values_, lambda v: finite_or_null(v)) if data_type == "float" else values_
    numbers = F.transform(clean, lambda v: F.coalesce(F.to_json(F.array(v)), F.lit("[null]")))
    inner = F.array_join(F.transform(numbers, lambda s: F.substring(s, F.lit(2), F.char_length(s) - 2)), ",")
    head = F.concat(F.lit(f'{{"type":"NdArray","dataType":"{data_type}"'))
    rank = F.when(F.size(shape) > 0, F.concat(F.lit(',"axisNames":'), F.to_json(axis_names), F.lit(',"shape":'), F.to_json(shape))).otherwise("")
    return F.concat(head, rank, F.lit(',"values":['), inner, F.lit("]}"))


def write_documents(documents: DataFrame, path: str) -> None:
    """The bodies of (.., body) as text, one document a line."""
    documents.select("body").write.text(path)
