"""What documents refer to by URL: sites in document order, their resolution, documents put together again, tiled arrays.

Fetched documents are a table (url, body), so all are met by joins on the URL; failures are rows. A site whose document is
missing fails as transient, one whose document can't be decoded or is of another type as unrecoverable, and then keeps its
URL. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isomere.functions.arrays import expand_template, strides, tile_count
from isomere.functions.text import member_texts, object_text
from isomere.operators import tiles
from isomere.sources import documents as docs
from isomere.sources.fetch import Fetch
from isomere.sources.fetch import fetched as fetch_urls
from isomere.sources.stored import stored

TILED = "struct<dataType:string,shape:array<int>,axisNames:array<string>,tileSets:array<struct<tileShape:array<int>,urlTemplate:string>>>"


def reference_sites(decoded: DataFrame) -> DataFrame:
    """(doc_id, cov_idx, slot_ord, slot, url): URLs in place of domains (slot null, the first) and ranges (slot their key)."""
    covs = docs.coverages(decoded).select("doc_id", "cov_idx", "own")
    domain = F.try_element_at("own", F.lit("domain"))
    of_domain = F.when(domain.isNotNull() & ~docs.is_object(domain), F.array(F.struct(F.lit(-1).alias("slot_ord"), F.lit(None).cast("string").alias("slot"), domain.alias("url"))))
    entries = F.map_entries(F.from_json(F.try_element_at("own", F.lit("ranges")), docs.MEMBERS))
    ranges = F.transform(entries, lambda e, i: F.struct(i.alias("slot_ord"), e["key"].alias("slot"), e["value"].alias("url")))
    of_ranges = F.filter(ranges, lambda r: r["url"].isNotNull() & ~docs.is_object(r["url"]))
    none = F.array().cast("array<struct<slot_ord:int,slot:string,url:string>>")
    return covs.select("doc_id", "cov_idx", F.inline(F.concat(F.coalesce(of_domain, none), F.coalesce(of_ranges, none))))


#: What a document must be where a domain or a range stands.
WANTED = {True: ("Domain",), False: ("NdArray", "TiledNdArray")}


def judged(documents: DataFrame) -> DataFrame:
    """(url, kind, message, lost) of documents (url, body): kind where the body decodes, else what is wrong with it.

    Documents may come with error and transient, as sources.fetch gives them. The body itself is not in the result.
    """
    failed = F.col("error").isNotNull() if "error" in documents.columns else F.lit(False)
    wrong = docs.model.structure_error(F.col("body"), docs.ROOTS)
    rows = documents.withColumn("_wrong", F.when(~failed, wrong))
    reason = F.concat(F.col("_wrong.reason"), F.when(F.col("_wrong.at") != "", F.concat(F.lit(" at "), F.col("_wrong.at"))).otherwise(""))
    error = F.when(failed, F.col("error")).otherwise(reason) if "error" in documents.columns else reason
    lost = F.coalesce(F.col("transient"), F.lit(False)) if "transient" in documents.columns else F.lit(False)
    return rows.select("url", F.when(error.isNull(), F.get_json_object("body", "$.type")).alias("kind"), error.alias("message"), lost.alias("lost"))


def fetched(sites: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, failures) of reference_sites() against documents (url, body).

    resolved: the sites that have a body. failures: the others with kind, message, and slot `domain` for that of a domain.

    A document is decoded once, however many sites refer to it, and its body comes last, to the sites that get it. Sites are
    written once to the shared checkpoint folder, as four steps read them.
    """
    sites = stored(sites)
    asked = sites.groupBy("url").agg(F.count("*").alias("_n"))
    found = asked.join(judged(documents), "url", "left").withColumn("there", F.col("kind").isNotNull() | F.col("message").isNotNull())
    met = _join_counted(sites, found)
    is_domain = F.col("slot").isNull()
    wanted = F.when(is_domain, F.col("kind").isin(*WANTED[True])).otherwise(F.col("kind").isin(*WANTED[False]))
    good = F.coalesce(wanted, F.lit(False))
    message = F.when(~F.col("there"), "no document").when(F.col("message").isNotNull(), F.col("message")).otherwise(F.concat(F.lit("unexpected type "), F.col("kind")))
    transient = ~F.col("there") | F.col("lost")
    failures = met.filter(~good).select(
        "doc_id", "cov_idx", "slot_ord", F.coalesce("slot", F.lit("domain")).alias("slot"), "url", F.when(F.coalesce(transient, F.lit(True)), "transient").otherwise("unrecoverable").alias("kind"), message.alias("message")
    )
    bodies = documents.select("url", "body").join(asked, "url")
    return _join_counted(met.filter(good).select("doc_id", "cov_idx", "slot_ord", "slot", "url"), bodies).drop("_n"), failures


#: A URL is hot from this many sites on, and from this share of all sites on; so at most 1 / HOT_SHARE are hot.
HOT_SITES, HOT_SHARE = 10_000, 0.001


def _join_counted(sites: DataFrame, by_url: DataFrame) -> DataFrame:
    """sites joined to by_url, one row a URL with the number of its sites in _n; hot URLs are spread over several tasks.

    The sites of a hot URL get a number below its spread, and its one row is repeated for each of these. Hot URLs are few, so
    their spreads are broadcast.
    """
    limit = F.greatest(F.lit(HOT_SITES), sites.select(F.count("*").alias("n")).scalar() * HOT_SHARE)
    spread = lambda n: F.greatest(F.lit(1), F.ceil(n / limit)).cast("int")
    hot = sites.groupBy("url").agg(F.count("*").alias("_m")).filter(F.col("_m") > limit).select("url", spread(F.col("_m")).alias("_spread"))
    salted = sites.join(F.broadcast(hot), "url", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "cov_idx", "slot_ord"), F.coalesce("_spread", F.lit(1))).cast("int")).drop("_spread")
    repeated = by_url.withColumn("_salt", F.explode(F.sequence(F.lit(0), spread(F.col("_n")) - 1)))
    return salted.join(repeated, ["url", "_salt"]).drop("_salt")


def rebuilt(decoded: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, body) of coverages and collections, with the resolved bodies in place of their URLs; the rest as written."""
    many = F.col("type") == "CoverageCollection"
    own = decoded.filter(F.col("type").isin("Coverage", "CoverageCollection")).select("doc_id", "body", many.alias("many"))
    lists = F.when(F.col("many"), F.from_json(docs.members("body")["coverages"], "array<string>")).otherwise(F.array("body"))
    covs = own.select("doc_id", "many", F.posexplode(lists).alias("cov_idx", "cov"))
    by = resolved.groupBy("doc_id", "cov_idx").agg(
        F.max(F.when(F.col("slot").isNull(), F.col("body"))).alias("domain"),
        F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "body")))).alias("ranges"),  # those of one coverage
    )
    covs = covs.join(by, ["doc_id", "cov_idx"], "left").withColumn("texts", member_texts("cov"))
    ranges = F.transform_values(member_texts(F.col("texts")["ranges"]), lambda k, v: F.coalesce(F.try_element_at("ranges", k), v))
    texts = F.transform_values(
        "texts", lambda k, v: F.when((k == "domain") & F.col("domain").isNotNull(), F.col("domain")).when((k == "ranges") & (F.size("ranges") > 0), object_text(ranges)).otherwise(v)
    )
    covs = covs.select("doc_id", "cov_idx", object_text(texts).alias("text"))
    listed = covs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cov_idx", "text"))), lambda x: x["text"]).alias("covs"))  # those of one document
    whole = own.join(listed, "doc_id", "left").withColumn("outer", member_texts("body"))
    inner = F.concat(F.lit("["), F.array_join(F.coalesce("covs", F.array().cast("array<string>")), ","), F.lit("]"))
    outer = F.transform_values("outer", lambda k, v: F.when(k == "coverages", inner).otherwise(v))
    return whole.select("doc_id", F.when(F.col("many"), object_text(outer)).otherwise(F.get("covs", F.lit(0))).alias("body"))


def resolve_references(decoded: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with what they refer to, failures) of decoded documents against documents (url, body)."""
    resolved, failures = fetched(reference_sites(decoded), documents)
    return rebuilt(decoded, resolved), failures


def resolve_with(decoded: DataFrame, fetch: Fetch, **options) -> tuple[DataFrame, DataFrame]:
    """As resolve_references(), with the documents that a user's function gives; options: as sources.fetch.fetched()."""
    return resolve_references(decoded, fetch_urls(reference_sites(decoded), fetch, **options))


def assemble_with(arrays: DataFrame, fetch: Fetch, keys: Sequence[str], tileset: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """As assemble(), with the tiles that a user's function gives; failed calls are failures of their tiles."""
    came = fetch_urls(tile_layout(arrays, keys, tileset), fetch, **options)
    cells, failures = assemble(arrays, came.filter("error is null"), keys, tileset)
    told = came.filter("error is not null").select("url", F.col("error").alias("_error"), F.col("transient").alias("_transient"))
    joined = failures.join(told, "url", "left").withColumn("kind", F.when(F.col("_error").isNull(), F.col("kind")).when(F.col("_transient"), "transient").otherwise("unrecoverable"))
    return cells, joined.withColumn("message", F.col("_error")).drop("_error", "_transient")


#: Arrays and tiles that one task sorts. Their texts are alike and shuffle to a tenth of their size or less, so that Spark,
#: which goes by these bytes, would give a few tasks all of them.
ARRAYS_A_TASK, TILES_A_TASK = 20_000, 50_000


def _tasks(arrays: DataFrame, tileset: int | None) -> tuple[int, int]:
    """Over how many tasks arrays and their tiles go, as many as there are cores at least."""
    a = F.from_json("body", TILED)
    counts = F.transform(a["tileSets"], lambda t: tile_count(a["shape"], t["tileShape"]))
    n, tiles_ = arrays.agg(F.count("*"), F.coalesce(F.sum(F.array_min(counts) if tileset is None else F.get(counts, F.lit(tileset))), F.lit(0))).head()
    cores = arrays.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-n // ARRAYS_A_TASK)), max(cores, -(-int(tiles_) // TILES_A_TASK))


def tile_layout(arrays: DataFrame, keys: Sequence[str], tileset: int | None = None, parts: int | None = None) -> DataFrame:
    """A row a tile of arrays (keys, body of a TiledNdArray): keys, data_type, axis_names, shape, url, ordinals, offsets.

    tileset: the number of the tile set taken; without it that with fewest tiles. An array without that set has no tiles.
    parts: over how many tasks arrays are dealt for that choice; without it Spark settles that by the bytes it shuffles.
    """
    a = arrays.select(*keys, F.from_json("body", TILED).alias("a"))
    whole = a.select(*keys, F.col("a.dataType").alias("data_type"), F.col("a.axisNames").alias("axis_names"), F.col("a.shape").alias("shape"), F.posexplode("a.tileSets").alias("pos", "t"))
    sets = whole.select(*keys, "data_type", "axis_names", "shape", "pos", F.col("t.tileShape").alias("tile_shape"), F.col("t.urlTemplate").alias("url_template"))
    rest = [*keys, "data_type", "axis_names"]
    if tileset is None and parts is not None:
        sets = sets.repartition(parts, *rest, "shape")
    chosen = tiles.select_tile_set(sets, rest) if tileset is None else sets.filter(F.col("pos") == tileset)
    per_axis = F.zip_with("shape", "tile_shape", lambda n, t: F.when(t.isNull(), F.lit(1)).otherwise(F.ceil(n / t)).cast("int"))
    rows = chosen.withColumn("per_axis", per_axis)
    count = F.aggregate("per_axis", F.lit(1).cast("long"), lambda x, y: x * y)
    rows = rows.select("*", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))).alias("n"))
    ordinals = F.zip_with(strides(F.col("per_axis")), "per_axis", lambda s, k: (F.floor(F.col("n") / s) % k).cast("int"))
    rows = rows.withColumn("ordinals", ordinals)
    offsets = F.zip_with("ordinals", "tile_shape", lambda o, t: F.when(t.isNull(), 0).otherwise(o * t).cast("int"))
    divided = F.filter(F.zip_with("axis_names", "tile_shape", lambda a, t: F.when(t.isNotNull(), a)), lambda x: x.isNotNull())
    numbers = F.filter(F.zip_with("ordinals", "tile_shape", lambda o, t: F.when(t.isNotNull(), o)), lambda x: x.isNotNull())
    return rows.select(*rest, "shape", expand_template(F.col("url_template"), divided, numbers).alias("url"), "ordinals", offsets.alias("offsets"))


def assemble(arrays: DataFrame, documents: DataFrame, keys: Sequence[str], tileset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, failures) of tiled arrays (keys, body) with tiles from documents (url, body); as tiles.stitch() gives them.

    Values come as text as they are written, null where they are missing.
    """
    head = "struct<type:string,shape:array<int>,values:array<string>>"
    d = F.from_json("body", head)
    right = d["type"] == "NdArray"
    bodies = documents.select("url", F.when(right, F.coalesce(d["shape"], F.array().cast("array<int>"))).alias("tile_shape"), F.when(right, d["values"]).alias("values"))
    of_arrays, of_tiles = _tasks(arrays, tileset)
    return tiles.stitch(tile_layout(arrays, keys, tileset, of_arrays), bodies, [*keys, "data_type", "axis_names"], parts=of_tiles)

