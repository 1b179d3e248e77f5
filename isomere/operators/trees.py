"""Trees of datasets: variables with CF metadata at the nodes of a tree, to and from collections.

A node is a row (tree, path, ord): the root's path is empty, others are `/name/name`; ord gives the order of nodes. The tables of
variables, cells, sizes and attributes are those of cf_documents with tree and path in place of ds_id.

A coordinate along the dimension of its own name holds for all nodes below, unless a node between or the node itself has a
variable of that name. Each node meets the nodes on its path by equal (tree, path), so a level costs no pass of its own, and
what is nearest is an aggregate that combines before the shuffle; values are joined last, to the source that was found.

A node becomes a member if it has data: children of the root only, or nodes of all depths if nested; the root where no other
does. Members that have no document, or a dimension of another length than the coordinate from above, stand in the quarantine
(tree, path, error) and are left out. A tree without data gives a collection without members. Null trees or paths belong to no
node; repeated nodes count once; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomere.operators import cf_documents
from isomere.operators.cf_variables import Variables
from isomere.sources.stored import shuffled, stored

NODE = ("tree", "path")


@dataclass
class Tree:
    nodes: DataFrame
    variables: DataFrame
    cells: DataFrame
    sizes: DataFrame
    attributes: DataFrame


def of_collections(v: Variables) -> Tree:
    """The tree of each document's datasets: coverage_0, coverage_1 and so on below the root, a single coverage at the root."""
    number = F.regexp_extract("ds_id", r"/coverages/(\d+)$", 1)
    path = F.when(number == "", "").otherwise(F.concat(F.lit("/coverage_"), number))

    def placed(df: DataFrame) -> DataFrame:
        return df.select(F.regexp_replace("ds_id", r"/coverages/\d+$", "").alias("tree"), path.alias("path"), *[c for c in df.columns if c != "ds_id"])

    tables = [placed(df) for df in (v.variables, v.cells, v.sizes, v.attributes)]
    nodes = v.attributes.select(F.regexp_replace("ds_id", r"/coverages/\d+$", "").alias("tree"), path.alias("path"), F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("long").alias("ord"))
    return Tree(nodes, *tables)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def members(tree: Tree, nested: bool = False) -> DataFrame:
    """(tree, path, ord) of the nodes that become coverages."""
    nodes = tree.nodes.filter("tree is not null and path is not null").groupBy(*NODE).agg(F.min("ord").alias("ord"))
    filled = nodes.join(shuffled(tree.variables.filter("not is_coord").select(*NODE).distinct()), list(NODE), "left_semi")
    below = filled.filter("path <> ''" if nested else depth(F.col("path")) == 1)
    root = filled.filter("path = ''").join(shuffled(below.select("tree").distinct()), "tree", "left_anti")
    return below.unionByName(root)


def sources(tree: Tree, taken: DataFrame) -> DataFrame:
    """(tree, path, name, source, own): for each variable that holds at a node, the path of the node that has it."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    lines = taken.select(*NODE, F.explode(above).alias("source"))
    everywhere = F.col("is_coord") & (F.size("dims") == 1) & (F.get("dims", F.lit(0)) == F.col("name"))
    known = tree.variables.select("tree", F.col("path").alias("source"), "name", everywhere.alias("everywhere")).distinct()
    # A variable between, whatever its kind, hides those of its name above; it holds below only if it is such a coordinate.
    nearest = lines.join(known, ["tree", "source"]).groupBy(*NODE, "name").agg(F.max_by(F.struct("source", "everywhere"), F.length("source")).alias("s"))
    found = nearest.select(*NODE, "name", "s.source", (F.col("s.source") == F.col("path")).alias("own"), "s.everywhere")
    return found.filter("own or everywhere").drop("everywhere")


def datasets(tree: Tree, nested: bool = False) -> tuple[Variables, DataFrame]:
    """(whole datasets of the members, with what they have from above; members as (ds_id, tree, path, ord))."""
    taken = stored(members(tree, nested))
    found = stored(sources(tree, taken))
    ds = F.to_json(F.array(*NODE))
    at_source = lambda df: df.withColumnRenamed("path", "source")
    of_variables = found.join(at_source(tree.variables), ["tree", "source", "name"])
    # What comes from above follows what is the node's own.
    last = F.max(F.when(F.col("own"), F.col("ord"))).over(Window.partitionBy(*NODE))
    variables = of_variables.withColumn("_last", last).select(ds.alias("ds_id"), F.when(F.col("own"), F.col("ord")).otherwise(F.col("_last") + 1 + F.col("ord")).alias("ord"), "name", "dims", "attrs", "is_coord", "is_time")
    cells = found.join(at_source(tree.cells), ["tree", "source", "name"]).select(ds.alias("ds_id"), "name", "idx", "number", "text")
    own = tree.sizes.join(taken.select(*NODE), list(NODE), "left_semi").select(*NODE, "dim", "size", F.lit(None).cast("int").alias("above"))
    given = found.filter("not own").withColumnRenamed("name", "dim").join(at_source(tree.sizes), ["tree", "source", "dim"]).select(*NODE, "dim", F.lit(None).cast("int").alias("size"), F.col("size").cast("int").alias("above"))
    both = own.unionByName(given).groupBy(*NODE, "dim").agg(F.max("size").alias("size"), F.max("above").alias("above"))
    sizes = both.select(ds.alias("ds_id"), "dim", F.coalesce("size", "above").alias("size"))
    wrong = both.filter("size <> above").select(ds.alias("ds_id"), F.concat(F.lit("dimension "), "dim", F.lit(" has another length above")).alias("error"))
    attributes = tree.attributes.join(taken.select(*NODE), list(NODE), "left_semi").select(ds.alias("ds_id"), "attrs")
    return Variables(variables, cells, sizes, attributes, wrong), taken.select(ds.alias("ds_id"), *NODE, "ord")


def to_collections(tree: Tree, nested: bool = False, compact: bool = True, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, body) of a CoverageCollection a tree, quarantine (tree, path, error)).

    overrides: (role, name), the coordinates that fill roles at every member that has them.
    """
    whole, taken = datasets(tree, nested)
    each = None
    if overrides is not None:
        each = whole.variables.filter("is_coord").select("ds_id", "name").join(F.broadcast(overrides), "name").select("ds_id", "role", "name")
    bodies, bad = cf_documents.documents(whole.variables, whole.cells, whole.sizes, whole.attributes, compact, each)
    bad = stored(bad.unionByName(whole.quarantine))
    good = taken.join(bodies.withColumnRenamed("doc_id", "ds_id"), "ds_id").join(bad.select("ds_id").distinct(), "ds_id", "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "body"))), lambda m: m["body"]), ",")
    trees = tree.nodes.select("tree").filter("tree is not null").distinct()
    listed = trees.join(shuffled(good.groupBy("tree").agg(text.alias("text"))), "tree", "left")
    body = F.concat(F.lit('{"type":"CoverageCollection","coverages":['), F.coalesce("text", F.lit("")), F.lit("]}"))
    return listed.select(F.col("tree").alias("doc_id"), body.alias("body")), taken.join(bad, "ds_id").select(*NODE, "error")
