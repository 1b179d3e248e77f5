"""Tiled arrays: the layout of tiles, their URLs, stitching them together, and failures under selectable strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomere.functions.arrays import strides, tile_count


def select_tile_set(sets: DataFrame, keys: Sequence[str], shape: str = "shape") -> DataFrame:
    """Of each array's tile sets (keys, pos, tile_shape, url_template, shape) the one with fewest tiles, the first of equals."""
    best = F.min_by(F.struct("pos", "tile_shape", "url_template"), F.struct(tile_count(F.col(shape), F.col("tile_shape")), "pos"))
    return sets.groupBy(*keys, shape).agg(best.alias("best")).select(*keys, shape, "best.*")


def layout(sets: DataFrame, keys: Sequence[str], axis_names: Sequence[str], shape: str = "shape") -> DataFrame:
    """A row a tile: keys, url, ordinals and offsets by axis, in row-major order of the tiles by ord.

    A null tile size spans its axis and gives the template no variable.
    """
    out = sets
    for k, _ in enumerate(axis_names):
        size, tile = F.get(shape, F.lit(k)), F.get("tile_shape", F.lit(k))
        tiles = F.when(tile.isNull(), F.lit(1)).otherwise(F.ceil(size / tile)).cast("int")
        out = out.withColumn(f"_o{k}", F.explode(F.sequence(F.lit(0), tiles - 1)))
    url: Column = F.col("url_template")
    for k, axis in enumerate(axis_names):
        spelled = F.replace(url, F.lit("{" + axis + "}"), F.col(f"_o{k}").cast("string"))
        url = F.when(F.get("tile_shape", F.lit(k)).isNull(), url).otherwise(spelled)
    ordinals = F.array(*[F.col(f"_o{k}") for k in range(len(axis_names))])
    offsets = F.array(*[(F.col(f"_o{k}") * F.coalesce(F.get("tile_shape", F.lit(k)), F.lit(0))).cast("int") for k in range(len(axis_names))])
    return out.select(*keys, shape, url.alias("url"), ordinals.alias("ordinals"), offsets.alias("offsets"))


def stitch(tiles: DataFrame, documents: DataFrame, keys: Sequence[str], shape: str = "shape", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, failures) of tiles from layout() and documents (url, tile_shape, values; null values are broken documents).

    cells: keys, flat_idx, value, with a null for every place that no tile fills; the tile with the larger ordinals wins where
    tiles overlap. failures: keys, url, kind (transient: no document, unrecoverable: a broken one), offsets, ordinals.

    Documents grow with the tiles, so they are not broadcast; failures meet them without their values. parts: over how many
    tasks tiles and documents are dealt by URL; without it Spark settles that by the bytes it shuffles.
    """
    bodies = documents.select("url", F.col("tile_shape").alias("_tile"), F.col("values").alias("_values"), F.col("values").isNotNull().alias("_whole"), F.lit(True).alias("_there"))
    dealt = (lambda df: df) if parts is None else (lambda df: df.repartition(parts, "url"))
    found = dealt(tiles).join(dealt(bodies).hint("merge"), "url", "left")
    failed = found.filter(~F.coalesce("_whole", F.lit(False))).select(
        *keys, "url", F.when(F.col("_there"), "unrecoverable").otherwise("transient").alias("kind"), "offsets", "ordinals"
    )
    cells = found.filter("_whole").select(*keys, shape, "offsets", "ordinals", "_tile", F.posexplode("_values").alias("_at", "value"))
    local = F.zip_with(strides(F.col("_tile")), F.col("_tile"), lambda s, n: F.floor(F.col("_at") / s) % n)
    index = F.zip_with(local, F.col("offsets"), lambda a, b: a + b)
    flat = F.aggregate(F.zip_with(index, strides(F.col(shape)), lambda i, s: i * s), F.lit(0).cast("long"), lambda a, x: a + x)
    last = cells.select(*keys, flat.alias("flat_idx"), "value", "ordinals").groupBy(*keys, "flat_idx").agg(F.max_by("value", "ordinals").alias("value"))
    whole = tiles.select(*keys, shape).distinct()
    size = F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, x: a * x)
    grid = whole.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("flat_idx"))
    return grid.join(last, [*keys, "flat_idx"], "left"), failed


class FetchError(Exception):
    """The failures that a strategy stopped at."""

    def __init__(self, failures: list):
        self.failures = failures
        first = failures[0]
        more = f" (and {len(failures) - 1} more)" if len(failures) > 1 else ""
        super().__init__(f"{first['kind']} fetching {first['url']}{more}")


def halted(failures: DataFrame, keys: Sequence[str], order: Sequence[str], strategy: str | Callable[[Column, Column], Column] = "collect_all", limit: int = 1) -> DataFrame:
    """The failures that a strategy sees until it stops, with halt true on the one that it stops at.

    strategy: one of those below, or a function from the number of failures so far and the kind of this one to a condition.
    fail_fast: the first; collect_all: all; halt_on_unrecoverable: up to the first that can't be tried again; stop_after: limit.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(window)
    if strategy == "stop_after" and limit < 1:
        raise ValueError("limit must be at least 1")
    stop = strategy(n, F.col("kind")) if callable(strategy) else {
        "fail_fast": n >= 1, "collect_all": F.lit(False), "stop_after": n >= limit, "halt_on_unrecoverable": F.col("kind") == "unrecoverable",
    }[strategy]
    marked = failures.withColumn("halt", stop)
    before = F.coalesce(F.max(F.col("halt").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_before", before).filter("_before = 0").drop("_before")


def raise_if_halted(seen: DataFrame) -> None:
    rows = seen.filter("halt").limit(1).collect()
    if rows:
        raise FetchError([r.asDict() for r in rows])
