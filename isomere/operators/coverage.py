"""Coverages as tables: axes with positions and values, ranges as cells, for any number of coverages at once.

A Coverage has key columns that tell coverages apart. An axis is a DataFrame (keys, pos, value), pos from 0. A range names
its axes and is a DataFrame (keys, one position column p_<axis> for each of its axes, value). Rows that are absent are missing
values. All operators are joins, windows and aggregates on the keys, so coverages never meet in one task but by hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    axis_names: tuple[str, ...]
    cells: DataFrame


@dataclass(frozen=True)
class Coverage:
    keys: tuple[str, ...]
    axes: dict[str, DataFrame]
    ranges: dict[str, Range]
    domain_type: str | None = None
    scalars: dict[str, DataFrame] = field(default_factory=dict)

    def sizes(self, axis: str) -> DataFrame:
        return self.axes[axis].groupBy(*self.keys).agg(F.count("*").alias("size"))


def place(axis: str) -> str:
    return f"p_{axis}"


def numbered_axis(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """An axis whose positions follow an order within each coverage."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.select(*keys, pos.alias("pos"), F.col(value).alias("value"))


def grid(df: DataFrame, dims: dict[str, str], measures: dict[str, str], keys: Sequence[str] = (), domain_type: str | None = "Grid") -> Coverage:
    """A grid from rows: the distinct values of each dimension in order make an axis; rows give cells.

    dims: axis name to column; measures: range name to column. A place without a row is missing.
    """
    axes, cells = {}, df
    for axis, column in dims.items():
        distinct = df.select(*keys, column).distinct()
        axes[axis] = numbered_axis(distinct, keys, [column], column) if keys else _global_axis(distinct, column)
        found = axes[axis].withColumnRenamed("value", column).withColumnRenamed("pos", place(axis))
        cells = cells.join(found, [*keys, column])
    ranges = {k: Range(tuple(dims), cells.select(*keys, *map(place, dims), F.col(c).alias("value"))) for k, c in measures.items()}
    return Coverage(tuple(keys), axes, ranges, domain_type)


def _global_axis(distinct: DataFrame, column: str) -> DataFrame:
    """Positions of a single coverage's axis: each value's rank, from the counts of range partitions."""
    rows = distinct.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    rows = rows.withColumn("_at", within)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return rows.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at")).cast("int").alias("pos"), F.col(column).alias("value"))


def series(df: DataFrame, key: str, time: str, order: Sequence[str], measures: dict[str, str], axis: str = "t", domain_type: str = "PointSeries") -> Coverage:
    """One coverage a key with a single axis; every row is a place of it, so equal times stay apart."""
    pos = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).alias("pos")
    rows = df.select(F.col(key), pos, F.col(time).alias("_at"), *[F.col(c).alias(f"_m_{k}") for k, c in measures.items()])
    values = rows.select(key, "pos", F.col("_at").alias("value"))
    ranges = {k: Range((axis,), rows.select(key, F.col("pos").alias(place(axis)), F.col(f"_m_{k}").alias("value"))) for k in measures}
    return Coverage((key,), {axis: values}, ranges, domain_type)


def domain(cov: Coverage) -> DataFrame:
    """All places of the domain: keys, and position and value of each axis, in row-major order by the positions."""
    out = None
    for axis, values in cov.axes.items():
        one = values.select(*cov.keys, F.col("pos").alias(place(axis)), F.col("value").alias(axis))
        if out is None:
            out = one
        else:
            out = out.join(one, list(cov.keys)) if cov.keys else out.crossJoin(one)  # the places of a grid are this product
    return out


def flatten(cov: Coverage, positions: bool = False) -> DataFrame:
    """The tidy relation: a row for each place with the axes' values and each range's value, null where it is missing.

    A range that lacks an axis is repeated along it.
    """
    out = domain(cov)
    for name, r in cov.ranges.items():
        on = [*cov.keys, *map(place, r.axis_names)]
        cells = r.cells.select(*on, F.col("value").alias(name))
        out = out.join(cells, on, "left") if on else out.crossJoin(cells)
    places = [place(a) for a in cov.axes] if positions else []
    return out.select(*cov.keys, *places, *cov.axes, *cov.ranges)


def union(members: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Flattened coverages of a collection under one key column; absent columns are null."""
    out = None
    for key, df in members:
        one = df.withColumn("coverage", F.lit(key))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("coverage", *[c for c in out.columns if c != "coverage"])


def transposed(cov: Coverage, key: str, axis_names: Sequence[str]) -> Coverage:
    """The same range with its axes stored in another order; the relation that it flattens to is unchanged."""
    r = cov.ranges[key]
    if set(axis_names) != set(r.axis_names):
        raise ValueError(f"{key} has the axes {r.axis_names}")
    return replace(cov, ranges=cov.ranges | {key: Range(tuple(axis_names), r.cells)})


def to_arrays(cov: Coverage, key: str) -> DataFrame:
    """(keys, shape, axis_names, values): a range as flat row-major arrays, missing values as nulls."""
    r = cov.ranges[key]
    full = domain(replace(cov, axes={a: cov.axes[a] for a in r.axis_names}))
    on = [*cov.keys, *map(place, r.axis_names)]
    rows = full.select(*on).join(r.cells, on, "left")
    values = F.transform(F.array_sort(F.collect_list(F.struct(*map(place, r.axis_names), "value"))), lambda s: s["value"])
    shape = F.array(*[(F.max(place(a)) + 1).cast("int") for a in r.axis_names])
    names = F.array(*map(F.lit, r.axis_names)).alias("axis_names")
    out = rows.groupBy(*cov.keys).agg(shape.alias("shape"), values.alias("values"))
    return out.select(*cov.keys, "shape", names, "values")


def from_arrays(df: DataFrame, keys: Sequence[str], axis_names: Sequence[str], values: str = "values", shape: str = "shape") -> Range:
    """A range from flat row-major arrays; places of missing values stay without a value."""
    from isomere.functions.arrays import unravel_index

    cells = df.select(*keys, F.col(shape).alias("_shape"), F.posexplode(values).alias("_flat", "value"))
    index = unravel_index(F.col("_flat"), F.col("_shape"))
    return Range(tuple(axis_names), cells.select(*keys, *[F.get(index, F.lit(i)).cast("int").alias(place(a)) for i, a in enumerate(axis_names)], "value"))
