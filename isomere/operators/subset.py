"""Subsetting: by position (isel) and by label (sel), exact, nearest or by inclusive slices."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import Coverage, Range, place


def _chosen(cov: Coverage, axis: str, which: int | slice) -> DataFrame:
    """(keys, pos, new): the selected positions of each coverage by Python's rules for indices and slices."""
    if axis not in cov.axes:
        raise ValueError(f"no axis {axis}")
    rows = cov.axes[axis].select(*cov.keys, "pos")
    size = F.count("*").over(Window.partitionBy(*cov.keys)) if cov.keys else F.lit(rows.count())
    if isinstance(which, int):
        wanted = F.lit(which) if which >= 0 else size + which
        return rows.withColumn("wanted", wanted).filter("pos = wanted").select(*cov.keys, "pos", F.lit(0).alias("new"))
    step = 1 if which.step is None else which.step
    if step == 0:
        raise ValueError("a slice's step can't be 0")

    def bound(x: int | None, default: Column, low: int, high: Column) -> Column:
        if x is None:
            return default
        return F.least(F.greatest(F.lit(x) if x >= 0 else size + x, F.lit(low)), high)

    if step > 0:
        start, stop = bound(which.start, F.lit(0), 0, size), bound(which.stop, size, 0, size)
        inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    else:
        start, stop = bound(which.start, size - 1, -1, size - 1), bound(which.stop, F.lit(-1), -1, size - 1)
        inside = (F.col("pos") <= F.col("start")) & (F.col("pos") > F.col("stop"))
    rows = rows.withColumns({"start": start, "stop": stop}).filter(inside)
    offset = F.col("pos") - F.col("start")
    return rows.filter(offset % step == 0).select(*cov.keys, "pos", (offset / step).cast("int").alias("new"))


def take(cov: Coverage, axis: str, chosen: DataFrame, keep: bool) -> Coverage:
    """cov at the chosen (keys, pos, new) of an axis; keep: whether ranges keep the axis. The axis itself always stays."""
    keys = list(cov.keys)
    values = cov.axes[axis].join(chosen, [*keys, "pos"]).select(*keys, F.col("new").alias("pos"), "value")
    ranges = {}
    for name, r in cov.ranges.items():
        if axis not in r.axis_names:
            ranges[name] = r
            continue
        at = chosen.select(*keys, F.col("pos").alias(place(axis)), "new")
        cells = r.cells.join(at, [*keys, place(axis)]).drop(place(axis))
        cells = cells.withColumnRenamed("new", place(axis)) if keep else cells.drop("new")
        ranges[name] = Range(r.axis_names if keep else tuple(a for a in r.axis_names if a != axis), cells)
    others = {a: v.join(values.select(*keys).distinct(), keys, "left_semi") if keys else v for a, v in cov.axes.items()}
    return replace(cov, axes=others | {axis: values}, ranges=ranges)


def isel(cov: Coverage, **indexers: int | slice) -> Coverage:
    """By position: an integer takes the axis out of the ranges, a slice keeps it. Coverages that lack a place go."""
    for axis, which in indexers.items():
        cov = take(cov, axis, _chosen(cov, axis, which), isinstance(which, slice))
    return cov


def sel(cov: Coverage, method: str | None = None, **labels: Any) -> Coverage:
    """By label: the first equal value, the nearest (the first of equally near ones), or a slice from the first to the last value inside.

    Coverages without such a label go.
    """
    for axis, label in labels.items():
        rows = cov.axes[axis]
        value = F.col("value")
        if isinstance(label, slice):
            if label.step is not None:
                raise ValueError("slices of labels have no step")
            inside = F.lit(True)
            if label.start is not None:
                inside &= value >= F.lit(label.start)
            if label.stop is not None:
                inside &= value <= F.lit(label.stop)
            ends = rows.filter(inside).groupBy(*cov.keys).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
            both = rows.join(ends, list(cov.keys)) if cov.keys else rows.crossJoin(F.broadcast(ends))  # one row
            chosen = both.filter("pos between low and high").select(*cov.keys, "pos", (F.col("pos") - F.col("low")).alias("new"))
        elif method == "nearest":
            best = F.min_by("pos", F.struct(F.abs(value - F.lit(label)), "pos"))
            chosen = rows.filter(value.isNotNull()).groupBy(*cov.keys).agg(best.alias("pos")).withColumn("new", F.lit(0))
        else:
            chosen = rows.filter(value == F.lit(label)).groupBy(*cov.keys).agg(F.min("pos").alias("pos")).withColumn("new", F.lit(0))
        cov = take(cov, axis, chosen, isinstance(label, slice))
    return cov
