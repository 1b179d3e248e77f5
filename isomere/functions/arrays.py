"""Column expressions on N-dimensional arrays: strides, index arithmetic, tiles, URL templates, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("long"), lambda acc, x: acc * x.cast("long"))


def strides(shape: Column) -> Column:
    """C-order strides: each the product of the sizes that follow."""
    n = F.size(shape)
    return F.transform(shape, lambda _, i: product(F.slice(shape, i + 2, F.greatest(n - i - 1, F.lit(0)))))


def ravel_index(index: Column, steps: Column) -> Column:
    return F.aggregate(F.zip_with(index, steps, lambda i, s: i.cast("long") * s), F.lit(0).cast("long"), lambda acc, x: acc + x)


def unravel_index(flat: Column, shape: Column) -> Column:
    """The position on each axis of a place in the flat array."""
    return F.zip_with(strides(shape), shape, lambda s, n: F.floor(flat / s) % n)


def tile_count(shape: Column, tile: Column) -> Column:
    """Tiles that cover an array; a null tile size stands for the whole axis."""
    per_axis = F.zip_with(shape, tile, lambda s, t: F.when(t.isNull(), F.lit(1)).otherwise(F.ceil(s / t)).cast("long"))
    return product(per_axis)


def template_variables(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{([^{}]+)\}"), F.lit(1))


def expand_template(template: Column, names: Column, values: Column) -> Column:
    """The template with each variable of names replaced by its value."""
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))
    braced = lambda x: F.concat(F.lit("{"), x["n"], F.lit("}"))
    return F.aggregate(pairs, template, lambda acc, x: F.replace(acc, braced(x), x["v"].cast("string")))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities are never encoded; they become missing."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def as_float(value: Column, fill: float | None = None) -> Column:
    """Missing values as NaN, or as a fill value."""
    return F.coalesce(value.cast("double"), F.lit(float("nan") if fill is None else fill))
