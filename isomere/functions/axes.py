"""Column expressions on domain axes: listed, regular and composite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative and absolute tolerance of equal steps.
REL_TOL, ABS_TOL = 1e-9, 1e-12


def regular_values(start: Column, stop: Column, num: Column) -> Column:
    """start + i * step with the step divided first; one value is start."""
    step = (stop - start) / F.nullif(num - 1, F.lit(0))
    many = F.transform(F.sequence(F.lit(0), num - 1), lambda i: start + i * step)
    return F.when(num == 1, F.array(start)).otherwise(many)


def coordinate_values(values: Column, start: Column, stop: Column, num: Column) -> Column:
    """Listed values win over the regular form."""
    return F.coalesce(values, regular_values(start, stop, num))


def length(values: Column, num: Column) -> Column:
    return F.coalesce(F.when(values.isNotNull(), F.size(values)), num)


def is_regular(values: Column) -> Column:
    """At least two numbers a constant step other than zero apart."""
    step = F.get(values, F.lit(1)) - F.get(values, F.lit(0))
    deltas = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)
    near = F.forall(deltas, lambda d: F.abs(d - step) <= F.greatest(REL_TOL * F.greatest(F.abs(d), F.abs(step)), F.lit(ABS_TOL)))
    return F.coalesce((F.size(values) >= 2) & (step != 0) & near, F.lit(False))


def compact(values: Column) -> Column:
    """struct(start, stop, num, values): the regular form where the values are regular, else listed."""
    regular = is_regular(values)
    return F.struct(
        F.when(regular, F.get(values, F.lit(0))).alias("start"), F.when(regular, F.element_at(values, -1)).alias("stop"),
        F.when(regular, F.size(values)).alias("num"), F.when(~regular, values).alias("values"),
    )


def coordinate_identifiers(coordinates: Column, name: Column) -> Column:
    return F.coalesce(coordinates, F.array(name))


def components(values: Column, count: int) -> list[Column]:
    """One array for each coordinate of a tuple axis."""
    def pick(k: int) -> Column:
        return F.transform(values, lambda v: F.get(v, F.lit(k)))

    return [pick(k) for k in range(count)]


def bounds_of(bounds: Column, positions: Column) -> Column:
    """The pairs of bounds at the chosen positions."""
    return F.flatten(F.transform(positions, lambda p: F.slice(bounds, 2 * p + 1, 2)))


def ring_too_short(ring: Column) -> Column:
    return F.size(ring) < 4


def ring_open(ring: Column) -> Column:
    """Whether a ring ends elsewhere than it starts; positions with NaN never equal each other."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    nan = F.exists(first, lambda x: F.isnan(x)) | F.exists(last, lambda x: F.isnan(x))
    return (first != last) | nan
