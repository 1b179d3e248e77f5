"""Subsetting of coverage documents: by position (isel) and by label (sel), documents in, documents out.

A coverage's row holds all that a selection needs, so each is one expression on it: positions on an axis, the axis's values and
bounds at these positions, and the values of ranges at the places that follow from positions and strides. A regular axis is
never spread: its size is known, and a value follows from its position. The subset axis lists its values.

An integer or a label takes one place of an axis and the axis out of the ranges; a slice keeps both. By label: the first equal
value, the nearest of numbers (the first of equally near ones), or from the first to the last value inside a slice.

What can't be subset stands in the quarantine (doc_id, path, error): domains and ranges elsewhere, an axis that is not there or
is composite, a place or a label that is not there, bounds of a wrong length. Coverages of collections come one by one, with
their path, and without what they share. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.arrays import strides
from isomere.functions.text import json_string, member_texts, object_text
from isomere.sources.model import is_number, is_text, present, sub
from isomere.sources.parts import parts, settled

Label = int | float | str


def merged(indexers: Mapping | None, more: Mapping) -> dict:
    """Indexers by axis, given as a mapping, by name or both; an axis in both is an error."""
    both = set(indexers or {}) & set(more)
    if both:
        raise ValueError(f"indexer for axis {min(both)!r} given both positionally and as a keyword")
    return {**(indexers or {}), **more}


def _positions(size: Column, which: int | slice) -> Column:
    """The positions that an index or a slice takes of an axis, by Python's rules; null for an index that is out of range."""
    if not isinstance(which, slice):
        at = F.lit(which) if which >= 0 else size + which
        return F.when(at.between(0, size - 1), F.array(at.cast("int")))
    step = 1 if which.step is None else which.step
    if step == 0:
        raise ValueError("a slice's step can't be 0")
    low, high = (F.lit(0), size) if step > 0 else (F.lit(-1), size - 1)
    bound = lambda x, default: default if x is None else F.least(F.greatest(F.lit(x) if x >= 0 else size + x, low), high)
    start, stop = bound(which.start, low if step > 0 else high), bound(which.stop, high if step > 0 else low)
    count = F.greatest(F.ceil((stop - start) / step), F.lit(0)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: (start + k * step).cast("int"))).otherwise(F.array().cast("array<int>"))


def _regular(a: Column) -> tuple[Column, Column, Column]:
    """start, step and number of values of a regular axis."""
    start, stop, num = (sub(a["axis"], m, k) for m, k in (("start", "double"), ("stop", "double"), ("num", "int")))
    return start, F.coalesce((stop - start) / F.nullif(num - 1, F.lit(0)), F.lit(0.0)), num


def _keys(a: Column, numeric: bool) -> Column:
    """The axis's values as numbers or texts, null for those of the other kind."""
    listed = F.transform(a["values"], lambda v: F.when(is_number(v), F.try_variant_get(v, "$", "double")) if numeric else F.when(is_text(v), F.try_variant_get(v, "$", "string")))
    start, step, num = _regular(a)
    counted = _let(F.struct(start.alias("start"), step.alias("step")), lambda r: F.transform(F.sequence(F.lit(0), num - 1), lambda i: r["start"] + i * r["step"]))
    return F.coalesce(listed, counted) if numeric else F.coalesce(listed, F.array().cast("array<string>"))


def _by_label(a: Column, label: Label | slice, nearest: bool) -> Column:
    """The positions that a label or a slice of labels takes of an axis; null for a label that is not there."""
    if isinstance(label, slice):
        if label.step is not None:
            raise ValueError("slices of labels have no step")
        ends = [x for x in (label.start, label.stop) if x is not None]
        numeric = not ends or not isinstance(ends[0], str)

        def inside(v: Column) -> Column:
            return v.isNotNull() & (F.lit(True) if label.start is None else v >= F.lit(label.start)) & (F.lit(True) if label.stop is None else v <= F.lit(label.stop))

        if not ends:
            return F.sequence(F.lit(0), a["size"] - 1)
        hits = F.filter(F.transform(_keys(a, numeric), lambda v, i: F.when(inside(v), i)), lambda i: i.isNotNull())
        return F.when(F.size(hits) > 0, F.sequence(F.get(hits, F.lit(0)), F.try_element_at(hits, F.lit(-1)))).otherwise(F.array().cast("array<int>"))
    if not nearest:
        at = F.array_position(_keys(a, not isinstance(label, str)), F.lit(label if isinstance(label, str) else float(label))).cast("int") - 1
        return F.when(at >= 0, F.array(at))
    start, step, num = _regular(a)
    # Of a regular axis only the two values beside the label can be the nearest.
    near = F.greatest(F.least(F.floor((F.lit(float(label)) - start) / F.nullif(step, F.lit(0.0))), num - 1), F.lit(0)).cast("int")
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.greatest(F.least(F.coalesce(near, F.lit(0)) + k, num - 1), F.lit(0))))
    counted = F.transform(beside, lambda i: F.struct(F.abs(start + i * step - F.lit(float(label))).alias("far"), i.cast("int").alias("at")))
    listed = F.transform(_keys(a, True), lambda v, i: F.struct(F.abs(v - F.lit(float(label))).alias("far"), i.alias("at")))
    best = F.array_min(F.filter(F.when(a["values"].isNull(), counted).otherwise(listed), lambda x: x["far"].isNotNull() & ~F.isnan(x["far"])))
    return F.when(best.isNotNull(), F.array(best["at"]))


def _tokens(values: Column, texts: Column) -> Column:
    """Values as JSON texts: numbers as they are written."""
    return F.zip_with(values, texts, lambda v, t: F.when(is_number(v), t).otherwise(F.coalesce(F.to_json(v), F.lit("null"))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _subset(decoded: DataFrame, selection: dict, positions: Callable[[Column, object], Column]) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) for axes and what of them is taken; positions: of an axis and its indexer."""
    rows = parts(decoded).filter("kind = 'Coverage'").withColumn("members", member_texts("text"))
    kept = ["doc_id", "path", "text", "members", "domain_at", "axes", "ranges", "arrays", "range_texts"]
    # Each step's columns are settled: they are read many times by the next ones, in lambdas too.
    rows = settled(rows, *kept)
    axis_of = lambda name: F.get(F.filter("axes", lambda a: a["name"] == name), F.lit(0))
    for k, name in enumerate(selection):
        rows = rows.withColumn(f"_a{k}", axis_of(name))
    kept += [f"_a{k}" for k in range(len(selection))]
    rows = settled(rows, *kept)
    for k, which in enumerate(selection.values()):
        rows = rows.withColumn(f"_p{k}", F.when(F.col(f"_a{k}").isNotNull(), positions(F.col(f"_a{k}"), which)))
    kept += [f"_p{k}" for k in range(len(selection))]
    rows = settled(rows, *kept)
    elsewhere = F.filter(F.map_keys("ranges"), lambda n: ~F.exists("arrays", lambda r: r["key"] == n))
    wrong = F.when(F.col("domain_at").isNull(), "the domain is elsewhere")
    for k, name in enumerate(selection):
        a, p = F.col(f"_a{k}"), F.col(f"_p{k}")
        bounds = sub(a["axis"], "bounds", "array<variant>")
        wrong = (
            wrong.when(a.isNull(), f"no axis {name}").when(a["data_type"].isin("tuple", "polygon"), F.concat(F.lit(f"axis {name} is a composite of "), a["data_type"]))
            .when(p.isNull(), f"axis {name} has no such place").when(bounds.isNotNull() & (F.size(bounds) != 2 * a["size"]), f"axis {name} has bounds of a wrong length")
            .when(F.size(p) == 0, f"nothing of axis {name} is taken")
        )
    wrong = wrong.when(F.size(elsewhere) > 0, F.concat(F.lit("ranges elsewhere: "), F.array_join(elsewhere, ", ")))
    rows = settled(rows.withColumn("error", wrong), *kept, "error")
    good, bad = rows.filter("error is null"), rows.filter("error is not null").select("doc_id", "path", "error")

    # Axes, as texts in their order.
    axes_text = F.get_json_object("text", "$.domain.axes")
    texts = member_texts(axes_text)
    taken = {}
    for k, name in enumerate(selection):
        a, p = F.col(f"_a{k}"), F.col(f"_p{k}")
        raw = F.from_json(F.try_element_at(F.from_json(axes_text, "map<string,string>"), F.lit(name)), "struct<values:array<string>,bounds:array<string>>")
        start, step, _ = _regular(a)
        counted = _let(F.struct(start.alias("start"), step.alias("step")), lambda r: F.transform(p, lambda i: (r["start"] + i * r["step"]).cast("string")))
        listed = _let(_tokens(a["values"], raw["values"]), lambda t: F.transform(p, lambda i: F.get(t, i)))
        values = F.when(a["values"].isNull(), counted).otherwise(listed)
        bounds = _tokens(sub(a["axis"], "bounds", "array<variant>"), raw["bounds"])
        pairs = F.flatten(_let(bounds, lambda t: F.transform(p, lambda i: F.array(F.get(t, 2 * i), F.get(t, 2 * i + 1)))))
        named = sub(a["axis"], "coordinates", "array<string>")
        taken[name] = F.concat(F.lit('{"values":'), _list(values), F.when(named.isNotNull(), F.concat(F.lit(',"coordinates":'), F.to_json(named))).otherwise(""), F.when(bounds.isNotNull(), F.concat(F.lit(',"bounds":'), _list(pairs))).otherwise(""), F.lit("}"))

    def axis_text(key: Column, text: Column) -> Column:
        for name, new in taken.items():
            text = F.when(key == name, new).otherwise(text)
        return text

    new_axes = object_text(F.transform_values(texts, axis_text))

    def range_text(r: Column) -> Column:
        shape, names = (F.coalesce(sub(r["array"], m, f"array<{k}>"), F.array().cast(f"array<{k}>")) for m, k in (("shape", "int"), ("axisNames", "string")))

        def dim(name: Column, size: Column) -> Column:
            out = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
            for k, wanted in enumerate(selection):
                out = F.when(name == wanted, F.col(f"_p{k}")).otherwise(out)
            return out

        dims = F.zip_with(F.zip_with(names, shape, lambda n, s: F.struct(n.alias("n"), dim(n, s).alias("at"))), strides(shape), lambda d, s: F.struct(d["n"].alias("n"), d["at"].alias("at"), s.alias("s")))
        single = [name for name, which in selection.items() if not isinstance(which, slice)]
        left = F.filter(dims, lambda d: ~d["n"].isin(single)) if single else dims
        tokens = _tokens(sub(r["array"], "values", "array<variant>"), F.from_json(F.try_element_at("range_texts", r["key"]), "struct<values:array<string>>")["values"])
        places = F.aggregate(dims, F.array(F.lit(0).cast("bigint")), lambda acc, d: F.flatten(F.transform(acc, lambda b: F.transform(d["at"], lambda i: b + i * d["s"]))))
        rank = F.when(F.size(left) > 0, F.concat(
            F.lit(',"shape":'), _list(F.transform(left, lambda d: F.size(d["at"]).cast("string"))), F.lit(',"axisNames":'), F.to_json(F.transform(left, lambda d: d["n"]))
        )).otherwise("")
        values = _let(tokens, lambda t: F.transform(places, lambda i: F.get(t, i.cast("int"))))
        return F.concat(F.lit('{"type":"NdArray","dataType":'), json_string(sub(r["array"], "dataType", "string")), F.lit(',"values":'), _list(values), rank, F.lit("}"))

    by_key = F.map_from_entries(F.transform("arrays", lambda r: F.struct(r["key"].alias("key"), range_text(r).alias("value"))))
    ranges = member_texts(F.col("members")["ranges"])
    domain = object_text(F.transform_values(member_texts(F.col("members")["domain"]), lambda k, v: F.when(k == "axes", F.col("_axes")).otherwise(v)))
    good = settled(good.withColumn("_axes", new_axes).withColumn("_ranges", by_key), "doc_id", "path", "members", "_axes", "_ranges")
    new_ranges = object_text(F.transform_values(ranges, lambda k, v: F.coalesce(F.try_element_at("_ranges", k), v)))
    body = object_text(F.transform_values("members", lambda k, v: F.when(k == "domain", domain).when(k == "ranges", new_ranges).otherwise(v)))
    return good.select("doc_id", "path", body.alias("body")), bad


def isel(decoded: DataFrame, indexers: Mapping[str, int | slice] | None = None, **more: int | slice) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, path, body), quarantine) of coverages at positions of axes."""
    return _subset(decoded, merged(indexers, more), lambda a, which: _positions(a["size"], which))


def sel(decoded: DataFrame, labels: Mapping[str, Label | slice] | None = None, method: str | None = None, **more: Label | slice) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, path, body), quarantine) of coverages at labels of axes; method: None for equal values, or nearest."""
    if method not in (None, "nearest"):
        raise ValueError(f"no method {method!r}")
    selection = merged(labels, more)
    for name, label in selection.items():
        if method == "nearest" and not isinstance(label, slice) and (isinstance(label, bool) or not isinstance(label, int | float)):
            raise TypeError(f"method='nearest' needs a numeric label for axis {name!r}, got {label!r}")
    return _subset(decoded, selection, lambda a, label: _by_label(a, label, method == "nearest"))
