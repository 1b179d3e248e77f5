"""Builders of parameters, groups and reference systems as documents' texts; members that are null are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _some(**members: Column | None) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items() if v is not None]))


def observed(label: Column, identifier: Column | None = None, description: Column | None = None, categories: Column | None = None) -> Column:
    """struct of an observed property; label and description are maps of language to text."""
    parts = {"id": identifier, "label": label, "description": description, "categories": categories}
    return F.struct(*[v.alias(k) for k, v in parts.items() if v is not None])


def continuous(property_: Column, unit: Column | None = None, label: Column | None = None) -> Column:
    return _some(type=F.lit("Parameter"), label=label, observedProperty=property_, unit=unit)


def categorical(property_: Column, encoding: Column, label: Column | None = None) -> Column:
    """encoding: map of category ids to codes; an empty one is left out."""
    return _some(type=F.lit("Parameter"), label=label, observedProperty=property_, categoryEncoding=F.when(F.size(encoding) > 0, encoding))


def group(members: Column, label: Column | None = None, property_: Column | None = None) -> Column:
    return _some(type=F.lit("ParameterGroup"), label=label, observedProperty=property_, members=members)


def system(kind: str, identifier: Column | None = None, calendar: Column | None = None, target: Column | None = None) -> Column:
    """kind: GeographicCRS, ProjectedCRS, VerticalCRS, TemporalRS or IdentifierRS."""
    return F.struct(*[v.alias(k) for k, v in {"type": F.lit(kind), "id": identifier, "calendar": calendar, "targetConcept": target}.items() if v is not None])


def connection(coordinates: Column, system_: Column) -> Column:
    return F.struct(coordinates.alias("coordinates"), system_.alias("system"))


def codes(encoding: Column) -> Column:
    """The codes of an encoding (map of ids to lists of codes), ids apart from codes: array of struct(id, code)."""
    each = F.transform(F.map_entries(encoding), lambda e: F.transform(e["value"], lambda c: F.struct(e["key"].alias("id"), c.alias("code"))))
    return F.flatten(each)
