"""Reference systems and parameters: refined kinds, CRS, vertical attributes, CF metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the known kinds, and what two of them must have.
KINDS = ("GeographicCRS", "ProjectedCRS", "VerticalCRS", "TemporalRS", "IdentifierRS")
REQUIRED = {"TemporalRS": "calendar", "IdentifierRS": "targetConcept"}
STANDARD_NAME = r"^.*/standard_name/([^/?#]+)/?$"


def missing_required_member(kind: Column, calendar: Column, target: Column) -> Column:
    return F.when((kind == "TemporalRS") & calendar.isNull(), "calendar").when((kind == "IdentifierRS") & target.isNull(), "targetConcept")


def refine(kind: Column, calendar: Column, target: Column) -> Column:
    """The kind, or Opaque for unknown kinds and for known ones that lack a required member."""
    known = kind.isin(*KINDS) & missing_required_member(kind, calendar, target).isNull()
    return F.when(F.coalesce(known, F.lit(False)), kind).otherwise("Opaque")


def is_custom(kind: Column) -> Column:
    return ~kind.isin(*KINDS)


def vertical_name(identifier: Column) -> Column:
    low = F.lower(identifier)
    return F.when(F.contains(low, F.lit("depth")), "depth").when(F.contains(low, F.lit("height")), "height").when(F.contains(low, F.lit("altitude")), "height")


def vertical_positive(identifier: Column) -> Column:
    name = vertical_name(identifier)
    return F.when(name == "depth", "down").when(name.isNotNull(), "up")


def geographic_crs(identifier: Column) -> Column:
    """The id if it names a published CRS, else the default longitude-latitude one."""
    known = F.regexp_like(identifier, F.lit(r"(?i)/def/crs/(OGC|EPSG)/[^/]+/[A-Za-z0-9]+$"))
    return F.when(F.coalesce(known, F.lit(False)), identifier).otherwise("OGC:CRS84")


def standard_name(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(identifier, F.lit("")), STANDARD_NAME, 1), F.lit(""))


def flag_meaning(label: Column) -> Column:
    return F.regexp_replace(F.trim(label), r"\s+", "_")
