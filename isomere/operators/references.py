"""URL references: sites in document order, resolution against a table of documents, failures, inheritance in collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(sites: DataFrame, documents: DataFrame, expected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved, failures) of sites (.., url) against documents (url, type, body).

    resolved: all sites with body, null where unresolved (they stay URLs). failures: unresolved sites with kind transient (no
    document) or unrecoverable (not of an expected type).
    """
    found = sites.join(documents.select("url", F.col("type").alias("_type"), F.col("body").alias("_body"), F.lit(True).alias("_there")), "url", "left")
    good = F.coalesce(F.col("_type").isin(*expected), F.lit(False))
    resolved = found.withColumn("body", F.when(good, F.col("_body"))).drop("_type", "_body", "_there")
    failures = found.filter(~good).withColumn("kind", F.when(F.col("_there"), "unrecoverable").otherwise("transient")).drop("_type", "_body", "_there")
    return resolved, failures


def inherited(own: Column, shared: Column, present: Column) -> Column:
    """A collection's member where the coverage does not have it; one that is present, even if empty, stays."""
    return F.when(present, own).otherwise(shared)


def inherited_referencing(own: Column, shared: Column, inline: Column) -> Column:
    """Reference systems reach only an inline domain without any of its own."""
    return F.when(inline & (F.coalesce(F.size(own), F.lit(0)) <= 0), shared).otherwise(own)


def effective_domain_type(inline: Column, own: Column) -> Column:
    """The domain's type or else the coverage's; empty strings count as absent."""
    return F.coalesce(F.nullif(inline, F.lit("")), F.nullif(own, F.lit("")))
