"""Media types, language maps and tags, JSON pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_TYPE = "application/prs.coverage+json"

#: Fixed: the subtags of a well-formed language tag, in order.
LANGUAGE_TAG = r"^(?i)([a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wy-z0-9](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?$"


def media_type(*profiles: str) -> str:
    return MEDIA_TYPE + (f'; profile="{" ".join(profiles)}"' if profiles else "")


def is_media_type(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))) == MEDIA_TYPE, F.lit(False))


def i18n(text: Column, **languages: Column) -> Column:
    pairs = [F.lit("und"), text] + [x for k, v in languages.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def display(texts: Column) -> Column:
    """The first of en or und in the map's order, else the first text, else empty."""
    entries = F.map_entries(texts)
    wanted = F.filter(entries, lambda e: e["key"].isin("en", "und"))
    return F.coalesce(F.get(wanted, F.lit(0))["value"], F.get(entries, F.lit(0))["value"], F.lit(""))


def valid_language_tag(tag: Column) -> Column:
    """Well formed by grammar; subtags are not looked up in a registry."""
    return F.coalesce(F.regexp_like(tag, F.lit(LANGUAGE_TAG)), F.lit(False))


def json_pointer(*parts: Column) -> Column:
    escaped = [F.concat(F.lit("/"), F.replace(F.replace(p.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts]
    return reduce(lambda a, b: F.concat(a, b), escaped, F.lit(""))


def json_string(text: Column) -> Column:
    """A text as JSON writes it, with quotes; null for null."""
    # The text's own brackets lie within its quotes, so those of the list alone are trimmed, and it is written once.
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def member_texts(text: Column | str) -> Column:
    """The members of an object's text, each as JSON text, in the order of the object; 1.50 becomes 1.5, 2.0 stays."""
    raw = F.from_json(text, "map<string,string>")

    def one(typed: Column) -> Column:
        return F.transform_values(raw, lambda k, v: F.when(F.regexp_like(v, F.lit(r"^\s*[\[{]")) & (F.schema_of_variant(typed[k]) != "STRING"), v).otherwise(F.coalesce(F.to_json(typed[k]), F.lit("null"))))

    # The text is parsed once, not once a member.
    return F.get(F.transform(F.array(F.from_json(text, "map<string,variant>")), one), F.lit(0))


def object_text(texts: Column) -> Column:
    """The text of an object with the members of member_texts()."""
    pairs = F.transform(F.map_entries(texts), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
