"""Short HTML cards of coverages for notebooks, made as a column so that any number of them can be shown or stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.axes import regular_values
from isomere.functions.text import display
from isomere.sources.model import is_text, sub
from isomere.sources.parts import parts


def escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def card(title: Column, rows: Column) -> Column:
    """rows: map of labels to texts, in order."""
    lines = F.transform(F.map_entries(rows), lambda e: F.concat(F.lit("<tr><th>"), escape(e["key"]), F.lit("</th><td>"), escape(F.coalesce(e["value"], F.lit(""))), F.lit("</td></tr>")))
    return F.concat(F.lit("<div><strong>"), escape(title), F.lit("</strong><table>"), F.array_join(lines, ""), F.lit("</table></div>"))


#: Values that a preview shows at either end.
SHOWN = 3


def grid(header: list[str], rows: Column) -> Column:
    """A table with a header, of rows (arrays of texts); empty without rows."""
    cells = lambda tag, texts: F.concat(F.lit("<tr>"), F.array_join(F.transform(texts, lambda x: F.concat(F.lit(f"<{tag}>"), escape(F.coalesce(x, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r: cells("td", r)), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), cells("th", F.array(*map(F.lit, header))), body, F.lit("</table>"))).otherwise(F.lit(""))


def preview(tokens: Column) -> Column:
    """The first and last values of a list of texts, with dots between them if some are left out."""
    tokens = F.transform(tokens, lambda t: F.coalesce(t, F.lit("null")))
    short = F.concat(F.array_join(F.slice(tokens, 1, SHOWN), ", "), F.lit(", …, "), F.array_join(F.slice(tokens, -SHOWN, SHOWN), ", "))
    return F.when(F.size(tokens) <= 2 * SHOWN, F.array_join(tokens, ", ")).otherwise(short)


def shape_text(names: Column, shape: Column) -> Column:
    """Like y: 2 × x: 3; scalar without axes."""
    pairs = F.zip_with(names, shape, lambda a, n: F.concat(F.coalesce(a, F.lit("?")), F.lit(": "), F.coalesce(n.cast("string"), F.lit("?"))))
    return F.when(F.size(shape) == 0, "scalar").otherwise(F.array_join(pairs, " × "))


def _texts(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,string>")


def _section(title: str, header: list[str], rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"<h4>{title}</h4>"), grid(header, rows))).otherwise("")


def _card(title: Column, *sections: Column) -> Column:
    return F.concat(F.lit("<div><strong>"), escape(title), F.lit("</strong>"), *sections, F.lit("</div>"))


def _tokens(values: Column) -> Column:
    return F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def axis_row(a: Column) -> Column:
    """Name, length and a preview of the values of an axis of sources.parts."""
    spread = regular_values(*[sub(a["axis"], m, k) for m, k in (("start", "double"), ("stop", "double"), ("num", "int"))])
    return F.array(a["name"], a["size"].cast("string"), preview(F.coalesce(_tokens(a["values"]), F.transform(spread, lambda v: v.cast("string")))))


def parameter_row(key: Column, p: Column) -> Column:
    """Key, name and unit of a parameter."""
    label = F.coalesce(display(_texts(sub(p, "label"))), F.lit(""))
    name = F.when(label == "", display(_texts(F.try_variant_get(p, "$.observedProperty.label", "variant")))).otherwise(label)
    get = lambda path: F.try_variant_get(p, path, "string")
    plain = F.when(is_text(F.try_variant_get(p, "$.unit.symbol", "variant")), get("$.unit.symbol"))
    return F.array(key, name, F.coalesce(get("$.unit.symbol.value"), plain, display(_texts(F.try_variant_get(p, "$.unit.label", "variant")))))


def range_row(key: Column, r: Column) -> Column:
    """Key, kind, type, shape and a preview of a range: values, tile sets or the URL."""
    kind, none = sub(r, "type", "string"), F.array()
    shape = shape_text(F.coalesce(sub(r, "axisNames", "array<string>"), none.cast("array<string>")), F.coalesce(sub(r, "shape", "array<int>"), none.cast("array<int>")))
    sets = F.transform(sub(r, "tileSets", "array<variant>"), lambda t: F.concat(sub(t, "urlTemplate", "string"), F.lit(" "), F.to_json(sub(t, "tileShape"))))
    shown = F.coalesce(preview(_tokens(sub(r, "values", "array<variant>"))), preview(sets), F.lit(""))
    return F.when(is_text(r), F.array(key, F.lit("url"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.try_variant_get(r, "$", "string"))).otherwise(
        F.array(key, kind, sub(r, "dataType", "string"), shape, shown)
    )


PARAMETERS, RANGES = ["key", "name", "unit"], ["key", "kind", "type", "shape", "values"]


def document_cards(decoded: DataFrame) -> DataFrame:
    """(doc_id, path, html) of each coverage (path of the coverage) and each document that is a domain or an array.

    A card lists axes by name, parameters and ranges by key; it is made from the coverage's row alone. Repeated rows give
    repeated cards.
    """
    p = parts(decoded)
    alone = F.array(range_row(F.lit(""), F.col("own")))
    ranges = F.when(F.col("kind").isin("NdArray", "TiledNdArray"), alone).otherwise(F.transform(F.map_entries("ranges"), lambda e: range_row(e["key"], e["value"])))
    html = _card(
        F.concat_ws(" ", "kind", "domain_type"), _section("Axes", ["name", "length", "values"], F.transform("axes", axis_row)),
        _section("Parameters", PARAMETERS, F.transform(F.map_entries("parameters"), lambda e: parameter_row(e["key"], e["value"]))), _section("Ranges", RANGES, ranges),
    )
    return p.select("doc_id", "path", html.alias("html"))


def collection_cards(decoded: DataFrame) -> DataFrame:
    """(doc_id, html) of each collection: its members by number, id, domain type and range keys, and what they share."""
    v = F.try_parse_json("body")
    shared = lambda m: F.map_entries(sub(v, m, "map<string,variant>"))

    def member(c: Column, i: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(c, "$.domain.domainType", "string"), sub(c, "domainType", "string"), sub(v, "domainType", "string"))
        return F.array(i.cast("string"), sub(c, "id", "string"), kind, F.array_join(F.map_keys(sub(c, "ranges", "map<string,variant>")), ", "))

    rows = F.transform(sub(v, "coverages", "array<variant>"), member)
    title = F.concat_ws(" ", F.lit("CoverageCollection"), sub(v, "domainType", "string"), F.concat(F.lit("("), F.size(rows).cast("string"), F.lit(")")))
    html = _card(title, _section("Coverages", ["number", "id", "domain type", "ranges"], rows), _section("Parameters", PARAMETERS, F.transform(shared("parameters"), lambda e: parameter_row(e["key"], e["value"]))))
    return decoded.filter("type = 'CoverageCollection'").select("doc_id", html.alias("html"))


def parameter_cards(decoded: DataFrame) -> DataFrame:
    """(doc_id, path, key, html) of each parameter of each coverage, inherited ones as well, with its categories and their codes."""
    each = parts(decoded).select("doc_id", "path", F.explode(F.map_entries("parameters")).alias("e")).select("doc_id", "path", "e.key", F.col("e.value").alias("p"))
    p = F.col("p")
    category = lambda c: F.array(sub(c, "id", "string"), display(_texts(sub(c, "label"))), F.to_json(F.try_element_at(sub(p, "categoryEncoding", "map<string,variant>"), sub(c, "id", "string"))))
    categories = F.transform(F.try_variant_get(p, "$.observedProperty.categories", "array<variant>"), category)
    html = _card(F.concat(F.lit("Parameter "), F.col("key")), grid(PARAMETERS, F.array(parameter_row(F.col("key"), p))), _section("Categories", ["id", "label", "codes"], categories))
    return each.select("doc_id", "path", "key", html.alias("html"))
