"""Findings of whole documents: from decoded documents of any root to rows (doc_id, code, severity, at, detail).

Each rule is an expression on the row of a coverage, a domain or an array (sources.parts), which gives its findings as a list;
one pass over the documents makes them all, without joins but for the twelve rules of domain types, and without sorting.
Rules that read every value run only if check_values is set.

A document that can't be decoded has no findings; it is in decode()'s quarantine. Findings of a coverage within a collection
point below /coverages/<i>, after inheritance. Repeated rows give repeated findings, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomere.functions.arrays import product, template_variables
from isomere.functions.systems import missing_required_member, refine
from isomere.functions.temporal import is_standard_calendar, resolve
from isomere.functions.text import json_pointer, valid_language_tag
from isomere.operators.validate import WARNINGS, rules
from isomere.sources import documents as docs
from isomere.sources.model import is_number, is_text, listed, mapped, present, sub
from isomere.sources.parts import entries, items, parts

FINDING = "struct<code:string,at:string,detail:string>"
NONE = f"cast(array() AS array<{FINDING}>)"

#: A frame of (doc_id, path, name, pos, v, ordering), the values of plain axes, to (doc_id, path, name, pos), the first value
#: of each axis that breaks the order; in place of the usual rule.
OrderChecker = Callable[[DataFrame], DataFrame]


def _below(at: Column, *more: Column | str) -> Column:
    """The pointer of a part below another; strings are member names that stand for themselves in pointers."""
    return F.concat(at, *[F.lit(f"/{p}") if isinstance(p, str) else json_pointer(p) for p in more])


def _issue(wrong: Column, code: str, at: Column, detail: Column | None = None) -> Column:
    """A list with the finding, empty unless wrong."""
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    one = F.array(F.struct(F.lit(code).alias("code"), at.alias("at"), detail.alias("detail")))
    return F.when(wrong, one).otherwise(F.expr(NONE))


def _each(of: Column, rule: Callable) -> Column:
    """The findings of all items."""
    return F.flatten(F.coalesce(F.transform(of, rule), F.expr(f"cast(array() AS array<array<{FINDING}>>)")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _axis_at(a: Column, *more: Column | str) -> Column:
    return _below(F.col("domain_at"), "axes", a["name"], *more)


def member_issues() -> list[Column]:
    """Domain types of a collection's coverages beside its own, and what a coverage must have."""
    kind = lambda c: F.nullif(F.col(c), F.lit(""))
    own, shared = F.coalesce(kind("inner_type"), kind("own_type")), kind("shared_type")
    at = F.when(kind("inner_type").isNotNull(), _below(F.col("path"), "domain", "domainType")).otherwise(_below(F.col("path"), "domainType"))
    cov = F.col("kind") == "Coverage"
    known = F.col("parameters").isNotNull()
    return [
        _issue(own != shared, "coverage.domain-type-conflict", at, own),
        _issue((own == shared) & F.col("own_type").isNotNull(), "coverage.domain-type-not-omitted", _below(F.col("path"), "domainType"), F.col("own_type")),
        _issue(cov & ~known, "coverage.missing-parameters", _below(F.col("path"), "parameters")),
        _each(F.when(known, F.map_keys("ranges")), lambda k: _issue(~F.map_contains_key("parameters", k), "coverage.range-without-parameter", _below(F.col("path"), "ranges", k), k)),
    ]


def domain_issues() -> list[Column]:
    """rule: those of the domain's type, null where it isn't known."""
    there, rule, axes = F.col("domain_at").isNotNull(), F.col("rule"), F.col("axes")
    names = F.transform(axes, lambda a: a["name"])

    def of_axis(a: Column) -> Column:
        composite = (a["name"] == "composite") & rule["composite"].isNotNull()
        typed = a["data_type"].eqNullSafe(rule["composite"])
        joined = F.array_join(a["coordinates"], ",")
        return F.concat(
            _issue(F.array_contains(rule["single"], a["name"]) & (a["size"] != 1), "domain.axis-not-single", _axis_at(a), a["name"]),
            _issue(~F.array_contains(F.concat(rule["required"], rule["optional"]), a["name"]) & (a["size"] != 1), "domain.extra-axis-not-single", _axis_at(a), a["name"]),
            _issue(composite & ~typed, "domain.composite-data-type", _axis_at(a), rule["composite"]),
            _issue(composite & typed & ~F.array_contains(rule["allowed"], joined), "domain.composite-coordinates", _axis_at(a), joined),
        )

    return [
        _issue(there & F.col("domain_type").isNull(), "domain.missing-domain-type", _below(F.col("domain_at"), "domainType")),
        _issue(there & F.col("referencing").isNull(), "domain.missing-referencing", _below(F.col("domain_at"), "referencing")),
        _each(F.array_except(rule["required"], names), lambda n: _issue(there, "domain.missing-axis", _below(F.col("domain_at"), "axes", n), n)),
        _each(F.when(rule.isNotNull(), axes), of_axis),
    ]


def axis_issues() -> list[Column]:
    def of_axis(a: Column) -> Column:
        more = F.filter(F.array(*[F.when(present(sub(a["axis"], m)), m) for m in ("start", "stop", "num")]), lambda x: x.isNotNull())
        bounds, named = (sub(a["axis"], m, f"array<{k}>") for m, k in (("bounds", "variant"), ("coordinates", "string")))
        plain = ~F.coalesce(a["data_type"], F.lit("")).isin("tuple", "polygon")
        return F.concat(
            _issue(a["values"].isNotNull() & (F.size(more) > 0), "axis.form-conflict", _axis_at(a), F.array_join(more, ",")),
            _issue(bounds.isNotNull() & (F.size(bounds) != 2 * a["size"]), "axis.bounds-length", _axis_at(a, "bounds"), F.size(bounds)),
            _issue(plain & named.eqNullSafe(F.array(a["name"])), "axis.coordinates-not-omitted", _axis_at(a, "coordinates"), a["name"]),
        )

    return [_each(F.col("axes"), of_axis)]


def composite_issues() -> list[Column]:
    def tuples(a: Column) -> Callable:
        def one(v: Column, i: Column) -> Column:
            x, at = listed(v), _axis_at(a, "values", i)
            return F.concat(_issue(x.isNull(), "axis.composite-value-shape", at, F.lit("tuple")), _issue(F.size(x) != F.size(a["coordinates"]), "axis.composite-arity", at, F.size(x)))

        return one

    def ring_issues(a: Column, at: Column, q: Column) -> Column:
        """q: the positions of a ring, each a list."""
        numbers = lambda p: F.transform(p, lambda c: F.coalesce(F.try_variant_get(c, "$", "double").cast("string"), F.to_json(c)))
        closed = numbers(F.get(q, F.lit(0))).eqNullSafe(numbers(F.try_element_at(q, F.lit(-1))))
        return F.concat(
            _each(q, lambda p, k: _issue(F.size(p) != F.size(a["coordinates"]), "axis.polygon-position-arity", _below(at, k), F.size(p))),
            _issue(F.size(q) < 4, "axis.polygon-ring-too-short", at, F.size(q)), _issue(~closed, "axis.polygon-ring-not-closed", at),
        )

    def polygons(a: Column) -> Callable:
        full = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))

        def one(v: Column, i: Column) -> Column:
            at = _axis_at(a, "values", i)
            rings = F.transform(listed(v), lambda r: F.transform(listed(r), listed))

            def judged(x: Column) -> Column:
                shaped = full(x) & F.forall(x, lambda q: full(q) & F.forall(q, lambda p: p.isNotNull()))
                right = F.coalesce(shaped, F.lit(False))
                return F.concat(_issue(~right, "axis.composite-value-shape", at, F.lit("polygon")), _each(F.when(right, x), lambda q, k: ring_issues(a, _below(at, k), q)))

            return _let(rings, judged)

        return one

    kind = lambda name: F.filter("axes", lambda a: a["data_type"] == name)
    return [_each(kind("tuple"), lambda a: _each(a["values"], tuples(a))), _each(kind("polygon"), lambda a: _each(a["values"], polygons(a)))]


def _plain(a: Column) -> Column:
    return a["values"].isNotNull() & ~F.coalesce(a["data_type"], F.lit("")).isin("tuple", "polygon")


def ordering(name: Column) -> Column:
    """numeric or temporal, by the last reference system that names the coordinate; else null."""
    last = F.try_element_at(F.filter("referencing", lambda c: F.array_contains(sub(c, "coordinates", "array<string>"), name)), F.lit(-1))
    member = lambda m: F.try_variant_get(last, f"$.system.{m}", "string")
    kind = refine(member("type"), member("calendar"), F.to_json(F.try_variant_get(last, "$.system.targetConcept", "variant")))
    return F.when(kind.isin("GeographicCRS", "ProjectedCRS", "VerticalCRS"), "numeric").when((kind == "TemporalRS") & is_standard_calendar(member("calendar")), "temporal")


def turned(keys: Column) -> Column:
    """The pos at which keys, of (pos, key), first turn back, or null; equal neighbours go either way."""
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("way"), F.lit(None).cast("int").alias("at"))

    def on(s: Column, x: Column) -> Column:
        step = F.coalesce(F.signum(x["key"] - s["before"]), F.lit(0.0))
        way = F.when(s["way"] == 0, step).otherwise(s["way"])
        back = (step != 0) & (step != way)
        return F.struct(x["key"].alias("before"), way.alias("way"), F.coalesce(s["at"], F.when(back, x["pos"])).alias("at"))

    return F.aggregate(keys, start, on, lambda s: s["at"])


def order_issues(usual: bool = True) -> list[Column]:
    """Lexical forms of times, and with the usual rule the order of axes."""

    def times(a: Column) -> Column:
        read = lambda v, i: F.struct(i.alias("pos"), F.when(is_text(v), F.try_variant_get(v, "$", "string")).alias("text"))
        texts = F.filter(F.transform(a["values"], read), lambda x: x["text"].isNotNull())
        return F.transform(texts, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), resolve(x["text"]).alias("when")))

    def temporal(a: Column) -> Column:
        def judged(x: Column) -> Column:
            lexical = _each(x, lambda t: _issue(t["when"]["kind"] == "malformed", "temporal.lexical-form", _axis_at(a, "values", t["pos"]), t["text"]))
            if not usual:
                return lexical
            moments = F.filter(x, lambda t: t["when"]["kind"] == "moment")
            zoned = F.array_distinct(F.transform(moments, lambda t: t["when"]["precision"] == "second"))
            keys = F.transform(moments, lambda t: F.struct(t["pos"].alias("pos"), F.unix_micros(t["when"]["when"]).cast("double").alias("key")))
            # Times with and without zones don't compare.
            return F.concat(lexical, _let(F.when(F.size(zoned) == 1, turned(keys)), lambda p: _issue(p.isNotNull(), "axis.not-monotonic", _axis_at(a, "values", p), p)))

        return _let(times(a), judged)

    def numeric(a: Column) -> Column:
        keys = F.transform(a["values"], lambda v, i: F.struct(i.alias("pos"), F.when(is_number(v), F.try_variant_get(v, "$", "double")).alias("key")))
        keys = F.filter(keys, lambda x: x["key"].isNotNull() & ~F.isnan(x["key"]))
        return _let(turned(keys), lambda p: _issue(p.isNotNull(), "axis.not-monotonic", _axis_at(a, "values", p), p))

    of = lambda kind: F.filter("axes", lambda a: _plain(a) & (ordering(a["name"]) == kind))
    return [_each(of("temporal"), temporal), *([_each(of("numeric"), numeric)] if usual else [])]


def array_issues() -> list[Column]:
    def of_array(r: Column) -> Column:
        none = lambda kind: F.array().cast(f"array<{kind}>")
        shape, names = F.coalesce(sub(r["array"], "shape", "array<int>"), none("int")), F.coalesce(sub(r["array"], "axisNames", "array<string>"), none("string"))
        n, expected = F.size(sub(r["array"], "values", "array<variant>")), F.when(F.size(shape) == 0, 1).otherwise(product(shape))

        def of_name(name: Column, k: Column) -> Column:
            return _let(F.get(F.filter("axes", lambda a: a["name"] == name), F.lit(0))["size"], lambda size: F.concat(
                _issue(size.isNull(), "coverage.range-axis-not-in-domain", _below(r["path"], "axisNames", k), name),
                _issue(F.get(shape, k) != size, "coverage.range-shape-mismatch", _below(r["path"], "shape", k), name),
            ))

        inline = (F.col("kind") == "Coverage") & F.col("domain_at").isNotNull()
        return F.concat(
            _issue(F.size(names) != F.size(shape), "ndarray.shape-rank", _below(r["path"], "shape")), _issue(n != expected, "ndarray.value-count", _below(r["path"], "values"), n),
            _each(F.when(inline, names), of_name),
        )

    return [_each(F.col("arrays"), of_array)]


def value_issues() -> list[Column]:
    """Types of values as written, and codes of categories."""

    def of_array(r: Column) -> Column:
        kind, p = sub(r["array"], "dataType", "string"), F.try_element_at("parameters", r["key"])
        ids = F.transform(F.try_variant_get(p, "$.observedProperty.categories", "array<variant>"), lambda c: sub(c, "id", "string"))
        encoding = sub(p, "categoryEncoding", "map<string,variant>")
        code = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<bigint>"), F.array(F.try_variant_get(v, "$", "bigint")))
        codes = F.flatten(F.transform(F.filter(F.map_entries(encoding), lambda e: F.array_contains(ids, e["key"])), lambda e: code(e["value"])))
        coded = ids.isNotNull() & encoding.isNotNull()
        tokens = F.from_json(F.try_element_at("range_texts", r["key"]), "struct<values:array<string>>")["values"]

        def of_value(x: Column, i: Column) -> Column:
            token, v = x["token"], x["v"]
            written = F.when(is_text(v), "string").when(F.schema_of_variant(v) == "BOOLEAN", "boolean").when(F.regexp_like(token, F.lit("[.eE]")), "float").otherwise("integer")

            def judged(w: Column) -> Column:
                fits = (w == kind) | ((kind == "float") & (w == "integer"))
                known = F.array_contains(codes, F.when(w == "integer", token.try_cast("bigint")))
                at = _below(r["path"], "values", i)
                there = present(v)
                return F.concat(_issue(there & ~fits, "range.value-type-mismatch", at, token), _issue(there & coded & ~F.coalesce(known, F.lit(False)), "range.invalid-category-code", at, token))

            return _let(written, judged)

        return _each(F.arrays_zip(tokens.alias("token"), sub(r["array"], "values", "array<variant>").alias("v")), of_value)

    return [_each(F.col("arrays"), of_array)]


def tile_issues() -> list[Column]:
    def of_array(r: Column) -> Column:
        shape, names = sub(r["array"], "shape", "array<int>"), sub(r["array"], "axisNames", "array<string>")
        same = F.size(shape) == F.size(names)

        def of_set(t: Column, i: Column) -> Column:
            tile, at = sub(t, "tileShape", "array<int>"), lambda *more: _below(r["path"], "tileSets", i, *more)
            variables = template_variables(sub(t, "urlTemplate", "string"))
            divided = F.filter(F.zip_with(names, tile, lambda a, n: F.when(n.isNotNull(), a)), lambda x: x.isNotNull())

            def of_size(n: Column, k: Column) -> Column:
                return F.concat(
                    _issue(n > F.get(shape, k), "tiled-ndarray.tile-shape-too-large", at("tileShape", k), n), _issue(n < 1, "tiled-ndarray.tile-shape-not-positive", at("tileShape", k), n)
                )

            return F.concat(
                _each(tile, of_size), _each(F.array_except(divided, variables), lambda v: _issue(F.lit(True), "tiled-ndarray.url-template-missing-variable", at("urlTemplate"), v)),
                _each(F.array_except(variables, divided), lambda v: _issue(same, "tiled-ndarray.url-template-unknown-variable", at("urlTemplate"), v)),
            )

        return F.concat(_issue(~same, "tiled-ndarray.shape-rank", _below(r["path"], "shape")), _each(sub(r["array"], "tileSets", "array<variant>"), of_set))

    return [_each(F.col("tiled"), of_array)]


def _parameter_at(key: Column, *more: Column | str) -> Column:
    return _below(F.col("path"), "parameters", key, *more)


def parameter_issues() -> list[Column]:
    def of_parameter(e: Column) -> Column:
        ids = F.transform(items(F.try_variant_get(e["value"], "$.observedProperty.categories", "variant")), lambda c: sub(c, "id", "string"))
        encoding = F.map_keys(sub(e["value"], "categoryEncoding", "map<string,variant>"))
        return _each(encoding, lambda k: _issue(~F.array_contains(ids, k), "parameter.category-encoding-unknown-id", _parameter_at(e["key"], "categoryEncoding", k), k))

    def of_group(g: Column, i: Column) -> Column:
        strange = lambda k: _issue(~F.map_contains_key("parameters", k), "parameter-group.unknown-member", _below(F.col("path"), "parameterGroups", i), k)
        return _each(sub(g, "members", "array<string>"), strange)

    return [_each(F.map_entries("parameters"), of_parameter), _each(F.col("groups"), of_group)]


def system_issues() -> list[Column]:
    def of_connection(c: Column, i: Column) -> Column:
        member = lambda m: F.try_variant_get(c, f"$.system.{m}", "string")
        target = F.to_json(F.when(present(F.try_variant_get(c, "$.system.targetConcept", "variant")), F.try_variant_get(c, "$.system.targetConcept", "variant")))
        missing = missing_required_member(member("type"), member("calendar"), target)
        at = lambda m: _below(F.col("domain_at"), "referencing", i, "system", m)
        return F.concat(_issue(missing == "calendar", "temporal.missing-calendar", at("calendar")), _issue(missing == "targetConcept", "identifier.missing-target-concept", at("targetConcept")))

    return [_each(F.col("referencing"), of_connection)]


def language_issues() -> list[Column]:
    """All language maps of parameters, groups and identifier systems."""

    one = lambda v, at, name: F.struct(_below(at, name).alias("at"), mapped(sub(v, name)).alias("texts"))
    both = lambda v, at: [one(v, at, "label"), one(v, at, "description")]

    def rule(t: Column) -> Column:
        tags = _each(F.map_keys(t["texts"]), lambda k: _issue(~valid_language_tag(k), "i18n.invalid-language-tag", _below(t["at"], k), k))
        return F.concat(_issue(F.size(t["texts"]) == 0, "i18n.empty", t["at"]), tags)

    def described(v: Column, at: Column, *more: Column) -> Column:
        inner, below = sub(v, "observedProperty"), _below(at, "observedProperty")
        listed_ = F.transform(items(sub(inner, "categories")), lambda c, i: F.array(*both(c, _below(below, "categories", i))))
        return F.concat(F.array(*both(v, at), *both(inner, below), *more), F.flatten(listed_))

    def of_parameter(e: Column) -> Column:
        at = _parameter_at(e["key"])
        return described(e["value"], at, one(sub(e["value"], "unit"), _below(at, "unit"), "label"))

    def of_connection(c: Column, i: Column) -> Column:
        s, at = sub(c, "system"), _below(F.col("domain_at"), "referencing", i, "system")
        named = F.transform(entries(sub(s, "identifiers", "map<string,variant>")), lambda e: F.array(*both(e["value"], _below(at, "identifiers", e["key"]))))
        return F.concat(F.array(*both(sub(s, "targetConcept"), _below(at, "targetConcept")), *both(s, at)), F.flatten(named))

    identified = F.filter("referencing", lambda c: F.try_variant_get(c, "$.system.type", "string") == "IdentifierRS")
    # Connections keep their numbers, as pointers have them.
    maps = [
        F.transform(F.map_entries("parameters"), of_parameter), F.transform("groups", lambda g, i: described(g, _below(F.col("path"), "parameterGroups", i))),
        F.when(F.size(identified) > 0, F.transform("referencing", lambda c, i: F.when(F.try_variant_get(c, "$.system.type", "string") == "IdentifierRS", of_connection(c, i)))),
    ]
    return [_each(F.filter(F.flatten(F.filter(m, lambda x: x.isNotNull())), lambda t: t["texts"].isNotNull()), rule) for m in maps]


def _found(rows: DataFrame, found: Sequence[Column]) -> DataFrame:
    severity = F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error").alias("severity")
    return rows.select("doc_id", F.inline(F.concat(*found))).select("doc_id", "code", severity, "at", "detail")


def validate(documents: DataFrame, check_values: bool = False, checker: OrderChecker | None = None) -> DataFrame:
    """Findings (doc_id, code, severity, at, detail) of documents (doc_id, body); those that don't decode have none."""
    decoded, _ = docs.decode(documents.select("doc_id", "body"))
    rows = parts(decoded)
    known = F.broadcast(rules(rows.sparkSession).select(F.col("domain_type").alias("_type"), F.struct("required", "optional", "single", "composite", "allowed").alias("rule")))  # twelve rows
    rows = rows.join(known, F.col("domain_type") == F.col("_type"), "left")
    found = [f for rule in (member_issues, domain_issues, axis_issues, array_issues, tile_issues, parameter_issues, system_issues, language_issues) for f in rule()]
    if check_values:
        found += [*composite_issues(), *order_issues(checker is None), *value_issues()]
    out = _found(rows, found)
    if check_values and checker is not None:
        axes = rows.select("doc_id", F.col("domain_at").alias("path"), "referencing", F.explode(F.filter("axes", _plain)).alias("a"))
        axes = axes.select("doc_id", "path", F.col("a.name").alias("name"), F.col("a.values").alias("values"), ordering(F.col("a.name")).alias("ordering"))
        broken = checker(axes.select("doc_id", "path", "name", F.posexplode("values").alias("pos", "v"), "ordering"))
        out = out.unionByName(_found(broken, [_issue(F.lit(True), "axis.not-monotonic", _below(F.col("path"), "axes", F.col("name"), "values", F.col("pos")), F.col("pos"))]))
    return out


class ValidationError(ValueError):
    """Raised by require_valid; holds the first errors found."""

    def __init__(self, errors: list):
        super().__init__("; ".join(f"{e.doc_id}{e.at}: {e.code}" for e in errors))
        self.errors = errors


def require_valid(documents: DataFrame, check_values: bool = False, most: int = 20) -> None:
    """Raises if documents have errors, with the first `most` by document, code and place; warnings pass."""
    errors = validate(documents, check_values).filter("severity = 'error'").orderBy("doc_id", "code", "at").limit(most).collect()
    if errors:
        raise ValidationError(errors)
