"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: clauses that must all hold, each with alternative strings, each
string standing for all its trigrams. The index holds, for every trigram that some query names, the ids of the documents
with it (in ASCII lower case, so it serves patterns in either case); a query intersects postings, and only its candidates
are verified with the pattern. Patterns without mandatory trigrams scan every text. DataFrame and SQL functions only.

Null texts count as empty. Rows with a null doc_id are not in the index, so every pattern scans them. Repeated rows give
repeated results, repeated ids share candidates (verification settles them), extra columns are ignored and an empty table
gives an empty result. Of overlapping matches of one kind the leftmost counts, and different kinds may overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """group: the part whose length counts; least: its least number of characters; base: one of the fixed kinds."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# Fixed patterns. The first three are the base kinds in the order of their listing.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
]

#: More alternatives than this are not spelled out in a query; the clause then ends there.
MOST_STRINGS = 64


def _strings(tokens) -> set[str] | None:
    """All strings that tokens match, or None if they are many."""
    out = {""}
    for op, arg in tokens:
        if op is c.LITERAL:
            new = {chr(arg)}
        elif op is c.IN and all(o is c.LITERAL for o, _ in arg):
            new = {chr(x) for _, x in arg}
        elif op is c.SUBPATTERN:
            new = _strings(arg[3])
        elif op is c.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            new = None if None in parts else set().union(*parts)
        elif op is c.MAX_REPEAT and arg[1] <= 4:
            part = _strings(arg[2])
            new = part and set().union(*({x * k for x in part} for k in range(arg[0], arg[1] + 1))) if part and (len(part) == 1 or arg[1] == 1) else None
        else:
            new = None
        if not new or len(out) * len(new) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in new}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses of which all must hold; each lists sets of lower-case trigrams of which one must be present as a whole."""
    runs, current = [], {""}
    for token in parser.parse(pattern):
        new = _strings([token])
        if new and len(current) * len(new) <= MOST_STRINGS:
            current = {a + b for a in current for b in new}
        else:
            runs.append(current)
            current = new or {""}
    clauses = []
    for run in [*runs, current]:
        sets = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if sets and all(sets):
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for each of the trigrams and each document (doc_id, text) with it."""
    lower = docs.filter("doc_id is not null").select("doc_id", ascii_lower(F.col("text")).alias("lower"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("lower"), t))
    return lower.select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(doc_id, kinds): the kinds whose trigram query each document meets."""
    rows = [(k, i, j, len(s), t) for k, q in queries.items() for i, sets in enumerate(q) for j, s in enumerate(sets) for t in sorted(s)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, clause int, choice int, of int, trigram string")
    need = reduce(lambda e, x: F.when(F.col("kind") == x[0], len(x[1])).otherwise(e), queries.items(), F.lit(0))
    whole = (
        index.join(F.broadcast(asked), "trigram")  # as many rows as the patterns have trigrams
        .groupBy("doc_id", "kind", "clause", "choice", "of").agg(F.count("*").alias("n")).filter("n = of")
    )
    met = whole.groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("n")).filter(F.col("n") == need)
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches in text: structs (start, number, end, kind) in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>").alias("out"))
    parts = F.arrays_zip(found.alias("m"), held.alias("g"), F.slice(between, 1, F.size(found)).alias("b"))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.char_length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    listed = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    return F.when(F.size(F.regexp_extract_all(text, F.lit(_quick(rule)), F.lit(0))) > 0, listed).otherwise(zero["out"])


def _quick(rule: Rule) -> str:
    """A pattern that matches in every text where the rule has a match that counts."""
    if rule.kind == "hex":
        return f"[0-9a-f]{{{rule.least},}}+"
    return rule.pattern


def listed(found: Column) -> Column:
    ordered = F.array_sort(found)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of the base kinds (long), base_sha256, spans, found (all spans as structs)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for sets in q for s in sets for t in s})
    met = candidates(postings(own, trigrams), queries) if queries else None
    rows = own.join(met, "doc_id", "left") if met is not None else own.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    for n, r in enumerate(rules):
        wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in queries else F.lit(True)
        rows = rows.withColumn(f"_{n}", F.when(wanted, spans(F.col("text"), r, n)).otherwise(none))
    every, base = (F.concat(*[F.col(f"_{n}") for n, r in enumerate(rules) if r.base or not only]) for only in (False, True))
    return rows.select(
        "doc_id", *[F.size(f"_{n}").cast("long").alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), F.array_sort(every).alias("found"),
    )


def sql(rules: list[Rule] = RULES) -> str:
    """The same result in DuckDB, every pattern scanning every text."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, r in enumerate(rules):
        parts.append(f"""SELECT doc_id, {n} AS number, {q(r.kind)} AS kind, {str(r.base).lower()} AS base, {r.least} AS least,
            regexp_extract_all(t, {q(r.pattern)}, 0) AS m, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS g, string_split_regex(t, {q(r.pattern)}) AS b FROM d""")
    counts = ", ".join(f"count(*) FILTER (kind = {q(r.kind)}) AS n_{r.kind}" for r in rules if r.base)
    one = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
    i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM m),
    l AS (SELECT doc_id, number, kind, base, k, least, len(m[k]) AS ml, len(g[k]) AS gl, len(b[k]) AS bl FROM i),
    p AS (SELECT *, sum(ml + bl) OVER (PARTITION BY doc_id, number ORDER BY k) AS e FROM l),
    f AS (SELECT doc_id, number, kind, base, e::BIGINT AS e, (e - ml)::BIGINT AS s FROM p WHERE gl >= least),
    a AS (SELECT doc_id, {counts}, coalesce(string_agg({one}, ',' ORDER BY s, number) FILTER (base), '') AS bases,
        string_agg({one}, ',' ORDER BY s, number) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)},
        sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
