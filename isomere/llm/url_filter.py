"""URL filters: fixed host rules, and association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host labels, top-level domain, path segments, query keys). Token combinations that are
frequent together with the label are found by Spark's FP-growth; rules below the confidence, support or lift wanted, and
rules that a part of their tokens implies with no less confidence, are pruned. A rule is indexed under its rarest token; a
URL looks up its tokens in that index, and candidates are verified against the whole rule. DataFrame, SQL and Spark ML only.

Labels must belong to URLs. The query's are the verdicts of the fixed rules on all pages, so mined rules carry these over to
URLs that have the same tokens in other places.

A null URL, or one without ://, has empty host and path, no tokens, and is allowed. Repeated rows give repeated results,
null page_ids are kept, extra columns are ignored, an empty table gives an empty result, and without labels no rule is mined.
Very long URLs are read whole. Of equally rare tokens a rule is indexed under the first by name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed rules of the query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Of the mined rules: least share and least number of the labelled URLs, least confidence, least lift.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 20, 0.8, 1.2
LABEL = "label=block"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, like com/en/, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; runs of digits count as one sign, so page numbers don't make tokens of their own."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    query = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    generic = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)), F.concat(F.lit("tld:"), F.element_at(labels, -1))),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), generic(x))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), generic(x))),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def by_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Labels (url, block) of all URLs: whether a fixed rule blocks them."""
    urls = pages.select(F.col(url_col).alias("url")).filter("url is not null")
    verdict = fixed_rule(host(F.col("url")), path(F.col("url")), rules)[1]
    return urls.select("url", F.coalesce(verdict == "block", F.lit(False)).alias("block"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules (antecedent, confidence, support, rarest) for blocking, from labelled (url, block boolean).

    The least support bounds the tokens kept, by their number a URL over min_support, whatever the number of URLs; the least
    count keeps a few URLs of a small table from making a rule.
    """
    min_support = min(1.0, max(min_support, min_count / max(1, labelled.count())))
    baskets = labelled.select(F.when(F.col("block"), F.array_append(tokens(F.col("url")), LABEL)).otherwise(tokens(F.col("url"))).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(
        (F.element_at("consequent", 1) == LABEL) & (F.col("lift") >= min_lift) & (F.col("support") >= min_support)
    ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("left_out")).select(
        "antecedent", "confidence", F.array_except("antecedent", F.array("left_out")).alias("part")
    )
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    implied = parts.join(shorter, "part").filter("part_confidence >= confidence").select("antecedent")
    rules = rules.join(implied, "antecedent", "left_anti")
    seen = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("token")).join(seen, "token")
        .groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    )
    return rules.join(rarest, "antecedent")


def url_filter(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", **limits: float) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined (the number of mined rules that fit)."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    mined = mine(labelled, **limits)
    distinct = own.select("url").filter("url is not null").distinct()
    looked_up = distinct.select("url", tokens(F.col("url")).alias("items")).withColumn("rarest", F.explode("items"))
    fits = (
        looked_up.join(mined.select("rarest", "antecedent"), "rarest")
        .filter(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("url").agg(F.count("*").alias("mined"))
    )
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        own.select("page_id", "url", h.alias("host"), p.alias("path")).join(fits, "url", "left")
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("mined") > 0, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("mined", F.lit(0)).alias("mined"),
        )
    )
