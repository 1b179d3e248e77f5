"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic), and the cells' weights are raked: scaled in turn so that the sums by
source, by language and by topic meet their targets, until no sum is off by more than TOLERANCE. Sampling probabilities are
the raked weights over the cells' tokens, times one factor such that the expected tokens meet the budget with no probability
above 1. A document is sampled if a hash of its id, mapped to [0, 1), is below its cell's probability.

Targets are the natural shares to the power TEMPERATURE for sources, and given weights or equal shares for languages and
topics; a value that a marginal gives no weight keeps its natural share. Where targets contradict each other (a source of
one language only), the last fit of the loop holds. Null sources, languages and ids count as values of their own. Texts
without a word have no tokens and are not sampled. Repeated rows get the same decision, extra columns are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpoint

TEMPERATURE, BUDGET = 0.7, 0.5
TOLERANCE, MOST_LOOPS = 1e-3, 30
#: Cells are broadcast up to this number, and shuffled to the documents beyond.
MOST_CELLS = 50_000
MARGINALS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    """A text's kind of content: the first of these signs that it shows."""
    t = F.coalesce(text, F.lit(""))
    head = F.regexp_replace(t, SPACE, " ")
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.regexp_like(t, F.lit(r"\w@\w")), "contact")
        .when(F.regexp_like(t, F.lit(r"[#*$%&]{3}")), "symbols")
        .when(F.upper(head) == head, "capitals")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(cells: DataFrame, by: str, given: dict[str, float] | None) -> DataFrame:
    """(value, target) of one marginal, the targets summing to 1."""
    sums = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t"))
    total = sums.agg(F.sum("t"), F.sum(F.pow("t", F.lit(TEMPERATURE))), F.count("*")).head()
    if by == "source" and given is None:
        want = F.pow("t", F.lit(TEMPERATURE)) / F.lit(total[1])
    elif given is None:
        want = F.lit(1.0) / F.lit(total[2])
    else:
        pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
        want = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(by)), F.col("t") / F.lit(total[0]))
    raw = sums.select(by, want.alias("want"))
    all_ = raw.agg(F.sum("want")).head()[0]
    return raw.select(by, (F.col("want") / F.lit(all_)).alias("want"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None]) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with weight, summing to 1.

    A loop shuffles the cells once for each marginal; what meets in a group is cells, never documents.
    """
    now = cells
    for by in MARGINALS:
        want = _targets(cells, by, targets.get(by)).select(F.col(by).alias("_by"), F.col("want").alias(f"want_{by}"))
        now = now.join(want, now[by].eqNullSafe(F.col("_by"))).drop("_by")
    now = checkpoint(now.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(MOST_LOOPS):
        off = F.lit(0.0)
        for by in MARGINALS:
            now = now.withColumn("have", F.sum("weight").over(Window.partitionBy(by)))
            now = now.withColumn(f"off_{by}", F.abs(F.col("have") / F.col(f"want_{by}") - 1))
            now = now.withColumn("weight", F.col("weight") * F.col(f"want_{by}") / F.col("have"))
            off = F.greatest(off, F.col(f"off_{by}"))
        now = checkpoint(now)
        if now.agg(F.max(off)).head()[0] <= TOLERANCE:
            break
    return now.select(*MARGINALS, "tokens", "docs", "weight")


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with prob: weight / tokens times the factor for which the expected tokens are budget of all, at most 1."""
    total, factor = cells.agg(F.sum("tokens")).head()[0], 0.0
    while True:  # each time more cells are full; it ends when none is added
        full = F.col("weight") * F.lit(factor) >= F.col("tokens")
        taken, free, n = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).head()
        left = budget * total - taken
        new = left / free if free and left > 0 else factor
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(factor) / F.col("tokens")))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, budget: float = BUDGET, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, weight of its cell, prob, sampled."""
    own = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", topic(F.col(text_col)).alias("topic"), tokens(F.col(text_col)).alias("tokens"))
    own = checkpoint(own)
    cells = checkpoint(own.filter("tokens > 0").groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    if not cells.head(1):
        return own.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("prob"), F.lit(False).alias("sampled"))
    found = checkpoint(calibrate(rake(cells, targets or {}), budget))
    return join_cells(own, found, seed)


def bounded(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= MOST_CELLS else cells


def join_cells(own: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """own with weight, prob and sampled of the cells; the join is on values, of which any may be null or held by most rows."""
    sides = [*MARGINALS]
    rows = found.select(*[F.col(c).alias(f"__{c}") for c in sides], "weight", "prob")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in sides]
    joined = own.join(bounded(rows), same[0] & same[1] & same[2], "left")
    return joined.select(
        "doc_id", *sides, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("prob", F.lit(0.0)).alias("prob"),
        (draw(F.col("doc_id"), seed) < F.coalesce("prob", F.lit(0.0))).alias("sampled"),
    )


def sample(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, budget: float = BUDGET, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of docs, with their columns."""
    mixed = mix(docs, targets, budget, seed, id_col, text_col)
    cells = mixed.groupBy(*MARGINALS).agg(F.max("weight").alias("weight"), F.max("prob").alias("prob"))
    names = {c: f"__{c}" for c in (*MARGINALS, "weight", "prob")}
    cells = checkpoint(cells.withColumnsRenamed(names))
    kind = topic(F.col(text_col))
    same = docs["source"].eqNullSafe(F.col("__source")) & docs["lang"].eqNullSafe(F.col("__lang")) & kind.eqNullSafe(F.col("__topic"))
    some = tokens(F.col(text_col)) > 0
    return docs.join(bounded(cells), same).filter(some & (draw(F.col(id_col), seed) < F.col("__prob"))).select(docs.columns)
