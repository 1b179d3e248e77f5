"""Ranked lexical search by Fagin's threshold algorithm, over documents dealt in blocks.

Documents become a forward index: one row each with its number of terms and its counts of the asked terms. A task takes the
documents of its rows a block at a time. Of a block it holds the impacts of the asked terms (forward index) and for each term
the documents with it, highest impact first (impact-sorted lists). For each item the lists are read in turn, a round of STEP
postings from each; every document met for the first time has its whole score looked up in the forward index. Reading stops
as soon as the sum of the impacts where the lists stand is strictly below the score of the last place; at equality another
document with a smaller id could still stand there. The best of a task's earlier blocks count as found, so later blocks mostly
stop in the first round. A last window takes the best of all tasks.

Items are asked in groups of at most TERMS terms (or one item), so what tasks get of them is bounded; each group reads the
forward index of its own terms. Sums of impacts stay below 2^53 for any item with less than 400,000 terms, so doubles hold
them exactly.

Null and empty texts have no term: such documents are not counted and never found, such items find nothing. A null doc_id is a
document, first among equal scores. Repeated rows of documents rank beside each other; repeated rows of items give repeated
rows. Very long texts are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, pieces, stored, trim

#: Places an item has. Terms asked at once. Postings of a list that a round reads. Cells of a block's forward index.
PLACES, TERMS, STEP, CELLS = 20, 20_000, 32, 2_000_000
#: Base impact of document lengths: 100 - 25 and 25 hundredths of the length against the mean one.
FIXED, BY_LENGTH = 75, 25

#: Bytes to themselves in lower case, or to a space where they part terms.
_BYTES = np.full(256, 32, np.uint8)
for _x in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTES[_x] = _x
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts (null: none) in one array, and for each the number of its text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    plain = _BYTES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    mapped = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(plain.tobytes()))
    lists = pc.ascii_split_whitespace(mapped)
    terms, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.not_equal(terms, "")
    return terms.filter(keep), of.filter(keep).to_numpy(zero_copy_only=False)


def _asked(batches):
    """(item_id, text, copies) to (item, term, n): the terms of each item with their numbers."""
    for batch in batches:
        terms, of = split_terms(batch.column("text"))
        names, at = numbered(terms)
        cells, n = np.unique(of * max(1, len(names)) + at, return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows, cols = cells // max(1, len(names)), cells % max(1, len(names))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(pa.array(rows)), names.take(pa.array(cols)).cast(pa.string()), pa.array(n.astype(np.int64))], names=["item", "term", "n"]
        )


def _forward(asked: list[str]):
    """(doc_id, text) to (doc_id, n, terms, counts): terms as numbers in `asked`; documents without any term are left out."""
    known = pa.array(asked, pa.large_string())

    def index(batches):
        for batch in pieces(batches):
            words, of = split_terms(batch.column("text"))
            names, at = numbered(words)
            number = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.bincount(of, minlength=batch.num_rows)
            term = number[at] if len(at) else np.zeros(0, np.int64)
            hit = term >= 0
            cells, counts = np.unique(of[hit] * (len(asked) + 1) + term[hit], return_counts=True)
            doc, term = cells // (len(asked) + 1), cells % (len(asked) + 1)
            kept = np.flatnonzero(n)
            ends = np.searchsorted(doc, np.append(kept, batch.num_rows)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (term.astype(np.int32), counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept)), pa.array(n[kept].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
        trim()

    return index


class Best:
    """The best places of one item among the documents seen so far: score descending, then doc_id ascending (null first)."""

    def __init__(self) -> None:
        self.score, self.doc = np.zeros(0), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        least = self.last()
        keep = score >= max(least, 1)
        if keep.any():
            score, doc = np.append(self.score, score[keep]), np.append(self.doc, doc[keep])
            order = np.lexsort((doc, -score))[:PLACES]
            self.score, self.doc = score[order], doc[order]

    def last(self) -> float:
        """The score of the last place; below any score while places are free."""
        return self.score[-1] if len(self.score) == PLACES else -1.0


class Block:
    """Forward index and impact-sorted lists of some documents."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        self.doc, self.impacts = doc, np.zeros((len(doc), terms))
        self.impacts[row, term] = impact
        order = np.lexsort((row, -impact, term))
        self.rows, self.high = row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Adds this block's documents to `best`; how many of them were looked up."""
        starts, ends, seen, looked = self.starts[terms], self.starts[terms + 1], np.zeros(len(self.doc), bool), 0
        stand = starts
        while True:
            there = stand < ends
            # What a document not met yet can score at most: it comes after where each list stands.
            bound = np.where(there, self.high[np.minimum(stand, len(self.high) - 1)], 0.0) @ times if len(self.high) else 0.0
            if not there.any() or bound < best.last() or bound <= 0:
                return looked
            stop = np.minimum(stand + STEP, ends)
            long = stop - stand
            at = np.repeat(stand - (np.cumsum(long) - long), long) + np.arange(long.sum())
            met = np.unique(self.rows[at])
            met = met[~seen[met]]
            seen[met] = True
            looked += len(met)
            if len(met):
                best.add(self.impacts[np.ix_(met, terms)] @ times, self.doc[met])
            stand = stop


#: Stands for a null doc_id within tasks, before every other.
_NULL = np.iinfo(np.int64).min


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int):
    """Forward index rows to (item, doc_id, score): the best of the task's documents for each item."""

    def best_of(batches):
        best = [Best() for _ in items]
        size = max(1, CELLS // max(1, len(weights)))
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                n = b.column("n").to_numpy(zero_copy_only=False)
                lists = b.column("terms")
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                tf = pc.list_flatten(b.column("counts")).to_numpy(zero_copy_only=False).astype(np.int64)
                mean = FIXED + BY_LENGTH * n * documents // length
                impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * mean[row]))
                held = impact > 0
                doc = pc.fill_null(b.column("doc_id").cast(pa.int64()), _NULL).to_numpy(zero_copy_only=False)
                block = Block(doc, row[held], term[held], impact[held].astype(float), len(weights))
                for k, (_, terms, times) in enumerate(items):
                    block.search(terms, times, best[k])
        for (item, _, _), b in zip(items, best, strict=True):
            docs = pa.array(b.doc, mask=b.doc == _NULL)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.doc), item)), docs, pa.array(b.score.astype(np.int64))], names=["item", "doc_id", "score"])
        trim()

    return best_of


def _group(documents: DataFrame, asked: list) -> DataFrame:
    """(item, doc_id, score): the candidates of all tasks for the items of `asked`, rows of (item, term, n)."""
    spark = documents.sparkSession
    number = {t: k for k, t in enumerate(sorted({r.term for r in asked}))}
    index = stored(documents.select("doc_id", "text").mapInArrow(_forward(list(number)), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"))
    total = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = held.select("term", F.floor(1000 * F.log((2 * F.lit(total.documents) + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
    weights = np.zeros(len(number), np.int64)
    for r in weight:
        weights[r.term] = r.w
    items: dict[int, list] = {}
    for r in asked:
        items.setdefault(r.item, []).append((number[r.term], r.n))
    plain = [(i, np.array([t for t, _ in x]), np.array([float(n) for _, n in x])) for i, x in sorted(items.items())]
    if not total.documents:
        return spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    return index.mapInArrow(_search(plain, weights, total.documents, total.terms), "item bigint, doc_id bigint, score bigint")


def search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the PLACES best documents of each row of items (item_id, text) with a score above 0."""
    own = stored(items.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("item", F.monotonically_increasing_id()))
    terms = stored(own.select("item", "text").mapInArrow(_asked, "item bigint, term string, n bigint"))
    # Items stand in groups by a hash, such that groups hold TERMS terms in the mean.
    groups = -(-terms.count() // TERMS)
    dealt = F.pmod(F.xxhash64("item"), F.lit(max(1, groups)))
    found = None
    for k in range(groups):
        part = _group(documents, terms.filter(dealt == k).collect())
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= PLACES)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return best.join(own.drop("text"), "item").withColumn("copy", copies).select("item_id", "rank", "doc_id", "score")


TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {TERM}) AS t FROM documents),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM n),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY 1),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {TERM}) AS t FROM benchmark),
q AS (SELECT i, item_id, t, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(t) AS t FROM i) GROUP BY 1, 2, 3),
x AS (SELECT i, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (r), s GROUP BY 1, 2, 3, 4),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20"""
