"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks. Blocks are shuffled by content and sorted, and each distinct block gets an integer
name; then adjacent names are paired and the pairs are named in the same way, until each document has one name. Names are
given to sorted keys and never derived from a hash, so two documents share a name only if their texts are equal.

Null texts count as empty, and empty texts equal each other. A null doc_id is larger than any other. Of repeated rows
(the same doc_id and text) one stays. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, join_counted, stored

BLOCK_CHARS = 4096


def normalised(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, pos) to one row a key of each batch, with the lists of its rows and positions."""
    for b in batches:
        if not b.num_rows:
            continue
        d = b.column("key").cast(pa.large_string()).dictionary_encode()
        of = d.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(d.dictionary)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), b.column(c).take(pa.array(order))) for c in ("row", "pos")]
        yield pa.RecordBatch.from_arrays([d.dictionary.cast(pa.string()), *lists], names=["key", "row", "pos"])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys of one partition to (row, pos, name): the partition's number and the key's rank within it."""
    from pyspark import TaskContext

    base, rank, last = TaskContext.get().partitionId() << 40, -1, None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").cast(pa.large_string())
        new = np.ones(len(key), bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        new[0] = key[0].as_py() != last
        ranks = rank + np.cumsum(new)
        rank, last = int(ranks[-1]), key[-1].as_py()
        sizes = pc.list_value_length(b.column("row")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pc.list_flatten(b.column("row")), pc.list_flatten(b.column("pos")), pa.array(np.repeat(base + ranks, sizes))],
            names=["row", "pos", "name"],
        )


def name_keys(cells: DataFrame) -> DataFrame:
    """(key string, row, pos) to (row, pos, name long): equal keys and no others share a name.

    Equal keys of a batch are put together before the shuffle, so a key that a third of all rows hold is dealt as one row a batch.
    """
    gathered = cells.select("key", "row", "pos").mapInArrow(_gather, "key string, row array<bigint>, pos array<int>")
    by_key = gathered.repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(_name, "row bigint, pos int, name bigint")


def identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, id, text_sha256, size, name) of every row of docs: texts are equal when size and name are."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t")
    )
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = base.select("row", F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(blocks).alias("blocks"))
    cells = cut.select("row", F.posexplode("blocks").alias("pos", "key"))
    rows = base.select("row", "id", F.sha2("t", 256).alias("text_sha256"))
    names = checkpoint(name_keys(cells))
    sizes = names.groupBy("row").agg((F.max("pos") + 1).alias("size"))
    open_ = names.join(sizes.filter("size > 1"), "row", "left_semi")
    done = [names.join(sizes.filter("size = 1"), "row", "left_semi").select("row", "name")]
    while open_.head(1):
        half = F.floor(F.col("pos") / 2).cast("int")
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = open_.groupBy("row", half.alias("pos")).agg(F.concat_ws(":", left, right).alias("key"))
        named = checkpoint(name_keys(pairs))
        left_over = named.filter("pos > 0").select("row").distinct()
        done.append(named.join(left_over, "row", "left_anti").select("row", "name"))
        open_ = named.join(left_over, "row", "left_semi")
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    return checkpoint(rows.join(sizes, "row").join(last, "row"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size long, kept boolean, text_sha256 string."""
    rows = identities(docs, text_col, id_col, block_chars)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = checkpoint(rows.groupBy("size", "name").agg(first, F.count("*").alias("group_size")))
    joined = join_counted(rows, groups, ["size", "name"], "group_size")
    return joined.select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns."""
    found = stored(exact_dedup(docs, text_col, id_col).select("doc_id", "text_sha256", "kept"))
    keep = found.filter("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    again = stored(found.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("__again_id"), F.col("text_sha256").alias("__again_sha")))
    own = docs.withColumn("__own_sha", F.sha2(normalised(F.col(text_col)), 256))
    same = (F.col("__own_sha") == F.col("__keep_sha")) & F.col(id_col).eqNullSafe(F.col("__keep_id"))
    kept = own.join(keep, same, "left_semi")
    if again.head(1):  # only rows that stand there twice, with id and text, need be put together
        twice = (F.col("__own_sha") == F.col("__again_sha")) & F.col(id_col).eqNullSafe(F.col("__again_id"))
        kept = kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates([id_col, "__own_sha"]))
    return kept.select(docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""
