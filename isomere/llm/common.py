"""What the operators of this subpackage share: reading, ASCII lower case, words, checkpoints, skewed joins, word chunks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java or Python regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python in batches of at most 4 MB in this session; whole texts make the usual 64 MB of rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine's only where none is named, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="isomere-checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends here."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again."""
    where = f"{_shared(df.sparkSession)}/{name}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to a folder of its own in the shared checkpoint folder, and read again.

    Unlike those of a checkpoint, its statistics are those of its files; loops need that, as the planner multiplies the
    sizes that it guesses for joins, time after time.
    """
    where = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    back = df.sparkSession.read.schema(df.schema).parquet(where)
    back.stored_in = where
    return back


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of tables that are written within go with the end of their writing, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(*frames: DataFrame) -> None:
    """Removes the files of frames that stored() gave and nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot from this many rows on, and from this share of all rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 1000, 0.005


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """left joined to right, which has one row a key and in `count` the number of left's rows with it.

    Hot keys, at most 1 / HOT_SHARE of them, are broadcast; the others go through a shuffle join. Both inputs are read
    twice, so they should be checkpointed.
    """
    total = right.agg(F.sum(count)).head()[0] or 0
    least = max(HOT_ROWS, total * HOT_SHARE)
    hot, cold = right.filter(F.col(count) >= least), right.filter(F.col(count) < least)
    if not hot.head(1):
        return left.join(right, keys)
    return left.join(F.broadcast(hot), keys).unionByName(
        left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    )


def _forest(batches):
    """Edges (a, b) of each batch to edges from every node to the least one that it reaches within the batch."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]), return_inverse=True)
        top = list(range(len(nodes)))

        def root(x: int, top: list[int] = top) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for a, b in at.reshape(2, -1).T.tolist():
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
        roots = np.array([root(x) for x in range(len(top))], np.int64)
        linked = np.nonzero(roots != np.arange(len(top)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[roots[linked]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b), whole numbers, can reach.

    Tasks first unite their own edges, a batch at a time; alternating large and small stars unite the rest. Each round is
    two joins of edges with one row a node, in which hot nodes are broadcast; the loop ends when a round changes nothing.
    """
    e = stored(edges.filter("a <> b").select("a", "b").mapInArrow(_forest, "a bigint, b bigint").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
        large = stored(join_counted(both, low, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_counted(large, lower, ["a"], "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.unionByName(lower.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        release(e, low, large, lower)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    stars = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    out = stored(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
    release(e)
    return out


def trim() -> None:
    """Gives memory that this process has freed back to the machine, as a worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of text that a task works on at once.
PIECE = 2_000_000


def pieces(batches, column: str = "text", most: int = PIECE):
    """The rows of batches in turn, cut such that each piece holds at most `most` bytes of text or is one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
        trim()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none) in one array, and for each the number of its text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.not_equal(words, "")
    return words.filter(keep), of.filter(keep).to_numpy(zero_copy_only=False)


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the number of each word among them."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
