"""Prefix trie of conversations; subtree totals by leaf-peeling message passing.

Every distinct sequence of first turns is a node. A turn in its place is a digest of 124 bits in four parts, and a prefix is the
sum of its turns' digests with its length, so a node's key and its parent's follow from any one of its rows. Positions and sums
are found by scan.running(), which spreads a conversation with very many turns over tasks.

A node is called by its smallest member and its depth. Nodes of one smallest member are a path of the trie, from some depth down
to that conversation's end. Peeling works on paths: each counts the other paths that hang on it and are not done; a path without
such sends its subtree's totals to the node that it hangs on, whose path counts one less; the last one is the root's. So rounds
are as many as paths lie on each other, not as turns do. A last running sum along each path, from its end up, of what its nodes
have and were sent, gives all nodes their totals.

A row with a null conv_id belongs to no conversation. Turns of one number (or null) stand by a digest of role and text; repeated
rows are turns of their own. Null role and text are empty. Very long texts are read once, for their digest and length.
Extra columns are ignored. An empty table gives an empty result; a conversation that loses all its turns is a member of the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, release, stored, trim
from .scan import running

#: Conversations that share turns with the one at the head of their hundred, and the most turns they can share.
FAMILY, MOST_SHARED = 100, 6
KEY = ["depth", "k1", "k2", "k3", "k4"]
PARTS = KEY[1:]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, d1, d2 (digest), points: turns without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("bigint")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), half(1).alias("d1"), half(17).alias("d2"), F.char_length(text).cast("bigint").alias("points"))
    return rows


def _kept(sums: DataFrame) -> DataFrame:
    """What running() gives, in a table of its own."""
    out = stored(sums)
    release(sums)
    return out


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length), and its turns (conv_id, depth from 1 on, k1 to k4, points): the first turns of the head of its hundred, then its own."""
    turns = _kept(running(_turns(conversations), "conv_id", ["turn", "d1", "d2"]))
    counts = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    head = F.expr(f"conv_id - conv_id % {FAMILY}")
    own = counts.withColumn("shared", F.expr(f"crc32(cast(cast(conv_id AS string) AS binary)) % {MOST_SHARED}")).withColumn("head", head)
    heads = own.filter("conv_id = head").select("head", F.col("n").alias("of_head"))
    all_ = stored(own.join(heads, "head", "left").withColumn("taken", F.least("shared", F.coalesce("of_head", F.lit(0)))))
    first = turns.filter(f"position < {MOST_SHARED - 1} AND conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "head")
    taken = all_.select("conv_id", "head", "taken").join(first, "head").filter("position < taken").withColumn("depth", F.col("position") + 1)
    kept = join_counted(turns, all_.select("conv_id", "n", "shared", "taken"), ["conv_id"], "n").filter("position >= shared").withColumn("depth", F.expr("position - shared + taken + 1"))
    rows = taken.unionByName(kept, allowMissingColumns=True)
    place = F.md5(F.concat_ws(" ", "depth", "d1", "d2"))
    part = lambda k: F.conv(F.substring(place, 1 + 8 * k, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2**31 - 1))
    rows = rows.select("conv_id", "depth", *(part(k).alias(c) for k, c in enumerate(PARTS)), "points")
    lengths, rows = stored(all_.select("conv_id", F.expr("taken + greatest(n - shared, 0)").alias("length"))), stored(rows)
    release(turns, counts, all_)
    return lengths, rows


def _chunks(batches):
    """(k.., conv_id), sorted, to rows (k.., first, ids): the decimal ids of a key's rows in a batch, comma-joined."""
    for b in batches:
        if b.num_rows:
            keys = np.stack([b.column(c).to_numpy() for c in KEY], 1)
            ids = b.column("conv_id")
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            texts = ids.cast(pa.string()).to_pylist()
            joined = [",".join(texts[s:e]) for s, e in zip(starts, np.append(starts[1:], len(texts)), strict=True)]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in KEY), ids.take(at), pa.array(joined)], names=[*KEY, "first", "ids"])


def _hashed(batches):
    """(k.., first, ids), sorted, to (k.., ends_sha256); a key may go on over any number of batches."""
    last, digest = None, None
    for b in batches:
        done, hashes = [], []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in KEY), b.column("ids").to_pylist(), strict=True):
            if key == last:
                digest.update(b"," + ids.encode())
            else:
                if last is not None:
                    done.append(last)
                    hashes.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(ids.encode())
        if done:
            yield _digests(done, hashes)
    if last is not None:
        yield _digests([last], [digest.hexdigest()])
    trim()


def _digests(keys: list, hashes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), pa.array(hashes)], names=[*KEY, "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(k.., ends_sha256) from (k.., conv_id), one row a conversation: chunks are joined where ids lie in order, then hashed in order."""
    by, keys = [*KEY, "conv_id"], ", ".join(f"{c} bigint" for c in KEY)
    chunks = last.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, f"{keys}, first bigint, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, f"{keys}, ends_sha256 string")


def _peel(paths: DataFrame) -> DataFrame:
    """(up, up_depth, leaves, saved): the totals that each path (conv_id, up, up_depth, leaves, saved) sends to the node it hangs on."""
    waiting = paths.groupBy(F.col("up").alias("conv_id")).agg(F.count("*").alias("open")).filter("conv_id IS NOT NULL")
    state = stored(paths.join(waiting, "conv_id", "left").fillna(0, ["open"]))
    sent = []
    while True:
        done = stored(state.filter("open = 0 AND up IS NOT NULL").select("up", "up_depth", "leaves", "saved"))
        if not done.head(1):
            break
        sent.append(done)
        came = done.groupBy(F.col("up").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        new = state.filter("open > 0").join(came, "conv_id", "left").fillna(0, ["n", "l", "s"])
        new = stored(new.select("conv_id", "up", "up_depth", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"), (F.col("open") - F.col("n")).alias("open")))
        release(state)
        state = new
    out = state.filter("1 = 0").select("up", "up_depth", "leaves", "saved")
    for done in sent:
        out = out.unionByName(done)
    return out


def _zero(*names: str) -> list[Column]:
    return [F.lit(0).cast("bigint").alias(c) for c in names]


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row a node."""
    lengths, rows = rebuilt(conversations)
    summed = _kept(running(rows, "conv_id", ["depth"], PARTS))
    release(rows)
    last = summed.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", "depth", *(F.col(f"{c}_sum").alias(c) for c in PARTS))
    turnless = lengths.filter("length = 0").select("conv_id", *_zero(*KEY))
    ends = _ends(last.unionByName(turnless))

    sums = [F.col(f"{c}_sum").alias(c) for c in PARTS]
    above = F.struct((F.col("depth") - 1).alias("depth"), *((F.col(f"{c}_sum") - F.col(c)).alias(c) for c in PARTS)).alias("above")
    nodes = summed.select("conv_id", "depth", *sums, "points", above).groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("points").alias("points"), F.first("above").alias("above"))
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(*_zero(*KEY), "n_convs", "conv_id", *_zero("points"))
    nodes = stored(nodes.unionByName(root, allowMissingColumns=True))
    children = nodes.filter("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("n_children")).select("above.*", "n_children")
    parents = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]).join(ends, KEY, "left"))
    named = parents.filter("n_children > 0").select(*(F.col(c).alias(f"above_{c}") for c in KEY), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hung = nodes.filter("above IS NOT NULL").select(*KEY, *(F.col(f"above.{c}").alias(f"above_{c}") for c in KEY))
    hung = join_counted(hung, named, [f"above_{c}" for c in KEY], "n_children").select(*KEY, "parent_conv_id")
    tree = stored(
        parents.join(hung, KEY, "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.expr("if(n_children = 0, 1L, 0L)").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saving"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
    release(lengths, summed, nodes, parents)
    paths = tree.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"), F.min_by(F.struct(F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("up_depth")), "depth").alias("top"))
    sent = _peel(paths.select("conv_id", "top.*", "leaves", "saved"))
    came = sent.groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    own = tree.join(came, ["conv_id", "depth"], "left").fillna(0, ["l", "s"])
    own = own.withColumn("leaf", F.col("leaf") + F.col("l")).withColumn("saving", F.col("saving") + F.col("s")).withColumn("upwards", -F.col("depth")).drop("l", "s")
    total = running(own, "conv_id", ["upwards"], ["leaf", "saving"])
    release(tree)
    return total.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf_sum").alias("n_leaves"), F.col("saving_sum").alias("saved_tokens"), "ends_sha256"
    )


def sql(crc32: str) -> str:
    """The same rows in DuckDB's SQL; crc32: the CRC-32 of the decimal conv_id."""
    return f"""WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS points FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p FROM t),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), c AS (SELECT conv_id, {crc32} % {MOST_SHARED} AS h, conv_id - conv_id % {FAMILY} AS head FROM n),
s AS (SELECT c.*, least(h, coalesce(n, 0)) AS taken FROM c LEFT JOIN n ON n.conv_id = head),
r AS (SELECT s.conv_id, p + 1 AS d, k, points FROM s JOIN o ON o.conv_id = head AND p < taken UNION ALL SELECT s.conv_id, p - h + taken + 1, k, points FROM s JOIN o ON o.conv_id = s.conv_id AND p >= h),
x AS (SELECT conv_id, d, points, md5(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM n),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY d, key) AS node, count(*) OVER (PARTITION BY d, key) AS n_convs, d = max(d) OVER (PARTITION BY conv_id) AS at_end FROM x),
v AS (SELECT a.conv_id, a.d, a.n_convs, (a.n_convs - 1) * a.points AS saving, b.node AS parent FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.d = a.d - 1 WHERE a.node = a.conv_id),
k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.parent = v.conv_id AND k.d = v.d),
u AS (SELECT m.node, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM w JOIN m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY 1, 2),
e AS (SELECT node, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m WHERE at_end GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, w.parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN u ON u.node = w.conv_id AND u.d = w.d LEFT JOIN e ON e.node = w.conv_id AND e.d = w.d"""
