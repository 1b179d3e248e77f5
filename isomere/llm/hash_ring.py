"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame and SQL functions only.

Each shard stands at NODES places of a ring of 2^32 places, and a document at the place of its doc_id's hash; its home is the
next node clockwise. A shard takes at most its share of all rows, with some slack if wanted. Homes are filled first, node by
node along the ring; rows of a node whose shard is full go on clockwise to the next shards that are not. Shares without slack
differ by at most one and are all taken, so the numbers of rows do as well (law `rows`).

Where rows go depends on the numbers of rows at the nodes only. There are shards * NODES of them, so that table is small
whatever the input's size; homes are filled by windows over it, and the overflow by a fold over its rows in SQL. What comes out
are runs of rows along the ring, each with its shard. Rows are sorted along the ring by ranges, without texts, and numbered by
their partition's offset; a row's run and its slot follow from its number. No window or group holds the rows of a node, shard
or id, so rows of one id, however many, are spread over tasks.

A null doc_id stands at the place of the empty text. Null and empty texts have 8 bytes and a CRC of 0. Repeated rows are rows
of their own, in slots of their own; rows of one id stand in the order of their texts' CRC and size. Very long texts are read
whole, once. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stored

#: Virtual nodes of a shard. Cells of the ring, in which nodes are looked up.
NODES, CELLS = 128, 4096
_PLACES = 2**32


def _place(text: Column) -> Column:
    """The first 32 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """(node, shard, from, to): the nodes numbered clockwise, each with the places whose home it is."""
    own = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("k"))
    own = own.withColumn("place", _place(F.concat_ws(" ", "shard", "k"))).groupBy("place").agg(F.min("shard").alias("shard"))
    along = Window.orderBy("place")
    return own.select(
        (F.row_number().over(along) - 1).alias("node"), "shard", (F.coalesce(F.lag("place").over(along), F.lit(-1)) + 1).alias("from"), F.col("place").alias("to")
    )


def _shares(nodes: DataFrame, shards: int, slack: float) -> DataFrame:
    """nodes (node, shard, n) with what each keeps for its shard, what it passes on, and the shard's free places after that."""
    total = F.ceil(F.sum("n").over(Window.partitionBy()) * (1 + slack))
    share = F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)")
    before = Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    kept = nodes.withColumn("total", total).withColumn("share", share).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    kept = kept.withColumn("home", F.greatest(F.lit(0), F.least("n", F.col("share") - F.col("before"))))
    return kept.withColumn("over", F.col("n") - F.col("home")).withColumn("free", F.col("share") - F.sum("home").over(Window.partitionBy("shard")))


#: One row (nodes: the shards clockwise; free: by shard; over: (node, n) along the ring) to runs (node, shard, n).
_OVERFLOW = """aggregate(over, named_struct('free', free, 'runs', cast(array() AS array<struct<node:int,shard:int,n:bigint>>)), (a, x) ->
  aggregate(array_distinct(concat(slice(nodes, x.node + 1, size(nodes)), slice(nodes, 1, x.node))), named_struct('left', x.n, 'free', a.free, 'runs', a.runs),
    (b, s) -> if(least(b.left, element_at(b.free, s + 1)) <= 0, b, named_struct(
      'left', b.left - least(b.left, element_at(b.free, s + 1)),
      'free', transform(b.free, (f, k) -> if(k = s, f - least(b.left, f), f)),
      'runs', concat(b.runs, array(named_struct('node', x.node, 'shard', s, 'n', least(b.left, element_at(b.free, s + 1))))))),
    b -> named_struct('free', b.free, 'runs', b.runs)), a -> a.runs)"""


def runs(nodes: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """nodes (node, shard, n) to (node, shard, start, n, slot): runs of rows of a node, from number `start` among the node's
    rows on, that go to a shard, from `slot` on."""
    shares = _shares(nodes, shards, slack)
    one = shares.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", "shard"))), lambda x: x["shard"]).alias("nodes"),
        F.array_sort(F.collect_list(F.when(F.col("over") > 0, F.struct("node", F.col("over").alias("n"))))).alias("over"),
        F.array_sort(F.collect_set(F.struct("shard", "free"))).alias("by_shard"),
    ).select("nodes", "over", F.expr(f"transform(sequence(0, {shards - 1}), s -> coalesce(element_at(filter(by_shard, x -> x.shard = s), 1).free, 0L))").alias("free"))
    passed = one.select(F.posexplode(F.expr(_OVERFLOW)).alias("turn", "run")).select("run.node", "run.shard", "run.n", (F.col("turn") + 1).alias("turn"))
    home = shares.filter("home > 0").select("node", "shard", F.col("home").alias("n"), F.lit(0).alias("turn"))
    before = lambda *by: Window.partitionBy(by[0]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return home.unionByName(passed).select(
        "node", "shard", F.coalesce(F.sum("n").over(before("node", "turn")), F.lit(0)).alias("start"), "n", F.coalesce(F.sum("n").over(before("shard", "turn", "node")), F.lit(0)).alias("slot")
    )


def shard(docs: DataFrame, shards: int, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("place", _place(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    width = _PLACES // CELLS
    # Places after the last node belong to the first.
    around = ring(docs.sparkSession, shards, nodes)
    last = around.agg(F.max("to").alias("last")).head().last
    around = stored(around.unionByName(around.filter("node = 0").select("node", "shard", F.lit(last + 1).alias("from"), F.lit(_PLACES - 1).alias("to"))))
    cells = around.withColumn("cell", F.explode(F.sequence(F.expr(f"from div {width}"), F.expr(f"to div {width}")))).select("node", "from", "to", "cell")
    rows = rows.withColumn("cell", F.expr(f"place div {width}")).join(F.broadcast(cells), "cell").filter("place BETWEEN from AND to").drop("cell", "from", "to")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))

    along = ["node", "place", "doc_id", "text_crc32", "size", "row"]
    lined = stored(rows.repartitionByRange(*along).sortWithinPartitions(*along).drop("row", "place").withColumn("at", F.monotonically_increasing_id()))
    release(rows)
    part = F.shiftright("at", 33).alias("part")
    counts = lined.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("at").bitwiseAND(F.lit(2**33 - 1))

    held = around.groupBy("node").agg(F.min("shard").alias("shard")).join(lined.groupBy("node").agg(F.count("*").alias("n")), "node", "left").fillna(0, ["n"])
    held = stored(held.withColumn("first", F.sum("n").over(Window.orderBy("node")) - F.col("n")))
    where = stored(runs(held.select("node", "shard", "n"), shards, slack).join(held.select("node", "first"), "node").select("node", "shard", (F.col("first") + F.col("start")).alias("start"), "n", "slot"))

    release(around, held)
    numbered = lined.select("*", part).join(F.broadcast(offsets), "part").withColumn("number", number)
    placed = numbered.join(F.broadcast(where), "node").filter("number >= start AND number < start + n")
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("number") - F.col("start")).alias("slot"))


def query(docs: DataFrame, shards: int = 24) -> DataFrame:
    """As shard(), with the law that holds; one more shard may move rows between others, so `grown_shard` is null."""
    return shard(docs, shards).select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def sql(shards: int = 24, nodes: int = NODES) -> str:
    """The same rows in DuckDB's SQL; rows of one id whose text and size are the same are told apart by their slots only."""
    place = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    # Remainders of the sixteen half bytes: fixed values of CRC-32.
    half = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    step = f"xor(d >> 4, {half}[(d & 15) + 1])"
    bytes_ = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
    byte = f"list_reduce([xor(c, b), 0::BIGINT, 0::BIGINT], lambda d, z: {step})"
    return f"""WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {place("coalesce(doc_id::VARCHAR, '')")} AS place,
xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: {byte}), 4294967295::BIGINT) AS text_crc32 FROM documents),
g AS (SELECT place, min(s) AS s FROM (SELECT s, {place("s || ' ' || k")} AS place FROM range({shards}) a(s), range({nodes}) b(k)) GROUP BY 1),
v AS (SELECT place, s, row_number() OVER (ORDER BY place) - 1 AS v FROM g), m AS (SELECT count(*) AS m FROM v),
h AS (SELECT r.*, coalesce(v.v, 0) AS v FROM r ASOF LEFT JOIN v ON r.place <= v.place),
l AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY place, doc_id NULLS FIRST, text_crc32, size, r) - 1 AS i FROM h), t AS (SELECT count(*) AS t FROM r),
n AS (SELECT v.v, v.s, count(l.r) AS n FROM v LEFT JOIN l USING (v) GROUP BY 1, 2),
a AS (SELECT n.*, t // {shards} + CASE WHEN s < t % {shards} THEN 1 ELSE 0 END AS share, sum(n) OVER (PARTITION BY s ORDER BY v) - n AS before FROM n, t),
b AS (SELECT *, greatest(0, least(n, share - before))::BIGINT AS home FROM a), free AS (SELECT list(f ORDER BY s) AS free FROM (SELECT s, (any_value(share) - sum(home))::BIGINT AS f FROM b GROUP BY 1)),
o AS (SELECT v, (n - home)::BIGINT AS n, row_number() OVER (ORDER BY v) AS turn FROM b WHERE n > home),
w AS (SELECT turn, s, row_number() OVER (PARTITION BY turn ORDER BY far) AS k FROM (SELECT turn, v.s, min((v.v - o.v + m) % m) AS far FROM o, v, m GROUP BY 1, 2)),
q AS (SELECT row_number() OVER (ORDER BY turn, k) AS q, w.*, o.v, o.n FROM w JOIN o USING (turn)),
f AS (SELECT 0::BIGINT AS q, 0::BIGINT AS v, 0::BIGINT AS s, 0::BIGINT AS took, 0::BIGINT AS rest, free FROM free
UNION ALL SELECT z.q, z.v, z.s, z.took, z.rest - z.took, list_transform(z.free, lambda e, i: CASE WHEN i = z.s + 1 THEN e - z.took ELSE e END)
FROM (SELECT q.q, q.v, q.s, CASE WHEN q.k = 1 THEN q.n ELSE f.rest END AS rest, least(CASE WHEN q.k = 1 THEN q.n ELSE f.rest END, f.free[q.s + 1]) AS took, f.free FROM f JOIN q ON q.q = f.q + 1) z),
p AS (SELECT v, s, home AS n, 0 AS turn FROM b WHERE home > 0 UNION ALL SELECT v, s, took, q FROM f WHERE took > 0),
y AS (SELECT v, s, n, sum(n) OVER (PARTITION BY v ORDER BY turn) - n AS start, sum(n) OVER (PARTITION BY s ORDER BY turn, v) - n AS slot FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, y.s::INTEGER AS shard, (slot + i - start)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM l JOIN y ON l.v = y.v AND i >= start AND i < start + y.n"""
