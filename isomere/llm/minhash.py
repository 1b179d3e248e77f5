"""MinHash near-dedup with SuperMinHash signatures.

A text's set is that of its distinct shingles of `words` words. Each shingle ranks the SIGNATURE places by a permutation
drawn from its hash, and a place keeps the smallest of rank plus a fraction; since the ranks of one shingle are all
different, the estimates vary less than with independent hashes, and once every place has a rank no later one can beat, the
text is done. Texts with the same set form one class, and classes that agree in a band of ROWS places meet in a bucket.

In a bucket each class is verified on full sets against the hub, the class that meets most others, as the text that copies
were made from does; so a group of copies costs one comparison a copy; buckets of the same texts have one hub between them. Then the classes of buckets of up to SMALL are paired
where they are not of one component yet. Two classes x and y of a larger bucket whose pair is still open, since at least x is
unlike the hub p, need not be compared one by one. If no shingle outside p is in both, what they
share is in x and p, so they are alike at most if y is smaller than p, and only by a little:

* they share a shingle that p lacks: each class posts its shingles that p lacks, and pairs come from equal posts. From the
  number of posts that a pair shares, and from what each shares with p, follows a bound of what the two share; pairs below
  the wanted similarity go, the others are verified on full sets. A post with more than SHORT classes is a bucket of its own
  and gets a hub in the next round. Of two alike classes each must share that part of its set with the other which it doesn't
  share with p, its need. So the least SHARED shingles that they share are among all but the last of either's own, by hash,
  as many as its need less SHARED. These first ones are posted first; a class with fewer shared posts than SHARED, or than its
  need, has no partner here and goes. The others post all, and those go whose shared posts are fewer than they need. Thus a
  passage that many texts have in common doesn't make their own shingles posts, nor itself buckets.
* or y is smaller than p: then x lacks all but a few of the shingles of p that y lacks. y posts so many of those that x must
  lack one of them, and x, if near enough to p, posts all that it lacks.

So every pair that meets is either linked already, or excluded by its sizes, or verified. Groups are connected components,
by union-find within tasks and alternating stars between them.

A text with fewer words than a shingle is one shingle; null, empty and blank texts have no set, link to nothing and stay.
component_id is the smallest doc_id of the group (null if all are null). Of repeated rows one stays. Very long texts have
sets of any size; such a set is held by one task at a time with its hub's. Equally good hubs are told apart by class number,
which changes no link. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, join_counted, numbered, pieces, release, split_words, stored

#: At similarity 0.8 a pair meets in no band with a chance of (1 - 0.8 ** 7) ** 50, or 8 in a million.
BANDS, ROWS = 50, 7
SIGNATURE = BANDS * ROWS
#: Places that are ranked: the least prime number from SIGNATURE on.
PLACES = 353
#: Classes of a bucket, and of a post, that are paired one by one; a post with more is a bucket of the next round.
SMALL, SHORT = 16, 64
#: Posts that two alike classes must share among the first of each, if they share so many; only then all are posted.
SHARED = 16
#: Rounds after which long posts are paired as well, as they are before if that gives fewer pairs than buckets have members.
ROUNDS = 12
#: Bytes of text whose signatures are made at once.
AT_ONCE = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): of each text its distinct shingles as sorted 64-bit hashes, from ends[i] to ends[i + 1]."""
    flat, of = split_words(texts)
    names, at = numbered(flat)
    hashes = pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False) if len(names) else np.zeros(0, U)
    h = hashes[at].astype(U)
    n = np.bincount(of, minlength=len(texts))
    size = np.minimum(n, words)[of]  # of each word's text, the words of its shingles
    within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    first = within + size <= n[of]
    starts = np.nonzero(first)[0]
    value = mix(size[starts].astype(U))
    for k in range(words):
        more = size[starts] > k
        value[more] = mix(value[more] ^ h[starts[more] + k])
    owner = of[starts]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of SIGNATURE values for each set; infinite where the set is empty.

    The permutation of a shingle goes round PLACES, a prime number, from a place and by a stride that its hash gives.
    """
    sets = len(ends) - 1
    owner = np.repeat(np.arange(sets), np.diff(ends)) * PLACES
    out = np.full(sets * PLACES, np.inf)
    own = mix(hashes)
    place, stride = ((own >> U(32)) % U(PLACES)).astype(np.int64), (1 + (own & U(0xFFFFFFFF)) % U(PLACES - 1)).astype(np.int64)
    for j in range(PLACES):
        part = mix(own + U(j + 1)) >> U(32)
        np.minimum.at(out, owner + place, j + part.astype(np.float64) / 2.0**32)
        stay = (out.reshape(sets, PLACES).max(axis=1) >= j + 1)[owner // PLACES]
        if not stay.any():
            break
        if not stay.all():
            own, owner, place, stride = own[stay], owner[stay], place[stay], stride[stay]
        place = place + stride
        place -= PLACES * (place >= PLACES)
    return out.reshape(sets, PLACES)[:, :SIGNATURE]


def names_of(hashes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A name of each set by two sums of its hashes and its size; null for an empty one."""
    sums = [np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(salt)))]) for salt in (1, 2)]
    one, two = (s[ends[1:]] - s[ends[:-1]] for s in sums)
    return pa.array([f"{x:016x}{y:016x}{z:x}" if z else None for x, y, z in zip(one.tolist(), two.tolist(), np.diff(ends).tolist(), strict=True)], pa.string())


SIGNED = "doc_id {}, n_shingles bigint, name string, bands array<bigint>"


def _sign(words: int):
    def run(batches):
        for b in pieces(batches, most=AT_ONCE):
            hashes, ends = shingles(b.column("text"), words)
            found = signatures(hashes, ends).view(U)
            n = np.diff(ends)
            band = np.zeros((len(n), BANDS), U)
            for k in range(ROWS):
                band = mix(band ^ found[:, k::ROWS])
            band = mix(band ^ np.arange(BANDS, dtype=U))
            lists = pa.array([x if f else None for x, f in zip(band.view(np.int64), n > 0, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), names_of(hashes, ends), lists], names=["doc_id", "n_shingles", "name", "bands"])

    return run


def _sets(words: int):
    def run(batches):
        for b in pieces(batches):
            hashes, ends = shingles(b.column("text"), words)
            sets = pa.array([hashes[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("class"), sets, names_of(hashes, ends)], names=["class", "hashes", "name"])

    return run


TESTED = "hub bigint, class bigint, of_hub bigint, size bigint, common bigint, alike boolean, novel array<bigint>, missing array<bigint>"


def _test(percent: int):
    """Pairs of sets (hub, class) to their sizes, what they share, whether they are alike, and what either has alone.

    Of an alike class only those missing shingles are given that it posts if it is smaller than the hub.
    """

    def run(batches):
        for b in pieces(batches, "hashes"):
            rows = []
            for hub, class_, p, x in zip(*(b.column(c).to_pylist() for c in ("hub", "class", "hub_hashes", "hashes")), strict=True):
                p, x = np.frombuffer(p, U), np.frombuffer(x, U)
                at = np.minimum(np.searchsorted(p, x), len(p) - 1)
                both = p[at] == x
                common = int(both.sum())
                lacks = np.ones(len(p), bool)
                lacks[at[both]] = False
                alike = 100 * common >= percent * (len(p) + len(x) - common)
                missing = p[lacks]
                if alike:
                    missing = missing[: 1 + (percent * (len(p) - len(x)) - 1) // (100 + percent)] if len(x) < len(p) else missing[:0]
                rows.append((hub, class_, len(p), len(x), common, alike, x[~both].view(np.int64), missing.view(np.int64)))
            types = [*[pa.int64()] * 5, pa.bool_(), *[pa.list_(pa.int64())] * 2]
            names = ["hub", "class", "of_hub", "size", "common", "alike", "novel", "missing"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """TESTED of distinct pairs (hub, class)."""
    hubs = sets.select(F.col("class").alias("hub"), F.col("hashes").alias("hub_hashes"))
    return pairs.join(sets, "class").join(hubs, "hub").select("hub", "class", "hub_hashes", "hashes").mapInArrow(_test(percent), TESTED)


def _may_be_alike(percent: int):
    """Whether two classes can be alike by their sizes and by what each shares with one hub: they share at most the lesser of
    that, and of what else they have."""
    most = F.least("common", "_common") + F.least(F.col("size") - F.col("common"), F.col("_size") - F.col("_common"))
    return (100 + percent) * most >= percent * (F.col("size") + F.col("_size"))


def _met(each: DataFrame, keep) -> DataFrame:
    """each where classes of several groups post the same, with the number n of these."""
    ends = F.min("g").alias("low"), F.max("g").alias("high")
    posts = keep(each.groupBy("hub", "e").agg(F.count("*").alias("n"), *ends).filter("low < high").select("hub", "e", "n"))
    return keep(join_counted(each, posts, ["hub", "e"], "n"))


def _enough(shared: DataFrame, need: Column) -> DataFrame:
    """(hub, class) of those classes of shared that have at least as many posts in it as they need."""
    return shared.groupBy("hub", "class", "size", "common").agg(F.count("*").alias("c")).filter(F.col("c") >= need).select("hub", "class")


def posted(found: DataFrame, percent: int, keep=stored) -> tuple[DataFrame, DataFrame]:
    """Of TESTED with the group g of each class: long posts (bucket, class, n), and pairs (hub, class) to verify."""
    spread = lambda df, posts: keep(df.select("hub", "class", "g", "size", "common", F.explode(posts).alias("e")))
    need = F.greatest(F.expr(f"({percent} * size + 99) div 100 - common"), F.lit(1))
    first = F.slice("novel", F.lit(1), (F.col("size") - F.col("common") - need + SHARED).cast("int"))
    few = _enough(_met(spread(found, first), keep), F.least(need, F.lit(SHARED)))
    every = _met(spread(found.join(few, ["hub", "class"], "left_semi"), F.col("novel")), keep)
    shared = _met(keep(every.drop("n").join(_enough(every, need), ["hub", "class"], "left_semi")), keep)
    long = shared.filter(F.col("n") > SHORT).select(F.xxhash64("hub", "e").alias("bucket"), "class", "n", "size", "common", "g")
    short = shared.filter(F.col("n") <= SHORT)
    other = short.select("hub", "e", *[F.col(c).alias(f"_{c}") for c in ("class", "g", "size", "common")])
    met = short.join(other, ["hub", "e"]).filter("class < _class and g <> _g").filter(_may_be_alike(percent))
    met = met.groupBy("hub", "class", "_class", "size", "_size", "common", "_common").agg(F.count("*").alias("c"))
    near = met.filter((100 + percent) * (F.col("c") + F.least("common", "_common")) >= percent * (F.col("size") + F.col("_size")))

    room = F.expr(f"{100 + percent} * common div {percent} - size")  # the size of the largest y that x may be like
    least = found.groupBy("hub").agg(F.min("size").alias("least"))
    x = found.filter(~F.col("alike") & (room < F.col("of_hub")) & (100 * room >= percent * F.col("size"))).join(least, "hub").filter(room >= F.col("least"))
    x = x.select("hub", "class", "g", room.alias("room"), F.explode("missing").alias("e"))
    first = F.expr(f"cast(1 + ({percent} * (of_hub - size) - 1) div {100 + percent} as int)")
    y = found.filter("size < of_hub").select("hub", F.col("class").alias("_class"), F.col("g").alias("_g"), "size", F.explode(F.slice("missing", F.lit(1), first)).alias("e"))
    under = x.join(y, ["hub", "e"]).filter("class <> _class and g <> _g and size <= room")
    pairs = near.select("class", "_class").unionByName(under.select("class", "_class"))
    return long, pairs.select(F.greatest("class", "_class").alias("class"), F.least("class", "_class").alias("hub")).distinct()


def central(ranked: DataFrame, keep=stored) -> DataFrame:
    """(bucket, n, hub) of members (bucket, class, n, meets): the member that meets most others.

    If of half a bucket's members the same class is the hub that meets most, it is this bucket's hub as well, in it or not; so
    the buckets of a group of copies have one hub between them, and no copy's own edits are compared with all others again.
    """
    own = keep(ranked.groupBy("bucket", "n").agg(F.max(F.struct("meets", "class")).alias("best")))
    told = keep(join_counted(ranked.select("bucket", "class"), own, ["bucket"], "n"))
    most = keep(told.groupBy("class").agg(F.max("best").alias("best"), F.count("*").alias("times")))
    joint = join_counted(told.select("bucket", "class", "n"), most, ["class"], "times").groupBy("bucket", "best").agg(F.count("*").alias("k"))
    joint = joint.groupBy("bucket").agg(F.max_by("best", F.struct("k", "best")).alias("joint"), F.max("k").alias("k"))
    return own.join(joint, "bucket").select("bucket", "n", F.when(2 * F.col("k") >= F.col("n"), F.col("joint.class")).otherwise(F.col("best.class")).alias("hub"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles long, component_id, kept boolean, class long (of texts with the same set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    lower = ascii_lower(F.col(text_col)).alias("text")
    own = docs.select(F.col(id_col).alias("doc_id"), lower)
    signed = stored(own.mapInArrow(_sign(words), SIGNED.format(kind)).withColumn("row", F.monotonically_increasing_id()))
    one = F.min_by(F.struct("doc_id", "n_shingles", "bands"), F.struct(F.col("doc_id").isNull(), F.col("row"))).alias("one")
    classes = signed.filter("name is not null").groupBy("name").agg(one, F.count("*").alias("rows"))
    classes = stored(classes.select("name", "one.*", "rows", F.monotonically_increasing_id().alias("class")))
    placed = classes.select("class", F.explode("bands").alias("bucket"))
    meet = stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(join_counted(placed, meet, ["bucket"], "n").select("bucket", "class", "n"))
    wanted = members.select("class").distinct().join(classes.select("class", F.col("doc_id").alias("_id")), "class")
    texts = docs.select(F.col(id_col).alias("_own"), lower).join(wanted, F.col("_own").eqNullSafe(F.col("_id")))
    # Another text under the same doc_id has another set, which goes by its name.
    named_sets = texts.select("class", "text").mapInArrow(_sets(words), "class bigint, hashes binary, name string")
    sets = stored(named_sets.join(classes.select("class", "name"), ["class", "name"]).dropDuplicates(["class"]).select("class", "hashes"))

    sizes = classes.select("class", F.col("n_shingles").alias("size"))
    members = stored(members.join(sizes, "class"))
    links, total = None, members.count()
    for left in range(ROUNDS - 1, -1, -1):
        passing: list[DataFrame] = []  # what this round alone reads

        def keep(df: DataFrame, passing: list[DataFrame] = passing) -> DataFrame:
            passing.append(stored(df))
            return passing[-1]

        often = members.groupBy("class").agg(F.sum("n").alias("meets"))
        ranked = keep(members.join(often, "class"))
        hubs = keep(central(ranked, keep))
        others = keep(join_counted(ranked.drop("n", "meets"), hubs, ["bucket"], "n").filter("class <> hub"))
        pairs = others.groupBy("hub", "class").agg(F.max(F.col("n") > SMALL).alias("large"))
        found = keep(tested(pairs.select("hub", "class"), sets, percent))
        new = found.filter("alike").select(F.col("hub").alias("a"), F.col("class").alias("b"))
        links = stored(new if links is None else links.unionByName(new))
        groups = components(links)
        grouped = lambda df: df.join(groups.withColumnsRenamed({"node": "class", "component": "g"}), "class", "left").withColumn("g", F.coalesce("g", "class"))  # noqa: B023, E731
        small = grouped(others.filter(F.col("n") <= SMALL).select("bucket", "class", "size"))
        # Only hubs with classes of several groups have open pairs.
        found = keep(grouped(found.join(pairs.filter("large").select("hub", "class"), ["hub", "class"])))
        mixed = found.groupBy("hub").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high")
        long, pairs = posted(keep(join_counted(found, keep(mixed.select("hub", "n")), ["hub"], "n").drop("n")), percent, keep)
        long = keep(long)
        meetings = long.groupBy("bucket").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0))).head()[0]
        last = not left or meetings <= total
        pairs = pairs.unionByName(paired(keep(small), percent))
        if last and meetings:
            pairs = pairs.unionByName(paired(long, percent))
        more = keep(tested(pairs.distinct(), sets, percent).filter("alike").select(F.col("hub").alias("a"), F.col("class").alias("b")))
        if more.head(1):
            links = stored(links.unionByName(more))
            groups = components(links)
        if last:
            break
        members = stored(long.select("bucket", "class", "n", "size"))
        release(*passing)
    named = classes.join(groups, classes["class"] == groups.node, "left").select("name", "class", F.coalesce("component", "class").alias("component"), "rows")
    named = stored(named)
    rows = stored(signed.filter("name is not null").select("row", "doc_id", "n_shingles", "name"))
    rows = stored(join_counted(rows, named, ["name"], "rows").drop("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    tops = stored(rows.groupBy("component").agg(first, F.count("*").alias("n")))
    full = join_counted(rows, tops, ["component"], "n").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "class")
    empty = signed.filter("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("class"))
    return full.unionByName(empty)


def paired(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, class) of the classes of each bucket that are of different groups and whose sizes let them be alike.

    With the column common, what each class shares with one hub: then two share at most the lesser of that, and of what else
    they have.
    """
    own = ["class", "g", "size", *(["common"] if "common" in members.columns else [])]
    other = members.select("bucket", *[F.col(c).alias(f"_{c}") for c in own])
    met = members.join(other, "bucket").filter("class > _class and g <> _g")
    met = met.filter(100 * F.least("size", "_size") >= percent * F.greatest("size", "_size"))
    if "common" in own:
        met = met.filter(_may_be_alike(percent))
    return met.select("class", F.col("_class").alias("hub"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, with their columns; rows with the same doc_id stay or go together."""
    gone = near_dedup(docs, words, percent, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")
