"""LM scoring by a hierarchical Pitman-Yor model of words.

A token's restaurant is that of the up to two words before it in its text, whatever words they are; the restaurant of two
words has that of the last one as its parent, shared by all contexts that end with it, and those share the root, whose base
is uniform over the training vocabulary and one unknown word. Every context that the training texts hold has a restaurant.

Seats are sampled by Gibbs: the customers of a dish leave and are seated again one after the other, given all others. Each
opens a table with the chance that the seats so far give; customers who don't are skipped together, by a draw of the next
one who would at the present chance, which is thinned by the chance that it has by then. Words are dealt over parts; a part
sweeps over all restaurants' cells of its words, given each restaurant's customers and tables as of the last round. These
totals are summed by the hash of the context, dealt over groups, and come back to the parts that hold the context; no task
holds those of all contexts. Predictive probabilities are averaged over the sweeps after BURN_IN; perplexity uses these
averages. All draws come from hashes of the word, its context and the draw's number, so they don't depend on how words are
dealt.

Null texts count as empty and still have their end. A null doc_id trains and is not held out. Repeated rows and ids are
kept, extra columns ignored; very long texts are read whole; equal counts need no order; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_trip
from .common import ascii_lower, release, shuffles_removed, split_words, stored
from .minhash import U, mix

ROUNDS = 2
SWEEPS, BURN_IN = 6, 2
MASK = (1 << 64) - 1
#: Draws that are made at once, if dishes are so few.
DRAWN = 4096
#: Of the restaurants without context, with one and with two words.
STRENGTH = np.array([10.0, 5.0, 5.0])


def uniform(keys: np.ndarray, number: int, count: int) -> np.ndarray:
    """The draws of count numbers from `number` on of each key, between 0 and 1; a row a number."""
    steps = np.array([(number + k) * 0xD1342543DE82EF95 & MASK for k in range(count)], U)
    return ((mix(keys + steps[:, None]) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def seat(keys: np.ndarray, number: int, customers: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after its customers sit down in turn; new: (strength + discount * tables) * parent's probability.

    The draws of a dish are those of its key from `number` on, DRAWN for the dishes that are left at once, as a few
    dishes with many tables go on long after all others.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.nonzero(customers > 1)[0]
    n, w, own, i = customers[live], new[live], tables[live], tables[live]
    while len(live):
        pairs = max(1, min(64, DRAWN // (2 * len(live))))
        draws, column = uniform(keys[live], number, 2 * pairs), slice(None)
        number += 2 * pairs
        skips = np.log(draws[::2])
        for k in range(pairs):
            t = discount * own
            chance = w / (i - t + w)
            skip = np.floor(skips[k, column] / np.log1p(-chance))
            i = i + np.minimum(skip, n).astype(np.int64)  # the next who would open a table at this chance
            own = own + ((i < n) & (draws[2 * k + 1, column] * chance < w / (i - t + w)))
            i = i + 1
            stay = i < n
            if not stay.all():
                tables[live[~stay]] = own[~stay]
                at = np.nonzero(stay)[0]
                column = at if isinstance(column, slice) else column[at]
                live, n, w, own, i = live[at], n[at], w[at], own[at], i[at]
                if not len(live):
                    break
    return tables


class State:
    """What a part is told: number of context words, vocabulary size, discounts a level, its contexts' customers and tables.

    A context is a number: the place of its last word, from 1, plus frequent + 1 times that of the word before; 0 is the root.
    codes are the sorted contexts that customers and tables belong to, from 0; without them they belong to all in turn.
    """

    def __init__(self, frequent: int, distinct: int, discounts: np.ndarray, customers: np.ndarray, tables: np.ndarray, codes: np.ndarray | None = None):
        self.side, self.distinct, self.discounts = frequent + 1, distinct, discounts
        self.codes = np.arange(len(customers)) if codes is None else codes
        level = np.where(self.codes >= self.side, 2, 1)
        level[0] = 0
        strength, discount = STRENGTH[level], discounts[level]
        self.new, self.all = strength + discount * tables, strength + customers
        self.left = self.new / self.all

    def at(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, context)

    def unknown(self, context: np.ndarray) -> np.ndarray:
        p = np.full(len(context), self.left[0] / (self.distinct + 1))
        return self.backed(context, p)

    def backed(self, context: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The probability in a context of a word without customers there or in the parent, by its probability in the root."""
        one = np.where(context > 0, self.left[self.at(context % self.side)] * root, root)
        return np.where(context >= self.side, self.left[self.at(context)] * one, one)


class Part:
    """The cells of a part's words: words in the root, and (context, word) with contexts of one and of two words."""

    def __init__(self, words: pa.Array, word: np.ndarray, context: np.ndarray, n: np.ndarray, side: int, named=None):
        """named: from contexts to hashes of theirs, which draws depend on."""
        size = max(1, len(words))
        self.words, self.size, self.side = words, size, side
        self.n = np.bincount(word, n, len(words)).astype(np.int64)
        direct = {k: (context * size + word)[m] for k, m in ((2, context >= side), (1, (context > 0) & (context < side)))}
        count = {2: n[context >= side], 1: n[(context > 0) & (context < side)]}
        self.two = np.sort(direct[2])
        upper = self.two // size % side * size + self.two % size
        self.one = np.union1d(direct[1], upper)
        self.up_two, self.up_one = np.searchsorted(self.one, upper), self.one % size
        self.customers = [np.zeros(len(words), np.int64), np.zeros(len(self.one), np.int64), count[2][np.argsort(direct[2], kind="stable")]]
        np.add.at(self.customers[0], word[context == 0], n[context == 0])
        self.customers[1][np.searchsorted(self.one, direct[1])] = count[1]
        self.direct = [x.copy() for x in self.customers]
        self.tables = [np.zeros(0)] * 3
        for k in (2, 1, 0):
            self.tables[k] = np.minimum(self.customers[k], 1)
            self.pass_up(k)
        self.p: list[np.ndarray] = []
        self.told: tuple | None = None
        name = mix(word_trip.names_of(words).view(U)) if len(words) else np.zeros(0, U)
        place = (lambda x: mix(x.astype(U))) if named is None else named
        self.keys = [name, *(mix(name[x % size] ^ place(x // size)) for x in (self.one, self.two))]

    def pass_up(self, k: int) -> None:
        if k == 2:
            self.customers[1] = self.direct[1] + np.bincount(self.up_two, self.tables[2], len(self.one)).astype(np.int64)
        elif k == 1:
            self.customers[0] = self.direct[0] + np.bincount(self.up_one, self.tables[1], len(self.words)).astype(np.int64)

    def contexts(self, s: State) -> list[np.ndarray]:
        """The place in s of the context of each cell."""
        if self.told is None or self.told[0] is not s:
            self.told = s, [np.zeros(len(self.words), np.int64), s.at(self.one // self.size), s.at(self.two // self.size)]
        return self.told[1]

    def predict(self, s: State) -> list[np.ndarray]:
        d, out, contexts = s.discounts, [], self.contexts(s)
        for k, up in enumerate((None, self.up_one, self.up_two)):
            above = np.full(len(self.words), 1 / (s.distinct + 1)) if up is None else out[-1][up]
            out.append((self.customers[k] - d[k] * self.tables[k] + s.new[contexts[k]] * above) / s.all[contexts[k]])
        return out

    def sweep(self, s: State, number: int) -> None:
        """number: of the first draw, of 2 ** 40 that a level may need."""
        p = self.predict(s)
        above = [np.full(len(self.words), 1 / (s.distinct + 1)), p[0][self.up_one], p[1][self.up_two]]
        for k in (2, 1, 0):
            new = s.new[self.contexts(s)[k]] * above[k]
            self.tables[k] = seat(self.keys[k], number + (k << 40), self.customers[k], new, s.discounts[k])
            self.pass_up(k)

    def run(self, s: State, round_: int) -> Part:
        """Sweeps; p is then the mean of the predictions of the sweeps after the first BURN_IN."""
        total = None
        for k in range(SWEEPS):
            self.sweep(s, (round_ * SWEEPS + k) << 42)
            if k >= BURN_IN:
                now = self.predict(s)
                total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
        self.p = [x / (SWEEPS - BURN_IN) for x in total]
        return self

    def log(self, s: State, word: np.ndarray, known: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 of the probability of items (place of the word, whether it has one, context)."""
        p = np.full(len(word), s.left[0] / (s.distinct + 1))
        if len(self.words):
            p[known] = self.p[0][word[known]]
        for level, keys, own in ((1, self.one, context % s.side), (2, self.two, context)):
            inside = (context > 0) if level == 1 else context >= s.side
            key = own * self.size + word
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            held = known & inside & (keys[at] == key) if len(keys) else np.zeros(len(word), bool)
            p = np.where(inside, s.left[s.at(own)] * p, p)
            if held.any():
                p[held] = self.p[level][at[held]]
        return np.log10(p)

    def sums(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """This part's customers and tables in each of the sorted contexts codes, which hold all of its own."""
        at = np.concatenate([np.searchsorted(codes, x) for x in (np.zeros(len(self.words), np.int64), self.one // self.size, self.two // self.size)])
        return tuple(np.bincount(at, np.concatenate(x), len(codes)).astype(np.int64) for x in (self.customers, self.tables))

    def totals(self) -> pa.RecordBatch:
        """(level, context, customers, tables, once, twice) of this part."""
        rows = []
        for k, keys in ((0, np.arange(len(self.words))), (1, self.one), (2, self.two)):
            names, at = np.unique(keys // self.size if k else np.zeros(len(keys), np.int64), return_inverse=True)
            c, t = self.customers[k], self.tables[k]
            rows.append([np.full(len(names), k), names, *(np.bincount(at, x, len(names)).astype(np.int64) for x in (c, t, c == 1, c == 2))])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows, strict=True)], names=TOTALS)


TOTALS = ["level", "context", "customers", "tables", "once", "twice"]


#: data: packed word, differences of context, n, hashes of context words, differences of all contexts, asked ones too;
#: stats: a level the cells with one customer and those with two at first, then the numbers of tokens and of words.
#: asked: the items of each chunk in its order, packed: the place of the word from 1, or 0 where it has none, and of the context.
PART = "part int, words array<string>, data binary, stats array<bigint>, asked array<struct<chunk:bigint,items:binary>>"
TOLD = "part int, words array<string>, data binary, state binary"
TOLD_ARROW = pa.schema([("part", pa.int32()), ("words", pa.list_(pa.string())), ("data", pa.binary()), ("state", pa.binary())])


ITEMS = pa.struct([("chunk", pa.int64()), ("items", pa.binary())])


def _listed(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


class Asked:
    """The items of a part's rows of word_trip.COUNTED: words, contexts by the sorted hashes of context words, counts."""

    def __init__(self, words: pa.ChunkedArray, items: pa.ChunkedArray):
        rows = [word_trip.unpacked(x) for x in items.to_pylist()]
        self.names = np.unique(np.concatenate([r[4] for r in rows]))
        side, starts = len(self.names) + 1, np.cumsum([0, *pc.list_value_length(words).to_pylist()])
        codes = []
        for _, one, two, _, names_ in rows:
            place = np.concatenate([[0], np.searchsorted(self.names, names_) + 1])
            codes.append(place[one] + side * place[two])
        self.words = pc.list_flatten(words).combine_chunks() if isinstance(words, pa.ChunkedArray) else pc.list_flatten(words)
        self.word = np.concatenate([r[0] + k for r, k in zip(rows, starts, strict=False)])
        self.context, self.n = np.concatenate(codes), np.concatenate([r[3] for r in rows])
        self.ends = np.cumsum([0, *(len(r[0]) for r in rows)])


def vocabulary(sent: DataFrame) -> DataFrame:
    """One row of PART a part: its training words, how often each context holds each of them, and all contexts asked for.

    The items of the texts stay with it as places, a few bytes each, so that they make their trip once.
    """

    def whole(t: pa.Table) -> pa.Table:
        a = Asked(t.column("words"), t.column("items"))
        side, learnt = len(a.names) + 1, a.n > 0
        d = a.words.dictionary_encode()
        used = np.zeros(len(d.dictionary), bool)
        every = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)[a.word]
        word = every[learnt]
        used[word] = True
        words = d.dictionary.filter(pa.array(used))
        order = pc.sort_indices(words).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        places = np.zeros(len(used), np.int64)
        places[used] = place + 1
        words, word, size = words.take(pa.array(order)), places[word] - 1, max(1, len(order))
        codes, at = np.unique(np.concatenate([[0], a.context, a.context % side]), return_inverse=True)
        known, context = places[every], at[1 : 1 + len(every)]
        asked = [{"chunk": c, "items": word_trip.pack(known[i:j], context[i:j])} for c, i, j in zip(t.column("chunk").to_pylist(), a.ends[:-1].tolist(), a.ends[1:].tolist(), strict=True)]
        cells, at = np.unique(np.searchsorted(codes, a.context[learnt]) * size + word, return_inverse=True)
        n = np.bincount(at, a.n[learnt], len(cells)).astype(np.int64)
        word, context = cells % size, codes[cells // size]
        part = Part(words, word, context, n, side)
        stats = [*(int((c == i).sum()) for i in (1, 2) for c in part.customers), int(n.sum()), len(words)]
        data = word_trip.pack(word, np.diff(context, prepend=0), n, a.names, np.diff(codes, prepend=0))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "words": _listed(words), "data": pa.array([data], pa.binary()), "stats": pa.array([stats], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(ITEMS))})

    return sent.groupBy("part").applyInArrow(whole, PART)


class Held:
    """A part as kept in rows of PART or TOLD, with the group and hash of each of its contexts and what it is told of them."""

    def __init__(self, words: pa.Array, data: bytes, groups: int):
        self.words = words
        self.word, context, self.n, self.names, codes = word_trip.unpacked(data)
        self.context, self.codes, self.side = np.cumsum(context), np.cumsum(codes), len(self.names) + 1
        each = np.concatenate([[0], self.names]).astype(np.int64).view(U)
        one, two = each[self.codes % self.side], self.codes // self.side
        self.hash = np.where(two > 0, mix(mix(one) ^ each[two]), one)
        group = (self.hash % U(groups)).astype(np.int64)
        self.order = np.argsort(group, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))])

    def part(self) -> Part:
        return Part(self.words, self.word, self.context, self.n, self.side, lambda x: mix(self.hash[np.searchsorted(self.codes, x)]))

    def state(self, distinct: int, discounts: np.ndarray, state: bytes) -> State:
        return State(self.side - 1, distinct, discounts, *word_trip.unpacked(state), self.codes)


def _round(parts: DataFrame, kept: DataFrame, groups: int, number: int, distinct: int, discounts: np.ndarray) -> DataFrame:
    """kept as rows of TOLD, after a round of sweeps of parts, or with one table a cell if number is 0.

    A part asks each group for its contexts there, giving its own customers and tables; their sums come back in turn.
    """

    def ask(batches):
        for b in batches:
            for k in range(b.num_rows):
                number_, held = b.column("part")[k].as_py(), Held(b.column("words")[k].values, b.column("data")[k].as_py(), groups)
                part = held.part()
                if number:
                    part.run(held.state(distinct, discounts, b.column("state")[k].as_py()), number)
                rows = [x[held.order] for x in (held.hash.view(np.int64), *part.sums(held.codes))]
                some = np.nonzero(np.diff(held.ends))[0]
                sums = [word_trip.pack(*(x[held.ends[g] : held.ends[g + 1]] for x in rows)) for g in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number_, np.int32)), pa.array(sums, pa.binary())], names=["group", "part", "sums"])

    def add(t: pa.Table) -> pa.Table:
        rows = [word_trip.unpacked(x) for x in t.column("sums").to_pylist()]
        names, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([r[k] for r in rows]), len(names)).astype(np.int64)[at] for k in (1, 2)]
        ends = np.cumsum([0, *(len(r[0]) for r in rows)])
        back = [word_trip.pack(*(x[a:b] for x in sums)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"group": t.column("group"), "part": t.column("part"), "sums": pa.array(back, pa.binary())})

    def tell(back: pa.Table, own: pa.Table) -> pa.Table:
        own, back = own.combine_chunks(), back.sort_by("group")
        held = Held(own.column("words").chunk(0)[0].values, own.column("data")[0].as_py(), groups)
        rows = [word_trip.unpacked(x) for x in back.column("sums").to_pylist()]
        sums = np.zeros((2, len(held.codes)), np.int64)
        sums[:, held.order] = [np.concatenate([r[k] for r in rows]) for k in (0, 1)]
        state = pa.array([word_trip.pack(*sums)], pa.binary())
        return pa.Table.from_arrays([own.column("part"), own.column("words"), own.column("data"), state], schema=TOLD_ARROW)

    kind = "group int, part int, sums binary"
    back = parts.mapInArrow(ask, kind).groupBy("group").applyInArrow(add, kind)
    return back.groupBy("part").cogroup(kept.select("part", "words", "data").groupBy("part")).applyInArrow(tell, TOLD)


def _split(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    words, of = split_words(b.column("text"))
    return words, np.bincount(of, minlength=b.num_rows)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


BACK = "part int, chunk bigint, n bigint, counts binary, logs binary"
BACK_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("logs", pa.binary())])


def pitman_yor(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", seats: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score. held: which rows not to learn from.

    Without seats, the words alone make the trip, no one is seated, and score is null; the other columns need no more.
    """
    lower = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("id"), lower.alias("text"), (~held).alias("learn"))
    count = word_trip.parts_for(docs)
    groups = max(1, count // 2)
    sent = word_trip.sent(own, _split, count, True, seats)
    with shuffles_removed(docs.sparkSession):
        parts = stored(vocabulary(sent))
    *few, n, v = parts.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(8)]).head()
    once, twice = np.array(few[:3], float), np.array(few[3:], float)
    discounts = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)
    told = parts.select("part", "words", "data")
    for k in range(ROUNDS if seats else 0):
        before = told
        with shuffles_removed(docs.sparkSession):
            told = stored(_round(before, parts.select("part", "words", "data"), groups, k, v, discounts))
        if k:
            release(before)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        known, rows = known.combine_chunks(), []
        number, held = known.column("part")[0].as_py(), Held(known.column("words").chunk(0)[0].values, known.column("data")[0].as_py(), groups)
        part = held.part()
        if seats:
            state = held.state(v, discounts, known.column("state")[0].as_py())
            part.run(state, ROUNDS)
        for items in pc.list_flatten(asked.column("asked")):
            place, context = word_trip.unpacked(items["items"].as_py())
            known_, at = place > 0, np.maximum(place - 1, 0)
            counts = np.where(known_, part.n[at], 0) if len(part.n) else np.zeros(len(at), np.int64)
            logs = part.log(state, at, known_, held.codes[context]) if seats else np.zeros(len(at))
            rows.append((number, items["chunk"].as_py(), len(at), pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True), logs.astype("<f4").tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, BACK_ARROW, strict=True)], schema=BACK_ARROW)

    back = parts.select("part", "asked").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer, BACK)
    texts = word_trip.kept(own.drop("learn"), _split, count, True, seats)
    kind = docs.schema[id_col].dataType

    def score(answers: pa.Table, row: dict) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        at, ends, order = word_trip.unpack(row)
        c, x = np.zeros(len(order), np.int64), np.zeros(len(order))
        found = answers.to_pylist()
        if sum(a["n"] for a in found) != len(order):
            raise ValueError("a chunk that was read again was cut otherwise")
        c[order] = np.concatenate([np.frombuffer(pa.decompress(a["counts"], 8 * a["n"], codec="zstd", asbytes=True), "<i8") for a in found])
        x[order] = np.concatenate([np.frombuffer(a["logs"], "<f4") for a in found])
        rows = len(row["ids"])
        of = np.repeat(np.arange(rows), np.diff(ends))
        total = lambda y: np.bincount(of, y[at], rows)
        return pa.table({
            "doc_id": pa.array(row["ids"], to_arrow_type(kind)), "n_tokens": np.diff(ends), "n_known": total(c > 0).astype(np.int64),
            "train_tokens": np.full(rows, n, np.int64), "base_score": total(np.log10((c + 1) / (n + v + 1))), "score": total(x) if seats else pa.nulls(rows, pa.float64()),
        })

    return word_trip.by_chunk(back, texts, score, f"doc_id {kind.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(docs: DataFrame) -> DataFrame:
    scored = pitman_yor(docs, held_out(F.col("doc_id")))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
