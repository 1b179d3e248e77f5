"""Token ids in compressed binary files: an adaptive context-mixing range coder.

A file holds shards of documents in ascending order of their ids. A shard's token ids are cut into blocks of BLOCK ids; each
block is coded by itself (the model starts anew) and carries its length and a CRC-32 of its ids, so a damaged block is
noticed and spoils no other. Order 2 (the two ids before) and order 1 (the id before) each remember the id that came last in
their context and how often it came in a row; order 0 knows how often each id stands in the run of blocks, by a table that is
written with the run's first block. First it is coded whether the id is order 2's, then whether it is order 1's, else the id
by its share of the run. The chance that a guess is right is mixed from the hit rates that the three orders have for it (by
their trust, and whether they agree), with weights that follow whichever order judged best; it drives a range coder. All
arithmetic is on integers, so what one machine writes any other reads. The blocks of a run are coded side by side, as lanes
of arrays.

Texts are cut before spaces that the tokenizer's pattern never reads past, and the library encodes each distinct piece once
as long as a task remembers it; a tokenizer of another kind gets whole texts.

A null text counts as empty and holds only its end. Null ids of documents come first. Repeated rows and ids are kept, extra
columns are ignored, and an empty table gives an empty result. Rows of one doc_id stand side by side, in any order. Very
long texts are encoded whole and span as many blocks as they need. Text that spells a special token of the tokenizer's file
is encoded as that token, as the library does. Ids must be below 65536.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

BLOCK, LANES = 4096, 2048
#: Places of remembered ids that a lane has.
PLACES = 4096
#: Bytes of text that are tokenised at once, and pieces of text whose ids a task remembers.
AT_ONCE, REMEMBERED = 2_000_000, 200_000
#: Characters of text that a shard has on average; one shard is written and read by one task.
SHARD_CHARS = 16_000_000
#: Of an interval of 64 bits: words of 16 bits leave when they are settled, or when it is short.
WORD, TOP, BOTTOM = np.uint64(16), np.uint64(1 << 48), np.uint64(1 << 32)
#: What the frequencies of a run's ids sum to, as a power of two.
TOTAL = 20
#: Chances are in parts of SCALE, and at least LEAST; runs are trusted up to TRUST.
SCALE, LEAST, TRUST = 4096, 32, 7
END_ID = 0


class Table:
    """How often each id stands in a run, in parts of 2 ** TOTAL; without ids all are equally frequent."""

    def __init__(self, size: np.ndarray | None = None):
        self.size = np.full(1 << 16, 1 << TOTAL - 16, np.uint64) if size is None else size.astype(np.uint64)
        self.start = np.cumsum(self.size, dtype=np.uint64) - self.size

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        n = np.bincount(ids, minlength=1 << 16)
        size = n * ((1 << TOTAL) - np.count_nonzero(n)) // max(1, len(ids)) + (n > 0)
        size[n.argmax()] += (1 << TOTAL) - size.sum()
        return cls(size)

    @classmethod
    def read(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))

    def written(self) -> bytes:
        return zlib.compress(self.size.astype("<u4").tobytes())

    def find(self, where: np.ndarray) -> np.ndarray:
        """The id that has each part."""
        if not hasattr(self, "parts"):
            self.parts = np.repeat(np.arange(1 << 16), self.size.astype(np.int64)).astype(np.uint16)
        return self.parts[where].astype(np.int64)


class Coder:
    """The interval of each lane."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, i: np.ndarray | slice, step: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """i: numbers of lanes, or a slice of the first lanes."""
        low, span = self.low[i] + start * step, size * step
        which = np.nonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM))[0]
        while len(which):
            a, b = low[which], span[which]
            b = np.where((a ^ (a + b)) < TOP, b, (~a + np.uint64(1)) & (BOTTOM - np.uint64(1)))
            self.shift(which if isinstance(i, slice) else i[which], a)
            a, b = a << WORD, b << WORD
            low[which], span[which] = a, b
            which = which[((a ^ (a + b)) < TOP) | (b < BOTTOM)]
        self.low[i], self.span[i] = low, span


class Encoder(Coder):
    def __init__(self, ids: np.ndarray):
        super().__init__(ids.shape[1])
        self.out, self.size = np.zeros((ids.shape[1], ids.shape[0] // 2 + 512), np.uint16), np.zeros(ids.shape[1], np.int64)

    def room(self) -> None:
        """Called every 32 ids, for which 512 words are enough."""
        if self.size.max(initial=0) + 512 > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros((len(self.out), self.out.shape[1] // 2 + 512), np.uint16)], axis=1)

    def shift(self, i: np.ndarray, low: np.ndarray) -> None:
        self.out[i, self.size[i]] = low >> np.uint64(48)
        self.size[i] += 1

    def hit(self, i: np.ndarray | slice, chance: np.ndarray, right: np.ndarray) -> np.ndarray:
        chance = chance.astype(np.uint64)
        step = self.span[i] >> np.uint64(12)
        self.narrow(i, step, np.where(right, np.uint64(0), chance), np.where(right, chance, np.uint64(SCALE) - chance))
        return right

    def symbol(self, i: np.ndarray, table: Table, wanted: np.ndarray) -> np.ndarray:
        self.narrow(i, self.span[i] >> np.uint64(TOTAL), table.start[wanted], table.size[wanted])
        return wanted

    def codes(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self.room()
        for _ in range(4):
            self.shift(every, self.low)
            self.low <<= WORD
        return [self.out[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.size)]


class Decoder(Coder):
    def __init__(self, codes: list[bytes]):
        super().__init__(len(codes))
        self.data = np.zeros((len(codes), max(map(len, codes), default=0) // 2 + 8), np.uint16)
        for i, c in enumerate(codes):
            self.data[i, : len(c) // 2] = np.frombuffer(c[: len(c) // 2 * 2], "<u2")
        self.code, self.at = np.zeros(len(codes), np.uint64), np.full(len(codes), 4)
        for k in range(4):
            self.code = (self.code << WORD) | self.data[:, k].astype(np.uint64)

    def room(self) -> None:
        """A damaged block may ask for more than there is."""
        np.minimum(self.at, self.data.shape[1] - 1, out=self.at)

    def shift(self, i: np.ndarray, low: np.ndarray) -> None:
        self.code[i] = (self.code[i] << WORD) | self.data[i, np.minimum(self.at[i], self.data.shape[1] - 1)].astype(np.uint64)
        self.at[i] += 1

    def hit(self, i: np.ndarray | slice, chance: np.ndarray, right: None) -> np.ndarray:
        chance = chance.astype(np.uint64)
        step = self.span[i] >> np.uint64(12)
        found = self.code[i] - self.low[i] < chance * step
        self.narrow(i, step, np.where(found, np.uint64(0), chance), np.where(found, chance, np.uint64(SCALE) - chance))
        return found

    def symbol(self, i: np.ndarray, table: Table, wanted: None) -> np.ndarray:
        step = self.span[i] >> np.uint64(TOTAL)
        found = table.find(np.minimum((self.code[i] - self.low[i]) // step, np.uint64((1 << TOTAL) - 1)))
        self.narrow(i, step, table.start[found], table.size[found])
        return found


class Mixer:
    """The guesses of orders 2 and 1, and hit rates and weights of both flags, of all lanes."""

    def __init__(self, lanes: int):
        #: A remembered id, and its trust above the id's 16 bits.
        self.held = np.zeros((2, lanes * PLACES), np.uint32)
        self.rates = np.full((2, 3 * lanes * 16), SCALE // 2, np.int32)
        self.weights = np.full((2, 3, lanes), 85, np.int32)
        self.first = np.arange(3)[:, None] * lanes * 16 + np.arange(lanes) * 16
        self.base, self.order = np.arange(lanes) * PLACES, np.arange(3, dtype=np.int8)[:, None]

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        """Goes on to the next id of the first lanes, whose ids so far end with before, last."""
        n = len(last)
        spread = last * 0x9E3779B1
        base = self.base[:n]
        self.place = [base + (((spread ^ (before * 0x85EBCA77)) & 0xFFFFFFFF) * 0x2C1B3C6D >> 15 & PLACES - 1), base + (spread >> 13 & PLACES - 1)]
        held = [self.held[k][p].astype(np.int64) for k, p in enumerate(self.place)]
        self.guess, self.trust = [x & 0xFFFF for x in held], [x >> 16 for x in held]
        agree = self.guess[0] == self.guess[1]
        self.context = self.first[:, :n].copy()
        self.context[1] += 2 * self.trust[1] + agree
        self.context[2] += 2 * self.trust[0] + agree

    def chance(self, flag: int, i: np.ndarray | slice) -> np.ndarray:
        """The chance that the guess is right, for lanes i."""
        self.at = self.context[:, i]
        self.judged = self.rates[flag][self.at]
        self.share = self.weights[flag][:, i]
        mixed = self.judged * self.share
        return np.minimum(np.maximum(mixed[0] + mixed[1] + mixed[2] >> 8, LEAST), SCALE - LEAST)

    def learn_flag(self, flag: int, i: np.ndarray | slice, right: np.ndarray) -> None:
        off = right * np.int32(SCALE) - self.judged
        self.rates[flag][self.at] = self.judged + (off >> 4)
        # The first of the orders that are least off.
        off = np.abs(off)
        best = np.where(off[1] < off[0], np.int8(1), np.int8(0))
        best[off[2] < np.minimum(off[0], off[1])] = 2
        share = self.share - (self.share >> 5)
        self.weights[flag][:, i] = share + (self.order == best) * (256 - share[0] - share[1] - share[2])

    def learn(self, ids: np.ndarray) -> None:
        for k, p in enumerate(self.place):
            trust = np.where(self.guess[k] == ids, np.minimum(self.trust[k] + 1, TRUST), 1)
            self.held[k][p] = ids | trust << 16


def _code(coder: Coder, ids: np.ndarray, lengths: np.ndarray, table: Table, known: bool) -> None:
    """Codes ids (a row a place in the block, a column a lane) if they are known, or else finds them; longest lanes first."""
    lanes = len(lengths)
    mixer = Mixer(lanes)
    last = before = np.zeros(lanes, np.int64)
    for t in range(int(lengths.max(initial=0))):
        if t % 32 == 0:
            coder.room()
            live = int(np.searchsorted(-lengths, -t, side="left"))
        if lengths[live - 1] <= t:
            live = int(np.searchsorted(-lengths, -t, side="left"))
        i = slice(0, live)
        now = ids[t, :live].astype(np.int64)
        mixer.look(last[:live], before[:live])
        right = coder.hit(i, mixer.chance(0, i), now == mixer.guess[0] if known else None)
        mixer.learn_flag(0, i, right)
        found = now if known else np.where(right, mixer.guess[0], now)
        i = np.nonzero(~right)[0]
        differ = mixer.guess[0][i] != mixer.guess[1][i]
        other = i[differ]
        if len(other):
            guess = mixer.guess[1][other]
            right = coder.hit(other, mixer.chance(1, other), now[other] == guess if known else None)
            mixer.learn_flag(1, other, right)
            found[other] = np.where(right, guess, found[other])
            left = ~differ
            left[differ] = ~right
            i = i[left]
        if len(i):
            found[i] = coder.symbol(i, table, now[i] if known else None)
        if not known:
            ids[t, :live] = found
        mixer.learn(found)
        last, before = found, last


def encode_blocks(blocks: list[np.ndarray], table: Table | None = None) -> list[bytes]:
    """Each block's code; blocks of ids below 65536 that the table knows."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((int(lengths.max(initial=0)), len(blocks)), np.uint16)
    for i, k in enumerate(order):
        ids[: lengths[k], i] = blocks[k]
    coder = Encoder(ids)
    _code(coder, ids, lengths[order], table or Table(), True)
    out = [b""] * len(blocks)
    for k, code in zip(order, coder.codes(), strict=True):
        out[k] = code
    return out


def decode_blocks(codes: list[bytes], lengths: np.ndarray, table: Table | None = None) -> list[np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((int(lengths.max(initial=0)), len(codes)), np.uint16)
    _code(Decoder([codes[k] for k in order]), ids, lengths[order].astype(np.int64), table or Table(), False)
    out = [np.zeros(0, np.uint16)] * len(codes)
    for i, k in enumerate(order):
        out[k] = ids[: lengths[k], i].copy()
    return out


def _shares(n: int) -> list[slice]:
    """n blocks in shares of about LANES."""
    ends = np.linspace(0, n, max(1, round(n / LANES)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _kind(path: str) -> tuple[bool, tuple[str, int] | None]:
    """Whether texts may be cut before spaces for the tokenizer of a file, and a special token (text, id) that parts pieces."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, added = told["pre_tokenizer"] or {}, told["added_tokens"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in added)
    known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    whole = told["normalizer"] or told["truncation"] or told["padding"] or told["model"].get("dropout")
    cut = known and plain and not whole
    return cut, (added[0]["content"], added[0]["id"]) if cut and added else None


#: A sign that no tokenizer takes for a space.
NO_SPACE = r"[^\x00-\x20\x7F-\xA0\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _units(texts: pa.Array, cut: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, the unit at each place, the number of units of each text); the units of a text make it up.

    Where texts may be cut, a unit ends before a space with no other space on either side.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not cut:
        d = texts.dictionary_encode()
        return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.ones(len(texts), np.int64)
    lists = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    d = pc.list_flatten(lists).dictionary_encode()
    names, at = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    opens, closes = (pc.match_substring_regex(d.dictionary, x).to_numpy(zero_copy_only=False) for x in (f"^{NO_SPACE}", f"{NO_SPACE}$"))
    starts, first = np.zeros(len(at), bool), np.cumsum(sizes) - sizes
    starts[1:] = closes[at[:-1]] & opens[at[1:]]
    starts[first] = True
    after = np.ones(len(at), np.int64)
    after[first] = 0
    begin = np.nonzero(starts)[0]
    length = np.diff(begin, append=len(at))
    unit = 2 * at[begin] + after[begin]
    long_ = np.nonzero(length > 1)[0]
    unit[long_] = 2 * len(names) + np.arange(len(long_))
    keys, place = np.unique(unit, return_inverse=True)
    spaced = ["", " "]
    distinct = [spaced[k % 2] + names[k // 2] for k in keys[keys < 2 * len(names)].tolist()]
    distinct += [spaced[after[i]] + " ".join([names[k] for k in at[i : i + n].tolist()]) for i, n in zip(begin[long_].tolist(), length[long_].tolist(), strict=True)]
    return distinct, place, np.add.reduceat(starts.astype(np.int64), first) if len(first) else sizes


def _encoded(tokenizer, units: list[str], parted: tuple[str, int] | None) -> list[bytes]:
    """The ids of each unit; with a token to part them, many units go to the library as one text."""
    ids = lambda x: np.array(x, "<u2")
    if parted is None:
        return [ids(e.ids).tobytes() for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
    text, number = parted
    out = []
    for i in range(0, len(units), 5000):
        some = units[i : i + 5000]
        if any(text in x for x in some):
            out += _encoded(tokenizer, some, None)
            continue
        found = ids(tokenizer.encode_batch_fast([text.join(some)], add_special_tokens=False)[0].ids)
        raw, ends = found.tobytes(), [*(2 * np.nonzero(found == number)[0]).tolist(), 2 * len(found)]
        out += [raw[a:b] for a, b in zip([0, *[x + 2 for x in ends[:-1]]], ends, strict=True)]
    return out


def _tokenise(path: str):
    """Rows (doc_id, text) to rows (doc_id, ids): a piece of bounded size at a time, on the task's one thread."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, (cut, parted) = Tokenizer.from_file(path), _kind(path)
        remembered: dict[str, bytes] = {}
        for b in pieces(batches, most=AT_ONCE):
            units, at, n = _units(b.column("text"), cut)
            new = [x for x in units if x not in remembered]
            fresh = dict(zip(new, _encoded(tokenizer, new, parted), strict=True))
            codes = [fresh[x] if x in fresh else remembered[x] for x in units]
            if len(remembered) < REMEMBERED:
                remembered |= {x: c for x, c in fresh.items() if len(x) < 50}
            del new, fresh
            flat, size = np.frombuffer(b"".join(codes), "<u2"), np.fromiter(map(len, codes), np.int64, len(codes)) // 2
            # A text's ids are those of its units in turn, then its end.
            start, many = (np.cumsum(size) - size)[at], size[at]
            ids = flat[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            own = np.add.reduceat(many, np.cumsum(n) - n)
            ends = np.cumsum(own)
            ids = np.insert(ids, ends, END_ID).astype("<u2")
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int64) * 2
            rows = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], names=["doc_id", "ids"])

    return run


#: A run's documents, their sizes and its table stand with its first block.
BLOCKS = "shard int, block bigint, doc_ids array<{}>, n_tokens array<bigint>, table binary, length int, crc bigint, code binary"


def _write(batches):
    """(doc_id, ids) of sorted documents of a shard to its blocks; the first block of a run lists its documents and has its table."""
    from pyspark import TaskContext

    shard, number, docs, held = TaskContext.get().partitionId(), 0, [], 0

    def blocks(docs):
        nonlocal number
        ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
        parts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        table = Table.of(ids)
        codes = [c for share in _shares(len(parts)) for c in encode_blocks(parts[share], table)]
        n = len(parts)
        kind = pa.list_(types[0])
        lists = pa.array([[d.as_py() for d, _ in docs], *[[]] * (n - 1)], kind)
        sizes = pa.array([[len(x) // 2 for _, x in docs], *[[]] * (n - 1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), lists, sizes, pa.array([table.written()] + [None] * (n - 1), pa.binary()), pa.array(map(len, parts), pa.int32()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(codes, pa.binary())],
            names=["shard", "block", "doc_ids", "n_tokens", "table", "length", "crc", "code"],
        )
        number += n

    types = [None]
    for b in batches:
        types[0] = b.column("doc_id").type
        for d, x in zip(b.column("doc_id"), b.column("ids"), strict=True):
            docs.append((d, x.as_py()))
            held += len(docs[-1][1]) // 2
            if held >= LANES * BLOCK:
                yield from blocks(docs)
                docs, held = [], 0
    if docs:
        yield from blocks(docs)


def write(docs: DataFrame, tokenizer_path: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of docs' ids, each document with its end, written under `name` to the shared folder and read again."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = own.agg(F.sum(F.char_length("text"))).head()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()
    tokenise = _tokenise(tokenizer_path)
    # The ranges are drawn from texts, so that each is tokenised once, after the shuffle.
    shards = own.repartitionByRange(max(1, -(-chars // SHARD_CHARS)), "doc_id").sortWithinPartitions("doc_id")
    return written(shards.mapInArrow(lambda batches: _write(tokenise(batches)), BLOCKS.format(kind)), name)


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit integers) from the blocks of write()."""
    kind = next(f.dataType.elementType for f in blocks.schema if f.name == "doc_ids")

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        codes, lengths, crcs = t.column("code").to_pylist(), t.column("length").to_numpy(), t.column("crc").to_pylist()
        parts, tables = [], t.column("table").to_pylist()
        runs = [i for i, x in enumerate(tables) if x is not None]
        for a, b in zip(runs, [*runs[1:], len(codes)], strict=True):
            table = Table.read(tables[a])
            for share in _shares(b - a):
                parts += decode_blocks(codes[a:b][share], lengths[a:b][share], table)
        for k, (p, crc) in enumerate(zip(parts, crcs, strict=True)):
            if zlib.crc32(p.astype("<u2").tobytes()) != crc:
                raise ValueError(f"shard {t.column('shard')[0]}, block {k}: checksum differs")
        ids = np.concatenate(parts).astype("<u4")
        n = pc.list_flatten(t.column("n_tokens")).to_numpy()
        ends = np.cumsum(n)
        shard = np.full(len(n), t.column("shard")[0].as_py(), np.int32)
        flat = pc.list_flatten(t.column("doc_ids"))
        return pa.table({"shard": shard, "doc_id": flat, "local": ends - n, "n_tokens": n, "ids": [ids[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]})

    rows = blocks.groupBy("shard").applyInArrow(one, f"shard int, doc_id {kind.simpleString()}, local bigint, n_tokens bigint, ids binary")
    sizes = blocks.groupBy("shard").agg(F.sum("length").alias("size"))  # a row a shard, of some SHARD_CHARS of text; ids stay in place
    before = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    back = read(write(docs, tokenizer_path, f"tokens-{uuid.uuid4().hex}"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
