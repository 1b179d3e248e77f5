"""A trip of the distinct words of a corpus: each goes once to one place, and what is found there comes back to all texts.

Texts are read in chunks of bounded size. A chunk sends its distinct words, dealt by their hash over `parts`, one row for
each part; what comes back a word is joined with the chunk's texts, kept as numbers of words. So the rows that Spark
shuffles are few and wide, and no word, however frequent, is sent more than once a chunk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import trim

#: A chunk ends with the text that takes it to so many words.
CHUNK_WORDS = 1_200_000
#: Texts that are cut into words at once.
AT_ONCE = 1000
SENT = "part int, chunk bigint, words array<string>"
COUNTED = SENT + ", items binary"

#: A batch with columns id and text to its words and the number of words of each text.
Split = Callable[[pa.RecordBatch], tuple[pa.Array, np.ndarray]]


#: The word that ends a text where ends are wanted; words have no spaces.
END = " "


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed byte by byte, as the high bytes are mostly equal."""
    out = []
    for x in arrays:
        planes, each = np.zeros((8, len(x)), np.uint8), np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)
        used = 8 if len(x) and x.min() < 0 else (int(x.max(initial=0)).bit_length() + 7) // 8
        for k in range(used):
            planes[k] = each[:, k]
        planes = pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b""
        out += [struct.pack("<qq", len(x), len(planes)), planes]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays that were given to pack()."""
    out, at = [], 0
    while at < len(data):
        n, size = struct.unpack_from("<qq", data, at)
        at += 16
        raw = pa.decompress(data[at : at + size], 8 * n, codec="zstd", asbytes=True) if n else b""
        x = np.zeros(n, "<i8")
        for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(8, n)):
            if plane.any():
                x.view(np.uint8).reshape(-1, 8)[:, k] = plane
        out.append(x)
        at += size
    return out


def spelled(words: pa.Array) -> list[bytes]:
    """The bytes of each word."""
    return words.cast(pa.large_string()).cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def names_of(words: pa.Array) -> np.ndarray:
    """A hash of 64 bits of each word, never 0."""
    hash_ = hashlib.blake2b
    h = np.frombuffer(b"".join([hash_(w, digest_size=8).digest() for w in spelled(words)]), "<i8")
    return np.where(h == 0, 1, h)


class Chunk:
    """ids; the distinct items, which are words or words in contexts; each position's item; words of each text; learn.

    The context of an item is up to two words before it: one is the last of them and two the one before that, as places
    among names counted from 1; 0 is no word.

    Items that are frequent in the chunk have small numbers. learn holds the column of that name for each text, if any.
    """

    def __init__(self, number: int, ids: list, words: list, lengths: list, learn: list, ends: bool, contexts: bool = True):
        self.number, self.ids = number, pa.chunked_array(ids).combine_chunks()
        self.lengths, self.learn = np.concatenate(lengths).astype(np.int64), np.concatenate(learn)
        d = pa.concat_arrays(words).dictionary_encode()
        at, names = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        if ends:
            at = np.insert(at, np.cumsum(self.lengths), len(names))
            self.lengths = self.lengths + 1
            names = pa.concat_arrays([names, pa.array([END], names.type)])
        size = max(1, len(names))
        items, before = np.arange(len(names)), np.zeros(1, np.int64)
        if ends and contexts:
            within = np.arange(len(at)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
            last, last_but_one = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            last[1:], last_but_one[2:] = at[:-1] + 1, at[:-2] + 1
            last[within < 1], last_but_one[within < 2] = 0, 0
            before, of = np.unique(last + last_but_one * (size + 1), return_inverse=True)
            items, at = np.unique(of * size + at, return_inverse=True)
        order = np.argsort(-np.bincount(at, minlength=len(items)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.at, items = rank[at], items[order]
        self.names, self.word, context = names, items % size, before[items // size]
        self.one, self.two = context % (size + 1), context // (size + 1)

    def parts(self, parts: int) -> np.ndarray:
        """The part of each item, by the CRC of its word."""
        return (np.fromiter(map(zlib.crc32, spelled(self.names)), np.int64, len(self.names)) % parts).astype(np.uint16)[self.word]


def chunks(batches: Iterator[pa.RecordBatch], split: Split, ends: bool = False, contexts: bool = True) -> Iterator[Chunk]:
    from pyspark import TaskContext

    number, ids, words, lengths, learn = TaskContext.get().partitionId() << 32, [], [], [], []
    for whole in batches:
        for start in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(start, AT_ONCE)
            w, n = split(b)
            ids.append(b.column("id"))
            words.append(w)
            lengths.append(n)
            learn.append(b.column("learn").to_numpy(zero_copy_only=False).astype(bool) if "learn" in b.schema.names else np.ones(len(n), bool))
            if sum(map(len, words)) >= CHUNK_WORDS:
                yield Chunk(number, ids, words, lengths, learn, ends, contexts)
                number, ids, words, lengths, learn = number + 1, [], [], [], []
                trim()
    if ids:
        yield Chunk(number, ids, words, lengths, learn, ends, contexts)
    trim()


def _part(c: np.ndarray, parts: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(c, minlength=parts))]).astype(np.int32)


def _counted(c: Chunk, order: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = np.bincount(c.at[np.repeat(c.learn, c.lengths)], minlength=len(c.word))
    hashes, strings = names_of(c.names), c.names.cast(pa.string())
    for k in np.nonzero(np.diff(starts))[0].tolist():
        of = order[starts[k] : starts[k + 1]]
        words, word = np.unique(c.word[of], return_inverse=True)
        before, place = np.unique(np.concatenate([[0], c.one[of], c.two[of]]), return_inverse=True)
        items = pack(word, place[1 : 1 + len(of)], place[1 + len(of) :], n[of], hashes[before[1:] - 1])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([k], pa.int32()), "chunk": [c.number], "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), strings.take(pa.array(words))), "items": pa.array([items], pa.binary()),
        })


def sent(docs: DataFrame, split: Split, parts: int, counted: bool = False, contexts: bool = True) -> DataFrame:
    """docs (id, what split wants) to rows of SENT: each chunk's distinct items of a part, in order of their numbers.

    counted: rows of COUNTED, in which texts have ends and items are words in their contexts of up to two words. A row then
    has its distinct words, and packed: the place of each item's word there, the places of the one and two words of its
    context among names, counted from 1, how often the texts to learn from hold it, and names, the hashes of the words.
    Without contexts, items of counted rows are words alone.
    """

    def run(batches):
        for c in chunks(batches, split, counted, contexts):
            part = c.parts(parts)
            order = np.argsort(part, kind="stable")
            starts = _part(part, parts)
            if counted:
                yield from _counted(c, order, starts)
                continue
            lists = pa.ListArray.from_arrays(pa.array(starts), c.names.take(pa.array(c.word[order])).cast(pa.string()))
            b = pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, c.number)), lists], names=["part", "chunk", "words"])
            yield b.filter(pc.greater(pc.list_value_length(lists), 0))

    return docs.mapInArrow(run, COUNTED if counted else SENT)


def kept(docs: DataFrame, split: Split, parts: int, counted: bool = False, contexts: bool = True) -> DataFrame:
    """docs to one row a chunk: the ids, the number of words of each text, the items of the words, the part of each item."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for c in chunks(batches, split, counted, contexts):
            planes = c.at.astype("<u4").view(np.uint8).reshape(-1, 4).T  # the high bytes are mostly zero
            packed, part = (pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (planes, c.parts(parts)))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": [c.number], "ids": pa.array([c.ids.to_pylist()], pa.list_(c.ids.type)), "counts": [c.lengths.astype(np.int32)],
                    "n": [len(c.at)], "at": [packed], "n_words": [len(c.word)], "part": [part],
                }
            )

    return docs.mapInArrow(run, f"chunk bigint, ids array<{kind}>, counts array<int>, n bigint, at binary, n_words bigint, part binary")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of kept(): the number of each word, the ends of the texts (from 0), and for each part and rank the number.

    The last is the order of numbers by part: what comes back for the parts in turn belongs to these numbers in turn.
    """
    n = row["n"]
    raw = np.frombuffer(pa.decompress(row["at"], 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    at = raw.reshape(4, n).T.copy().view("<u4").reshape(-1) if n else np.zeros(0, np.uint32)
    part = np.frombuffer(pa.decompress(row["part"], 2 * row["n_words"], codec="zstd", asbytes=True), np.uint16) if row["n_words"] else np.zeros(0, np.uint16)
    ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
    return at, ends, np.argsort(part, kind="stable")


def parts_for(docs: DataFrame) -> int:
    return min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 60_000)


def by_chunk(back: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """run(answers of a chunk in order of part, the chunk's row of kept()) to a table, for each chunk."""

    def both(answers: pa.Table, chunk: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            raise ValueError("answers without texts: a chunk that was read again was cut otherwise")
        return run(answers.sort_by("part"), chunk.to_pylist()[0])

    return back.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(both, schema)
