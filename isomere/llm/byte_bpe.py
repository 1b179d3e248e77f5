"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions; each distinct pre-token goes to one place by its hash, is encoded there
once, and its ids come back to all texts that hold it and are put together by position. Decoding joins the ids with the
table of token bytes, which is as large as the vocabulary.

Null texts count as empty and have no ids. Null and repeated ids of documents are kept as they are, extra columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_trip
from .common import trim

#: Distinct words that one task remembers; it starts anew beyond.
MOST_KNOWN = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pre_tokens(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): the matches of pattern in order, with Unicode's white space as \\s."""
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), found.alias("tokens"))


def _tokens(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    lists = b.column("tokens")
    return pc.list_flatten(lists).cast(pa.large_string()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _encoder(path: str, pattern: str):
    def run(batches):
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        known: dict[str, bytes] = {}
        for b in batches:
            out = []
            for words in b.column("words").to_pylist():
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w), "<u4").tobytes()
                found = [known[w] for w in words]
                out.append((np.array([len(x) // 4 for x in found], "<u4").tobytes(), b"".join(found)))
                if len(known) > MOST_KNOWN:
                    known.clear()
            # Vocabularies are far below 2^24, so the planes of the high bytes are empty and cost nothing once compressed.
            packed = [[len(x) // 4, pa.compress(_planes(x), codec="zstd", asbytes=True)] for pair in out for x in pair]
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("chunk"), *(pa.array([p[k] for p in packed[j::2]]) for j in (0, 1) for k in (0, 1))],
                names=["part", "chunk", "n_words", "lengths", "n_ids", "ids"],
            )
        del encode
        known.clear()
        trim()

    return run


def _planes(x: bytes) -> bytes:
    return np.frombuffer(x, np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    raw = pa.decompress(packed, 4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)


def _reassemble(answers: pa.Table, row: dict) -> pa.Table:
    at, ends, order = word_trip.unpack(row)
    parts = answers.to_pylist()
    lengths = np.concatenate([_numbers(p["lengths"], p["n_words"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    pool = np.concatenate([_numbers(p["ids"], p["n_ids"]) for p in parts] or [np.zeros(0, np.uint32)])
    if len(lengths) != len(order):
        raise ValueError("a chunk that was read again was cut otherwise")
    start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    start[order], size[order] = np.cumsum(lengths) - lengths, lengths
    n = size[at]
    stop = np.concatenate([[0], np.cumsum(n)])
    from_ = np.repeat(start[at] - stop[:-1], n)
    from_ += np.arange(stop[-1])
    lists = pa.ListArray.from_arrays(pa.array(stop[ends].astype(np.int32)), pa.array(pool[from_].view(np.int32)))
    return pa.table({"doc_id": pa.chunked_array([pa.array(row["ids"])]), "ids": lists})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, lambda t: t, "ids array<int>")


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, then, schema: str) -> DataFrame:
    """(doc_id, ids) of every row of docs, after `then`, which makes doc_id and the columns of schema of a chunk's rows."""
    tokens, parts = pre_tokens(docs, pattern, id_col, text_col), word_trip.parts_for(docs)
    words = word_trip.sent(tokens, _tokens, parts).repartition("part")
    back = words.mapInArrow(_encoder(ranks_path, pattern), "part int, chunk bigint, n_words bigint, lengths binary, n_ids bigint, ids binary")
    kind = docs.schema[id_col].dataType.simpleString()
    typed = _typed(docs.select(F.col(id_col).alias("doc_id")).schema)
    texts = word_trip.kept(tokens, _tokens, parts)

    def whole(answers: pa.Table, row: dict) -> pa.Table:
        out = typed(then(_reassemble(answers, row)))
        trim()
        return out

    return word_trip.by_chunk(back, texts, whole, f"doc_id {kind}, {schema}")


def _typed(schema):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[0].dataType)
    return lambda t: t.set_column(0, "doc_id", t.column("doc_id").cast(kind))


@functools.lru_cache(maxsize=1)
def _token_bytes(ranks_path: str) -> list[bytes]:
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


DECODED = "n_tokens bigint, ids_sha256 string, decoded binary"


def _decoded(batches, ranks_path: str):
    """Batches of (doc_id, ids) to batches of doc_id and DECODED, few rows at a time."""
    table = _token_bytes(ranks_path)
    for b in (whole.slice(start, word_trip.AT_ONCE) for whole in batches for start in range(0, whole.num_rows, word_trip.AT_ONCE)):
        lists = b.column("ids")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        rows = [flat[s:e] for s, e in zip(ends, ends[1:], strict=False)]
        ids = [r.astype("<u4").tobytes() for r in rows]
        text = [b"".join([table[i] for i in r.tolist()]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(list(map(len, rows)), pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(text, pa.binary())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded"],
        )
        del lists, flat, rows, ids, text
        trim()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids) with ids_le (the ids as little-endian unsigned 32-bit integers) and decoded (their bytes)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, ranks_path), f"doc_id {kind}, {DECODED}")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A chunk's ids are decoded by the worker that has put them together, so that a task keeps one worker, not two.
    """

    def back(ids: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_decoded(ids.to_batches(), ranks_path))

    decoded = _encoded(docs, ranks_path, pattern, id_col, text_col, back, DECODED)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
