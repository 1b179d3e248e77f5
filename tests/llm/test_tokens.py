import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isomere.llm import byte_bpe, token_file

from . import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe(docs, rows, encoder):
    got = sorted(map(tuple, byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for r in rows:
        ids = encoder.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(r[1] or "")))
    assert got == sorted(want, key=str)


def test_byte_bpe_odd_texts(spark, encoder):
    texts = ["'s's 's", "  a  b   ", "\u0085\u2028x\u00a0 y", "٣٤ x²½", "a\x00b\x1cc\x1fd", "ǅ ʰ ᾳ", "漢字かな交じり 문장", "\n\n \n a", "<|endoftext|>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == [encoder.encode_ordinary(t) for t in texts]


def test_byte_bpe_one_worker_a_task(docs):
    """Chunks, words and encoding are each a step of their own stage; putting together and decoding is one step of one."""
    plan = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("FlatMapCoGroupsInArrow")) == (3, 1)


def test_byte_bpe_decodes_encoded(docs):
    own = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    whole = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, hashlib.sha256(r.decoded).hexdigest()) for r in own) == sorted((str(r[0]), *r[1:]) for r in whole)


def test_byte_bpe_empty(none):
    assert byte_bpe.encode_and_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5)), max_size=60), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    codes = token_file.encode_blocks(arrays)
    back = token_file.decode_blocks(codes, np.array([len(b) for b in blocks]))
    assert [b.tolist() for b in back] == blocks


def test_blocks_compress():
    ids = np.tile(np.arange(40), 60)
    (code,) = token_file.encode_blocks([ids])
    assert len(code) < len(ids)


def test_token_file(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(map(tuple, token_file.query(docs, path).collect()), key=lambda r: r[1])
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_file_special(spark):
    """A special token's text is encoded as that token, as the library does without a switch."""
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "a <|endoftext|> b"
    (row,) = token_file.query(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), path).collect()
    ids = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_token_file_damage(docs):
    import uuid

    from pyspark.sql import functions as F

    blocks = token_file.write(docs.filter("doc_id < 4"), public_tokenizers.path("byte_bpe_50k.json"), uuid.uuid4().hex)
    with pytest.raises(Exception, match="checksum"):
        token_file.read(blocks.withColumn("crc", F.col("crc") + 1)).collect()


def test_token_file_empty(none):
    assert token_file.query(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_file_units(monkeypatch):
    """Odd texts have the library's ids, and a piece that comes again is not encoded again."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, asked, encoded = public_tokenizers.path("byte_bpe_50k.json"), [], token_file._encoded
    monkeypatch.setattr(token_file, "_encoded", lambda tokenizer, units, parted: [asked.append(x) for x in units] and encoded(tokenizer, units, parted))
    signs = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "a", "b's", "'LL", "12", "!", "é", "中", "😀", "<|endoftext|>", "<|end", "oftext|>", "_", "\r\n", "\x00"]
    dice = random.Random(3)
    texts = ["".join(dice.choices(signs, k=dice.randrange(25))) for _ in range(3000)] + [None, "", " ", "common words " * 5000]
    tokenizer = Tokenizer.from_file(path)
    want = [np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 0], "<u2").tobytes() for x in texts]
    for some in (slice(0, 1500), slice(1500, None)):
        b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts[some]))), "text": pa.array(texts[some], pa.string())})
        got = [x for part in token_file._tokenise(path)([b]) for x in part.column("ids").to_pylist()]
        assert got == want[some]
    asked.clear()
    again = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["common words " * 300_000, "words common"]})
    assert sum(b.num_rows for b in token_file._tokenise(path)([again])) == 2
    assert len(asked) <= 6


def test_blocks_of_a_run():
    """A run's table goes with it, and a damaged block spoils no other."""
    dice = np.random.default_rng(5)
    blocks = [dice.zipf(1.3, n) % 50_000 for n in (4096, 4096, 700, 1)]
    table = token_file.Table.of(np.concatenate(blocks))
    assert int(table.size.sum()) == 1 << token_file.TOTAL and (table.size[np.concatenate(blocks)] > 0).all()
    codes, lengths = token_file.encode_blocks(blocks, table), np.array([4096, 4096, 700, 1])
    assert sum(map(len, codes)) < sum(map(len, token_file.encode_blocks(blocks)))
    again = token_file.Table.read(table.written())
    assert [b.tolist() for b in token_file.decode_blocks(codes, lengths, again)] == [b.tolist() for b in blocks]
    codes[1] = codes[1][:50] + bytes(len(codes[1]) - 50)
    back = token_file.decode_blocks(codes, lengths, again)
    assert back[1].tolist() != blocks[1].tolist() and [back[k].tolist() for k in (0, 2, 3)] == [blocks[k].tolist() for k in (0, 2, 3)]
    assert [s.stop - s.start for s in token_file._shares(2 * token_file.LANES + 1)] == [token_file.LANES, token_file.LANES + 1]
