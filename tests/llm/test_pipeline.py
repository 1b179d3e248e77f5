"""The pipeline against plain versions of its stages."""

import hashlib

import numpy as np
import public_tokenizers

from isomere.llm import byte_bpe, language_id, mixing

from . import brute


def test_pipeline(spark, sf, sf_docs):
    import corpus_pipeline
    import tiktoken

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near-dedup", "mixing", "BPE"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = sorted(((int(i), t) for i, t in zip(sf_docs.doc_id, sf_docs.text, strict=True) if t and any(c.isalpha() for c in t)))
    first = {}
    for i, t in docs:
        first.setdefault(brute.normal(t), (i, t))
    docs = sorted(first.values())
    sets = brute.shingle_sets([t for _, t in docs], 5)
    low = brute.groups([i for i, _ in docs], sets)
    docs = [d for d, k in zip(docs, low, strict=True) if k == d[0]]
    kept = spark.read.parquet(f"{sf}/documents.parquet").filter(f"doc_id in ({','.join(str(i) for i, _ in docs)})")
    want = {r.doc_id for r in mixing.mix(kept).collect() if r.sampled}
    assert set(got) == want
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    texts = dict(docs)
    for i, r in got.items():
        assert r.ids_sha256 == hashlib.sha256(np.array(encode(texts[i]), "<u4").tobytes()).hexdigest() and r.decoded_sha256 == brute.sha(texts[i])
    assert language_id.UND == "und"


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, "")
        assert own.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_decides(spark, sf, sf_docs):
    """Texts in a script of no language and letters at random are dropped, clean ones kept; a null language is filled."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    junk = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(200))
    german = sf_docs[(sf_docs.lang == "de") & (sf_docs.n_chars > 500)].text.iloc[0]
    known = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**9, "собака и кошка бегут по улице", None, "a", 29), (10**9 + 1, junk, None, "a", len(junk)), (10**9 + 2, german, None, "a", len(german))]
    docs = known.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {r.doc_id: r.lang for r in corpus_pipeline.identified(spark, docs, sf).collect()}
    assert 10**9 not in got and 10**9 + 1 not in got and got[10**9 + 2] == "de"
    assert len(got) == len(sf_docs) + 1
