"""Fixed lists of the contract, held against what the queries use."""

import pytest
from pyspark.sql import functions as F

from isomere.llm import pitman_yor, url_filter

#: The contract's rules of op8: word, host and path.
CONTRACT_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def test_url_rules_are_the_contracts(spark):
    assert [f"{verdict} {host}{path}" for verdict, host, path in url_filter.RULES] == CONTRACT_RULES
    urls = [("http://a.com/en/1", "block"), ("http://example.com/en/7", "allow"), ("http://b.net/de/1", "allow"), ("http://example.net/de/81", "block"), ("http://c.org/es/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    none = spark.createDataFrame([], "url string, block boolean")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, none).collect()} == {i: v for i, (_, v) in enumerate(urls)}


def test_base_columns_need_no_seats(spark, monkeypatch):
    texts = ["a b c a b", "B a", None, "", "new words here", "a  b\n\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held, columns = F.col("doc_id") == 4, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    whole = pitman_yor.pitman_yor(docs, held).select(columns).orderBy("doc_id").collect()

    def seated(*_):
        raise AssertionError("a round of seating")

    monkeypatch.setattr(pitman_yor, "_round", seated)
    base = pitman_yor.pitman_yor(docs, held, seats=False).orderBy("doc_id").collect()
    assert [r.score for r in base] == [None] * len(texts)
    for a, b in zip(whole, base, strict=True):
        assert a[:4] == b[:4] and b.base_score == pytest.approx(a.base_score)
