import numpy as np
import pytest

from isomere.llm import mixing

from . import brute


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 17)) + (" | x" if i % 7 == 0 else ""), "s" + str(i % 5 if i % 3 else 0), "en" if i % 4 else "de") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    targets = {"lang": {"en": 0.6, "de": 0.4}}
    got = mixing.mix(docs, targets).toPandas()
    cells = got.drop_duplicates(["source", "lang", "topic"])
    by = cells.groupby("lang").weight.sum()
    assert abs(by["en"] - 0.6) < 0.002 and abs(cells.weight.sum() - 1) < 1e-6
    tokens = got.groupby("source").tokens.sum() ** mixing.TEMPERATURE
    assert np.allclose(cells.groupby("source").weight.sum(), tokens / tokens.sum(), rtol=0.01)
    assert abs((got.prob * got.tokens).sum() / got.tokens.sum() - mixing.BUDGET) < 0.02
    assert (got.tokens == [len(brute.words(t)) for t in got.merge(docs.toPandas(), on="doc_id").text]).all()


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, (3, 2, 2))
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(counts[i, j, k]), 1) for i in range(3) for j in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint, docs bigint")
    targets = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"l0": 0.5, "l1": 0.5}, "topic": {"t0": 0.9, "t1": 0.1}}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, targets).collect()}
    w = counts / counts.sum()
    for _ in range(200):
        w *= (np.array([0.2, 0.3, 0.5]) / w.sum((1, 2)))[:, None, None]
        w *= (np.array([0.5, 0.5]) / w.sum((0, 2)))[None, :, None]
        w *= (np.array([0.9, 0.1]) / w.sum((0, 1)))[None, None, :]
    for i in range(3):
        for j in range(2):
            for k in range(2):
                assert got[f"s{i}", f"l{j}", f"t{k}"] == pytest.approx(w[i, j, k], rel=0.01)


def test_mix_odd(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(not r.sampled for r in got if r.tokens == 0)
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.sampled and r.doc_id is not None)
