import collections

from isomere.llm import exact_dedup, minhash

from . import brute


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[brute.normal(r[1])].append(r[0])
    for r in rows:
        own = [g for g in got if g.doc_id == r[0] and g.text_sha256 == brute.sha(brute.normal(r[1]))]
        ids = by[brute.normal(r[1])]
        assert own and all(g.group_size == len(ids) and g.keep_id == min((i for i in ids if i is not None), default=None) for g in own)
    kept = collections.Counter(g.text_sha256 for g in got if g.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by)


def test_exact_dedup_small_blocks(docs):
    same = lambda n: {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, block_chars=n).collect()}
    assert same(7) == same(4096)


def test_drop_copies(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert got.count() == len({brute.normal(r[1]) for r in rows})


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert minhash.near_dedup(none).count() == 0 and minhash.drop_near_copies(none).count() == 0


def test_near_dedup(docs, rows):
    for k in (2, 5):
        sets = brute.shingle_sets([r[1] for r in rows], k)
        low = brute.groups([r[0] for r in rows], sets)
        want = sorted(((r[0] or -1), len(s), g if s else r[0]) for r, s, g in zip(rows, sets, low, strict=True))
        got = minhash.near_dedup(docs, words=k).collect()
        assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(a, b, c) for a, b, c in want]
        full = [r for r in got if r.n_shingles]
        assert sum(r.kept for r in full) == len({g for g, s in zip(low, sets, strict=True) if s and g is not None}) + 1  # and the null id's


def test_near_dedup_table(spark, sf, sf_docs):
    from isomere.llm import queries

    got = {r.doc_id: r for r in queries.op2_minhash(spark, sf).collect()}
    ids = sorted(sf_docs.doc_id)
    texts = dict(zip(sf_docs.doc_id, sf_docs.text, strict=True))
    sets = brute.shingle_sets([texts[i] for i in ids], 2)
    for i, s, low in zip(ids, sets, brute.groups(ids, sets), strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low, low == i)


def test_hot_group(spark):
    """A third of all rows are near copies of one text; no link is lost."""
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join([*base[:100], f"own{i}", *base[101:]])) for i in range(300)]
    rest = [(i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(300, 900)]
    got = minhash.near_dedup(spark.createDataFrame(near + rest, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 300} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 300)


def test_signatures_estimate():
    """Signatures agree in a share of places that is the sets' similarity, with less spread than independent ones have."""
    import numpy as np

    rng = np.random.default_rng(1)
    for both, alone in ((160, 20), (60, 40)):
        got = []
        for _ in range(150):
            h = rng.integers(0, 1 << 63, both + 2 * alone, np.uint64)
            sets = [h[: both + alone], np.concatenate([h[:both], h[both + alone :]])]
            x, y = minhash.signatures(np.concatenate(sets), np.array([0, both + alone, 2 * (both + alone)]))
            got.append((x == y).mean())
        j = both / (both + 2 * alone)
        assert abs(np.mean(got) - j) < 0.006 and np.std(got) < np.sqrt(j * (1 - j) / minhash.SIGNATURE)


def _edited(rng, words, share, tag):
    """words with a share of them replaced, some left out, by few replacements so that edits are shared now and then."""
    out = []
    for w in words:
        x = rng.random()
        if x < share * 0.8:
            out.append(f"{tag}{rng.randrange(40)}")
        elif x >= share:
            out.append(w)
    return out


def test_near_dedup_copies_of_copies(spark, monkeypatch):
    """Groups around texts that themselves are edited copies, in all degrees of likeness; brute force finds the same groups."""
    import random

    rng, texts = random.Random(5), []
    for t in range(3):
        top = [f"t{t}w{i}" for i in range(90)]
        for _ in range(60):
            texts.append(_edited(rng, top, rng.uniform(0, 0.25), "x"))
        for k in range(3):
            own = _edited(rng, top, 0.2, f"s{k}x")
            texts += [_edited(rng, own, rng.uniform(0, 0.2), "y") for _ in range(25)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = brute.shingle_sets([t for _, t in rows], 2)
    want = dict(zip(range(len(rows)), brute.groups([i for i, _ in rows], sets), strict=True))
    for small, short in ((16, 64), (2, 12)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "SHORT", short)
        got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert 20 < len(set(want.values())) < len(rows)


def test_common_passage_makes_no_posts(spark):
    """Of 100 texts with a passage in common, all unlike the hub, only the two that are alike go on; the passage is no bucket."""
    own = lambda i: list(range(1000 * i, 1000 * i + 110))
    passage = list(range(-30, 0))
    rows = [(0, i, 140, 140, 0, False, passage + own(i), [], i) for i in range(1, 101)]
    rows[1] = (0, 2, 140, 140, 0, False, passage + own(1)[:105] + own(2)[:5], [], 2)
    found = spark.createDataFrame(rows, minhash.TESTED + ", g bigint")
    long, pairs = minhash.posted(found, 80)
    assert long.count() == 0 and [tuple(r) for r in pairs.collect()] == [(2, 1)]


def test_buckets_of_one_group_share_a_hub(spark):
    """A copy that is the first of some buckets of a group is not their hub, as most of their members meet class 1 more often."""
    members = [(b, c) for b in range(4) for c in range(1, 21)] + [(b, c) for b in (4, 5) for c in range(2, 21)] + [(6, 40), (6, 41)]
    n = {b: sum(x == b for x, _ in members) for b in range(7)}
    meets = {c: sum(n[b] for b, x in members if x == c) - (0 if c == 1 else 60) for _, c in members}
    ranked = spark.createDataFrame([(b, c, n[b], meets[c]) for b, c in members], "bucket bigint, class bigint, n bigint, meets bigint")
    assert {r.bucket: r.hub for r in minhash.central(ranked).collect()} == dict.fromkeys(range(6), 1) | {6: 41}


def test_pair_in_a_bucket_with_a_hub_elsewhere(spark):
    """Two texts that are alike and meet alone in a bucket are linked, also if that bucket has another's hub."""
    import random

    rng = random.Random(7)
    top = [f"w{i}" for i in range(120)]
    texts = [_edited(rng, top, rng.uniform(0, 0.3), f"x{i}") for i in range(150)]
    texts += [[*t[:60], f"more{i}", *t[60:]] for i, t in enumerate(texts[:40])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute.groups([i for i, _ in rows], brute.shingle_sets([t for _, t in rows], 2))
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert [got[i] for i, _ in rows] == want
