import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from isomere.llm import language_id, pitman_yor, quality

from . import brute


def base_scores(rows):
    tokens = [(i, [*brute.lower_words(t), None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if i is None or brute.crc(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def test_pitman_yor_base(docs, rows):
    got = sorted(pitman_yor.query(docs).collect(), key=lambda r: (r.doc_id or -1, r.base_score))
    n, want = base_scores([(r[0], r[1]) for r in rows])
    for g, w in zip(got, sorted(want, key=lambda r: (r[0] or -1, r[3])), strict=True):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == (*w[:3], n)
        assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and g.score < 0
        assert g.held_out == (g.doc_id is not None and brute.crc(g.doc_id, 7) == 2)


def test_pitman_yor_beats_base(spark, sf, sf_docs):
    from isomere.llm import queries

    got = queries.op1_pitman_yor(spark, sf).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_pitman_yor_empty(none):
    assert pitman_yor.query(none).count() == 0


def test_predictions_sum_to_one():
    """Over all words and the unknown one, the probabilities of a context sum to about 1."""
    import pyarrow as pa

    words = pa.array(["a", "b", "c", "d"])
    word, context = np.array([0, 1, 2, 3, 0, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1, 4, 3 + 1])
    n = np.array([50, 20, 5, 1, 30, 9, 4, 2])
    part = pitman_yor.Part(words, word, context, n, 3)
    t = part.totals().to_pandas()
    customers, tables = (np.bincount(t.context, t[c], 9) for c in ("customers", "tables"))
    state = pitman_yor.State(2, 4, np.array([0.5, 0.5, 0.5]), customers, tables)
    part.p = part.predict(state)
    for c in (0, 1, 4):
        p = 10 ** part.log(state, np.arange(4), np.ones(4, bool), np.full(4, c))
        assert abs(p.sum() + state.unknown(np.array([c]))[0] - 1) < 1e-9


def seated_singly(rng, customers, new, discount):
    """The tables of one dish, by a chance for each customer."""
    tables = 1
    for i in range(1, customers):
        tables += rng.random() < new / (i - discount * tables + new)
    return tables


def test_seating():
    """Skipping customers gives the same distribution of tables as seating them one by one."""
    keys = np.arange(4, dtype=np.uint64)
    t = pitman_yor.seat(keys, 0, np.array([0, 1, 5, 100_000]), np.full(4, 2.0), 0.5)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 5 and 1 < t[3] < 100_000
    rng, runs = np.random.default_rng(0), 4000
    for customers, new, discount in ((2, 0.4, 0.5), (7, 3.0, 0.8), (60, 0.7, 0.3), (300, 12.0, 0.6)):
        fast = pitman_yor.seat(np.arange(runs, dtype=np.uint64) << np.uint64(20), 7 << 42, np.full(runs, customers), np.full(runs, new), discount)
        slow = np.array([seated_singly(rng, customers, new, discount) for _ in range(runs)])
        error = 5 * math.sqrt((fast.var() + slow.var()) / runs)
        assert abs(fast.mean() - slow.mean()) < error and abs(fast.std() - slow.std()) < error


def test_pitman_yor_is_dealt_alike(spark, sf):
    """Scores don't depend on the number of shuffle partitions, by which words and contexts are dealt."""
    docs, key, found = spark.read.parquet(f"{sf}/documents.parquet"), "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in (4, 9):
        spark.conf.set(key, n)
        found.append({r.doc_id: r.score for r in pitman_yor.query(docs).collect()})
    spark.conf.set(key, before)
    assert all(math.isclose(x, found[1][i], rel_tol=1e-6) for i, x in found[0].items())


def test_pitman_yor_rare_contexts(spark):
    """Pairs of words, each with one word in 6000, are told from their context, of one word and of two."""
    pairs = [(k, f"a{k} b{k} c{k}") for k in range(2000)]
    rows = [(i, " ".join(t for _, t in pairs[i % 100 :: 100])) for i in range(300)]
    held = [(1000, "a7 b7 c7"), (1001, "zzz b8 c8"), (1002, "b8 a7 c8")]
    docs = spark.createDataFrame(rows + held, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in pitman_yor.pitman_yor(docs, F.col("doc_id") >= 1000).collect()}
    # b7 and c7 follow from their contexts, which together save two words of about 1 in 6000.
    assert got[1000].score > got[1000].base_score + 4
    # Only c8 does, by one word before it that is known with two others.
    assert got[1001].score > got[1001].base_score + 1.5
    assert got[1002].score < got[1000].score - 3


def test_pitman_yor_totals_are_of_all_parts():
    """A state of some contexts predicts as one of all."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words, code = pa.array(list("abcdef")), rng.choice([0, 1, 2, 4, 5, 7, 8], 40)
    cells, n = np.unique(code * 6 + rng.integers(0, 6, 40), return_counts=True)
    part = pitman_yor.Part(words, cells % 6, cells // 6, n, 3)
    codes = np.unique(np.concatenate([[0], cells // 6, cells // 6 % 3]))
    customers, tables = part.sums(codes)
    t = part.totals().to_pandas()
    for r in t.itertuples():
        assert (customers[codes == r.context], tables[codes == r.context]) == (r.customers, r.tables)
    all_ = [np.bincount(codes, x, 9) for x in (customers, tables)]
    dense, sparse = pitman_yor.State(2, 6, np.full(3, 0.5), *all_), pitman_yor.State(2, 6, np.full(3, 0.5), customers, tables, codes)
    for a, b in zip(part.predict(dense), part.predict(sparse), strict=True):
        assert np.allclose(a, b)


def test_language_id_held_out(spark, sf, sf_docs):
    from isomere.llm import queries

    got = queries.op7_language_id(spark, sf).toPandas().merge(sf_docs, on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


def test_language_id_odd(spark, docs, rows):
    known = [("en", "the quick brown fox runs over the lazy dog with a text of its own far away"), ("de", "der schnelle Hund läuft über den faulen Fuchs und springt weiter"), ("fr", "le renard naïf boit un café")]
    model = language_id.train(spark.createDataFrame(known * 3, "lang string, text string"))
    got = collections.defaultdict(set)
    for r in language_id.identify(docs, model).collect():
        got[r.doc_id].add((r.lang_pred, r.score if r.lang_pred == "und" else None))
    for i in (4, 5, 6, 10):
        assert got[i] == {("und", 0.0)}
    assert got[9] == {("de", None)} and got[1] == {("en", None)}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


def test_language_id_spans(spark):
    en, de = "the cat and the dog run over this small house with them", "der Hund und die Katze laufen über das kleine Haus mit ihnen"
    train = spark.createDataFrame([("en", en)] * 3 + [("de", de)] * 3 + [("ru", "кошка и собака бегут")], "lang string, text string")
    model = language_id.train(train)
    texts = spark.createDataFrame([(1, f"{en} {de}"), (2, en), (3, "собака")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_id.identify(texts, model).collect()}
    assert got[1].n_spans == 2 and got[2].n_spans == 1 and 0.4 < got[1].score < 0.7
    assert got[3].lang_pred == "ru"


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    scores, of = rng.normal(0, 8, (9, 3)), np.array([0, 0, 0, 0, 0, 1, 3, 3, 3])
    got = language_id.viterbi(scores, of, 4)
    import itertools

    for text in (0, 1, 3):
        at = np.nonzero(of == text)[0]
        value = lambda way: sum(scores[i, k] for i, k in zip(at, way, strict=True)) - language_id.SWITCH * sum(a != b for a, b in zip(way, way[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(value(got[at]), max(map(value, itertools.product(range(3), repeat=len(at)))))


def test_language_id_nothing_to_learn(none, docs):
    model = language_id.train(none.select("lang", "text"))
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}


def counted(text):
    w, lines = brute.words(text), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base(docs, rows, spark):
    extra = spark.createDataFrame([(100, "a b c d e f a b c d e f a\na b\na b\n\n#|", "en"), (101, "x y " * 40, "en")], "doc_id bigint, text string, lang string")
    frame = docs.select("doc_id", "text", "lang").unionByName(extra)
    got = quality.quality(frame).collect()
    want = sorted([(r[0] or -1, *counted(r[1])) for r in rows] + [(r.doc_id, *counted(r.text)) for r in extra.collect()])
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_rejects_outliers(spark):
    clean = [(i, " ".join(f"{a}{b}" for a in ("ba", "be", "bi", "bo") for b in ("la", "le", f"l{'aeiou'[i % 5]}")), "en") for i in range(80)]
    odd = [(1000, " ".join("".join(chr(0x4E00 + 7 * k + j) for j in range(5)) for k in range(12)), "en")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(clean + odd, "doc_id bigint, text string, lang string")).collect()}
    assert not got[1000].base_failed and not got[1000].kept
    assert all(got[i].kept for i, _, _ in clean if not got[i].base_failed)


def kneser_ney(words, fold):
    """log p of a tuple of folded signs, as a function, by modified Kneser-Ney over the words' windows."""
    order, kinds = quality.ORDER, 31
    counts = {order: collections.Counter()}
    for w in words:
        signs = [quality.BEFORE] * (order - 1) + fold(w) + [quality.LAST]
        counts[order].update(tuple(signs[i : i + order]) for i in range(len(w) + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        known = n[1] + 2 * n[2]
        cuts[k] = [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if known and n[i] else 0.5 * i for i in (1, 2, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / kinds
        same = {h: n for h, n in counts[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        cut = lambda n: cuts[k][min(n, 3) - 1]
        total, n = sum(same.values()), same.get(g, 0)
        return ((n - cut(n)) if n else 0) / total + sum(map(cut, same.values())) / total * p(g[1:])

    return p


def test_kneser_ney(spark):
    """Every probability is that of a plain model, and those of all signs in a context sum to one."""
    words = "abba baab abab bbaa aabb abcd abba 12-3 ÉÈ abab".split()
    raw, signs = quality.counted(spark.createDataFrame([("en", " ".join(words)), ("de", "xyx yxx")], "lang string, text string"))
    model = quality.train(raw, quality.Alphabets(signs))
    lang = model.alphabets.langs.index("en")
    fold = lambda w: model.alphabets.fold(np.full(len(w), lang), np.array([ord(c) for c in w])).tolist()
    p = kneser_ney(words, fold)
    contexts = [tuple(fold(c)) for c in ("   ", "  a", " ab", "aba", "zzz", "12-", "q9a")]
    for context in contexts:
        rows = [(*context, s) for s in range(1, 32)]
        g = np.array([sum(s << 5 * (3 - i) for i, s in enumerate(r)) for r in rows])
        got = np.exp(model.logs(np.full(31, lang), g))
        assert abs(got.sum() - 1) < 1e-5 and np.allclose(got, [p(r) for r in rows], rtol=1e-4)


def test_quality_languages_in_turn(spark, monkeypatch):
    """More languages than have their models with the tasks at once give the same results."""
    rows = [(i, " ".join(f"{'abcdefgh'[(i + k) % 8]}{'aeiou'[k % 5]}{i % 3}" for k in range(30)), f"l{i % 5}" if i % 11 else None) for i in range(120)]
    frame, found = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), []
    for n in (8, 2):
        monkeypatch.setattr(quality, "AT_ONCE", n)
        found.append({r.doc_id: r for r in quality.quality(frame).collect()})
    assert len(found[0]) == 120 and all(found[1][i].kept == r.kept and math.isclose(found[1][i].perplexity, r.perplexity, rel_tol=1e-6) for i, r in found[0].items())


def test_seating_draws_ahead(monkeypatch):
    """A dish with many tables needs few passes of draws, and the tables are those of one pair of draws after the other."""
    keys, customers, new, discount = np.arange(40, dtype=np.uint64) * np.uint64(977), np.array([0, 1, 2, 9, 300_000] * 8), np.linspace(0.1, 400, 40), 0.6
    want = np.minimum(customers, 1)
    for k in range(40):
        key, i, number = keys[k : k + 1], int(want[k]), 5 << 40
        while i < customers[k]:
            (u,), (v,) = pitman_yor.uniform(key, number, 2)
            t = discount * want[k]
            chance = new[k] / (i - t + new[k])
            i += int(min(np.floor(np.log(u) / np.log1p(-chance)), customers[k]))
            want[k] += i < customers[k] and v * chance < new[k] / (i - t + new[k])
            i, number = i + 1, number + 2
    passes, uniform = [], pitman_yor.uniform
    monkeypatch.setattr(pitman_yor, "uniform", lambda *x: passes.append(x) or uniform(*x))
    assert pitman_yor.seat(keys, 5 << 40, customers, new, discount).tolist() == want.tolist()
    assert len(passes) < want.max() / 10


def test_pitman_yor_leaves_no_rounds(docs, spark):
    """Of the tables between rounds only the parts and the last round's stay, and the session's setting is as before."""
    import os

    from isomere.llm import common

    folder, name = common._shared(spark).removeprefix("file:"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, setting = set(os.listdir(folder)), spark.conf.get(name)
    scored = pitman_yor.query(docs)
    assert len(set(os.listdir(folder)) - held) == 2 and spark.conf.get(name) == setting
    assert scored.count() == docs.count()


def test_packed_numbers():
    from isomere.llm import word_trip

    rows = [np.array(x, np.int64) for x in ([], [0], [1, 255, 256, 2**40], [-1, 5, 2**63 - 1, -(2**63)], [0, 0])]
    assert [x.tolist() for x in word_trip.unpacked(word_trip.pack(*rows))] == [x.tolist() for x in rows]


def test_quality_every_sign_counts(spark):
    """Signs beyond the frequent ones are told apart, and a word's probability is that of a plain model of its symbols."""
    import pyarrow as pa

    digits, number = quality.spelling()
    codes = np.zeros(len(digits), np.int64)
    for k in range(digits.shape[1]):
        codes = codes * 32 + digits[:, k]
    assert len(np.unique(codes)) == 0x110000 and ((digits > 0).sum(axis=1) == number).all() and digits.max() < 32
    assert all(len(set(number[digits[:, 0] == d].tolist())) == 1 for d in range(1, 32))  # no spelling begins another
    plain = " ".join("abcdefghi jklmnopqr stuvwxyz! abc bcd cde".split() * 3)
    texts = [(i, plain + x, "en") for i, x in enumerate([" QaQ XbX", " QaQ XbX", " QaQ XbX", " YaY XbX", " \u0416a\u0416 \u4e2db\u4e2d", " \U00020021a\U000e0021"])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality.quality(frame).collect()}
    assert got[0] == got[1] < got[3]  # they differ in a rare sign only
    raw, signs = quality.counted(frame.select("lang", "text"))
    model = quality.train(raw, quality.Alphabets(signs))

    def spelled(w):
        out = []
        for c in map(ord, w):
            own = signs["en"].index(c) + quality.FIRST if c in signs["en"] else None
            kind = quality.DIGIT if chr(c) in "0123456789" else quality.LETTER if c >= 128 or chr(c).isalpha() else quality.OTHER
            out += [own] if own else [kind, *digits[c, : number[c]].tolist()]
        return tuple(out)

    words = [spelled(w) for _, x, _ in texts for w in x.split()]
    p = kneser_ney(words, list)
    for w in ("QaQ", "\u0416a\u0416", "\u4e2db\u4e2d", "\U00020021a\U000e0021", "abc"):
        line = [quality.BEFORE] * 3 + list(spelled(w)) + [quality.LAST]
        want = sum(math.log(p(tuple(line[i : i + 4]))) for i in range(len(line) - 3))
        (log,), (n,) = model.words(np.zeros(1, np.int64), pa.array([w]))
        assert n == len(w) + 1 and math.isclose(log, want, rel_tol=1e-4)


def test_quality_empty(none):
    assert quality.quality(none).count() == 0
    assert F is not None


def test_items_of_texts_make_their_trip_once(spark):
    """What scores the texts reads them once more for their places, but sends no items a second time."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    scored = pitman_yor.pitman_yor(docs, pitman_yor.held_out(F.col("doc_id")), seats=False)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.n_tokens for r in scored.collect()) == [1, 3, 4]
