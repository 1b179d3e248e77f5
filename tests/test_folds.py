"""Ordered folds against a plain loop."""

import itertools
import random

import pytest

from isomere.operators import folds


def repeated(state, row):
    """Stops at the third failure in a row of one kind."""
    kind, n = state
    n = n + 1 if kind == row["kind"] else 1
    return (row["kind"], n), n >= 3


def loop(rows, start, step):
    out = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        state = start()
        for g, at, kind in group:
            state, halt = step(state, {"g": g, "at": at, "kind": kind})
            out.append((g, at, kind, halt))
            if halt:
                break
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


@pytest.mark.parametrize("chunk", [7, 40, 1000])
def test_fold_equals_loop(spark, chunk):
    draw = random.Random(chunk)
    rows = [(draw.choice(["hot", "hot", "a", "b", None]), 2**60 + i, draw.choice("xyz" if i % 50 else "x")) for i in range(150)]
    draw.shuffle(rows)
    got = folds.fold(spark.createDataFrame(rows, "g string, at long, kind string"), ["g"], ["at"], repeated, lambda: (None, 0), chunk)
    assert order(map(tuple, got.collect())) == loop(rows, lambda: (None, 0), repeated)


def test_state_goes_through_all_parts(spark):
    rows = [("hot", i, "x") for i in range(60)] + [("other", 0, "x")]

    def count(n, row):
        return n + 1, n + 1 == 55

    got = folds.fold(spark.createDataFrame(rows, "g string, at long, kind string"), ["g"], ["at"], count, lambda: 0, 9)
    assert order(map(tuple, got.collect())) == loop(rows, lambda: 0, count)


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([("a", 1, "x")] * 4, "g string, at long, kind string")
    assert folds.fold(df.limit(0), ["g"], ["at"], repeated, lambda: (None, 0)).count() == 0
    assert sorted(r.halt for r in folds.fold(df, ["g"], ["at"], repeated, lambda: (None, 0), 1).collect()) == [False, False, True]
    with pytest.raises(ValueError):
        folds.fold(df.withColumnRenamed("kind", "halt"), ["g"], ["at"], repeated)
