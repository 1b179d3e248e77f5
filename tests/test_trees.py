"""Trees of datasets: inheritance along paths, which nodes become members, what stands in the quarantine."""

import json

import pytest

from isomere.operators import trees


@pytest.fixture
def tree(spark):
    def make(nodes, variables):
        """nodes: (path, ord); variables: (path, name, dims, coordinate?, values)."""
        of = lambda rows, schema: spark.createDataFrame(rows, "tree string, path string, " + schema)
        size = {(p, d): n for p, _, dims, _, values in variables if len(dims) == 1 for d, n in [(dims[0], len(values))]}
        return trees.Tree(
            of([("a", p, k) for p, k in nodes], "ord long"), of([("a", p, k, n, dims, {}, coord, False) for k, (p, n, dims, coord, _) in enumerate(variables)], "ord int, name string, dims array<string>, attrs map<string,string>, is_coord boolean, is_time boolean"),
            of([("a", p, n, i, float(v), None) for p, n, _, _, values in variables for i, v in enumerate(values)], "name string, idx int, number double, text string"),
            of([("a", p, d, n) for (p, d), n in size.items()], "dim string, size int"), of([("a", p, {"id": p}) for p, _ in nodes], "attrs map<string,string>"),
        )

    return make


def members(rows):
    """Each member's id, axes' values and ranges' values."""
    (body,) = [r.body for r in rows.collect()]
    values = lambda a: a.get("values") or [a["start"], a["stop"], a["num"]]
    return [(c["id"], {k: values(a) for k, a in c["domain"]["axes"].items()}, {k: r["values"] for k, r in c["ranges"].items()}) for c in json.loads(body)["coverages"]]


def test_nearest_coordinate_holds(tree):
    t = tree([("", 0), ("/m", 1), ("/m/k", 3), ("/m/l", 2), ("/n", 4)], [
        ("", "z", ["z"], True, [1, 2, 4]), ("", "far", [], True, [7]), ("/m", "z", ["z"], True, [5, 6, 9]), ("/m/k", "v", ["z"], False, [1, 2, 3]), ("/m/l", "z", ["z"], True, [0, 3]), ("/m/l", "v", ["z"], False, [4, 5]),
        ("/n", "v", ["z"], False, [6, 7, 8]),
    ])
    rows, bad = trees.to_collections(t, nested=True, compact=False)
    assert members(rows) == [("/m/l", {"z": [0, 3]}, {"v": [4, 5]}), ("/m/k", {"z": [5, 6, 9]}, {"v": [1, 2, 3]}), ("/n", {"z": [1, 2, 4]}, {"v": [6, 7, 8]})]
    assert bad.count() == 0
    assert members(trees.to_collections(t, compact=False)[0]) == [("/n", {"z": [1, 2, 4]}, {"v": [6, 7, 8]})]


def test_root_alone_and_no_data(tree):
    alone = tree([("", 0), ("/e", 1)], [("", "z", ["z"], True, [1, 2, 4]), ("", "v", ["z"], False, [1, 2, 3]), ("/e", "w", [], True, [0])])
    assert members(trees.to_collections(alone, compact=False)[0]) == [("", {"z": [1, 2, 4]}, {"v": [1, 2, 3]})]
    assert members(trees.to_collections(tree([("", 0), ("", 0)], [("", "z", ["z"], True, [1])]))[0]) == []


def test_other_length_than_above(tree):
    t = tree([("", 0), ("/a", 1), ("/b", 2)], [("", "z", ["z"], True, [1, 2, 4]), ("/a", "v", ["z"], False, [1, 2]), ("/b", "v", ["z"], False, [1, 2, 3])])
    rows, bad = trees.to_collections(t, compact=False)
    assert [m[0] for m in members(rows)] == ["/b"]
    assert [tuple(r) for r in bad.collect()] == [("a", "/a", "dimension z has another length above")]


def test_no_table_of_datasets_is_broadcast(spark, tree, monkeypatch):
    """Whatever sizes the planner guesses, joins of tables that grow with the trees shuffle."""
    from isomere.operators import cf_documents
    from isomere.sources.stored import stored

    plans = []

    def noted(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *name)

    monkeypatch.setattr(trees, "stored", noted)
    monkeypatch.setattr(cf_documents, "stored", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    try:
        t = tree([("", 0), ("/m", 1)], [("", "z", ["z"], True, [1, 2, 4]), ("/m", "v", ["z"], False, [1, 2, 3])])
        rows, _ = trees.to_collections(t)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]
