"""References and tiles of documents: odd bodies, order of sites, strategies of one's own."""

import json

from pyspark.sql import functions as F

from isomere.operators import fetching, tiles
from isomere.sources import fetch
from isomere.sources.documents import decode

BODY = {"type": "CoverageCollection", "extra": "1.5", "n": 1, "coverages": [{"type": "Coverage", "domain": "http://d", "ranges": {"z": "http://z", "a": {"type": "NdArray", "dataType": "string", "values": ["[x"]}, "b": "http://gone"}}, {"type": "Coverage", "domain": "http://d", "ranges": {}}]}
OTHERS = [("http://d", '{"type":"Domain","axes":{}}'), ("http://z", '{"type":"Coverage","domain":"u","ranges":{}}')]


def test_resolve(spark):
    decoded, _ = decode(spark.createDataFrame([(1, json.dumps(BODY)), (2, '{"type":"NdArray"}')], "doc_id bigint, body string"))
    sites = fetching.reference_sites(decoded).orderBy("cov_idx", "slot_ord").collect()
    assert [(r.cov_idx, r.slot, r.url) for r in sites] == [(0, None, "http://d"), (0, "z", "http://z"), (0, "b", "http://gone"), (1, None, "http://d")]
    whole, failures = fetching.resolve_references(decoded, spark.createDataFrame(OTHERS, "url string, body string"))
    (row,) = whole.collect()
    want = json.loads(json.dumps(BODY))
    for c in want["coverages"]:
        c["domain"] = {"type": "Domain", "axes": {}}
    assert json.loads(row.body) == want and list(json.loads(row.body)["coverages"][0]["ranges"]) == ["z", "a", "b"]
    assert {(r.slot, r.kind, r.message) for r in failures.collect()} == {("z", "unrecoverable", "unexpected type Coverage"), ("b", "transient", "no document")}


def test_tiles_of_any_rank(spark):
    body = {"type": "TiledNdArray", "dataType": "float", "axisNames": ["t", "y", "x"], "shape": [2, 2, 3], "tileSets": [{"tileShape": [1, None, 2], "urlTemplate": "http://x/{t}/{x}"}, {"tileShape": [None, None, None], "urlTemplate": "http://x/all"}]}
    arrays = spark.createDataFrame([(1, json.dumps(body))], "doc_id bigint, body string")
    found = [(r.url, r.offsets) for r in fetching.tile_layout(arrays, ["doc_id"], 0).orderBy("url").collect()]
    assert found == [("http://x/0/0", [0, 0, 0]), ("http://x/0/1", [0, 0, 2]), ("http://x/1/0", [1, 0, 0]), ("http://x/1/1", [1, 0, 2])]
    assert [r.url for r in fetching.tile_layout(arrays, ["doc_id"]).collect()] == ["http://x/all"]
    assert fetching.tile_layout(arrays, ["doc_id"], 7).count() == 0
    others = spark.createDataFrame([("http://x/all", json.dumps({"type": "NdArray", "shape": [2, 2, 3], "values": list(range(11)) + [None]}))], "url string, body string")
    cells, failures = fetching.assemble(arrays, others, ["doc_id"])
    assert [r.value for r in cells.orderBy("flat_idx").collect()] == [str(i) for i in range(11)] + [None] and failures.count() == 0


def test_own_strategy(spark):
    rows = spark.createDataFrame([(1, i, "transient" if i % 2 else "unrecoverable") for i in range(6)], "k int, i int, kind string")
    seen = tiles.halted(rows, ["k"], ["i"], lambda n, kind: (n >= 2) & (kind == "unrecoverable"))
    assert [(r.i, r.halt) for r in seen.orderBy("i").collect()] == [(0, False), (1, False), (2, True)]
    assert tiles.halted(rows.filter(F.col("i") < 0), ["k"], ["i"], "fail_fast").count() == 0


def calls(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().split())


def counting(folder):
    """A function that leaves a line for each of its calls."""
    where = str(folder)

    def fetch(url):
        import os
        import threading

        with open(f"{where}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(url + "\n")
        if "gone" in url:
            raise FileNotFoundError(url)
        if "bad" in url:
            raise ValueError("no such kind")
        return {"http://d": b'{"type":"Domain","axes":{}}', "http://raw": b"\xff\xfe"}.get(url, b'{"type":"NdArray","dataType":"float","values":[1]}')

    return fetch


def test_fetch_once_a_url(spark, tmp_path):
    urls = ["http://d"] * 500 + ["http://a", "http://gone", "http://bad", "http://raw", None] * 7
    rows = fetch.fetched(spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, doc_id int").repartition(6), counting(tmp_path), in_flight=3, retries=2, wait=0.01)
    got = {r.url: (r.body, r.error, r.transient, r.calls) for r in rows.collect()}
    rows.count()
    assert calls(tmp_path) == ["http://a", "http://bad", "http://d", "http://gone", "http://gone", "http://gone", "http://raw"]
    assert got["http://d"] == ('{"type":"Domain","axes":{}}', None, None, 1) and got["http://raw"] == (None, None, None, 1)
    assert got["http://gone"] == (None, "FileNotFoundError: http://gone", True, 3) and got["http://bad"] == (None, "ValueError: no such kind", False, 1) and len(got) == 5


def test_fetch_async(spark):
    async def get(url):
        import asyncio

        await asyncio.sleep(0.01)
        if url.endswith("7"):
            raise TimeoutError("late")
        return url.encode()

    rows = fetch.fetched(spark.range(40).selectExpr("concat('http://x/', id) AS url"), get, in_flight=8, retries=1, wait=0.01, at_once=16).collect()
    assert {r.url for r in rows if r.error} == {f"http://x/{n}7" for n in ("", 1, 2, 3)} and {r.calls for r in rows if r.error} == {2}
    assert all(r.body == r.url for r in rows if not r.error) and len(rows) == 40
    assert fetch.fetched(spark.createDataFrame([], "url string"), get).count() == 0


def test_resolve_with(spark, tmp_path, monkeypatch):
    """A document that all sites share is asked for once, and its sites are spread over several tasks."""
    monkeypatch.setattr(fetching, "HOT_SITES", 5)
    cov = {"type": "Coverage", "domain": "http://d", "ranges": {"p": "http://a", "q": "http://gone", "r": "http://bad", "s": "http://raw", "t": "http://d"}}
    decoded, _ = decode(spark.createDataFrame([(i, json.dumps(cov)) for i in range(40)], "doc_id bigint, body string"))
    whole, failures = fetching.resolve_with(decoded, counting(tmp_path), retries=0)
    bodies = [json.loads(r.body) for r in whole.collect()]
    assert len(bodies) == 40 and all(b["domain"] == {"type": "Domain", "axes": {}} and b["ranges"]["p"]["values"] == [1] and b["ranges"]["q"] == "http://gone" for b in bodies)
    told = {(r.slot, r.kind, r.message) for r in failures.collect()}
    assert told == {("q", "transient", "FileNotFoundError: http://gone"), ("r", "unrecoverable", "ValueError: no such kind"), ("s", "unrecoverable", "not JSON"), ("t", "unrecoverable", "unexpected type Domain")}
    assert failures.count() == 160 and len(calls(tmp_path)) == 5


def test_assemble_with(spark):
    def get(url):
        if url.endswith("1"):
            raise ConnectionError("down")
        return b'{"type":"NdArray","dataType":"float","axisNames":["x"],"shape":[2],"values":[1,2]}'

    body = {"type": "TiledNdArray", "dataType": "float", "axisNames": ["x"], "shape": [4], "tileSets": [{"tileShape": [2], "urlTemplate": "http://x/{x}"}]}
    cells, failures = fetching.assemble_with(spark.createDataFrame([(1, json.dumps(body))], "doc_id bigint, body string"), get, ["doc_id"], retries=0)
    assert [r.value for r in cells.orderBy("flat_idx").collect()] == ["1", "2", None, None]
    assert [(r.url, r.kind, r.message) for r in failures.collect()] == [("http://x/1", "transient", "ConnectionError: down")]
