"""Documents at URLs, by a function of the user's: `fetch(url)` gives the bytes, or raises.

The library opens no connection itself; clients, credentials and caches are the function's business. It runs in tasks: the
distinct URLs are dealt by hash, so each is asked for once whatever the number of places that refer to it, and a task has a
bounded number of calls under way. What came is written once to the shared checkpoint folder and read from there, so neither a
lost executor nor a second use of the result fetches again what was written.

A null URL is not fetched. What is no UTF-8 text counts as fetched, with a null body. A call that raises is made again up to
`retries` times if the error is one of `transient`; other errors are final at once.
"""

from __future__ import annotations

import asyncio
import inspect
import sys
import time
from collections.abc import Awaitable, Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from isomere.sources.stored import stored

# Workers get these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Fetch = Callable[[str], bytes] | Callable[[str], Awaitable[bytes]]
SCHEMA = "url string, body string, error string, transient boolean, calls int"


def _row(url: str, data: bytes | str | None, error: Exception | None, transient: bool, calls: int) -> dict:
    body = data
    if isinstance(data, bytes):
        try:
            body = data.decode("utf-8")
        except UnicodeDecodeError:
            body = None
    return {"url": url, "body": body, "error": error and f"{type(error).__name__}: {error}", "transient": error and transient, "calls": calls}


def _caller(fetch: Fetch, retries: int, wait: float, transient: tuple[type[Exception], ...]):
    def one(url: str) -> dict:
        for n in range(retries + 1):
            try:
                return _row(url, fetch(url), None, False, n + 1)
            except Exception as e:  # noqa: BLE001  whatever a user's function raises becomes a row
                if n == retries or not isinstance(e, transient):
                    return _row(url, None, e, isinstance(e, transient), n + 1)
                time.sleep(wait * 2**n)
        raise AssertionError

    async def one_async(url: str, free: asyncio.Semaphore) -> dict:
        async with free:
            for n in range(retries + 1):
                try:
                    return _row(url, await fetch(url), None, False, n + 1)
                except Exception as e:  # noqa: BLE001
                    if n == retries or not isinstance(e, transient):
                        return _row(url, None, e, isinstance(e, transient), n + 1)
                    await asyncio.sleep(wait * 2**n)
        raise AssertionError

    return one, one_async


def fetched(urls: DataFrame, fetch: Fetch, in_flight: int = 16, retries: int = 2, wait: float = 0.5, transient: tuple[type[Exception], ...] = (OSError, TimeoutError), at_once: int = 256) -> DataFrame:
    """(url, body, error, transient, calls) of the distinct URLs of urls (url).

    fetch: plain or asynchronous. in_flight: calls under way in a task. retries: calls after the first for transient errors,
    after `wait` seconds, then twice as long each. at_once: documents that a task holds before it hands them on.
    """
    one, one_async = _caller(fetch, retries, wait, transient)
    types = {"url": pa.string(), "body": pa.string(), "error": pa.string(), "transient": pa.bool_(), "calls": pa.int32()}

    async def together(part: list[str]) -> list[dict]:
        free = asyncio.Semaphore(in_flight)
        return list(await asyncio.gather(*(one_async(u, free) for u in part)))

    def run(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                asked = b.column("url").to_pylist()
                for k in range(0, len(asked), at_once):
                    part = asked[k : k + at_once]
                    rows = asyncio.run(together(part)) if inspect.iscoroutinefunction(fetch) else list(pool.map(one, part))
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(types.items())))

    distinct = urls.select("url").filter("url is not null").distinct()
    return stored(distinct.repartition("url").mapInArrow(run, SCHEMA), "fetched")
