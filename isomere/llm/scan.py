"""Positions and running sums within the rows of a key, whatever the number of rows a key has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, trim


def _local(key: str, sums: list[str], names: list[str]):
    def run(batches):
        part, rows, last, runs, at, totals = TaskContext.get().partitionId(), 0, None, 0, 0, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False)
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            run, starts = np.cumsum(new), np.flatnonzero(new)
            first = np.append(0, starts)[run]
            place = np.arange(len(keys)) - first + np.where(run == 0, at, 0)
            out = []
            for k, s in enumerate(sums):
                values = b.column(s).to_numpy(zero_copy_only=False)
                so_far = np.append(0, np.cumsum(values))
                out.append(so_far[1:] - so_far[first] + np.where(run == 0, totals[k], 0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(place), *map(pa.array, out), pa.array(np.full(len(keys), part, np.int32)), pa.array(np.arange(rows, rows + len(keys))), pa.array(runs + run == 1)], names=names
            )
            rows, last, runs, at, totals = rows + len(keys), keys[-1], runs + int(run[-1]), int(place[-1]) + 1, [x[-1] for x in out]
        trim()

    return run


def running(df: DataFrame, key: str, order: list[str], sums: list[str] = ()) -> DataFrame:
    """df with `position`, from 0 on, among the rows of a key in the order given, and for each of `sums` its running sum as `<name>_sum`.

    key and sums are whole numbers without nulls. Rows are sorted by ranges of (key, order); rows that are equal in these are
    split by their number. Tasks count and add along their own rows, and what the key of a task's first row has had in tasks
    before is added to that key's rows: it is read off one row a task. The result reads one stored table, which release() of
    the result removes.
    """
    sums = list(sums)
    kept = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    by = [F.asc_nulls_first(c) for c in (key, *order, "_row")]
    extra = ["position", *(f"{s}_sum" for s in sums), "_part", "_at", "_head"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_row").schema), *(f"`{c}` bigint" for c in extra[:-3]), "_part int, _at bigint, _head boolean"])
    lined = kept.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    lined = stored(lined.mapInArrow(_local(key, sums, [*lined.columns, *extra]), schema))
    release(kept)
    ends = lined.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(F.col(key).alias("last"), "_head", *extra[:-3]), "_at").alias("end"))
    carried, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        went_on = before is not None and before[0] == r["first"]
        carry = before[1] if went_on else [0] * (1 + len(sums))
        if went_on:
            carried.append((r["_part"], *carry))
        end = [r["end"]["position"] + 1, *(r["end"][f"{s}_sum"] for s in sums)]
        before = r["end"]["last"], [x + (c if r["end"]["_head"] else 0) for x, c in zip(end, carry, strict=True)]
    if not carried:
        out = lined.drop(*extra[-3:])
        out.stored_in = lined.stored_in
        return out
    table = df.sparkSession.createDataFrame(carried, ", ".join(["_part int", *(f"_carry_{c} bigint" for c in extra[:-3])]))
    joined = lined.join(F.broadcast(table), "_part", "left")
    total = lambda c: F.col(c) + F.when(F.col("_head"), F.coalesce(f"_carry_{c}", F.lit(0))).otherwise(0)
    out = joined.select(*kept.drop("_row").columns, *(total(c).alias(c) for c in extra[:-3]))
    out.stored_in = lined.stored_in
    return out
