"""Ordered folds with a state of the user's: step(state, row) gives (state, whether to stop) for each row of a group in order.

Rows are cut by ranges of (keys, order) into parts of about `chunk` rows, written once, one folder a part. A part's groups are
folded in its task. A group that goes on into the next part hands its state over: each further round folds the next part of all
such groups side by side, and reads these parts only. A group that has stopped is not read any further. So a group of any length
takes no more memory than a part and its state, and rounds are as many as parts lie in the longest group before it stops.

Null keys are a group of their own, null order comes first. Rows that are equal in keys and order have no order among them, and
stay in one part; they should be told apart by `order`. Columns named _part, _given, _state and halt are refused. The state is
pickled between rounds.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructType

from isomere.sources.stored import shared, stored

# Workers get these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Step = Callable[[object, dict], tuple[object, bool]]
OWN = ("_part", "_given", "_state", "halt")


def _folded(keys: Sequence[str], order: Sequence[str], step: Step, start: Callable[[], object], columns: Sequence[str]):
    by = [(c, "ascending") for c in (*keys, *order)]

    def fold_part(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start"))
        seen, halts, states = [], [], []
        group, state, stopped = None, None, True
        for at, row in enumerate(table.to_pylist()):
            key = tuple(row[k] for k in keys)
            if key != group:
                group, stopped = key, False
                state = start() if row["_given"] is None else pickle.loads(row["_given"])
            elif not stopped:
                states[-1] = None  # the state stands with the group's last row only
            if stopped:
                continue
            state, stopped = step(state, {c: row[c] for c in columns})
            seen.append(at)
            halts.append(bool(stopped))
            states.append(pickle.dumps(state))
        out = table.select([*columns, "_part"]).take(pa.array(seen, pa.int64()))
        return out.append_column("halt", pa.array(halts, pa.bool_())).append_column("_state", pa.array(states, pa.binary()))

    return fold_part


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(keys)])


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, start: Callable[[], object] = lambda: None, chunk: int = 100_000) -> DataFrame:
    """The rows that each group's fold sees until it stops, with `halt` true on the one that it stops at.

    start() makes a group's first state; step gets a row as a dict of its columns.
    """
    if clash := set(OWN) & set(rows.columns):
        raise ValueError(f"columns of these names are the fold's own: {sorted(clash)}")
    if chunk < 1:
        raise ValueError("a part has one row at least")
    spark, columns = rows.sparkSession, rows.columns
    many = max(1, -(-rows.count() // chunk))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    where = f"{shared(spark)}/fold-{uuid.uuid4().hex}"
    rows.repartitionByRange(many, *by).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(where)
    cut = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _part int").parquet(where)

    # A row a part: whether its first group is the last one of the part before.
    key = F.struct(*keys)
    ends = cut.groupBy("_part").agg(F.min(key).alias("head"), F.max(key).alias("tail"))
    before = Window.orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_part").over(before)).withColumn("_tail", F.lag("tail").over(before))
    heads = stored(ends.filter(F.col("_before").isNotNull() & F.col("head").eqNullSafe(F.col("_tail"))).select("_part", "_before", *[F.col("head")[k].alias(f"_k{i}") for i, k in enumerate(keys)]))

    schema = StructType([*rows.schema.fields]).add("_part", IntegerType()).add("halt", BooleanType()).add("_state", BinaryType())
    run = _folded(list(keys), list(order), step, start, columns)
    go = lambda df: stored(df.groupBy("_part").applyInArrow(run, schema), "folded")

    first = cut.join(F.broadcast(heads), (cut["_part"] == heads["_part"]) & _same(cut, heads, keys), "left_anti")
    done = [go(first.withColumn("_given", F.lit(None).cast("binary")))]
    while True:
        last = done[-1].filter("_state is not null and not halt").select(F.col("_part").alias("_at"), *keys, F.col("_state").alias("_given"))
        on = stored(heads.join(last, (heads["_before"] == last["_at"]) & _same(last, heads, keys)).select("_part", *[f"_k{i}" for i in range(len(keys))], "_given"))
        at = [r["_part"] for r in on.select("_part").collect()]  # numbers of parts
        if not at:
            return reduce(DataFrame.unionByName, done).drop("_part", "_state")
        these = cut.filter(F.col("_part").isin(at))
        done.append(go(these.join(F.broadcast(on), (these["_part"] == on["_part"]) & _same(these, on, keys)).select(*[these[c] for c in columns], these["_part"], "_given")))
