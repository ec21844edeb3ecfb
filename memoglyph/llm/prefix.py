"""Segmented prefix sums over sorted ranges: no group and no order is one task's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memoglyph.llm.common import checkpointed, giving_back


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str | None], ranged: bool = False) -> DataFrame:
    """df, checkpointed, with running sums (inclusive) of long columns within each group, in the order given.

    sums has new name -> summed column, None for a count. Rows are dealt to ranges of (group, order), so a group of any
    size is split; a range sums its own rows, one row a range goes to the driver, and what a group has in earlier ranges is
    added to its part in the first group of a range. Rows that are equal in group and order come in any order, unless the
    caller ends the order by a column that tells them apart. Null is a group of its own. An empty table stays empty.
    ranged: df is what this function returned for the same group and order, so it needs no shuffle.
    """
    names = list(sums)
    if not ranged:
        keys = [*(F.col(c) for c in group), *(F.col(c) if isinstance(c, str) else c for c in order)]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    source = df.withColumn("_range", F.spark_partition_id())
    longs = [T.StructField(n, T.LongType(), False) for n in (*names, "_row")]
    schema = T.StructType([*source.schema.fields, *longs, T.StructField("_lead", T.BooleanType(), False)])
    at = [source.columns.index(c) for c in group]
    of = [None if c is None else source.columns.index(c) for c in sums.values()]

    def run(batches):
        carried, before, seen, lead = np.zeros(len(of), np.int64), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(i) for i in at]
            starts = _starts(keys, n)
            now = [k[0].as_py() for k in keys]
            starts[0] = before is not None and now != before
            segment = np.cumsum(starts)
            firsts = np.flatnonzero(starts)
            made = []
            for j, i in enumerate(of):
                values = np.ones(n, np.int64) if i is None else batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                base = np.concatenate([[-carried[j]], total[firsts] - values[firsts]])
                made.append(total - base[segment])
            carried = np.array([m[-1] for m in made], np.int64)
            own = (segment == 0) & lead
            lead = bool(own[-1])
            before = [k[n - 1].as_py() for k in keys]
            arrays = [*batch.columns, *(pa.array(m) for m in made), pa.array(np.arange(seen, seen + n)), pa.array(own)]
            seen += n
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    local = checkpointed(source.mapInArrow(giving_back(run), schema))
    ends = [F.max_by(F.struct(*(F.col(c) for c in [*group, *names]), "_lead"), "_row").alias("last"), F.min_by(F.struct(F.lit(1).alias("one"), *(F.col(c) for c in group)), "_row").alias("first")]
    offsets, carry, open_group = [], [0] * len(names), None
    for r in local.groupBy("_range").agg(*ends).orderBy("_range").collect():
        first, last = [r["first"][c] for c in group], [r["last"][c] for c in group]
        same = open_group is not None and first == open_group
        if same and any(carry):
            offsets.append((r["_range"], *carry))
        tail = [r["last"][n] for n in names]
        carry = [a + b for a, b in zip(carry, tail)] if same and r["last"]["_lead"] else tail
        open_group = last
    rows = [c for c in source.columns if c != "_range"]
    if not offsets:
        return local.select(*rows, *names)
    more = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("_range", T.IntegerType()), *(T.StructField(f"_more{i}", T.LongType()) for i in range(len(names)))]))
    joined = local.join(F.broadcast(more), "_range", "left")  # one row a range at most
    return joined.select(*rows, *((F.col(n) + F.when(F.col("_lead"), F.coalesce(F.col(f"_more{i}"), F.lit(0))).otherwise(F.lit(0))).alias(n) for i, n in enumerate(names)))


def _starts(keys: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first is False."""
    starts = np.zeros(n, bool)
    for k in keys:
        here, before = k.slice(1), k.slice(0, n - 1)
        other = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        starts[1:] |= other | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return starts
