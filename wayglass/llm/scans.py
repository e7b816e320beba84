"""Prefix sums and ranks over whole sorted tables: tasks scan their ranges of the order, and what the ranges before them add is one small row a range.

Nothing is grouped into one task: a segment that holds most rows is spread over the ranges like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .store import lean, written


def _in_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def running(df: DataFrame, by: list[str], segment: str | None = None, add: tuple[str, ...] = (), xor: tuple[str, ...] = ()) -> DataFrame:
    """df in the order `by` with `place` (the row's number in its segment, from 0) and `upto_c` for each column c: its sum, or its bits' parity, over the segment's rows up to this one.

    by: columns that put the rows in order, the segment (a long without nulls) first; by them no two rows may be alike where a segment may hold many rows.
    add, xor: columns of longs without nulls.
    """
    sums = [(c, np.add, 0) for c in add] + [(c, np.bitwise_xor, 0) for c in xor]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n, carry = None, 0, [0] * len(sums)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            seg = batch.column(batch.schema.get_field_index(segment)).to_numpy() if segment else np.zeros(rows, np.int64)
            heads = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
            which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, rows)))
            goes_on = last is not None and seg[0] == last
            place = np.arange(rows) - heads[which] + np.where(which == 0, n if goes_on else 0, 0)
            out = [place]
            for k, (c, op, zero) in enumerate(sums):
                x = batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64)
                whole = op.accumulate(x)
                before = np.concatenate([[zero], whole])[heads]
                inside = whole - before[which] if op is np.add else whole ^ before[which]
                inside = op(inside, np.where(which == 0, carry[k] if goes_on else zero, zero))
                carry[k] = int(inside[-1])
                out.append(inside)
            last, n = seg[-1], int(place[-1]) + 1
            extra = [pa.array(np.asarray(o, np.int64)) for o in out] + [pa.array(np.full(rows, part, np.int32))]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + extra, names)

    added = ["place", *[f"upto_{c}" for c, _, _ in sums]]
    names = [*df.columns, *added, "_range"]
    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in added], StructField("_range", IntegerType())])
    rows = written(_in_ranges(df, by).mapInArrow(lean(work), schema), "scan")

    seg = F.col(segment) if segment else F.lit(0).cast("long")
    ends = rows.groupBy("_range").agg(F.min(seg).alias("first"), F.max(F.struct(seg.alias("seg"), *added)).alias("end")).orderBy("_range")
    offsets, last, carry = [], None, []  # a row for each range
    for r in ends.collect():
        seg_, place, *upto = r["end"]
        if last is not None and r["first"] == last:
            offsets.append((r["_range"], last, *carry))
            if seg_ == last:  # the whole range goes on with the segment
                place, upto = place + carry[0], [int(op(x, y)) for x, y, (_, op, _) in zip(upto, carry[1:], sums)]
        last, carry = seg_, [place + 1, *upto]
    if not offsets:
        return rows.drop("_range")
    fields = ["_off_range int", "_off_seg long", *[f"_off_{c} long" for c in added]]
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, ", ".join(fields)))
    moved = rows.join(small, (F.col("_range") == F.col("_off_range")) & (seg == F.col("_off_seg")), "left")
    for c, op in [("place", np.add), *[(f"upto_{c}", op) for c, op, _ in sums]]:
        off = F.coalesce(f"_off_{c}", F.lit(0).cast("long"))
        moved = moved.withColumn(c, F.col(c) + off if op is np.add else F.col(c).bitwiseXOR(off))
    return moved.select(*df.columns, *added)


def ranked(df: DataFrame, key: str, apart: list[str], name: str) -> DataFrame:
    """df with the dense rank of `key` (binary, no nulls) from 0 as column `name`. apart: columns that tell rows of one key apart, so that a key of many rows is spread."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n = None, -1
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            if not len(keys):
                continue
            plain = keys.to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or plain[0] != last], plain[1:] != plain[:-1]]).astype(np.int64)
            rank = n + np.cumsum(new)
            last, n = plain[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(np.full(len(keys), part, np.int32))], names)

    names = [*df.columns, name, "_range"]
    schema = StructType([*df.schema.fields, StructField(name, LongType()), StructField("_range", IntegerType())])
    rows = written(_in_ranges(df, [key, *apart]).mapInArrow(lean(work), schema), "ranks")
    offsets, last, n = [], None, 0  # a row for each range
    for r in rows.groupBy("_range").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max(name).alias("n")).orderBy("_range").collect():
        at = n - 1 if last is not None and r["a"] == last else n
        offsets.append((r["_range"], at))
        last, n = r["b"], at + r["n"] + 1
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "_off_range int, _off long"))
    return rows.join(small, F.col("_range") == F.col("_off_range")).withColumn(name, F.col(name) + F.col("_off")).select(*df.columns, name)
