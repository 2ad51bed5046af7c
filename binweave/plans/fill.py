"""The plan of a fill: one projection to bin numbers, one groupBy.  The same plan serves batch and streaming tables."""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.accumulator import Accumulator
from ..operators.axis import Axis


def as_column(c) -> Column:
    """A column by name or expression; anything else is a constant for all rows."""
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def keys(axes: list[Axis]) -> list[str]:
    return [f"i{k}" for k in range(len(axes))]


def axis_columns(axes: list[Axis], columns: list) -> list[tuple[Column, ...]]:
    """Columns for each axis; a single axis of several columns takes them unpacked, too."""
    if len(axes) == 1 and axes[0].arity > 1 and len(columns) == axes[0].arity:
        columns = [tuple(columns)]
    if len(columns) != len(axes):
        raise ValueError(f"{len(axes)} axes need as many values, not {len(columns)}")
    out = []
    for a, c in zip(axes, columns):
        group = tuple(map(as_column, c)) if isinstance(c, (tuple, list)) else (as_column(c),)
        if len(group) != a.arity:
            raise ValueError(f"an axis of {a.arity} columns got {len(group)}")
        out.append(group)
    return out


BROADCAST = 8 << 20  # bytes of a table of values that is sent to every task; larger ones are joined by hash


def dictionary(spark: SparkSession, values: list, value: str, number: str) -> DataFrame:
    """A table of values and their places."""
    table = pa.table({value: pa.array(values), number: pa.array(np.arange(len(values), dtype=np.int32))})
    out = spark.createDataFrame(table)
    return F.broadcast(out) if table.nbytes <= BROADCAST else out


def binned(df: DataFrame, axes: list[Axis], columns: list, inner_only: bool = False, **more: Column | None) -> DataFrame:
    """Bin numbers i0, i1, ... and the other columns of the rows that have a cell.

    Conditions for axes that have a bin for every value are left out.  With `inner_only`, ranges of the raw columns are
    added where they follow from the bins, since only those reach the file scan.
    """
    sources = axis_columns(axes, columns)
    if inner_only:
        ranges = [r for a, c in zip(axes, sources) if a.arity == 1 and (r := a.raw_range(c[0])) is not None]
        if ranges:
            df = df.where(fold(Column.__and__, ranges))
    names, numbers = keys(axes), []
    for k, (a, c) in enumerate(zip(axes, sources)):
        look = a.lookup(*c)
        if look is None:
            numbers.append(a.index(*c))
        else:  # too many values for an expression: a table of them is joined
            values, column = look
            df = df.withColumn(f"_c{k}", column).join(dictionary(df.sparkSession, values, f"_v{k}", f"_n{k}"), F.col(f"_c{k}") == F.col(f"_v{k}"), "left")
            numbers.append(F.coalesce(F.col(f"_n{k}"), F.lit(a.size)))
    rows = df.select(*(n.alias(k) for n, k in zip(numbers, names)), *(c.alias(n) for n, c in more.items() if c is not None))
    tests = [a.inner(F.col(k)) if inner_only else a.valid(F.col(k)) for a, k in zip(axes, names)]
    tests += [F.col(n).isNotNull() for n, c in more.items() if c is not None and n[:2] in ("_w", "_s")]
    tests = [t for t in tests if t is not None]
    return rows.where(fold(Column.__and__, tests)) if tests else rows


def fill_cells(df: DataFrame, axes: list[Axis], acc: Accumulator, columns: list, weight=None, sample=None, order_by=None, shift: float | None = None, inner_only: bool = False) -> DataFrame:
    """Cells (i0, i1, ..., state) of one pass over the rows."""
    samples = [] if sample is None else list(sample) if isinstance(sample, (list, tuple)) else [sample]
    acc.check(weight, samples)
    more = {"_w": None if weight is None else as_column(weight)} | {f"_s{i}": as_column(s) for i, s in enumerate(samples)} | {"_o": None if order_by is None else as_column(order_by)}
    rows, names = binned(df, axes, columns, inner_only, **more), keys(axes)
    w, x = None if weight is None else F.col("_w"), [F.col(f"_s{i}") for i in range(len(samples))]
    own = acc.filled(rows, names, w, x)
    if own is not None:
        return own
    if shift is None:
        shift = 0.0
        if acc.needs_shift and weight is not None or acc.name == "weighted_mean":
            # any constant near the samples' mean keeps the variance free of cancellation
            shift = 0.0 if df.isStreaming else rows.agg(F.avg("_s0")).first()[0] or 0.0
    return rows.groupBy(*names).agg(*acc.fill(w, x, float(shift), None if order_by is None else F.col("_o")))
