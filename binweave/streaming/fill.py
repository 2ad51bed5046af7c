"""Running binned tables of a stream: the plan of a batch fill under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.accumulator import Accumulator, Count
from ..operators.axis import Axis
from ..operators.binned import Binned
from ..plans.fill import axis_columns, binned, fill_cells, keys


def fill_stream(df: DataFrame, axes: list[Axis], columns: list, accumulator: Accumulator | None = None, weight=None, sample=None, shift: float = 0.0) -> DataFrame:
    """Cells of a stream, for output mode "complete" or "update".

    Axes must not grow (their bins have to be known when the query starts).  Weighted means are summed around `shift`.
    """
    if any(a.growth for a in axes):
        raise ValueError("a stream needs axes that don't grow; bin to whole numbers with integer keys instead (fill_keys)")
    return fill_cells(df, axes, accumulator or Count(real=weight is not None), columns, weight, sample, shift=shift)


def fill_windows(df: DataFrame, time: str, size: str, lateness: str, axes: list[Axis], columns: list, slide: str | None = None) -> DataFrame:
    """Counts per time window and cell; state older than the watermark is dropped, so this also runs in "append" mode."""
    rows = binned(df.withWatermark(time, lateness), axes, columns, _t=F.col(time))
    window = F.window("_t", size, slide) if slide else F.window("_t", size)
    counts = rows.groupBy(window, *keys(axes)).agg(F.count(F.lit(1)).alias("value"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys(axes), "value")


def fill_sessions(df: DataFrame, time: str, gap: str, lateness: str, axes: list[Axis], columns: list) -> DataFrame:
    """Counts per cell and session: rows of a cell that follow one another within `gap`.  For output mode "complete" or "append"."""
    rows = binned(df.withWatermark(time, lateness), axes, columns, _t=F.col(time))
    counts = rows.groupBy(F.session_window("_t", gap).alias("session"), *keys(axes)).agg(F.count(F.lit(1)).alias("value"))
    return counts.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *keys(axes), "value")


def fill_keys(df: DataFrame, axis: Axis, column, most: int = 1_000_000) -> DataFrame:
    """Counts of a growing axis under keys that don't depend on how far it has grown: unbounded bin numbers, or the values of a category axis.

    rebase() turns a snapshot into a binned table.  A value further than `most` bins from the start stops the query, as an axis of so many bins
    would; it is never counted elsewhere.  NULL and what isn't finite have no bin.
    """
    (c,) = axis_columns([axis], [column])[0]
    if axis.kind == "category":
        return df.select(c.alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("value"))
    z = axis._z(c) * axis.cells if axis.kind == "regular" else c.cast("double") - axis.start
    far = F.raise_error(F.concat(F.lit(f"more than {most} bins from the start: "), c.cast("string"))).cast("double")
    key = F.when(F.abs(z) <= most, F.floor(z)).when(F.abs(z) < float("inf"), far)
    return df.select(key.cast("long").alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("value"))


def rebase(snapshot: DataFrame, axis: Axis) -> Binned:
    """A binned table from a table that fill_keys() has written."""
    if axis.kind == "regular":
        column: Column = F.lit(axis.start) + (F.col("key") + 0.5) / axis.cells * F.lit(axis.stop_ - axis.start)
    else:
        column = F.col("key") if axis.kind == "category" else F.col("key") + axis.start
    return Binned(axis).fill(snapshot, column, weight="value")
