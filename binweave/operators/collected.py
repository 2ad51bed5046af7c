"""Collected samples of cells that don't fit one row: each cell is a sequence of segments.

A collected table has rows (i0, i1, ..., segment, items): the samples of a cell in order, `size` to a segment, numbered from 0.  Samples are dealt
out by ranges of (cell, order, sample), so a cell of any size lies over many tasks and rows; where a range's rows begin within
their cell follows from the ranges' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fill import as_column, axis_columns, binned, keys
from .axis import Axis, grown_axes
from .binned import Binned
from .reduce import Command, normalised, plan

ITEMS = "array<struct<o:double,x:double>>"


class Collected:
    """Samples by cell, in the order of `order_by` (else of the samples themselves), ties by sample."""

    def __init__(self, *axes: Axis, size: int = 100_000, cells: DataFrame | None = None):
        if size < 1:
            raise ValueError("a segment has at least one sample")
        self.axes, self.size, self._cells = list(axes), size, cells
        self.keys = keys(self.axes)

    @property
    def cells(self) -> DataFrame:
        if self._cells is None:
            return Binned(*self.axes).cells.select(*self.keys, F.lit(0).cast("long").alias("segment"), F.array().cast(ITEMS).alias("items"))
        return self._cells

    def fill(self, df: DataFrame, *columns, sample, order_by=None) -> Collected:
        """Rows with a NULL sample are left out."""
        x = as_column(sample).cast("double")
        o = x if order_by is None else as_column(order_by).cast("double")
        axes = grown_axes(self.axes, df, axis_columns(self.axes, list(columns)), None if order_by is None else as_column(order_by))
        rows = binned(df, axes, list(columns), _s0=x, _o=o).select(*self.keys, F.col("_o").alias("o"), F.col("_s0").alias("x"))
        new = Collected(*axes, size=self.size)
        if self._cells is None:
            return new._segmented(rows)
        return new._segmented(rows.unionByName(self._in(axes)._rows(list(map(F.col, self.keys)), self.keys)))

    def _in(self, axes: list[Axis]) -> Collected:
        """The same samples in the axes that these have become."""
        return self if axes == self.axes else Collected(*axes, size=self.size, cells=Binned(*self.axes).renumbered(self.cells, axes))

    def _rows(self, index: list[Column], names: list[str]) -> DataFrame:
        """Samples one by one, under new bin numbers (NULL: dropped)."""
        cells = self.cells.select(*(i.alias(n) for i, n in zip(index, names)), F.explode("items").alias("s"))
        return cells.na.drop(subset=names).select(*names, F.col("s.o").alias("o"), F.col("s.x").alias("x"))

    def _segmented(self, rows: DataFrame) -> Collected:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [*self.keys, "o", "x"]
        # equal rows are told apart by where they came from, so a range may end among them; a stated number keeps ranges whole
        dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id())
        dealt = dealt.persist()  # both readings below see the same ranges
        counts = dealt.groupBy(*self.keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        inside = Window.partitionBy(*self.keys, "_part").orderBy("o", "x", "_tie")
        near = F.col("_part") == F.col("_p")
        for k in self.keys:
            near = near & (F.col(k) == F.col(f"_{k}"))
        ranked = dealt.withColumn("_at", F.row_number().over(inside) - 1).join(starts, near)
        segment = F.floor((F.col("_at") + F.col("_start")) / self.size).cast("long")
        parts = ranked.select(*self.keys, segment.alias("segment"), F.struct("o", "x").alias("s")).groupBy(*self.keys, "segment")
        return Collected(*self.axes, size=self.size, cells=parts.agg(F.array_sort(F.collect_list("s")).alias("items")))  # `size` items at most

    def table(self) -> DataFrame:
        """(i0, ..., segment, first, items, count): `first` is the place in the cell of a segment's first sample."""
        return self.cells.select(*self.keys, "segment", (F.col("segment") * self.size).alias("first"), F.transform("items", lambda s: s["x"]).alias("items"), F.size("items").cast("long").alias("count"))

    def counts(self) -> Binned:
        """Samples per cell."""
        return Binned(*self.axes, cells=self.cells.groupBy(*self.keys).agg(F.sum(F.size("items")).cast("bigint").alias("value")))

    def project(self, *axes: int) -> Collected:
        new = Collected(*(self.axes[k] for k in axes), size=self.size)
        return new._segmented(self._rows([F.col(f"i{k}") for k in axes], new.keys))

    def reduce(self, *commands: Command) -> Collected:
        chosen = normalised(list(commands), len(self.axes))
        plans = [plan(a, chosen.get(k), F.col(f"i{k}")) for k, a in enumerate(self.axes)]
        return Collected(*(p.axis for p in plans), size=self.size)._segmented(self._rows([p.index for p in plans], self.keys))

    def __add__(self, other: Collected) -> Collected:
        """All samples of both, in order."""
        if len(self.axes) != len(other.axes):
            raise ValueError("tables of different rank")
        axes = [a.merged(b) for a, b in zip(self.axes, other.axes)]
        parts = [h._in(axes)._rows(list(map(F.col, h.keys)), h.keys) for h in (self, other)]
        return Collected(*axes, size=self.size)._segmented(parts[0].unionByName(parts[1]))
