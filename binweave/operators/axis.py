"""Axes: how a value becomes a bin number.  Rows see only Column expressions; edges live on the driver.

Bin numbers are ints: -1 is underflow, `size` overflow.  A number without a bin drops its row.  NULL goes where
NaN goes: to `size`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import INF, Transform, transform_from_json

UNDERFLOW, OVERFLOW, CIRCULAR, GROWTH = "underflow", "overflow", "circular", "growth"
FEW = 200  # categories that an expression holds; a table of more is joined
_BIG = float(1 << 53)  # doubles from here on are whole numbers


def _options(given, default: set[str], forbidden: list[set[str]]) -> frozenset[str]:
    out = frozenset(default if given is None else given)
    if unknown := out - {UNDERFLOW, OVERFLOW, CIRCULAR, GROWTH}:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    for pair in forbidden:
        if pair <= out:
            raise ValueError(f"options exclude each other: {sorted(pair)}")
    return out


@dataclass(frozen=True)
class Bin:
    """Interval [lower, upper), or one value where both ends are it."""

    lower: Any
    upper: Any

    @property
    def is_discrete(self) -> bool:
        return self.lower == self.upper

    @property
    def center(self):
        return self.lower if self.is_discrete else 0.5 * (self.lower + self.upper)

    @property
    def width(self):
        return 0 if not isinstance(self.lower, (int, float)) else self.upper - self.lower


@dataclass(frozen=True, kw_only=True)
class Axis:
    metadata: Any = ""
    options: frozenset[str] = field(default=None)

    arity = 1
    kind = ""

    @property
    def size(self) -> int:
        raise NotImplementedError

    def index(self, *columns: Column) -> Column:
        raise NotImplementedError

    def lookup(self, *columns: Column) -> tuple[tuple, Column] | None:
        """Values by number, and the column to find among them, where a join is better than index()."""
        return None

    def value(self, i: float):
        raise IndexError("this axis has no values")

    @property
    def underflow(self) -> bool:
        return UNDERFLOW in self.options

    @property
    def overflow(self) -> bool:
        return OVERFLOW in self.options

    @property
    def circular(self) -> bool:
        return CIRCULAR in self.options

    @property
    def growth(self) -> bool:
        return GROWTH in self.options

    @property
    def inclusive(self) -> bool:
        """Every value has a bin."""
        return self.underflow and self.overflow

    @property
    def ordered(self) -> bool:
        return True

    @property
    def continuous(self) -> bool:
        return False

    @property
    def first(self) -> int:
        return -1 if self.underflow else 0

    @property
    def stop(self) -> int:
        return self.size + (1 if self.overflow else 0)

    @property
    def extent(self) -> int:
        return self.stop - self.first

    def value_column(self, i: Column) -> Column | None:
        """value() of a bin number in a column; None where only the driver knows it."""
        return None

    def bin(self, i: int) -> Bin:
        if self.continuous:
            return Bin(self.value(i), self.value(i + 1))
        return Bin(self.value(i), self.value(i))

    def width(self, i: int) -> float:
        return self.bin(i).width

    def __iter__(self) -> Iterator[Bin]:
        return (self.bin(i) for i in range(self.size))

    def __len__(self) -> int:
        return self.size

    def valid(self, i: Column) -> Column | None:
        """Whether the number has a bin; None if it always has."""
        if self.inclusive:
            return None
        low = None if self.underflow else i >= 0
        high = None if self.overflow else i < self.size
        return high if low is None else low if high is None else low & high

    def inner(self, i: Column) -> Column:
        return (i >= 0) & (i < self.size)

    def raw_range(self, column: Column) -> Column | None:
        """Condition on the raw column that holds for every row of an inner bin; it reaches the file scan."""
        return None

    def ends(self, column: Column) -> tuple[Column, Column] | None:
        """Aggregates of the rows from which grown_to() gives the axis after them; None if grown() needs more than that."""
        return None

    def grown_to(self, low: int | None, high: int | None) -> Axis:
        """This axis with bins for what ends() found."""
        return self

    def grown(self, rows: DataFrame, column: Column, order: Column | None = None) -> Axis:
        """This axis after seeing the rows."""
        ends = self.ends(column) if self.growth else None
        return self if ends is None else self.grown_to(*rows.agg(*ends).first())

    def find(self, x) -> int:
        """Bin number of one value, on the driver (for reduce by value)."""
        raise TypeError(f"{self.kind} has no order of values")

    def reduced(self, begin: int, end: int, merge: int) -> Axis:
        raise ValueError(f"{self.kind} can't be reduced")

    def merged(self, other: Axis) -> Axis:
        if self != other:
            raise ValueError("these axes have no common form")
        return self

    def to_json(self) -> dict:
        return {"kind": self.kind, "metadata": self.metadata, "options": sorted(self.options)}

    def __repr__(self) -> str:
        parts = self._parts()
        if self.metadata not in ("", None):
            parts.append(f'metadata="{self.metadata}"')
        names = [o for o in (UNDERFLOW, OVERFLOW, CIRCULAR, GROWTH) if o in self.options]
        parts.append("options=" + (" | ".join(names) or "none"))
        return f"{self.kind}({', '.join(parts)})"

    def _parts(self) -> list[str]:
        return [str(self.size)]


def _num(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


@dataclass(frozen=True, kw_only=True, repr=False)
class Regular(Axis):
    """n bins of equal width after a transform; start may be above stop.

    A grown axis keeps its first grid (`cells` bins from start to stop) and has `low` as the number of its first bin there.
    """

    n: int
    start: float
    stop_: float
    transform: Transform = Transform()
    cells: int = 0
    low: int = 0

    kind = "regular"

    def __post_init__(self):
        set_ = object.__setattr__
        set_(self, "options", _options(self.options, {UNDERFLOW, OVERFLOW}, [{CIRCULAR, GROWTH}]))
        set_(self, "start", float(self.start))
        set_(self, "stop_", float(self.stop_))
        set_(self, "cells", self.cells or self.n)
        if self.n <= 0:
            raise ValueError("an axis needs at least one bin")
        if not (math.isfinite(self.min) and math.isfinite(self.delta)):
            raise ValueError("start and stop must be finite after the transform")
        if self.delta == 0:
            raise ValueError("start and stop must differ")

    @property
    def min(self) -> float:
        return self.transform.forward(self.start)

    @property
    def delta(self) -> float:
        return self.transform.forward(self.stop_) - self.min

    @property
    def size(self) -> int:
        return self.n

    @property
    def continuous(self) -> bool:
        return True

    @property
    def _plain(self) -> bool:
        return self.low == 0 and self.cells == self.n

    def _z(self, column: Column) -> Column:
        return (self.transform.column(column.cast("double")) - F.lit(self.min)) / F.lit(self.delta)

    def index(self, column: Column) -> Column:
        z, n = self._z(column), self.n
        if self.circular:
            part = F.when(F.abs(z) < _BIG, z - F.floor(z)).otherwise(F.lit(0.0))
            return F.when(F.abs(z) < INF, (part * n).cast("int")).otherwise(F.lit(n))
        if not self._plain:
            at = F.floor(z * self.cells)
            return F.when(z == -INF, -1).when(F.abs(z) < INF, F.least(F.greatest(at - self.low, F.lit(-1)), F.lit(n)).cast("int")).otherwise(n)
        out = F.when(z < 1, F.when(z >= 0, (z * n).cast("int")).otherwise(F.lit(-1)))
        if not self.overflow:
            out = out.when(z == 1, F.lit(n - 1))
        return out.otherwise(F.lit(n))

    def find(self, x: float) -> int:
        z = (self.transform.forward(x) - self.min) / self.delta
        if self.circular:
            return int((z - math.floor(z)) * self.n) if math.isfinite(z) else self.n
        if not self._plain:
            return max(-1, min(self.n, math.floor(z * self.cells) - self.low)) if math.isfinite(z) else -1 if z < 0 else self.n
        if z < 1:
            return int(z * self.n) if z >= 0 else -1
        return self.n - 1 if z == 1 and not self.overflow else self.n

    def value(self, i: float) -> float:
        z = (i + self.low) / self.cells
        if not self.circular and i < 0:
            return self.transform.inverse(-INF * self.delta)
        if not self.circular and i > self.n:
            return self.transform.inverse(INF * self.delta)
        return self.transform.inverse((1 - z) * self.min + z * (self.min + self.delta))

    def value_column(self, i: Column) -> Column | None:
        z = (i + self.low) / self.cells
        inner = self.transform.back_column((1 - z) * F.lit(self.min) + z * F.lit(self.min + self.delta))
        if inner is None or self.circular:
            return inner
        ends = [F.lit(float(self.transform.inverse(x * self.delta))) for x in (-INF, INF)]
        return F.when(i < 0, ends[0]).when(i > self.n, ends[1]).otherwise(inner)

    def raw_range(self, column: Column) -> Column | None:
        if type(self.transform) is not Transform or self.circular or self.growth or not self._plain or self.delta < 0:
            return None
        return (column >= math.nextafter(self.start, -INF)) & (column <= math.nextafter(self.stop_, INF))

    def ends(self, column: Column) -> tuple[Column, Column]:
        z = self._z(column)
        at = F.when(F.abs(z) < INF, F.floor(z * self.cells))
        return F.min(at), F.max(at)

    def grown_to(self, low: int | None, high: int | None) -> Regular:
        if low is None:
            return self
        first = min(self.low, low)
        return replace(self, low=first, n=max(self.low + self.n, high + 1) - first)

    def reduced(self, begin: int, end: int, merge: int) -> Regular:
        if self.circular and not (begin == 0 and end == self.n):
            raise ValueError("a circular axis keeps its whole range")
        n = (end - begin) // merge
        if self.circular:
            return replace(self, n=n, cells=n)
        return replace(self, n=n, cells=n, low=0, start=self.value(begin), stop_=self.value(end))

    def to_json(self) -> dict:
        return super().to_json() | {"n": self.n, "start": self.start, "stop_": self.stop_, "transform": self.transform.to_json(), "cells": self.cells, "low": self.low}

    def _parts(self) -> list[str]:
        return [*([] if type(self.transform) is Transform else [f"transform::{self.transform.name}" + ("{}"if self.transform.name != "pow" else f"{{{_num(self.transform.power)}}}")]), str(self.n), _num(self.value(0)), _num(self.value(self.n))]


def regular(n, start, stop, metadata="", options=None, transform=None) -> Regular:
    return Regular(n=n, start=start, stop_=stop, metadata=metadata, options=options, transform=transform or Transform())


def regular_step(width: float, start: float, stop: float, metadata="", options=None, transform=None) -> Regular:
    """As many bins of the given width as fit between start and stop; a transform changes the bins between, not their number or the end."""
    if width <= 0:
        raise ValueError("the step must be positive")
    n = int(abs(stop - start) / width)
    return regular(n, start, start + n * (width if stop > start else -width), metadata, options, transform)


def circular(n, start=0.0, stop=2 * math.pi, metadata="") -> Regular:
    return regular(n, start, stop, metadata, {OVERFLOW, CIRCULAR})


def _replayed(edges: list[float], most: int):
    """Rows (o, x) in order to the edges they add, in order; ends early once there are more than `most` bins."""

    def run(batches):
        low, below_low, before_high, high, n = edges[0], edges[1], edges[-2], edges[-1], len(edges)
        for batch in batches:
            added: list[tuple[bool, float]] = []
            for x in batch.column("x").to_pylist():
                if x >= high:
                    before_high, high = high, max(math.nextafter(x, INF), high + 0.5 * (high - before_high))
                    added.append((False, high))
                elif x < low:
                    below_low, low = low, min(x, low - 0.5 * (below_low - low))
                    added.append((True, low))
                if len(added) and n + len(added) > most + 1:
                    break
            n += len(added)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in added], pa.bool_()), pa.array([e for _, e in added], pa.float64())], ["below", "edge"])
            if n > most + 1:
                return

    return run


@dataclass(frozen=True, kw_only=True, repr=False)
class Variable(Axis):
    """Bins between given edges (infinite ones allowed)."""

    edges: tuple[float, ...]
    most: int = 100_000  # bins, when growing

    kind = "variable"

    def __post_init__(self):
        object.__setattr__(self, "edges", tuple(float(x) for x in self.edges))
        object.__setattr__(self, "options", _options(self.options, {UNDERFLOW, OVERFLOW}, [{CIRCULAR, GROWTH}]))
        if len(self.edges) < 2:
            raise ValueError("an axis needs at least one bin")
        if not all(a < b for a, b in zip(self.edges, self.edges[1:])):
            raise ValueError("edges must ascend")

    @property
    def size(self) -> int:
        return len(self.edges) - 1

    @property
    def continuous(self) -> bool:
        return True

    def index(self, column: Column) -> Column:
        x = column.cast("double")
        if self.circular:
            a, b = self.edges[0], self.edges[-1]
            turns = (x - a) / (b - a)
            x = F.when(F.abs(turns) < _BIG, x - F.floor(turns) * F.lit(b - a)).otherwise(F.when(F.abs(turns) < INF, F.lit(a)).otherwise(F.lit(float("nan"))))
        n = self.size

        def tree(lo: int, hi: int) -> Column:  # edges[lo-1] <= x < edges[hi]
            if lo > hi - 1 and lo == hi:
                return F.lit(lo - 1)
            mid = (lo + hi) // 2
            return F.when(x < self.edges[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

        def search() -> Column:  # number of edges <= x, by halving steps
            edges = F.array(*map(F.lit, self.edges))
            steps = F.array(*(F.lit(1 << k) for k in reversed(range((n + 1).bit_length()))))
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n + 1) & (F.element_at(edges, F.least(at + step, F.lit(n + 1))) <= x), at + step).otherwise(at))

        out = tree(0, n + 1) if n <= 64 else F.when(x.isNull(), n).otherwise(search() - 1)
        if not self.overflow and not self.circular:
            out = F.when(x == self.edges[-1], n - 1).otherwise(out)
        return out.cast("int")

    def find(self, x: float) -> int:
        if self.circular:
            a, b = self.edges[0], self.edges[-1]
            x -= math.floor((x - a) / (b - a)) * (b - a)
        if not self.overflow and x == self.edges[-1]:
            return self.size - 1
        return self.size if math.isnan(x) else sum(e <= x for e in self.edges) - 1

    def value(self, i: float) -> float:
        n = self.size
        if self.circular:
            turns = math.floor(i / n)
            return turns * (self.edges[-1] - self.edges[0]) + self._at(i - turns * n)
        return -INF if i < 0 else INF if i > n else self._at(i)

    def _at(self, i: float) -> float:
        k = min(int(i), self.size - 1)
        z = i - k
        return self.edges[k] if z == 0 else self.edges[k + 1] if z == 1 else (1 - z) * self.edges[k] + z * self.edges[k + 1]

    def raw_range(self, column: Column) -> Column | None:
        return None if self.circular or self.growth else (column >= self.edges[0]) & (column <= self.edges[-1])

    def grown(self, rows: DataFrame, column: Column, order: Column | None = None) -> Variable:
        """Edges depend on the order of arrival (`order`, ties by value); only values beyond all earlier ones matter.

        Rows are dealt out by ranges of the order, and each range keeps the values beyond those before it there and in earlier ranges.
        Ranges that have any are replayed in turn, each in a task: edges go in, edges come out, and no rows go to the driver.
        """
        if not self.growth:
            return self
        if order is None:
            raise ValueError("a growing variable axis needs order_by")
        x = column.cast("double")
        out = rows.select(order.alias("o"), x.alias("x")).where((F.abs(F.col("x")) < INF) & ((F.col("x") < self.edges[0]) | (F.col("x") >= self.edges[-1])))
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = out.repartitionByRange(ranges, "o").withColumn("p", F.spark_partition_id()).persist()
        inside = Window.partitionBy("p").orderBy("o", "x").rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        ends = dealt.groupBy(F.col("p").alias("q")).agg(F.max("x").alias("top"), F.min("x").alias("low")).select("q", F.max("top").over(earlier).alias("top"), F.min("low").over(earlier).alias("low"))
        run = dealt.select("p", "o", "x", F.max("x").over(inside).alias("run_top"), F.min("x").over(inside).alias("run_low")).join(F.broadcast(ends), F.col("p") == F.col("q"))
        beyond = (F.col("x") > F.coalesce(F.greatest("run_top", "top"), F.lit(-INF))) | (F.col("x") < F.coalesce(F.least("run_low", "low"), F.lit(INF)))
        news = run.where(beyond).select("p", "o", "x").persist()
        edges = list(self.edges)
        for p in sorted(r[0] for r in news.select("p").distinct().collect()):
            one = news.where(F.col("p") == p).select("o", "x").coalesce(1).sortWithinPartitions("o", "x")
            sides = one.mapInArrow(_replayed(edges, self.most), "below boolean, edge double").collect()
            edges = [r["edge"] for r in reversed(sides) if r["below"]] + edges + [r["edge"] for r in sides if not r["below"]]
            if len(edges) > self.most + 1:
                raise OverflowError(f"more than {self.most} bins")
        news.unpersist()
        dealt.unpersist()
        return replace(self, edges=tuple(edges))

    def reduced(self, begin: int, end: int, merge: int) -> Variable:
        if self.circular and not (begin == 0 and end == self.size):
            raise ValueError("a circular axis keeps its whole range")
        return replace(self, edges=self.edges[begin : end + 1 : merge])

    def to_json(self) -> dict:
        return super().to_json() | {"edges": [str(e) for e in self.edges]}

    def _parts(self) -> list[str]:
        return [_num(e) for e in self.edges]


def variable(edges, metadata="", options=None) -> Variable:
    return Variable(edges=tuple(edges), metadata=metadata, options=options)


@dataclass(frozen=True, kw_only=True, repr=False)
class Integer(Axis):
    """One bin per whole number from start to stop-1.  `floating` takes doubles, else values are truncated to whole numbers first."""

    start: int
    stop_: int
    floating: bool = False

    kind = "integer"

    def __post_init__(self):
        object.__setattr__(self, "options", _options(self.options, {UNDERFLOW, OVERFLOW}, [{CIRCULAR, GROWTH}]))
        if not self.floating and self.options & {CIRCULAR, GROWTH} and self.options & {UNDERFLOW, OVERFLOW}:
            raise ValueError("circular or growing integer axes of whole numbers have no flow bins")
        if self.stop_ < self.start:
            raise ValueError("stop is below start")

    @property
    def size(self) -> int:
        return self.stop_ - self.start

    @property
    def continuous(self) -> bool:
        return self.floating

    @property
    def inclusive(self) -> bool:
        return self.underflow and self.overflow or not self.floating and bool(self.options & {CIRCULAR, GROWTH}) and self.size > 0

    def index(self, column: Column) -> Column:
        n = self.size
        if not self.floating:
            x = column.cast("long")
            if self.circular and n:
                return F.coalesce(F.pmod(x - self.start, F.lit(n)).cast("int"), F.lit(n))
            return F.when(x < self.start, -1).when(x < self.stop_, (x - self.start).cast("int")).otherwise(n)
        z = column.cast("double") - F.lit(float(self.start))
        if self.circular and n:
            turned = F.when(F.abs(z) < _BIG, z - F.floor(z / n) * n).otherwise(F.lit(0.0))
            return F.when(F.abs(z) < INF, turned.cast("int")).when(z == -INF, -1).otherwise(n)
        return F.when(z < 0, -1).when(z < n, z.cast("int")).otherwise(n)

    def find(self, x: float) -> int:
        z = (x if self.floating else int(x)) - self.start
        n = self.size
        if self.circular and math.isfinite(z):
            return int(z - math.floor(z / n) * n)
        return (int(z) if z >= 0 else -1) if z < n else n

    def value(self, i: float):
        if self.floating and not self.circular and (i < 0 or i > self.size):
            return -INF if i < 0 else INF
        return self.start + (float(i) if self.floating else int(i))

    def value_column(self, i: Column) -> Column | None:
        if not self.floating:
            return i.cast("long") + self.start
        inner = i.cast("double") + float(self.start)
        return inner if self.circular else F.when(i < 0, -INF).when(i > self.size, INF).otherwise(inner)

    def raw_range(self, column: Column) -> Column | None:
        return None if self.circular or self.growth else (column >= self.start - 1) & (column <= self.stop_)

    def ends(self, column: Column) -> tuple[Column, Column]:
        x = column.cast("double") if self.floating else column.cast("long")
        key = F.when(F.abs(x) < INF, F.floor(x)) if self.floating else x
        return F.min(key), F.max(key)

    def grown_to(self, low: int | None, high: int | None) -> Integer:
        if low is None:
            return self
        if self.size == 0:  # an empty axis still begins at its start
            low, high = min(low, self.start), max(high, self.start - 1)
        return replace(self, start=min(self.start, low), stop_=max(self.stop_, high + 1))

    def reduced(self, begin: int, end: int, merge: int) -> Integer:
        if merge > 1:
            raise ValueError("bins of an integer axis stay single")
        if self.circular and not (begin == 0 and end == self.size):
            raise ValueError("a circular axis keeps its whole range")
        return replace(self, start=self.start + begin, stop_=self.start + end)

    def merged(self, other: Axis) -> Axis:
        if self == other:
            return self
        if not (isinstance(other, Integer) and self.growth and other.growth and replace(other, start=self.start, stop_=self.stop_) == self):
            raise ValueError("these axes have no common form")
        if other.size == 0 or self.size == 0:
            return self if other.size == 0 else other
        return replace(self, start=min(self.start, other.start), stop_=max(self.stop_, other.stop_))

    def to_json(self) -> dict:
        return super().to_json() | {"start": self.start, "stop_": self.stop_, "floating": self.floating}

    def _parts(self) -> list[str]:
        return [str(self.start), str(self.stop_)]


def integer(start, stop, metadata="", options=None, floating=False) -> Integer:
    return Integer(start=start, stop_=stop, metadata=metadata, options=options, floating=floating)


@dataclass(frozen=True, kw_only=True, repr=False)
class Category(Axis):
    """One bin per listed value; others go to overflow, or are appended by a growing axis in the order they are first seen."""

    values: tuple
    most: int = 1_000_000

    kind = "category"

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))
        object.__setattr__(self, "options", _options(self.options, {OVERFLOW}, [{UNDERFLOW}, {CIRCULAR}, {GROWTH, OVERFLOW}]))

    @property
    def size(self) -> int:
        return len(self.values)

    @property
    def inclusive(self) -> bool:
        return self.overflow or self.growth

    def valid(self, i: Column) -> Column | None:
        return None if self.overflow else i < self.size  # NULL never grows an axis

    @property
    def ordered(self) -> bool:
        return False

    def index(self, column: Column) -> Column:
        n = self.size
        if n <= 32:
            out = F.lit(n)
            for i, v in reversed(list(enumerate(self.values))):
                out = F.when(column == F.lit(v), i).otherwise(out)
            return out
        table = F.create_map(*(F.lit(x) for i, v in enumerate(self.values) for x in (v, i)))
        return F.when(column.isNull(), n).otherwise(F.coalesce(table[column], F.lit(n)))

    def lookup(self, column: Column) -> tuple[tuple, Column] | None:
        return (self.values, column) if self.size > FEW else None

    def find(self, x) -> int:
        return self.values.index(x) if x in self.values else self.size

    def value(self, i: float):
        if not 0 <= i < self.size:
            raise IndexError("no such category")
        return self.values[int(i)]

    def grown(self, rows: DataFrame, column: Column, order: Column | None = None) -> Category:
        """New values in the order of their smallest `order` (without one: in their own order)."""
        if not self.growth:
            return self
        seen = rows.select(column.alias("v"), (column if order is None else order).alias("o")).where("v is not null").groupBy("v").agg(F.min("o").alias("o"))
        if self.size > FEW:
            from ..plans.fill import dictionary

            seen = seen.join(dictionary(rows.sparkSession, self.values, "_v", "_n"), F.col("v") == F.col("_v"), "left_anti")
        elif self.values:
            seen = seen.where(~F.col("v").isin(list(self.values)))
        new = seen.orderBy("o", "v").limit(self.most + 1).collect()
        if len(new) > self.most:
            raise OverflowError(f"more than {self.most} categories")
        return replace(self, values=(*self.values, *(r["v"] for r in new)))

    def reduced(self, begin: int, end: int, merge: int) -> Category:
        if merge > 1:
            raise ValueError("bins of a category axis stay single")
        return replace(self, values=self.values[begin:end])

    def merged(self, other: Axis) -> Axis:
        if self == other:
            return self
        if not (isinstance(other, Category) and self.growth and other.growth and replace(other, values=self.values) == self):
            raise ValueError("these axes have no common form")
        known = set(self.values)
        return replace(self, values=(*self.values, *(v for v in other.values if v not in known)))

    def to_json(self) -> dict:
        return super().to_json() | {"values": list(self.values)}

    def _parts(self) -> list[str]:
        return [f'"{v}"' if isinstance(v, str) else _num(v) for v in self.values]


def category(values=(), metadata="", options=None) -> Category:
    return Category(values=tuple(values), metadata=metadata, options=options)


@dataclass(frozen=True, kw_only=True, repr=False)
class Boolean(Axis):
    kind = "boolean"

    def __post_init__(self):
        if self.options:
            raise ValueError("a boolean axis has no options")
        object.__setattr__(self, "options", frozenset())

    @property
    def size(self) -> int:
        return 2

    @property
    def inclusive(self) -> bool:
        return True

    def valid(self, i: Column) -> Column | None:
        return i < 2  # NULL has no bin

    def index(self, column: Column) -> Column:
        return F.coalesce(column.cast("boolean").cast("int"), F.lit(2))

    def find(self, x) -> int:
        return int(bool(x))

    def value(self, i: float) -> bool:
        return bool(i)

    def _parts(self) -> list[str]:
        return []


def boolean(metadata="") -> Boolean:
    return Boolean(metadata=metadata)


@dataclass(frozen=True, kw_only=True, repr=False)
class UserAxis(Axis):
    """Caller's own mapping of one or several columns to bin numbers 0..bins-1 (others as its options say)."""

    bins: int
    mapping: Callable[..., Column]
    arity: int = 1
    labels: Callable[[int], Any] | None = None

    kind = "user"

    def __post_init__(self):
        object.__setattr__(self, "options", _options(self.options, set(), []))

    @property
    def size(self) -> int:
        return self.bins

    def index(self, *columns: Column) -> Column:
        return F.coalesce(self.mapping(*columns).cast("int"), F.lit(self.bins))

    def value(self, i: float):
        return self.labels(int(i)) if self.labels else int(i)

    def to_json(self) -> dict:
        raise TypeError("a user axis can't be stored")


@dataclass(frozen=True, kw_only=True, repr=False)
class Adapted(Axis):
    """Another axis behind a conversion of its input (parse a string, try several types)."""

    base: Axis
    convert: Callable[..., Column]
    arity: int = 1

    def __post_init__(self):
        object.__setattr__(self, "options", self.base.options)
        object.__setattr__(self, "metadata", self.base.metadata)

    kind = "adapted"
    size = property(lambda self: self.base.size)
    inclusive = property(lambda self: self.base.inclusive)
    ordered = property(lambda self: self.base.ordered)
    continuous = property(lambda self: self.base.continuous)

    def index(self, *columns: Column) -> Column:
        return self.base.index(self.convert(*columns))

    def lookup(self, *columns: Column) -> tuple[tuple, Column] | None:
        return self.base.lookup(self.convert(*columns))

    def value(self, i: float):
        return self.base.value(i)

    def bin(self, i: int) -> Bin:
        return self.base.bin(i)

    def find(self, x) -> int:
        return self.base.find(x)

    def reduced(self, *a) -> Axis:
        return replace(self, base=self.base.reduced(*a))

    def to_json(self) -> dict:
        raise TypeError("an adapted axis can't be stored")


def grown_axes(axes: list[Axis], rows: DataFrame, sources: list[tuple[Column, ...]], order: Column | None = None) -> list[Axis]:
    """All axes after seeing the rows; those that grow by their ends share one reading."""
    ends = {k: e for k, (a, c) in enumerate(zip(axes, sources)) if a.growth and (e := a.ends(c[0])) is not None}
    found = rows.agg(*(x for pair in ends.values() for x in pair)).first() if ends else ()
    reached = {k: found[2 * n : 2 * n + 2] for n, k in enumerate(ends)}
    return [a.grown_to(*reached[k]) if k in reached else a.grown(rows, c[0], order) if a.growth else a for k, (a, c) in enumerate(zip(axes, sources))]


def axis_from_json(d: dict) -> Axis:
    kind = {"regular": Regular, "variable": Variable, "integer": Integer, "category": Category, "boolean": Boolean}[d["kind"]]
    d = {k: v for k, v in d.items() if k != "kind"}
    d["options"] = frozenset(d["options"]) if kind is not Boolean else None
    if kind is Regular:
        d["transform"] = transform_from_json(d["transform"])
    if kind is Variable:
        d["edges"] = tuple(float(e) for e in d["edges"])
    if kind is Category:
        d["values"] = tuple(d["values"])
    return kind(**d)
