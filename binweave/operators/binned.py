"""The binned table: axes on the driver, cells in a DataFrame (i0, i1, ..., state).

Cells are sparse: a cell that isn't there has the accumulator's zero.  Every operation on a filled binned table is a
projection of bin numbers followed by a merge of states, on a table as small as the number of cells.
"""

from __future__ import annotations

from functools import reduce as fold
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import limbs
from ..plans.fill import as_column, axis_columns, dictionary, fill_cells, keys
from .accumulator import ROWS, Accumulator, BigCount, Count, Fraction, LargeCount, Mean, WeightedMean, WeightedSum, bound, exact_sums, is_whole, whole_for
from .axis import FEW, Axis, Category, Integer, Regular, grown_axes
from .reduce import Command, normalised, plan

MAX_RANK = 32
MAX_DENSE = 50_000_000
MAX_BINS = 1_000_000
FEW_BINS = 50_000


def _moved(old: Axis, new: Axis, i: Column) -> Column:
    """Bin numbers of an axis in the axis that it has grown or been merged into."""
    if old == new:
        return i
    if isinstance(old, Category):
        at = _places(old, new)
        inner = i if at is None else F.element_at(F.array(*map(F.lit, at)), F.when((i >= 0) & (i < old.size), i + 1).otherwise(1))
    else:
        shift = old.low - new.low if isinstance(old, Regular) else old.start - new.start if isinstance(old, Integer) else new.edges.index(old.edges[0])
        inner = i + shift
    return F.when(i < 0, i).when(i >= old.size, F.lit(new.size)).otherwise(inner).cast("int")


def _places(old: Category, new: Category) -> list[int] | None:
    """Of the old values among the new; None if they are the first ones."""
    if new.values[: old.size] == old.values:
        return None
    number = {v: i for i, v in enumerate(new.values)}
    return [number[v] for v in old.values]


class Binned:
    def __init__(self, *axes: Axis, accumulator: Accumulator | None = None, cells: DataFrame | None = None):
        if not 1 <= len(axes) <= MAX_RANK:
            raise ValueError(f"a binned table has 1 to {MAX_RANK} axes")
        self.axes, self.accumulator, self._cells = list(axes), accumulator or Count(), cells

    # --- inspection

    @property
    def rank(self) -> int:
        return len(self.axes)

    @property
    def size(self) -> int:
        """Number of cells, flow bins included."""
        return prod(a.extent for a in self.axes)

    def axis(self, i: int = 0) -> Axis:
        return self.axes[i]

    @property
    def keys(self) -> list[str]:
        return keys(self.axes)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, T.IntegerType()) for k in self.keys] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in self.accumulator.state])

    @property
    def cells(self) -> DataFrame:
        """Bin numbers and state of the cells that were touched."""
        if self._cells is None:
            session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            return session.createDataFrame([], self.schema)
        return self._cells

    def _with(self, axes: list[Axis], cells: DataFrame | None, acc: Accumulator | None = None) -> Binned:
        return Binned(*axes, accumulator=acc or self.accumulator, cells=cells)

    def cached(self) -> Binned:
        """Keep the cells, so that several readings share one pass over the rows."""
        return self._with(self.axes, self.cells.cache())

    def reset(self) -> Binned:
        return self._with(self.axes, None)

    # --- filling

    def fill(self, df: DataFrame, *columns, weight=None, sample=None, order_by=None, shift: float | None = None, inner_only: bool = False) -> Binned:
        """This binned table after seeing the rows.  Columns are names, expressions or constants; a row without a cell is left out.

        NULL in an axis column counts like NaN; rows with a NULL weight or sample are left out.
        """
        order = None if order_by is None else as_column(order_by)
        sources = axis_columns(self.axes, list(columns))
        axes = grown_axes(self.axes, df, sources, order)
        acc = self.accumulator
        if isinstance(acc, Count) and weight is not None:
            acc = Count(real=True)
        elif is_whole(acc) and weight is None:
            acc = whole_for(ROWS, acc)
        new = self._with(axes, fill_cells(df, axes, acc, list(columns), weight, sample, order, shift, inner_only), acc)
        return new if self._cells is None else self._moved_to(axes)._merged_with(new)

    def _moved_to(self, axes: list[Axis]) -> Binned:
        if axes == self.axes:
            return self
        return self._with(axes, self.renumbered(self.cells, axes))

    def renumbered(self, df: DataFrame, axes: list[Axis]) -> DataFrame:
        """Rows with bin numbers of this table's axes, with those of the axes they have become."""
        kept = [c for c in df.columns if c not in self.keys]
        numbers = []
        for old, new, k in zip(self.axes, axes, self.keys):
            at = _places(old, new) if isinstance(old, Category) and old.size > FEW and old != new else None
            if at is None:
                numbers.append(_moved(old, new, F.col(k)))
            else:  # a table of places is joined
                df = df.join(dictionary(df.sparkSession, at, f"_to_{k}", f"_at_{k}"), F.col(k) == F.col(f"_at_{k}"), "left")
                numbers.append(F.coalesce(F.col(f"_to_{k}"), F.lit(new.size)).cast("int"))
        return df.select(*(n.alias(k) for n, k in zip(numbers, self.keys)), *kept)

    def _regroup(self, axes: list[Axis], index: list[Column]) -> Binned:
        """Cells under new bin numbers (NULL: dropped), states of one number merged."""
        names, own = keys(axes), self._roomy()
        rows = own.cells.select(*(i.alias(n) for i, n in zip(index, names)), *(c for c, _ in own.accumulator.state)).na.drop(subset=names)
        return self._with(axes, own.accumulator.merged(rows, names), own.accumulator)

    def _roomy(self) -> Binned:
        """The same cells in a count that holds their sum, whatever they are."""
        acc = self.accumulator
        return self._promoted(whole_for(bound(acc), acc)) if is_whole(acc) else self

    # --- reading

    def table(self, dense: bool = False) -> DataFrame:
        """Bin numbers and results (value, variance, ...); with `dense` also for cells never touched."""
        cells = self.dense() if dense else self.cells
        return cells.select(*self.keys, *(c.alias(n) for n, c in self.accumulator.read().items()))

    def dense(self, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """All cells, in any order, or those of a rectangle [begin, end) per axis; touched ones have their state, others zero.

        Only the rectangle is laid out, so a small one of any table can be read.
        """
        spans = [(a.first, a.stop) for a in self.axes] if ranges is None else [(max(b, a.first), min(e, a.stop)) for a, (b, e) in zip(self.axes, ranges, strict=True)]
        sizes = [max(0, e - b) for b, e in spans]
        if prod(sizes) > MAX_DENSE:
            raise OverflowError(f"{prod(sizes)} cells are too many to lay out")
        grid, step, columns = self.cells.sparkSession.range(prod(sizes)), 1, []
        for k, (b, _), n in zip(self.keys, spans, sizes):  # the first axis runs fastest
            columns.append((F.floor(F.col("id") / max(step, 1)) % max(n, 1) + b).cast("int").alias(k))
            step *= n
        cells = self.cells if ranges is None else self.cells.where(fold(Column.__and__, [(F.col(k) >= b) & (F.col(k) < e) for k, (b, e) in zip(self.keys, spans)]))
        zero = self.accumulator.zero()
        joined = grid.select(*columns).join(cells, self.keys, "left")
        return joined.select(*self.keys, *(F.coalesce(F.col(c), zero[c]).alias(c) for c, _ in self.accumulator.state))

    def annotated(self, notes: DataFrame, dense: bool = False) -> DataFrame:
        """Results with the caller's columns about cells (a table with this one's bin numbers, one row per cell at most)."""
        twice = notes.groupBy(*self.keys).count().where("count > 1").select(F.raise_error(F.lit("a cell has two notes")).cast("int").alias("_bad"), *self.keys)
        once = notes.join(twice, self.keys, "left").where(F.col("_bad").isNull()).drop("_bad")
        return self.table(dense).join(once, self.keys, "left")

    def ordered(self, df: DataFrame) -> DataFrame:
        """In the order of iteration: the first axis runs fastest."""
        return df.orderBy(*reversed(self.keys))

    def _inner(self) -> Column:
        return fold(Column.__and__, [a.inner(F.col(k)) for a, k in zip(self.axes, self.keys)])

    def _checked(self, index: tuple) -> Column:
        if len(index) != self.rank:
            raise ValueError(f"{self.rank} axes need as many numbers, not {len(index)}")
        for a, i in zip(self.axes, index):
            if not a.first <= i < a.stop:
                raise IndexError("no such cell")
        return fold(Column.__and__, [F.col(k) == i for k, i in zip(self.keys, index)])

    def at(self, *index: int) -> dict:
        """Results of one cell."""
        where = self._checked(index)
        found = self.table().where(where).drop(*self.keys).first()
        if found is None:
            one = self.cells.sparkSession.range(1).select(*(c.alias(n) for n, c in self.accumulator.zero().items()))
            found = one.select(*(c.alias(n) for n, c in self.accumulator.read().items())).first()
        return found.asDict(recursive=True)

    def __getitem__(self, index) -> dict:
        return self.at(*(index if isinstance(index, tuple) else (index,)))

    def with_cell(self, *index: int, **state) -> Binned:
        """The same with one cell's state replaced."""
        where, acc = self._checked(index), self.accumulator
        if is_whole(acc):  # a count takes any whole number
            value = abs(int(state.get("value", 0)))
            acc = whole_for(value, acc).__class__(most=(0 if self._cells is None else bound(acc)) + value)
        given = acc.given(state)
        row = self.cells.sparkSession.range(1).select(*(F.lit(i).cast("int").alias(k) for k, i in zip(self.keys, index)), *(given[c].alias(c) for c, _ in acc.state))
        return self._with(self.axes, self._promoted(acc).cells.where(~where).unionByName(row), acc)

    def map_cells(self, **state: Column) -> Binned:
        """All cells, untouched ones too, with states computed from their old ones; counts computed as decimals of more digits than bigint holds become wider."""
        cells, acc = self.dense(), self.accumulator
        if is_whole(acc):
            acc = type(acc)(most=acc.most if isinstance(acc, LargeCount) else None)  # new values, of the same width
        if acc == Count() and "value" in state:
            value, kind = state["value"], cells.select(state["value"]).schema[0].dataType
            if isinstance(kind, T.DecimalType) and kind.precision - kind.scale > 18:
                acc, state = BigCount(), {"value": F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if kind.scale else value}
        return self._with(self.axes, cells.select(*self.keys, *(state.get(c, F.col(c)).cast(t).alias(c) for c, t in acc.state)), acc)

    def edges(self, k: int, begin: int | None = None, end: int | None = None) -> DataFrame:
        """Bins of axis k, flow bins included: (i, lower, upper, center, width) or (i, bin); from `begin` to before `end` if given."""
        a, session = self.axes[k], self.cells.sparkSession
        numbers = range(a.first if begin is None else max(begin, a.first), a.stop if end is None else min(end, a.stop))
        if len(numbers) > MAX_BINS:
            raise OverflowError(f"{len(numbers)} bins are too many to list")
        if a.continuous:
            rows = [(i, float(b.lower), float(b.upper), float(b.center), float(b.width)) for i in numbers for b in [a.bin(i)]]
            return session.createDataFrame(rows, f"i{k} int, lower{k} double, upper{k} double, center{k} double, width{k} double")
        rows = [(i, str(a.value(i)) if 0 <= i < a.size else None) for i in numbers]
        return session.createDataFrame(rows, f"i{k} int, bin{k} string")

    def indexed(self, coverage: str = "inner", ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """Cells in order with their bins; inner ones, all, or those in a rectangle [begin, end) per axis."""
        if ranges is None:
            ranges = [(0, a.size) if coverage == "inner" else (a.first, a.stop) for a in self.axes]
        out = self.dense(ranges).select(*self.keys, *(c.alias(n) for n, c in self.accumulator.read().items()))
        for k, (b, e) in enumerate(ranges):
            out = self._with_bins(out, k, b, e)
        return self.ordered(out)

    def _with_bins(self, out: DataFrame, k: int, begin: int, end: int) -> DataFrame:
        """Rows with the columns of edges(k): computed from the bin number, or joined where the axis is a list of values."""
        a, i = self.axes[k], F.col(f"i{k}")
        low = a.value_column(i)
        if low is None:
            some = self.edges(k, begin, end)
            return out.join(F.broadcast(some) if min(end, a.stop) - max(begin, a.first) <= FEW_BINS else some, f"i{k}")
        if not a.continuous:
            return out.withColumn(f"bin{k}", F.when((i >= 0) & (i < a.size), low.cast("string")))
        out = out.withColumns({f"lower{k}": low, f"upper{k}": a.value_column(i + 1)})
        low, high = F.col(f"lower{k}"), F.col(f"upper{k}")
        return out.withColumns({f"center{k}": F.when(low == high, low).otherwise(0.5 * (low + high)), f"width{k}": high - low})

    def density(self, coverage: str = "inner") -> DataFrame:
        """Value over the product of bin widths (1 for discrete axes)."""
        out = self.indexed(coverage)
        width = fold(Column.__mul__, [F.col(f"width{k}") if a.continuous else F.lit(1.0) for k, a in enumerate(self.axes)])
        return out.withColumn("density", F.when(F.abs(width) == float("inf"), 0.0).otherwise(F.col("value") / F.when(width != 0, width)))

    def cumulative(self, axis: int = 0) -> DataFrame:
        """Running sum of the inner cells along an axis."""
        rest = [k for i, k in enumerate(self.keys) if i != axis]
        window = Window.partitionBy(*rest).orderBy(self.keys[axis]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.table(dense=True).where(self._inner()).withColumn("cumulative", F.sum("value").over(window))

    def top(self, n: int = 1, coverage: str = "inner", smallest: bool = False) -> DataFrame:
        out = self.table(dense=True)
        out = out.where(self._inner()) if coverage == "inner" else out
        return out.orderBy(F.col("value").asc() if smallest else F.col("value").desc(), *reversed(self.keys)).limit(n)

    def any_of(self, test: Column, coverage: str = "inner") -> bool:
        out = self.table(dense=True)
        return bool((out.where(self._inner()) if coverage == "inner" else out).agg(F.bool_or(test)).first()[0])

    def cosine(self, other: Binned) -> float:
        """Cosine similarity of the inner cells' values."""
        a, b = (h.table().where(h._inner()).select(*h.keys, F.col("value").cast("double").alias(n)) for h, n in ((self, "a"), (other, "b")))
        both = a.join(b, self.keys, "full_outer").na.fill(0.0)
        ab, aa, bb = both.agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b"))).first()
        return ab / ((aa * bb) ** 0.5)

    # --- algorithms

    def sum(self, coverage: str = "all") -> dict:
        """Results of all cells merged."""
        own = self._roomy()
        out = own.sum_state(coverage).select(*(c.alias(n) for n, c in own.accumulator.read().items())).first()
        return out.asDict(recursive=True)

    def sum_state(self, coverage: str = "all") -> DataFrame:
        own = self._roomy()
        cells = own.cells.where(self._inner()) if coverage == "inner" else own.cells
        acc, zero = own.accumulator, own.accumulator.zero()
        doubles = [c for c, t in acc.state if t == "double"]
        if isinstance(acc, (Count, WeightedSum)) and doubles:  # real cells may cancel
            return exact_sums(cells, doubles)
        one = cells.sparkSession.range(1).select(F.lit(0).alias("_one"))
        sums = acc.merged(cells.withColumn("_all", F.lit(0)), ["_all"])
        return one.join(sums, F.col("_one") == F.col("_all"), "left").select(*(F.coalesce(F.col(c), zero[c]).alias(c) for c, _ in acc.state))

    def empty(self, coverage: str = "all") -> bool:
        cells, zero = (self.cells.where(self._inner()) if coverage == "inner" else self.cells), self.accumulator.zero()
        return cells.where(fold(Column.__or__, [~F.col(c).eqNullSafe(zero[c]) for c, _ in self.accumulator.state])).isEmpty()

    def project(self, *axes: int) -> Binned:
        """Keep these axes, in this order; cells of the others, flow bins too, are merged."""
        if len(set(axes)) != len(axes):
            raise ValueError("axes must be different")
        if not axes or not all(0 <= k < self.rank for k in axes):
            raise ValueError("no such axis")
        return self._regroup([self.axes[k] for k in axes], [F.col(f"i{k}") for k in axes])

    def reduce(self, *commands: Command) -> Binned:
        chosen = normalised([c for x in commands for c in (x if isinstance(x, (list, tuple)) else [x])], self.rank)
        plans = [plan(a, chosen.get(k), F.col(f"i{k}")) for k, a in enumerate(self.axes)]
        return self._regroup([p.axis for p in plans], [p.index for p in plans])

    def grouping_sets(self, sets: list[list[int]]) -> DataFrame:
        """One reading of the cells for several projections, each row under every set; bin numbers of axes left out are NULL."""
        own = self._roomy()
        names, acc = ["_set", *self.keys], own.accumulator
        under = F.array(*(F.struct(F.lit(n).alias("_set"), *((F.col(k) if i in s else F.lit(None).cast("int")).alias(k) for i, k in enumerate(self.keys))) for n, s in enumerate(sets)))
        rows = own.cells.select(F.inline(under), *(c for c, _ in acc.state))
        return acc.merged(rows, names).select(*self.keys, *(c for c, _ in acc.state))

    # --- operators

    def _promoted(self, acc: Accumulator) -> Binned:
        """The same cells in a wider accumulator: whole (of any width) < real < weighted."""
        own = self.accumulator
        if acc.state == own.state and (not isinstance(own, LargeCount) or acc.n == own.n):
            return self._with(self.axes, self._cells, acc)
        if not isinstance(own, (Count, BigCount, LargeCount)) or not isinstance(acc, (Count, BigCount, LargeCount, WeightedSum)) or own.name == "count" and own.real and is_whole(acc):
            raise ValueError(f"{own.name} and {acc.name} can't be combined")
        if isinstance(own, LargeCount):
            real, wide = limbs.whole_double(F.col("limbs")), lambda: limbs.extended(F.col("limbs"), acc.n)
        else:
            real, wide = F.col("value").cast("double"), lambda: limbs.whole_limbs(F.col("value"), acc.n)
        to = {"limbs": wide} if isinstance(acc, LargeCount) else {"value": lambda: real if dict(acc.state)["value"] == "double" else F.col("value").cast(dict(acc.state)["value"]), "variance": lambda: real}
        return self._with(self.axes, self.cells.select(*self.keys, *(to[c]().alias(c) for c, _ in acc.state)), acc)

    @staticmethod
    def _common(a: Accumulator, b: Accumulator, most: int | None = None) -> Accumulator:
        """For results of both; of counts, those up to `most`."""
        if is_whole(a) and is_whole(b):
            return whole_for(bound(a) + bound(b) if most is None else most, a, b)
        rank = lambda x: 0 if is_whole(x) else 1 if isinstance(x, Count) else 2
        return a if rank(a) >= rank(b) else b

    def _merged_with(self, other: Binned) -> Binned:
        acc = self._common(self.accumulator, other.accumulator)
        a, b = self._promoted(acc), other._promoted(acc)
        return self._with(a.axes, acc.merged(a.cells.unionByName(b.cells), self.keys), acc)

    def __add__(self, other: Binned) -> Binned:
        """Cell by cell; growing integer and category axes may differ and are merged."""
        if self.rank != other.rank:
            raise ValueError("binned tables of different rank")
        axes = [a.merged(b) for a, b in zip(self.axes, other.axes)]
        return self._moved_to(axes)._merged_with(other._moved_to(axes))

    def _aligned(self, other: Binned, allowed: tuple, most: int | None = None) -> tuple[DataFrame, Accumulator]:
        if self.axes != other.axes:
            raise ValueError("axes differ")
        acc = self._common(self.accumulator, other.accumulator, most)
        if not isinstance(acc, allowed):
            raise TypeError(f"{acc.name} has no such operator")
        a, b = self._promoted(acc), other._promoted(acc)
        zero = acc.zero()
        left = a.cells.select(*self.keys, *(F.col(c).alias(f"a_{c}") for c, _ in acc.state))
        right = b.cells.select(*self.keys, *(F.col(c).alias(f"b_{c}") for c, _ in acc.state))
        both = left.join(right, self.keys, "full_outer")
        return both.select(*self.keys, *(F.coalesce(F.col(f"{p}_{c}"), zero[c]).alias(f"{p}_{c}") for p in "ab" for c, _ in acc.state)), acc

    def __sub__(self, other: Binned) -> Binned:
        both, acc = self._aligned(other, (Count, BigCount, LargeCount))
        if isinstance(acc, LargeCount):
            value = limbs.carried(F.zip_with("a_limbs", "b_limbs", lambda x, y: x.cast(limbs.WIDE) - y.cast(limbs.WIDE)), limbs.TEN18)
        else:
            value = F.col("a_value") - F.col("b_value")
        (name, kind), *_ = acc.state
        return self._with(self.axes, both.select(*self.keys, value.cast(kind).alias(name)), acc)

    def __mul__(self, other) -> Binned:
        if not isinstance(other, Binned):
            cells = self.cells.select(*self.keys, *(c.alias(n) for n, c in self.accumulator.scale(other).items()))
            return self._with(self.axes, cells, self.accumulator.scaled)
        whole = is_whole(self.accumulator) and is_whole(other.accumulator)
        both, acc = self._aligned(other, (Count, BigCount, LargeCount), bound(self.accumulator) * bound(other.accumulator) if whole else None)
        value = limbs.whole_product(F.col("a_limbs"), F.col("b_limbs"), acc.n) if isinstance(acc, LargeCount) else F.col("a_value") * F.col("b_value")
        (name, kind), *_ = acc.state
        return self._with(self.axes, both.select(*self.keys, value.cast(kind).alias(name)), acc)

    __rmul__ = __mul__

    def __truediv__(self, other) -> Binned:
        """By a number, or cell by cell in doubles (0/0 is NaN, so all cells are laid out; the variance of weighted sums is propagated)."""
        if not isinstance(other, Binned):
            return self * (1.0 / other)
        a, b = (h._promoted(Count(real=True)) if is_whole(h.accumulator) else h for h in (self, other))
        both, acc = a._with(self.axes, a.dense())._aligned(b, (Count, WeightedSum))
        a, b = F.col("a_value").cast("double"), F.col("b_value").cast("double")
        signed = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        ratio = F.when(b != 0, a / F.when(b != 0, b)).otherwise(signed)
        if not isinstance(acc, WeightedSum):
            return self._with(self.axes, both.select(*self.keys, ratio.alias("value")), Count(real=True))
        part = lambda v, x: F.when(x != 0, F.col(v) / F.when(x != 0, x * x)).otherwise(F.lit(float("nan")))
        variance = (part("a_variance", a) + part("b_variance", b)) * ratio * ratio
        return self._with(self.axes, both.select(*self.keys, ratio.alias("value"), variance.alias("variance")), acc)

    def __eq__(self, other) -> bool:
        if not isinstance(other, Binned) or self.axes != other.axes:
            return False
        if is_whole(self.accumulator) and is_whole(other.accumulator):
            acc = self._common(self.accumulator, other.accumulator)
            self, other = self._promoted(acc), other._promoted(acc)
        elif self.accumulator.name != other.accumulator.name:
            return False
        names, zero = [c for c, _ in self.accumulator.state], self.accumulator.zero()
        a = self.cells.select(*self.keys, *(F.col(c).alias(f"a_{c}") for c in names))
        b = other.cells.select(*self.keys, *(F.col(c).alias(f"b_{c}") for c in names))
        differ = [~F.coalesce(F.col(f"a_{c}"), zero[c]).eqNullSafe(F.coalesce(F.col(f"b_{c}"), zero[c])) for c in names]
        return a.join(b, self.keys, "full_outer").where(fold(Column.__or__, differ)).isEmpty()

    __hash__ = None

    def __repr__(self) -> str:
        return f"binned table({', '.join(map(repr, self.axes))}, accumulator={self.accumulator.name})"


def weighted_binned(*axes: Axis) -> Binned:
    return Binned(*axes, accumulator=WeightedSum())


def profile(*axes: Axis) -> Binned:
    return Binned(*axes, accumulator=Mean())


def weighted_profile(*axes: Axis) -> Binned:
    return Binned(*axes, accumulator=WeightedMean())


def fraction(*axes: Axis) -> Binned:
    return Binned(*axes, accumulator=Fraction())
