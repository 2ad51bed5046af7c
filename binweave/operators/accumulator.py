"""Accumulators: what a cell gathers.  Each is a set of mergeable state columns built from Spark aggregates.

`fill` gives aggregates over rows, `merge` aggregates over states of the same names, `read` result columns
computed from a state, `scale` the state times a number; `merged` is the whole merge where aggregates over states aren't enough.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import limbs


def _null() -> Column:
    return F.lit(None).cast("double")


def _over(a: Column, b: Column, otherwise: Column) -> Column:
    """a / b where b isn't 0 (a division by 0 would raise)."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(otherwise)


class Accumulator:
    """Base; `samples` is the number of sample columns it takes."""

    name = ""
    state: list[tuple[str, str]] = []
    samples = 0
    weighted = True
    needs_shift = False

    def fill(self, weight: Column | None, samples: list[Column], shift: float, order: Column | None) -> list[Column]:
        raise NotImplementedError

    def merge(self) -> list[Column]:
        return [F.sum(c).cast(t).alias(c) for c, t in self.state]

    def filled(self, rows: DataFrame, keys: list[str], weight: Column | None, samples: list[Column]) -> DataFrame | None:
        """Cells from rows (keys, ...), where aggregates over rows aren't enough; None if they are."""
        return None

    def merged(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """One state per key from states of the same key."""
        return cells.groupBy(*keys).agg(*self.merge())

    def parameters(self) -> dict:
        """What it takes, beside its name, to make it again; plain values."""
        return {}

    def given(self, state: dict) -> dict[str, Column]:
        """State columns of one cell from the caller's values."""
        return {c: F.lit(str(v) if t == limbs.WIDE else v).cast(t) for c, t in self.state for v in [state.get(c, 0)]}

    def read(self) -> dict[str, Column]:
        return {c: F.col(c) for c, _ in self.state}

    def scale(self, k: float) -> dict[str, Column]:
        raise TypeError(f"{self.name} can't be scaled")

    def zero(self) -> dict[str, Column]:
        return {c: F.lit(0).cast(t) for c, t in self.state}

    def check(self, weight, samples: list) -> None:
        if weight is not None and not self.weighted:
            raise TypeError(f"{self.name} takes no weight")
        if len(samples) != self.samples:
            raise TypeError(f"{self.name} takes {self.samples} sample columns, not {len(samples)}")

    @property
    def scaled(self) -> Accumulator:
        """The accumulator of the states that scale() makes."""
        return self

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self):
        return hash(self.name)


#: A fill counts fewer rows than this; bounds of sums and products follow from it.
ROWS = 1 << 48
#: What cells of unknown origin may add up to: as many as can be laid out, of any bigint.
UNKNOWN = 1 << 90


class Count(Accumulator):
    """Number of rows, or the sum of weights once one was given or the cells were scaled (`real`).

    `most` bounds the sum of all cells; operations hand it on and change to a wider kind of count (up to 38 digits, then limbs) where
    bigint might not hold their results, so counts never overflow.
    """

    name = "count"
    capacity = (1 << 63) - 1

    def __init__(self, real: bool = False, most: int | None = None):
        self.real, self.most = real, most
        self.state = [("value", "double" if real else "bigint")]

    def fill(self, weight, samples, shift, order):
        if weight is None:
            return [F.count(F.lit(1)).cast(self.state[0][1]).alias("value")]
        return [F.sum(weight).cast(self.state[0][1]).alias("value")]

    def scale(self, k):
        return {"value": F.col("value").cast("double") * F.lit(float(k))}

    @property
    def scaled(self):
        return Count(real=True)

    def parameters(self):
        return {"real": self.real, "most": self.most}


class BigCount(Accumulator):
    """Exact count of up to 38 digits."""

    name = "bigcount"
    state = [("value", limbs.WIDE)]
    capacity = 10**38 - 1
    real = False

    def __init__(self, most: int | None = None):
        self.most = most

    def parameters(self):
        return {"most": self.most}

    def fill(self, weight, samples, shift, order):
        return [(F.count(F.lit(1)) if weight is None else F.sum(weight)).cast(limbs.WIDE).alias("value")]

    def scale(self, k):
        return {"value": F.col("value").cast("double") * F.lit(float(k))}

    @property
    def scaled(self):
        return Count(real=True)


class LargeCount(Accumulator):
    """Exact count of any size, in limbs of 18 digits; read as a double and as its digits."""

    name = "largecount"
    state = [("limbs", "array<bigint>")]
    capacity = None
    real = False

    def __init__(self, most: int | None = None):
        self.most = UNKNOWN if most is None else most

    def parameters(self):
        return {"most": self.most}

    @property
    def n(self) -> int:
        return limbs.limbs_needed(self.most)

    def fill(self, weight, samples, shift, order):
        return [limbs.whole_limbs(F.count(F.lit(1)) if weight is None else F.sum(weight), self.n).alias("limbs")]

    def merge(self):
        return [limbs.summed("limbs", self.n, limbs.TEN18).alias("limbs")]

    def read(self):
        digits = limbs.whole_text(F.col("limbs"))
        return {"value": digits.cast("double"), "digits": digits}

    def given(self, state):
        return {"limbs": limbs.constant_limbs(int(state.get("value", 0)), self.n)}

    def zero(self):
        return {"limbs": limbs.constant_limbs(0, self.n)}

    def scale(self, k):
        return {"value": limbs.whole_double(F.col("limbs")) * F.lit(float(k))}

    @property
    def scaled(self):
        return Count(real=True)


WHOLE = (Count, BigCount, LargeCount)


def is_whole(acc: Accumulator) -> bool:
    return isinstance(acc, WHOLE) and not acc.real


def bound(acc: Accumulator) -> int:
    """Of the sum of the cells' absolute values."""
    return acc.most if acc.most is not None else UNKNOWN if isinstance(acc, Count) else BigCount.capacity << 27


def whole_for(most: int, *kinds: Accumulator) -> Accumulator:
    """The narrowest count for sums up to `most` that is as wide as the given ones."""
    first = max(WHOLE.index(type(k)) for k in kinds)
    kind = next(k for k in WHOLE[first:] if k.capacity is None or k.capacity >= most)
    return kind(most=most)


class Sum(Accumulator):
    """Sum of the weights (or 1 per row), exact until it is read: small terms survive large ones that cancel, in any order of rows and cells.

    The state is the sum as a whole multiple of the smallest double; what isn't finite is added up beside it.
    """

    name = "sum"
    state = [("limbs", "array<bigint>"), ("odd", "double")]

    def windows(self, rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
        """Rows as rows of windowed() columns."""
        k, *parts = limbs.windowed(F.col("x"))
        finite = F.abs(F.col("x")) < float("inf")
        return rows.select(*keys, x.alias("x")).select(*keys, k.alias("k"), *(p.alias(f"p{i}") for i, p in enumerate(parts)), F.when(~finite, F.col("x")).alias("odd"))

    def filled(self, rows, keys, weight, samples):
        """In a batch, rows are first added up by cell and range of exponents, four whole numbers each."""
        own = self.windows(rows, keys, F.lit(1.0) if weight is None else weight.cast("double"))
        if not rows.isStreaming:
            own = own.groupBy(*keys, "k").agg(*(F.sum(c).alias(c) for c in ("p0", "p1", "p2", "p3", "odd")))
        return own.groupBy(*keys).agg(limbs.window_sums("k", ["p0", "p1", "p2", "p3"]).alias("limbs"), F.sum("odd").alias("odd"))

    def fill(self, weight, samples, shift, order):
        raise TypeError("sum is filled in two steps")

    def merge(self):
        return [limbs.summed("limbs", limbs.REAL_LIMBS, limbs.BITS24).alias("limbs"), F.sum("odd").alias("odd")]

    def zero(self):
        return {"limbs": F.array_repeat(F.lit(0).cast("bigint"), limbs.REAL_LIMBS), "odd": _null()}

    def read(self):
        """The sum rounded once (large), and what rounding lost (small)."""
        large = limbs.real_double(F.col("limbs"))
        lost = limbs.let(large, lambda v: F.when(F.abs(v) < float("inf"), limbs.real_double(limbs.real_sum(F.col("limbs"), limbs.real_limbs(-v)))).otherwise(0.0))
        value = F.coalesce(F.col("odd"), large)
        return {"value": value, "large": value, "small": F.when(F.col("odd").isNull(), lost).otherwise(0.0)}

    def scale(self, k):
        own = {n: c * F.lit(float(k)) for n, c in self.read().items()}
        return {"limbs": limbs.real_sum(limbs.real_limbs(own["large"]), limbs.real_limbs(own["small"])), "odd": F.when(~(F.abs(own["large"]) < float("inf")), own["large"])}

    def given(self, state):
        x = F.lit(float(state.get("value", 0)))
        return {"limbs": limbs.real_limbs(x), "odd": F.when(~(F.abs(x) < float("inf")), x)}


def exact_sums(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sums of double columns, each rounded once."""
    parts = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("x")) for i, c in enumerate(columns)))
    rows = cells.select(F.inline(parts))
    sums = Sum().filled(rows, ["c"], F.col("x"), []).select("c", Sum().read()["value"].alias("v"))
    return sums.agg(*(F.coalesce(F.max(F.when(F.col("c") == i, F.col("v"))), F.lit(0.0)).alias(c) for i, c in enumerate(columns)))


class WeightedSum(Accumulator):
    """Sum of weights and of their squares (its variance)."""

    name = "weighted_sum"
    state = [("value", "double"), ("variance", "double")]

    def fill(self, weight, samples, shift, order):
        w = F.lit(1.0) if weight is None else weight.cast("double")
        return [F.sum(w).alias("value"), F.sum(w * w).alias("variance")]

    def scale(self, k):
        return {"value": F.col("value") * F.lit(float(k)), "variance": F.col("variance") * F.lit(float(k) * float(k))}


class _Moments(Accumulator):
    """Merges (weight, mean, deltas) states around the mean of each key, which comes from a first round; a task holds one state per key in both."""

    weight = ""

    def merge(self):
        raise TypeError("means are merged in two rounds")

    def merged(self, cells, keys):
        w, more = F.col(self.weight), [c for c, _ in self.state if c not in (self.weight, "mean", "deltas")]
        centre = cells.groupBy(*keys).agg(_over(F.sum(w * F.col("mean")), F.sum(w), F.lit(0.0)).alias("_centre")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_centre")
        near = fold(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else F.lit(True)
        off = F.col("mean") - F.col("_centre")
        sums = cells.join(centre, near).groupBy(*keys).agg(
            F.sum(w).alias(self.weight), *(F.sum(c).alias(c) for c in more), F.max("_centre").alias("_c"), F.sum(w * off).alias("_first"), F.sum(F.col("deltas") + w * off * off).alias("_second")
        )
        rest = _over(F.col("_first"), w, F.lit(0.0))  # what rounding left
        out = {"mean": F.col("_c") + rest, "deltas": F.col("_second") - rest * F.col("_first")}
        return sums.select(*keys, *(out.get(c, F.col(c)).alias(c) for c, _ in self.state))


def _shifted(w: Column, x: Column, shift: float) -> tuple[Column, Column]:
    """Mean and sum of squared deltas from sums around a constant near the mean."""
    total, first, second = F.sum(w), F.sum(w * (x - shift)), F.sum(w * (x - shift) * (x - shift))
    ratio = _over(first, total, F.lit(0.0))
    return F.lit(shift) + ratio, second - ratio * first


class Mean(_Moments):
    """Count, mean and variance of a sample; weights count repetitions."""

    name = "mean"
    state = [("count", "double"), ("mean", "double"), ("deltas", "double")]
    samples = 1
    needs_shift = True

    def fill(self, weight, samples, shift, order):
        x = samples[0].cast("double")
        if weight is None:
            n = F.count(x).cast("double")
            return [n.alias("count"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("deltas")]
        mean, deltas = _shifted(weight.cast("double"), x, shift)
        return [F.sum(weight).cast("double").alias("count"), mean.alias("mean"), deltas.alias("deltas")]

    weight = "count"

    def read(self):
        n = F.col("count")
        return {"count": n, "value": F.col("mean"), "variance": F.when(n > 1, F.col("deltas") / F.when(n > 1, n - 1))}

    def scale(self, k):
        return {"count": F.col("count"), "mean": F.col("mean") * F.lit(float(k)), "deltas": F.col("deltas") * F.lit(float(k) * float(k))}

    @staticmethod
    def from_moments(count: float, mean: float, variance: float) -> dict[str, float]:
        return {"count": count, "mean": mean, "deltas": variance * (count - 1)}


class WeightedMean(_Moments):
    """Mean and variance of a sample under reliability weights."""

    name = "weighted_mean"
    state = [("sum_of_weights", "double"), ("sum_of_weights_squared", "double"), ("mean", "double"), ("deltas", "double")]
    samples = 1
    needs_shift = True

    def fill(self, weight, samples, shift, order):
        x = samples[0].cast("double")
        w = (F.lit(1.0) if weight is None else weight).cast("double")
        mean, deltas = _shifted(w, x, shift)
        return [F.sum(w).alias("sum_of_weights"), F.sum(w * w).alias("sum_of_weights_squared"), mean.alias("mean"), deltas.alias("deltas")]

    weight = "sum_of_weights"

    def read(self):
        w, w2 = F.col("sum_of_weights"), F.col("sum_of_weights_squared")
        free = w - _over(w2, w, F.lit(0.0))
        return {"sum_of_weights": w, "sum_of_weights_squared": w2, "count": _over(w * w, w2, F.lit(0.0)), "value": F.col("mean"), "variance": _over(F.col("deltas"), free, _null())}

    def scale(self, k):
        return {"sum_of_weights": F.col("sum_of_weights"), "sum_of_weights_squared": F.col("sum_of_weights_squared"), "mean": F.col("mean") * F.lit(float(k)), "deltas": F.col("deltas") * F.lit(float(k) * float(k))}

    @staticmethod
    def from_moments(w: float, w2: float, mean: float, variance: float) -> dict[str, float]:
        return {"sum_of_weights": w, "sum_of_weights_squared": w2, "mean": mean, "deltas": variance * (w - w2 / w)}


class Fraction(Accumulator):
    """Successes and failures of a boolean sample."""

    name = "fraction"
    state = [("successes", "bigint"), ("failures", "bigint")]
    samples = 1
    weighted = False

    def fill(self, weight, samples, shift, order):
        b = samples[0].cast("boolean").cast("int")
        return [F.sum(b).cast("bigint").alias("successes"), F.sum(1 - b).cast("bigint").alias("failures")]

    def read(self):
        from ..functions.intervals import wilson

        s, f = F.col("successes").cast("double"), F.col("failures").cast("double")
        p = _over(s, s + f, F.lit(float("nan")))
        low, high = wilson(s, f)
        return {"count": F.col("successes") + F.col("failures"), "successes": F.col("successes"), "failures": F.col("failures"), "value": p, "variance": _over(p * (1 - p), s + f, F.lit(float("nan"))), "lower": low, "upper": high}


class Collector(Accumulator):
    """The samples themselves, in the order of `order_by` (else in their own order).  A cell's list has to fit one row."""

    name = "collector"
    state = [("items", "array<struct<o:double,x:double>>")]
    samples = 1
    weighted = False

    def fill(self, weight, samples, shift, order):
        x = samples[0].cast("double")
        return [F.array_sort(F.collect_list(F.struct((x if order is None else order.cast("double")).alias("o"), x.alias("x")))).alias("items")]

    def merge(self):
        return [F.array_sort(F.flatten(F.collect_list("items"))).alias("items")]

    def read(self):
        return {"items": F.transform("items", lambda v: v["x"]), "count": F.size("items").cast("bigint")}

    def zero(self):
        return {"items": F.array().cast(self.state[0][1])}


class Custom(Accumulator):
    """Caller's own: aggregates over rows, aggregates over states, results."""

    def __init__(self, state: list[tuple[str, str]], on_fill: Callable, on_merge: Callable | None = None, on_read: Callable | None = None, on_scale: Callable | None = None, on_zero: Callable | None = None, samples: int = 1, weighted: bool = False, name: str = "custom"):
        self.state, self.on_fill, self.on_merge, self.on_read = state, on_fill, on_merge, on_read
        self.on_scale, self.on_zero, self.samples, self.weighted, self.name = on_scale, on_zero, samples, weighted, name

    def fill(self, weight, samples, shift, order):
        return [c.alias(n) for c, (n, _) in zip(self.on_fill(weight, samples), self.state)]

    def merge(self):
        if not self.on_merge:
            raise TypeError("this accumulator can't be merged")
        return [c.alias(n) for c, (n, _) in zip(self.on_merge(), self.state)]

    def read(self):
        return self.on_read() if self.on_read else super().read()

    def scale(self, k):
        return self.on_scale(k) if self.on_scale else super().scale(k)

    def zero(self):
        return self.on_zero() if self.on_zero else super().zero()


def maximum() -> Custom:
    """Largest sample, 0 at least."""
    top = lambda c: F.greatest(F.max(c), F.lit(0.0))
    return Custom([("value", "double")], lambda w, s: [top(s[0].cast("double"))], lambda: [top(F.col("value"))], name="maximum")


def means(n: int) -> Custom:
    """Several weighted means side by side."""
    state = [("weight", "double"), *((f"sum{i}", "double") for i in range(n))]
    fill = lambda w, s: [F.sum((F.lit(1.0) if w is None else w).cast("double")), *(F.sum((F.lit(1.0) if w is None else w) * x.cast("double")) for x in s)]
    read = lambda: {"weight": F.col("weight")} | {f"mean{i}": _over(F.col(f"sum{i}"), F.col("weight"), F.lit(0.0)) for i in range(n)}
    return Custom(state, fill, lambda: [F.sum(c) for c, _ in state], read, samples=n, weighted=True, name="means")


RANGE = 12  # bits of the bin numbers that are gathered at a time


class Nested(Accumulator):
    """A binned table in every cell: the first sample's bins in `axis`, each with an inner accumulator's state; a cell holds the bins it has met.

    A cell has to fit one row; more than `most` bins in one are an error, if that is given.  An inner integer axis that grows does so in each cell by itself: its bins are numbered from the axis' start without end.
    """

    name = "nested"
    weighted = True

    def __init__(self, axis, inner: Accumulator | None = None, most: int | None = None):
        if axis.growth and axis.kind != "integer":
            raise ValueError("inside a cell, only integer axes grow")
        self.axis, self.inner, self.most = axis, inner or Count(), most
        self.samples = 1 + self.inner.samples
        fields = ",".join(f"{c}:{t}" for c, t in self.inner.state)
        self.state = [("bins", f"array<struct<bin:bigint,{fields}>>")]

    def parameters(self):
        return {"axis": self.axis.to_json(), "inner": [self.inner.name, self.inner.parameters()], "most": self.most}

    def check(self, weight, samples):
        super().check(weight, samples)
        self.inner.check(weight, samples[1:])

    def _gathered(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        names = [c for c, _ in self.inner.state]
        # in two steps, as a list of lists holds its rows packed: bins are gathered by ranges, which are put together in order
        parts = cells.groupBy(*keys, F.shiftright("_bin", RANGE).alias("_range")).agg(F.array_sort(F.collect_list(F.struct(F.col("_bin").alias("bin"), *names))).alias("_part"))  # one per bin
        whole = F.array_sort(F.collect_list(F.struct("_range", "_part")))
        out = parts.groupBy(*keys).agg(F.flatten(F.transform(whole, lambda p: p["_part"])).alias("bins"))
        if self.most is None:
            return out
        return out.withColumn("bins", F.when(F.size("bins") > self.most, F.raise_error(F.lit(f"more than {self.most} bins in a cell")).cast(self.state[0][1])).otherwise(F.col("bins")))

    def filled(self, rows, keys, weight, samples):
        x, *more = samples
        if self.axis.growth:
            number = F.floor(x.cast("double")) if self.axis.floating else x.cast("long")
            number, valid = number.cast("bigint") - self.axis.start, None
        else:
            number, valid = self.axis.index(x).cast("bigint"), self.axis.valid(F.col("_bin"))
        own = rows.withColumn("_bin", number).where("_bin is not null")
        own = own if valid is None else own.where(valid)
        inner = self.inner.filled(own, [*keys, "_bin"], weight, more)
        if inner is None:
            inner = own.groupBy(*keys, "_bin").agg(*self.inner.fill(weight, more, 0.0, None))
        return self._gathered(inner, keys)

    def merge(self):
        raise TypeError("nested tables are merged bin by bin")

    def merged(self, cells, keys):
        rows = cells.select(*keys, F.explode("bins").alias("_b")).select(*keys, F.col("_b.bin").alias("_bin"), *(F.col(f"_b.{c}").alias(c) for c, _ in self.inner.state))
        return self._gathered(self.inner.merged(rows, [*keys, "_bin"]), keys)

    def read(self):
        return {"bins": F.col("bins"), "count": F.size("bins").cast("bigint")}

    def zero(self):
        return {"bins": F.array().cast(self.state[0][1])}


def nested_from(axis: dict, inner: list, most: int | None) -> Nested:
    from .axis import axis_from_json

    return Nested(axis_from_json(axis), BY_NAME[inner[0]](**inner[1]), most)


BY_NAME: dict[str, Callable[..., Accumulator]] = {a.name: a for a in (Count, BigCount, LargeCount, Sum, WeightedSum, Mean, WeightedMean, Fraction, Collector)} | {"nested": nested_from}


def register(make: Callable[..., Accumulator]) -> Callable[..., Accumulator]:
    """Let tables of the caller's own accumulator be stored: `make(**parameters)` gives it again, under its name."""
    name = make().name
    if BY_NAME.get(name, make) is not make:
        raise ValueError(f"there is an accumulator named {name}")
    BY_NAME[name] = make
    return make
