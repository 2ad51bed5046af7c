"""Filling, reading, combining and making smaller, with known cells."""

import math

import pytest
from pyspark.sql import functions as F

from binweave.functions import intervals
from binweave.operators import reduce as R
from binweave.operators.accumulator import BigCount, Collector, Count, Fraction, Mean, Sum, WeightedMean, WeightedSum, maximum, means
from binweave.operators.axis import UserAxis, boolean, category, integer, regular, variable
from binweave.operators.binned import Binned, fraction, profile, weighted_binned, weighted_profile
from binweave.sources.store import load, save
from binweave.sources.text import bars, table
from tests.compare import database, difference


def values(h, name="value", dense=True):
    rows = h.table(dense).collect()
    return {tuple(r[k] for k in h.keys) if h.rank > 1 else r["i0"]: r[name] for r in rows}


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema).repartition(3)


def cells_of(spark, axes, cells, acc=None):
    """A binned table with given counts."""
    rows = [(*(k if isinstance(k, tuple) else (k,)), v) for k, v in cells.items()]
    names = ", ".join(f"i{k} int" for k in range(len(axes)))
    return Binned(*axes, accumulator=acc, cells=spark.createDataFrame(rows, f"{names}, value long"))


def test_one_axis(spark):
    x = [-0.5, 1.1, 0.3, 1.7, -1.5, -1.0, 2.0, 20.0, 0.1]
    h = Binned(regular(6, -1, 2, "x")).fill(frame(spark, [[v] for v in x], "x double"), "x")
    assert values(h) == {-1: 1, 0: 1, 1: 1, 2: 2, 3: 0, 4: 1, 5: 1, 6: 2}
    assert h.sum()["value"] == 9 and h.sum("inner")["value"] == 6 and not h.empty() and h.reset().empty()
    assert h.at(2) == {"value": 2} and h[3] == {"value": 0} and h.size == 8
    with pytest.raises(IndexError):
        h.at(7)
    with pytest.raises(ValueError):
        h.at(1, 2)
    assert [r["value"] for r in h.indexed().collect()] == [1, 1, 2, 0, 1, 1]
    assert [round(r["density"], 9) for r in h.density().collect()] == [2, 2, 4, 0, 2, 2]
    assert [r["cumulative"] for r in h.cumulative().orderBy("i0").collect()] == [1, 2, 4, 4, 5, 6]
    assert h.top().first()["i0"] == 2 and h.any_of(F.col("value") == 0)
    assert h.with_cell(3, value=5).at(3) == {"value": 5}
    assert values(h.map_cells(value=F.col("value") + 1))[3] == 1
    twice = h.fill(frame(spark, [[0.3]], "x double"), "x")
    assert values(twice)[2] == 3


def test_rows_without_a_cell_are_left_out(spark):
    rows = frame(spark, [(0.5, 0.5), (2.0, 0.5), (0.5, 5.0), (None, 0.1), (float("nan"), 0.1)], "x double, y double")
    h = Binned(regular(2, 0, 1, options={"underflow"}), regular(2, 0, 1)).fill(rows, "x", "y")
    assert h.sum()["value"] == 2 and values(h, dense=False) == {(1, 1): 1, (1, 2): 1}
    pushed = Binned(regular(2, 0, 1)).fill(rows, "x", inner_only=True)
    assert values(pushed, dense=False) == {1: 2}
    with pytest.raises(ValueError):
        h.fill(rows, "x")


def test_category_and_two_axes(spark):
    rows = frame(spark, [("red", 0.1, 0.2), ("blue", 0.7, 0.3), ("red", 0.3, 0.7), ("red", 0.7, 0.7)], "c string, x double, y double")
    h = Binned(category(["red", "blue"]), regular(3, 0, 1), regular(3, 0, 1)).fill(rows, "c", "x", "y")
    assert [r["value"] for r in h.indexed().collect()] == [int(i in (0, 5, 12, 16)) for i in range(18)]


def test_two_columns_for_one_axis(spark):
    circle = UserAxis(bins=2, arity=2, mapping=lambda x, y: F.when(x * x + y * y <= 1, 1).otherwise(0))
    rows = frame(spark, [(0, 0), (0, -1), (0, 1), (-1, 0), (1, 0), (1, 1), (-1, -1)], "x int, y int")
    assert values(Binned(circle).fill(rows, "x", "y")) == {0: 2, 1: 5}


def test_weights(spark):
    rows = frame(spark, [(0.0, 1.0), (0.1, 2.0), (0.4, 3.0), (0.5, 4.0), (0.2, 5.0), (0.6, 6.0), (0.9, None)], "x double, w double")
    h = weighted_binned(regular(3, 0, 1)).fill(rows, "x", weight="w")
    assert values(h, dense=False) == {0: 8, 1: 13} and values(h, "variance", False) == {0: 30, 1: 61}
    double, sum_ = h * 2, h + h
    assert values(double, "variance", False) == {0: 120, 1: 244} and values(sum_, "variance", False) == {0: 60, 1: 122}
    counted = Binned(regular(3, 0, 1)).fill(rows, "x", weight="w")
    assert values(counted, dense=False) == {0: 8, 1: 13}
    assert values(Binned(regular(3, 0, 1), accumulator=BigCount()).fill(rows, "x"), dense=False) == {0: 3, 1: 3, 2: 1}
    ratio = (h / h).table().where("i0 = 0").first()
    assert ratio["value"] == 1 and ratio["variance"] == pytest.approx(2 * 30 / 64)
    promoted = h + Binned(regular(3, 0, 1)).fill(rows, "x")
    assert values(promoted, "variance", False)[0] == 33


def test_profiles(spark):
    rows = frame(spark, [(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0), (2, 5.0), (2, 6.0), (3, 9.0)], "i int, s double")
    h = profile(integer(0, 5)).fill(rows, "i", sample="s")
    assert values(h) == {-1: 0, 0: 1.5, 1: 3.5, 2: 5.5, 3: 9, 4: 0, 5: 0}
    assert values(h, "variance")[1] == 0.5 and values(h, "variance")[3] is None and values(h, "count")[2] == 2
    big = frame(spark, [(0, 1e8 + v) for v in (4, 7, 13, 16)], "i int, s double")
    m = profile(integer(0, 1)).fill(big, "i", sample="s").at(0)
    assert (m["count"], m["value"], m["variance"]) == (4, 1e8 + 10, pytest.approx(30))
    ones = profile(integer(0, 1)).fill(big, "i", sample="s", weight=1).at(0)
    assert ones["variance"] == pytest.approx(30)
    w = weighted_profile(integer(0, 1)).fill(frame(spark, [(0, 1.0, 0.5), (0, 2.0, 1.0), (0, 3.0, 0.5)], "i int, s double, w double"), "i", sample="s", weight="w").at(0)
    assert w == {"sum_of_weights": 2, "sum_of_weights_squared": 1.5, "count": pytest.approx(4 / 1.5), "value": 2, "variance": pytest.approx(0.8)}
    parts = [weighted_profile(integer(0, 1)).fill(frame(spark, r, "i int, s double, w double"), "i", sample="s", weight="w") for r in ([(0, 4.0, 2.0), (0, 3.0, 3.0)], [(0, 2.0, 4.0), (0, 1.0, 6.0)])]
    whole = weighted_profile(integer(0, 1)).fill(frame(spark, [(0, 4.0, 2.0), (0, 3.0, 3.0), (0, 2.0, 4.0), (0, 1.0, 6.0)], "i int, s double, w double"), "i", sample="s", weight="w").at(0)
    assert (parts[0] + parts[1]).at(0) == pytest.approx(whole)
    first, rest = (profile(integer(0, 1)).fill(frame(spark, [(0, v) for v in x], "i int, s double"), "i", sample="s") for x in ((1.0, 2.0, 3.0), (4.0, 6.0)))
    assert (first + rest).at(0)["variance"] == pytest.approx(3.7)
    assert (first * 2).at(0) == {"count": 3, "value": 4, "variance": 4}
    with pytest.raises(TypeError):
        profile(integer(0, 1)).fill(rows, "i")
    assert Mean.from_moments(4, 10, 30)["deltas"] == 90 and WeightedMean.from_moments(2, 1.5, 2, 0.8)["deltas"] == pytest.approx(1)


def test_other_accumulators(spark):
    rows = frame(spark, [(0, True), (0, False), (1, True)], "i int, b boolean")
    f = fraction(integer(0, 3)).fill(rows, "i", sample="b")
    assert values(f, "successes") == {-1: 0, 0: 1, 1: 1, 2: 0, 3: 0} and values(f, "failures")[0] == 1 and math.isnan(values(f)[2])
    with pytest.raises(TypeError):
        f.fill(rows, "i", sample="b", weight="i")
    c = Binned(integer(0, 3), accumulator=Collector()).fill(frame(spark, [(0, 1.1, 2), (0, 2.2, 1), (1, 10.1, 3)], "i int, x double, t int"), "i", sample="x", order_by="t")
    assert values(c, "items") == {-1: [], 0: [2.2, 1.1], 1: [10.1], 2: [], 3: []}
    s = Binned(integer(0, 1), accumulator=Sum()).fill(frame(spark, [(0, v) for v in (1.0, 1e100, 1.0, -1e100)], "i int, x double"), "i", weight="x")
    assert s.at(0)["value"] == 2 and (s + s).at(0)["value"] == 4 and s.sum()["value"] == 2
    rows = frame(spark, [(0, 1.0, 2.0, 1.0), (0, 3.0, 4.0, 1.0), (1, 5.0, 6.0, 2.0), (1, 7.0, 8.0, 3.0)], "i int, a double, b double, w double")
    m = Binned(integer(0, 2), accumulator=means(2)).fill(rows, "i", sample=["a", "b"], weight="w")
    assert (m.at(0)["mean0"], m.at(0)["mean1"]) == (2, 3) and (m.at(1)["mean0"], m.at(1)["mean1"]) == (6.2, 7.2)
    assert values(Binned(integer(0, 2), accumulator=maximum()).fill(rows, "i", sample="a"), dense=False) == {0: 3, 1: 7}


A, B = regular(4, 1, 5), regular(3, -1, 2)
CELLS = {(0, 0): 1, (0, 1): 1, (1, 1): 1, (1, 2): 2, (2, 0): 1, (2, 2): 1, (3, 2): 3, (-1, -1): 1, (4, 3): 1}


def nonzero(h):
    return {k: v for k, v in values(h).items() if v}


def test_shrink_and_rebin(spark):
    h = cells_of(spark, [A, B], CELLS)
    assert h.reduce(R.shrink(1, -1, 2), R.rebin(0, 1)) == h and h.reduce(R.slice_(1, 0, 4), R.slice_(0, 0, 4)) == h
    small = h.reduce(R.shrink(0, 2, 4))
    assert small.axes[0] == regular(2, 2, 4) and small.sum()["value"] == 12
    assert nonzero(small) == {(-1, -1): 1, (-1, 0): 1, (1, 0): 1, (-1, 1): 1, (0, 1): 1, (0, 2): 2, (1, 2): 1, (2, 2): 3, (2, 3): 1}
    both = h.reduce(R.shrink_and_rebin(0, 2, 5, 2), R.rebin(1, 3))
    assert both.axes == [regular(1, 2, 4), regular(1, -1, 2)] and nonzero(both) == {(-1, -1): 1, (-1, 0): 2, (0, 0): 5, (1, 0): 3, (1, 1): 1}
    for same in ([R.shrink(0, 2, 5), R.rebin(0, 2), R.rebin(1, 3)], [R.rebin(1, 3), R.rebin(0, 2), R.shrink(0, 2, 5)], [R.shrink_and_rebin(2, 5, 2), R.rebin(3)]):
        assert h.reduce(same) == both


def test_crop(spark):
    h = cells_of(spark, [A, regular(3, 1, 4)], CELLS)
    small = h.reduce(R.crop(2, 4), R.crop_and_rebin(2, 4, 2))
    assert small.axes == [regular(2, 2, 4), regular(1, 2, 4)] and nonzero(small) == {(0, 0): 3, (1, 0): 1}
    assert small == h.reduce(R.slice_(1, 3, crop=True), R.slice_and_rebin(1, 3, 2, crop=True))
    assert small == h.reduce(R.rebin(1, 2), R.crop(0, 2, 4), R.crop(1, 2, 4))
    flow = cells_of(spark, [integer(1, 4, floating=True)], {i: 1 for i in range(-1, 4)})
    for (lo, hi), (b, e), total in (((0, 3), (-1, 2), 3), ((1, 3), (0, 2), 2), ((2, 5), (1, 4), 3), ((2, 4), (1, 3), 2)):
        one = flow.reduce(R.crop(lo, hi))
        assert one == flow.reduce(R.slice_(b, e, crop=True)) and one.sum()["value"] == total and one.size == 4


def test_reduce_limits(spark):
    one_flow = cells_of(spark, [integer(0, 3, options={"overflow"}), integer(0, 3, options={"underflow"})], {(i, j): 1 for i in range(4) for j in range(-1, 3)})
    small = one_flow.reduce(R.slice_(0, 1, 2), R.slice_(1, 1, 2))
    assert values(small) == {(0, -1): 2, (1, -1): 4, (0, 0): 1, (1, 0): 2}
    cat = cells_of(spark, [category([1, 2, 3])], {i: 1 for i in range(4)})
    assert values(cat.reduce(R.slice_(1, 2))) == {0: 1, 1: 3}
    h = cells_of(spark, [A, B], CELLS)
    for bad in ([R.rebin(2, 2)], [R.rebin(0, 2), R.rebin(0, 3)], [R.shrink(0, 1, 2), R.slice_(0, 0, 1)], [R.rebin(2), R.rebin(0, 2)], [R.rebin(2), R.rebin(2), R.rebin(2)], [R.shrink(0, 2, 2)], [R.rebin(0, 5)]):
        with pytest.raises(ValueError):
            h.reduce(bad)
    for bad in (lambda: R.slice_(1, 1), lambda: R.rebin(0), lambda: cat.reduce(R.rebin(2)), lambda: Binned(boolean()).reduce(R.slice_(0, 1))):
        with pytest.raises(ValueError):
            bad()


def test_project(spark):
    rows = frame(spark, [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 2)], "x int, y int")
    h = Binned(integer(0, 2), integer(0, 3)).fill(rows, "x", "y")
    assert nonzero(h.project(0)) == {0: 2, 1: 4} and nonzero(h.project(1)) == {0: 2, 1: 2, 2: 2} and h.project(1, 0).axes == [h.axes[1], h.axes[0]]
    assert h.project(0, 1) == h and h.project(1, 0).project(1, 0) == h
    for bad in ((), (2,), (0, 0)):
        with pytest.raises(ValueError):
            h.project(*bad)
    assert h.grouping_sets([[0], []]).count() == 3


def test_operators(spark):
    a, b = (cells_of(spark, [integer(0, 3)], c) for c in ({0: 2, 1: 4}, {0: 1, 2: 3}))
    assert nonzero(a + b) == {0: 3, 1: 4, 2: 3} and nonzero(a - b) == {0: 1, 1: 4, 2: -3} and nonzero(a * b) == {0: 2}
    quotient = values(a / b)
    assert quotient[0] == 2 and quotient[1] == math.inf and quotient[2] == 0 and math.isnan(quotient[3])
    assert nonzero(a * 0.5) == nonzero(0.5 * a) == nonzero(a / 2) == {0: 1, 1: 2}
    assert a == cells_of(spark, [integer(0, 3)], {0: 2, 1: 4, 2: 0}) and a != b and a != cells_of(spark, [integer(0, 3, "m")], {0: 2, 1: 4})
    assert a.cosine(a) == pytest.approx(1)
    with pytest.raises(ValueError):
        a + cells_of(spark, [integer(0, 4)], {})
    with pytest.raises(ValueError):
        a - cells_of(spark, [integer(0, 4)], {})
    with pytest.raises(TypeError):
        weighted_binned(integer(0, 3)) * weighted_binned(integer(0, 3))


def test_merging_axes(spark):
    grow = {"growth"}
    a = Binned(category([], options=grow)).fill(frame(spark, [(2, 0), (1, 1)], "x int, t int"), "x", order_by="t")
    b = Binned(category([], options=grow)).fill(frame(spark, [(2, 0), (3, 1), (4, 2)], "x int, t int"), "x", order_by="t")
    assert (a + b).axes[0].values == (2, 1, 3, 4) and values(a + b) == {0: 2, 1: 1, 2: 1, 3: 1}
    a = cells_of(spark, [category([1, 2], options=grow), integer(4, 5, options=grow)], {(0, 0): 1, (1, 0): 1})
    b = cells_of(spark, [category([2, 3], options=grow), integer(5, 6, options=grow)], {(0, 0): 1, (1, 0): 1})
    assert values(a + b) == {(0, 0): 1, (1, 0): 1, (2, 0): 0, (0, 1): 0, (1, 1): 1, (2, 1): 1}
    h = Binned(integer(0, 2, options=grow)).fill(frame(spark, [[0], [1]], "x int"), "x").fill(frame(spark, [[-2], [0], [3]], "x int"), "x")
    assert (h.axes[0].start, h.axes[0].stop_) == (-2, 4) and values(h) == {0: 1, 1: 0, 2: 2, 3: 1, 4: 0, 5: 1}
    r = Binned(regular(2, 0, 1, options=grow)).fill(frame(spark, [[0.1], [0.9]], "x double"), "x").fill(frame(spark, [[-0.3], [1.9]], "x double"), "x")
    assert values(r) == {0: 1, 1: 1, 2: 1, 3: 0, 4: 1}


def test_intervals(spark):
    rows = spark.createDataFrame([(5.0, 5.0), (1.0, 9.0), (9.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "s double, f double").coalesce(1)
    s, f = F.col("s"), F.col("f")
    got = [tuple(r) for r in rows.select(*intervals.wilson(s, f)).collect()]
    want = [(0.3492443277, 0.6507556723), (0.0388744973, 0.2338527754), (0.7661472246, 0.9611255027), (0, 0.5), (0.5, 1)]
    assert got[:5] == [pytest.approx(w, abs=1e-9) for w in want] and math.isnan(got[5][0])
    assert tuple(rows.select(*intervals.wald(s, f)).first()) == pytest.approx((0.3418861170, 0.6581138830), abs=1e-9)
    got = [tuple(r) for r in rows.select(*intervals.clopper_pearson(s, f)).collect()]
    assert got[3] == pytest.approx((0, 0.841), abs=1e-3) and got[0] == pytest.approx((0.304, 0.695), abs=1e-3)
    z = intervals.deviation(0.95)
    assert z == pytest.approx(1.959964, abs=1e-6) and intervals.confidence_level(z) == pytest.approx(0.95) and intervals.normal_cdf(0) == 0.5 and intervals.erf_inv(math.erf(0.3)) == pytest.approx(0.3)
    for (a, b), (lo, hi) in {(0, 7): (0, 0.41), (1, 6): (0, 0.501), (2, 5): (0.065, 0.648), (3, 4): (0.139, 0.766), (4, 3): (0.234, 0.861)}.items():
        assert intervals.jeffreys_of(a, b, z) == pytest.approx((lo, hi), abs=1.5e-3)
    for bad in (lambda: intervals.deviation(1), lambda: intervals.confidence_level(0)):
        with pytest.raises(ValueError):
            bad()


def test_real_cells_cancel(spark):
    cells = spark.createDataFrame([(0, 1.0), (1, 1e100), (2, 1.0), (3, -1e100)], "i0 int, value double").repartition(3)
    assert Binned(integer(0, 4), accumulator=Count(real=True), cells=cells).sum()["value"] == 2.0


def test_store_and_text(spark, tmp_path):
    rows = frame(spark, [(0.1, 1.0), (0.5, 2.0), (3.0, 1.0)], "x double, w double")
    for h in (Binned(regular(2, 0, 1, "x")).fill(rows, "x"), weighted_binned(variable([0, 0.5, math.inf])).fill(rows, "x", weight="w")):
        path = str(tmp_path / h.accumulator.name)
        save(h, path)
        assert load(spark, path) == h
    assert len(bars(h).splitlines()) == 5 and "=" in bars(h, ascii_only=True) and table(h).count("\n") == 6
    with pytest.raises(ValueError):
        Binned(*[boolean()] * 33)
    with pytest.raises(OverflowError):
        Binned(*[integer(0, 100)] * 5).dense()


def test_partitions_do_not_matter(spark):
    rows = spark.range(4000).select((F.randn(1) * 2).cast("int").alias("x"), (F.randn(2) * 2).cast("int").alias("y"), (F.lit(0.5) + F.abs(F.randn(3))).alias("w")).cache()
    for acc, more in ((Count(), {}), (Fraction(), {"sample": F.col("x") > 0}), (Collector(), {"sample": "w"})):
        one, many = (Binned(integer(-3, 4), integer(-2, 2, options=()), accumulator=acc).fill(df, "x", "y", **more) for df in (rows.coalesce(1), rows.repartition(9)))
        assert one == many
    a, b = (values(Binned(integer(-3, 4), accumulator=WeightedSum()).fill(df, "x", weight="w")) for df in (rows.coalesce(1), rows.repartition(9)))
    assert a == pytest.approx(b)


def test_registered_queries_agree_with_sql(spark):
    """Storage, reading, equality and growing edges on the smallest tables."""
    from binweave.plans.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = database(folder)
    for name in ("hist_variable_grow", "fraction_clopper", "fraction_jeffreys", "hist_own_transform", "hist_step_transform", "hist_many_edges", "hist_tuple", "bins_log", "bins_variable", "values_circular", "bins_integer", "at_cells", "equality", "described", "stored_profile", "op_div_weighted", "cell_from_moments", "reset_and_filled", "mapped_cells", "rejected_fills"):
        assert difference(spark, con, folder, QUERIES[name], SQL[name]) is None, name


def test_many_edges_with_nan_null_and_ends(spark):
    axis = variable([float(k) for k in range(101)])
    rows = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (0.0,), (99.5,), (100.0,), (float("inf"),)], "x double")
    assert [r["i"] for r in rows.select(axis.index(F.col("x")).alias("i")).collect()] == [100, 100, -1, 0, 99, 100, 100]
