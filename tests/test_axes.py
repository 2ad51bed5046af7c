"""Bin numbers of every kind of axis, on rows and on the driver."""

import math

import pytest
from pyspark.sql import functions as F

from binweave.functions.transforms import Log, Pow, Sqrt, UserTransform
from binweave.operators.axis import Adapted, Category, UserAxis, axis_from_json, boolean, category, circular, integer, regular, regular_step, variable

INF, NAN = math.inf, math.nan

DOUBLES = [
    (regular(4, -2, 2), {-10: -1, -2.1: -1, -2: 0, -1.1: 0, 0: 2, 0.9: 2, 1: 3, 10: 4, -INF: -1, INF: 4, NAN: 4}),
    (regular(2, 1, -2), {2: -1, 1.001: -1, 1: 0, 0: 0, -0.499: 0, -0.5: 1, -1: 1, -2: 2, -20: 2}),
    (regular(2, 1, 100, transform=Log()), {-1: 2, 0: -1, 1: 0, 9: 0, 10: 1, 90: 1, 100: 2, INF: 2}),
    (regular(2, 0, 4, transform=Sqrt()), {-1: 2, 0: 0, 0.99: 0, 1: 1, 3.99: 1, 4: 2, 100: 2, INF: 2}),
    (regular(2, 0, 4, transform=Pow(power=0.5)), {-1: 2, 0: 0, 0.99: 0, 1: 1, 3.99: 1, 4: 2, 100: 2, INF: 2}),
    (circular(4, 0, 1), {-3: 0, 0: 0, 0.25: 1, 0.5: 2, 0.75: 3, 1: 0, INF: 4, -INF: 4, NAN: 4, -1e-17: 4}),
    (regular(2, 0, 1, options={"overflow"}), {0: 0, 0.49: 0, 0.5: 1, 0.99: 1, 1: 2, 1.1: 2}),
    (regular(2, 0, 1, options=()), {0: 0, 0.5: 1, 0.99: 1, 1: 1, 1.1: 2}),
    (regular(15, 0, 104999), {41999.6: 5}),
    (regular_step(0.5, 1, 3.7), {1: 0, 3.49: 4, 3.5: 5}),
    (variable([-1, 0, 1]), {-10: -1, -1: 0, 0: 1, 1: 2, 10: 2, -INF: -1, INF: 2, NAN: 2}),
    (variable([-INF, 1, 2, INF]), {-INF: 0, 0: 0, 1: 1, 2: 2, INF: 3}),
    (variable([-1, 1, 2], options={"overflow", "circular"}), {-3: 0, -2: 1, -1: 0, 0: 0, 1: 1, 2: 0, 3: 0, 4: 1}),
    (variable([0, 1, 2], options=()), {0: 0, 2: 1, 2.1: 2}),
    (variable(range(101)), {-1: -1, 0: 0, 57.5: 57, 100: 100, NAN: 100}),
    (integer(-1, 2, floating=True), {-10: -1, -2: -1, -1: 0, 0: 1, 1: 2, 2: 3, 10: 3, NAN: 3, -0.5: 0}),
    (integer(-1, 1, floating=True, options={"circular", "overflow"}), {-1.9: 1, -1.1: 1, 2.1: 1, 2.9: 1, NAN: 2}),
]


@pytest.mark.parametrize("axis,cases", DOUBLES, ids=[repr(a) for a, _ in DOUBLES])
def test_doubles(spark, axis, cases):
    rows = spark.createDataFrame([(float(x), i) for x, i in cases.items()], "x double, i int")
    got = rows.select("x", "i", axis.index(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got if r.i != r.got] == []
    for x, i in cases.items():
        if not (axis.circular and not math.isfinite(x)) and not (isinstance(axis, type(DOUBLES[-1][0])) and not math.isfinite(x)):
            assert axis.find(float(x)) == i
    assert spark.createDataFrame([(None,)], "x double").select(axis.index(F.col("x"))).first()[0] == axis.size


def indices(spark, axis, values, kind):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1).select(axis.index(F.col("x"))).collect()]


def test_other_values(spark):
    assert indices(spark, integer(-1, 1, options={"circular"}), [-2, -1, 0, 1, 2], "int") == [1, 0, 1, 0, 1]
    assert indices(spark, category(["A", "B", "C"]), ["A", "B", "C", "", None], "string") == [0, 1, 2, 3, 3]
    assert indices(spark, category(range(50)), [0, 49, 50, None], "int") == [0, 49, 50, 50]
    assert indices(spark, boolean(), [True, False, None], "boolean") == [1, 0, 2]
    assert indices(spark, Adapted(base=integer(0, 3), convert=lambda c: c.cast("int")), ["0", "2", "9"], "string") == [0, 2, 3]
    far = UserAxis(bins=2, arity=2, mapping=lambda x, y: F.when(F.hypot(x, y) < 1, 0).otherwise(1))
    rows = spark.createDataFrame([(0.1, 0.2), (3.0, 4.0)], "x double, y double").coalesce(1)
    assert [r[0] for r in rows.select(far.index(F.col("x"), F.col("y"))).collect()] == [0, 1]
    square = UserTransform(on_column=lambda c: c * c, to=lambda x: x * x, back=math.sqrt)
    assert indices(spark, regular(2, 0, 2, transform=square), [0.0, 1.4, 1.5], "double") == [0, 0, 1]


def test_edges():
    a = regular(4, -2, 2)
    assert [a.value(i) for i in (-1, 0, 0.5, 4, 5)] == [-INF, -2, -1.5, 2, INF]
    assert [(b.lower, b.upper, b.center, b.width) for b in a][1] == (-1, 0, -0.5, 1)
    assert regular(2, 0, 4, transform=Sqrt()).value(-1) == INF
    v = variable([0, 1, 3, 6], options={"overflow", "circular"})
    assert [v.value(i) for i in (0, 1, 2, 3, 4, 1.5, -1)] == [0, 1, 3, 6, 7, 2, -3]
    assert category("ab").value(1) == "b" and boolean().value(1) is True and integer(3, 5).value(1) == 4
    with pytest.raises(IndexError):
        category("ab").value(2)
    assert repr(regular(4, -2, 2, "bar")) == 'regular(4, -2, 2, metadata="bar", options=underflow | overflow)'


def test_errors_and_options():
    for bad in (lambda: regular(0, 0, 1), lambda: regular(1, 0, 0), lambda: regular(2, -1, 1, transform=Log()), lambda: regular(2, 0, 1, options={"circular", "growth"}), lambda: regular_step(0, 0, 1),
                lambda: variable([1]), lambda: variable([1, 1]), lambda: variable([0, NAN]), lambda: integer(2, 1), lambda: integer(0, 1, options={"growth", "overflow"}), lambda: category("a", options={"growth", "overflow"}), lambda: category("a", options={"circular"})):
        with pytest.raises(ValueError):
            bad()
    assert integer(0, 0).size == 0 and regular(2, 0, 1).inclusive and not regular(2, 0, 1, options={"overflow"}).inclusive
    assert category("ab") != category("ba") and regular(2, 0, 1) != regular(2, 0, 1, "x") and not category("ab").ordered


def test_json():
    for a in (regular(3, 1, 9, "m", transform=Pow(power=0.5)), circular(4), variable([-INF, 0, 2]), integer(1, 4, floating=True), category(["x", "y"], options={"growth"}), boolean("b")):
        assert axis_from_json(a.to_json()) == a


def test_growth(spark):
    x = [0.1, 0.9, -INF, NAN, INF, -0.3, 1.9]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(x)], "x double, t int").repartition(3)
    grown = regular(2, 0, 1, options={"growth"}).grown(rows, F.col("x"))
    assert [grown.value(i) for i in range(grown.size + 1)] == [-0.5, 0, 0.5, 1, 1.5, 2]
    whole = integer(0, 0, floating=True, options={"growth", "underflow", "overflow"}).grown(spark.createDataFrame([(v,) for v in (-INF, NAN, INF, 0.0, 2.0, -2.0)], "x double"), F.col("x"))
    assert (whole.start, whole.stop_) == (-2, 3)
    edges = variable([0, 1, 5], options={"growth"})
    seen, want = [6.0, -0.2, 3.0, 7.0, -4.0, 5.5, INF, 6.5], [0, 1, 5]
    for v in seen:
        if math.isfinite(v) and v >= want[-1]:
            want.append(max(math.nextafter(v, INF), want[-1] + (want[-1] - want[-2]) / 2))
        elif v < want[0]:
            want.insert(0, min(v, want[0] - (want[1] - want[0]) / 2))
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(seen)], "x double, t int").repartition(4)
    assert list(edges.grown(rows, F.col("x"), F.col("t")).edges) == want
    words = spark.createDataFrame([("b", 2), ("a", 5), ("c", 1), ("b", 0), (None, 9)], "x string, t int")
    assert category(["z"], options={"growth"}).grown(words, F.col("x"), F.col("t")).values == ("z", "b", "c", "a")
    assert isinstance(category("a").grown(words, F.col("x")), Category)
