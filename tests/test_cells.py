"""Rectangles, large axes, nested and segmented cells."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from binweave.operators import reduce as R
from binweave.operators.accumulator import Mean, Nested, WeightedSum, maximum, register
from binweave.operators.axis import Adapted, boolean, category, integer, regular, variable
from binweave.operators.binned import Binned
from binweave.operators.collected import Collected
from binweave.plans import fill
from binweave.sources.store import describe, load, save

FOLDER = "/root/testdata/sf0.001"


def test_rectangles(spark):
    rows = spark.createDataFrame([(0.5, 3), (1.5, 3), (9999.5, 9999), (-1.0, 4), (None, 4)], "x double, y int")
    h = Binned(regular(10_000, 0, 10_000), integer(0, 10_000)).fill(rows, "x", "y")
    assert h.size > 10**8
    with pytest.raises(OverflowError):
        h.indexed()
    got = h.indexed(ranges=[(0, 2), (3, 5)]).collect()
    assert [(r["i0"], r["i1"], r["value"]) for r in got] == [(0, 3, 1), (1, 3, 1), (0, 4, 0), (1, 4, 0)]
    assert got[1]["lower0"] == 1 and got[1]["bin1"] == "3"
    assert h.indexed(ranges=[(2, 2), (0, 9)]).count() == 0 and h.indexed(ranges=[(5, 3), (0, 9)]).count() == 0
    assert [(r["i0"], r["value"]) for r in h.indexed(ranges=[(-9, 0), (4, 5)]).collect()] == [(-1, 1)]
    assert [(r["i0"], r["value"]) for r in h.indexed(ranges=[(10_000, 99_999), (4, 5)]).collect()] == [(10_000, 1)]
    small = Binned(regular(3, 0, 3), integer(0, 2)).fill(rows, "x", "y")
    assert small.indexed("all").count() == 20 and small.indexed().count() == 6


def test_many_categories(spark, monkeypatch):
    values = [f"v{k}" for k in range(200_000)]
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, F.lit("other")).otherwise(F.concat(F.lit("v"), (F.col("id") * 199).cast("string"))).alias("k"))
    for most in (fill.BROADCAST, 0):  # sent to every task, and joined by hash
        monkeypatch.setattr(fill, "BROADCAST", most)
        h = Binned(category(values)).fill(rows, "k")
        got = {r["i0"]: r["value"] for r in h.table().collect()}
        assert got.pop(200_000) == 200 and got == {199 * i: 1 for i in range(1000) if i % 10 > 1}
        plan = h.cells._jdf.queryExecution().optimizedPlan().toString()
        assert "v199" not in plan and "keys: [" not in plan
    upper = Adapted(base=category([v.upper() for v in values[:1000]]), convert=lambda c: F.upper(c))
    assert Binned(upper).fill(rows, "k").at(398)["value"] == 1
    grow = {"growth"}
    a = Binned(category(values[:5000], options=grow)).fill(rows, "k")
    assert a.axes[0].values[:5000] == tuple(values[:5000]) and len(set(a.axes[0].values)) == a.axes[0].size and "other" in a.axes[0].values
    b = Binned(category(values[4999::-1], options=grow)).fill(rows, "k")
    both = a + b
    counts = {both.axes[0].values[r["i0"]]: r["value"] for r in both.table().collect()}
    assert counts["other"] == 200 and counts["v398"] == 2 and counts["v198801"] == 2 and sum(counts.values()) == 1800


def replayed(edges, xs):
    edges = list(edges)
    for x in xs:
        if not math.isfinite(x):
            continue
        if x >= edges[-1]:
            edges.append(max(math.nextafter(x, math.inf), edges[-1] + 0.5 * (edges[-1] - edges[-2])))
        elif x < edges[0]:
            edges.insert(0, min(x, edges[0] - 0.5 * (edges[1] - edges[0])))
    return edges


def test_variable_axes_grow_range_by_range(spark):
    rng = random.Random(3)
    for spread in (1.0, 50.0):
        xs = [rng.gauss(0, spread) * (1 + k / 200) for k in range(2000)] + [math.nan, math.inf]
        rows = spark.createDataFrame(list(enumerate(xs)), "o long, x double").repartition(7)
        axis = variable([0.0, 1.0, 1.5], options={"growth"}).grown(rows, F.col("x"), F.col("o"))
        assert list(axis.edges) == replayed([0.0, 1.0, 1.5], xs)
    rising = spark.range(20_000).select("id", (F.col("id") * F.col("id")).cast("double").alias("x"))
    one = variable([0.0, 1.0], options={"growth"})
    assert list(one.grown(rising.where("id < 300"), F.col("x"), F.col("id")).edges) == replayed([0, 1], [float(k * k) for k in range(300)])
    from dataclasses import replace

    with pytest.raises(OverflowError):
        replace(one, most=5).grown(rising, F.col("x"), F.col("id"))
    assert one.grown(rising.limit(0), F.col("x"), F.col("id")) == one


def test_segmented_cells(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2]), rng.choice([1.0, 2.0, rng.random()]), rng.choice([5, rng.randrange(100)])) for _ in range(3000)] + [(1, None, 3)]
    df = spark.createDataFrame(rows, "i int, x double, t int").repartition(5)
    h = Collected(integer(0, 2), size=64).fill(df, "i", sample="x", order_by="t")
    parts = {}
    for r in h.table().orderBy("i0", "segment").collect():
        assert r["first"] == len(parts.setdefault(r["i0"], [])) and r["count"] <= 64
        parts[r["i0"]] += r["items"]
    want = {k: [x for _, x in sorted((float(t), x) for i, x, t in rows if i == k and x is not None)] for k in range(3)}
    assert parts == want
    assert {r["i0"]: r["value"] for r in h.counts().table().collect()} == {k: len(v) for k, v in want.items()}
    halves = [Collected(integer(0, 2), size=64).fill(df.where(c), "i", sample="x", order_by="t") for c in ("t % 2 = 0", "t % 2 = 1")]
    assert sorted(map(repr, (halves[0] + halves[1]).table().collect())) == sorted(map(repr, h.table().collect()))
    assert sorted(map(repr, halves[0].fill(df.where("t % 2 = 1"), "i", sample="x", order_by="t").table().collect())) == sorted(map(repr, h.table().collect()))
    two = Collected(integer(0, 2), integer(0, 200), size=50).fill(df, "i", "t", sample="x", order_by="t")
    flat = [x for r in two.project(0).table().where("i0 = 0").orderBy("segment").collect() for x in r["items"]]
    assert flat == want[0]
    cut = h.reduce(R.slice_(0, 0, 1))
    assert {r["i0"]: r["value"] for r in cut.counts().table().collect()} == {0: len(want[0]), 1: len(want[1]) + len(want[2])}
    assert Collected(integer(0, 2)).table().count() == 0 and Collected(integer(0, 2)).fill(df.limit(0), "i", sample="x").table().count() == 0


def test_nested_cells(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(-40, 40), rng.random()) for _ in range(500)] + [(0, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, k int, x double")
    h = Binned(integer(0, 3), accumulator=Nested(integer(0, 0, options={"growth"}))).fill(df, "i", sample="k")
    for i in range(3):
        want = {}
        for c, k, _ in rows:
            if c == i and k is not None:
                want[k] = want.get(k, 0) + 1
        assert {b["bin"]: b["value"] for b in h.at(i)["bins"]} == want and h.at(i)["count"] == len(want)
    assert h.at(-1) == {"bins": [], "count": 0}
    twice = h + h
    assert sum(b["value"] for b in twice.at(1)["bins"]) == 2 * sum(b["value"] for b in h.at(1)["bins"]) and twice != h
    for inner, more, weight in ((Mean(), ["x"], None), (WeightedSum(), [], "x")):
        n = Binned(integer(0, 3), integer(-40, 40), accumulator=Nested(regular(4, -40, 40), inner)).fill(df, "i", "k", sample=["k", *more], weight=weight).project(0)
        plain = Binned(integer(0, 3), regular(4, -40, 40), accumulator=inner).fill(df.where("k is not null"), "i", "k", sample=more or None, weight=weight)
        for b in n.at(2)["bins"]:
            state = plain.cells.where(f"i0 = 2 and i1 = {b['bin']}").first().asDict()
            assert all(b[c] == pytest.approx(state[c]) for c, _ in inner.state)
        save(n, str(tmp_path / inner.name))
        assert load(spark, str(tmp_path / inner.name)) == n
    with pytest.raises(Exception, match="more than 3 bins"):
        Binned(integer(0, 3), accumulator=Nested(integer(0, 0, options={"growth"}), most=3)).fill(df, "i", sample="k").cells.collect()
    with pytest.raises(ValueError):
        Nested(regular(1, 0, 1, options={"growth"}))


def test_own_accumulators_and_notes(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5), (0, 2.5), (1, -3.0)], "i int, x double")
    h = Binned(integer(0, 2), accumulator=maximum()).fill(df, "i", sample="x")
    register(maximum)
    save(h, str(tmp_path / "own"))
    assert load(spark, str(tmp_path / "own")) == h
    with pytest.raises(ValueError):
        register(lambda: Mean())
    from binweave.operators.accumulator import Custom

    with pytest.raises(TypeError):
        describe(Binned(integer(0, 2), accumulator=Custom([("v", "double")], lambda w, s: [F.max(s[0])], name="unknown")))
    notes = spark.createDataFrame([(0, "a"), (9, "z")], "i0 int, note string")
    assert sorted(map(tuple, h.annotated(notes).collect())) == [(0, 2.5, "a"), (1, 0.0, None)]
    with pytest.raises(Exception, match="two notes"):
        h.annotated(notes.unionAll(notes)).collect()


NAMES = ("hist_nested", "nested_stored", "collector_segments", "hist_many_categories", "rectangle", "count_widened", "count_past_bigint", "annotated_cells", "stored_own_accumulator", "sum_real_cells", "sum_compensated")


def test_registered_queries_agree_with_sql(spark):
    from binweave.plans.queries import QUERIES, SQL
    from tests.compare import database, difference

    con = database(FOLDER)
    for name in NAMES:
        assert difference(spark, con, FOLDER, QUERIES[name], SQL[name]) is None, name


def test_growing_axes_share_a_reading(spark):
    rows = spark.createDataFrame([(-3, 7.5, "b"), (4, -0.5, "a"), (None, float("nan"), None)], "i int, x double, c string")
    grow = {"growth"}
    h = Binned(integer(0, 1, options=grow), regular(2, 0, 1, options=grow), integer(0, 0, options=grow, floating=True), category([], options=grow)).fill(rows, "i", "x", "x", "c")
    assert (h.axes[0].start, h.axes[0].stop_) == (-3, 5) and (h.axes[1].low, h.axes[1].size) == (-1, 17) and (h.axes[2].start, h.axes[2].stop_) == (-1, 8)
    assert h.axes[3].values == ("a", "b") and h.sum()["value"] == 2
    seen = []
    counted = type(rows).agg

    def agg(self, *a):
        seen.append(len(a))
        return counted(self, *a)

    type(rows).agg = agg
    try:
        Binned(integer(0, 1, options=grow), regular(2, 0, 1, options=grow)).fill(rows, "i", "x")
    finally:
        type(rows).agg = counted
    assert seen == [4]


def test_nested_cells_of_many_bins(spark, tmp_path):
    """More bins in a cell than the limit that there once was, added up, projected and stored; then the query beside its SQL."""
    from binweave.plans.queries import QUERIES, SQL
    from tests.compare import difference

    n = 110_000
    h = Binned(integer(0, 2), boolean(), accumulator=Nested(integer(0, 0, options={"growth"}))).fill(spark.range(n), F.lit(1), F.col("id") % 7 == 0, sample="id")
    save(h + h, str(tmp_path / "twice"))
    twice = load(spark, str(tmp_path / "twice")).project(0)
    assert twice.accumulator == h.accumulator
    bins = twice.table().select("i0", "count", F.expr("aggregate(bins, 0L, (s, b) -> s + b.value)").alias("rows"), F.expr("bins[0].bin").alias("first"), F.expr("bins[count - 1].bin").alias("last"))
    assert [tuple(r) for r in bins.collect()] == [(1, n, 2 * n, 0, n - 1)]
    rows = spark.range(n).select(F.lit(7.0).alias("l_quantity"), F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("l_returnflag"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_suppkey"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), QUERIES["hist_nested"], SQL["hist_nested"]) is None


def test_bars_show_all_digits_of_counts(spark):
    """Counts of seven, twenty and eighty digits; doubles keep six."""
    from binweave.operators.accumulator import Count, LargeCount
    from binweave.sources.text import bars

    rows = spark.range(1_234_567).select(F.when(F.col("id") == 0, "A").otherwise("N").alias("f"))
    h = Binned(category("AN")).fill(rows, "f")
    assert [line.split("|")[0] for line in bars(h, ascii_only=True).splitlines()[1:]] == ["A           1 ", "N     1234566 ", "other       0 "]
    assert bars(h, ascii_only=True).splitlines()[2].count("=") == 78 - 5 - 7 - 4
    wide = h.map_cells(value=F.col("value").cast("decimal(38,0)") * 10**13)
    assert bars(wide).splitlines()[2].split()[1] == str(1_234_566 * 10**13)
    large = wide * wide * wide * wide
    assert isinstance(large.accumulator, LargeCount) and bars(large).splitlines()[2].split()[1] == str((1_234_566 * 10**13) ** 4)
    assert (h * 1.0).accumulator == Count(real=True) and bars(h * 1.0).splitlines()[2].split()[1] == "1.23457e+06"


def test_listed_cells_show_all_digits_of_counts(spark):
    """Whole numbers of seven digits, alone and beside doubles, which keep six."""
    from binweave.operators.accumulator import Fraction
    from binweave.sources.text import table

    rows = spark.range(1_234_567).select(F.when(F.col("id") == 0, "A").otherwise("N").alias("f"), (F.col("id") % 2 == 0).alias("even"))
    h = Binned(category("AN")).fill(rows, "f")
    assert table(h).splitlines()[2:-1] == ["  ( 0): 1", "  ( 1): 1234566", "  ( 2): 0"]
    assert table(h * 1.0).splitlines()[3] == "  ( 1): 1.23457e+06"
    assert table(h.map_cells(value=F.col("value").cast("decimal(38,0)") * 10**13)).splitlines()[3] == f"  ( 1): {1_234_566 * 10**13}"
    text = table(Binned(category("AN"), accumulator=Fraction()).fill(rows, "f", sample="even")).splitlines()[3]
    assert text.startswith("  ( 1): (count=1234566, successes=617283, failures=617283, value=0.5, variance=2.025e-07, ")


def test_nested_bins_stay_in_order_across_ranges(spark):
    bins = [-(2**40), -4097, -4096, -1, 0, 4095, 4096, 2**40]
    rows = spark.createDataFrame([(i, b, float(b)) for b in bins for i in (0, 1, 1)], "i int, b long, x double").repartition(5)
    for inner, more in ((None, []), (Mean(), ["x"])):
        h = Binned(integer(0, 2), accumulator=Nested(integer(0, 0, options={"growth"}), inner)).fill(rows, "i", sample=["b", *more])
        for own, times in ((h, 1), (h + h, 2)):
            got = own.at(1)["bins"]
            assert [b["bin"] for b in got] == bins and {b["mean" if inner else "value"] for b in got} == (set(map(float, bins)) if inner else {2 * times})
    assert h.reset().table().count() == 0 and h.fill(rows.limit(0), "i", sample=["b", "x"]) == h
