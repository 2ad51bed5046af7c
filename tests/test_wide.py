"""Counts that widen, sums that lose nothing, means merged from many cells."""

import math
import random
from decimal import Decimal
from fractions import Fraction as Ratio

import duckdb
import pytest
from pyspark.sql import functions as F

from binweave.functions import limbs
from binweave.operators.accumulator import Count, Mean, Sum, WeightedMean
from binweave.operators.axis import integer
from binweave.operators.binned import Binned, profile
from binweave.plans.queries import QUERIES, SQL
from binweave.sources.store import load, save
from tests.compare import difference


def exact(h, i):
    out = h.at(i)
    return int(out.get("digits", out["value"]))


def test_counts_widen_by_themselves(spark, tmp_path):
    top = (1 << 63) - 1
    h = Binned(integer(0, 4), cells=spark.createDataFrame([(0, top), (1, 1), (2, -5)], "i0 int, value long"))
    assert h.sum()["value"] == top - 4 and exact(h + h, 0) == 2 * top and exact(h - h, 0) == 0
    one = Binned(integer(0, 4)).with_cell(0, value=1)
    assert exact(h + one, 0) == 1 << 63
    assert exact(one.with_cell(1, value=10**30), 1) == 10**30 and exact(one.with_cell(1, value=10**60), 1) == 10**60
    power, want = h, [top, 1, -5]
    for _ in range(2):
        power, want = power * power, [x * x for x in want]
    power, want = power * h, [x * y for x, y in zip(want, (top, 1, -5))]
    assert [exact(power, i) for i in range(3)] == want and len(str(want[0])) > 90 and want[2] < 0
    assert int(power.sum()["digits"]) == sum(want) and int((power - h).at(2)["digits"]) == want[2] + 5
    assert exact(power + one, 0) == want[0] + 1 and exact(power.project(0), 2) == want[2]
    assert power.at(0)["value"] == pytest.approx(float(want[0])) and (power * 0.5).at(1)["value"] == 0.5
    assert (power / power).at(0)["value"] == 1 and power == power + Binned(integer(0, 4)) and power != h
    save(power, str(tmp_path / "wide"))
    assert load(spark, str(tmp_path / "wide")) == power
    filled = Binned(integer(0, 4)).fill(spark.range(10), F.col("id") % 4)
    assert filled.accumulator.state == [("value", "bigint")] and (filled + filled).accumulator.state == [("value", "bigint")]


def test_limbs_of_doubles(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**-1022, 2.0**-1060, 0.1, -0.1, 2.0**53 + 2, 1e16 + 1]
    xs += [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-1074, 1023)) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", limbs.real_limbs(F.col("x")).alias("limbs"))
    for r in rows.select("x", "limbs", limbs.real_double(F.col("limbs")).alias("back")).collect():
        assert r["back"] == r["x"]
        assert sum(Ratio(v) * Ratio(2) ** (24 * k - 1074) for k, v in enumerate(r["limbs"])) == Ratio(r["x"])


def test_sums_are_exact_in_any_order(spark):
    rng = random.Random(2)
    rows = []
    for cell in range(12):
        spread = rng.choice([3, 60, 900])
        xs = [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-spread, spread)) for _ in range(200)]
        xs += [-x for x in xs[:150]]
        rows += [(cell, x) for x in xs]
    rows += [(20, math.inf), (20, 1.0), (21, math.inf), (21, -math.inf), (22, math.nan), (23, 1.7e308), (23, 1.7e308), (24, 1.7e308), (24, 1.7e308), (24, -1.7e308)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, x double").repartition(5)
    h = Binned(integer(0, 30), accumulator=Sum()).fill(df, "i", weight="x")
    got = {r["i0"]: r for r in h.table().collect()}
    for cell in range(12):
        xs = [x for c, x in rows if c == cell]
        want = math.fsum(xs)
        assert got[cell]["value"] == want and got[cell]["small"] == math.fsum([*xs, -want])
    assert got[20]["value"] == math.inf and math.isnan(got[21]["value"]) and math.isnan(got[22]["value"]) and got[23]["value"] == math.inf and got[24]["value"] == 1.7e308
    parts = [Binned(integer(0, 30), accumulator=Sum()).fill(df.where(c), "i", weight="x") for c in ("x > 0", "not x > 0")]
    assert parts[0] + parts[1] == parts[1] + parts[0] == h
    some = Binned(integer(0, 12, options=()), accumulator=Sum()).fill(df, "i", weight="x")
    assert some.sum()["value"] == math.fsum(x for c, x in rows if c < 12)
    assert (some * 2.0).at(3)["value"] == pytest.approx(2 * some.at(3)["value"])
    plan = h.cells._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "collect_list" not in plan


def test_means_of_many_cells(spark):
    n = 20000
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(1e8) + F.col("id") % 7).alias("s"), (F.col("id") % 3 + 1).cast("double").alias("w"))
    for acc, weight in ((Mean(), None), (WeightedMean(), "w")):
        h = Binned(integer(0, n), integer(0, 1), accumulator=acc).fill(rows, "i", F.lit(0), sample="s", weight=weight)
        got = h.project(1).at(0)
        xs, ws = [1e8 + i % 7 for i in range(n)], [1.0 if weight is None else i % 3 + 1.0 for i in range(n)]
        total = sum(ws)
        mean = 1e8 + sum(w * (x - 1e8) for x, w in zip(xs, ws)) / total
        second = sum(w * (x - mean) ** 2 for x, w in zip(xs, ws))
        free = total - (1 if weight is None else sum(w * w for w in ws) / total)
        assert got["value"] == pytest.approx(mean, rel=1e-15) and got["variance"] == pytest.approx(second / free, rel=1e-9)
        assert h.sum()["variance"] == pytest.approx(second / free, rel=1e-9)
        assert "collect_list" not in h.project(1).cells._jdf.queryExecution().toString()
    assert profile(integer(0, 2)).sum() == {"count": 0, "value": 0, "variance": None}


def test_grouping_sets_read_once(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), F.col("id").cast("double").alias("s"))
    for h in (Binned(integer(0, 3), integer(0, 5)).fill(rows, "a", "b"), Binned(integer(0, 3), integer(0, 5), accumulator=Mean()).fill(rows, "a", "b", sample="s")):
        out = h.grouping_sets([[0, 1], [0], [1], []])
        assert out.count() == 15 + 3 + 5 + 1
        one = out.where("i0 is null and i1 is null").first().asDict()
        assert one.get("value", one.get("count")) == 1000
    plain = Binned(integer(0, 3), integer(0, 5)).fill(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_linenumber", "l_quantity").grouping_sets([[0, 1], [0], [1], []])
    assert plain._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_count_kinds():
    assert Count(most=5) != Count(most=6) and Count(most=5) == Count(most=5)


def test_mapped_counts_past_bigint(spark, tmp_path):
    """200,000 rows of one quantity: their cells times 10**14 are beyond 2**63 before any sum."""
    spark.range(200_000).select(F.col("id").alias("l_orderkey"), F.lit(7.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), QUERIES["count_past_bigint"], SQL["count_past_bigint"]) is None


def test_mapped_counts_are_as_wide_as_their_values(spark):
    h = Binned(integer(0, 2)).fill(spark.createDataFrame([(0,), (0,), (0,), (1,)], "i int"), "i")
    wide = F.col("value").cast("decimal(38,0)")
    assert exact(h.map_cells(value=wide * F.lit(10**18) * F.lit(-7)), 0) == -21 * 10**18
    assert [exact(h.map_cells(value=wide * F.lit(Decimal("0.5")) * k), 0) for k in (1, -1)] == [1, -1]  # cut towards 0, as bigint is
    for value in (F.col("value") * 2, F.col("value") / 2, F.col("value").cast("decimal(18,0)"), F.lit(10**14)):
        assert h.map_cells(value=value).accumulator == Count()
