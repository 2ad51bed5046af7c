"""Named queries over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.transforms import Log, Pow, Sqrt, UserTransform
from ..operators import reduce as R
from ..operators.accumulator import BigCount, Collector, Count, Custom, Fraction, Mean, Nested, Sum, WeightedMean, WeightedSum, maximum, means
from ..operators.axis import Adapted, UserAxis, boolean, category, circular, integer, regular, regular_step, variable
from ..operators.binned import Binned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; only a local session may have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/{name}_{uuid.uuid4().hex}"


# --- SQL forms of the axes


def reg(x: str, n: int, start: str, delta: str, overflow: bool = True) -> str:
    z = f"(({x}) - ({start})) / ({delta})"
    last = "" if overflow else f"WHEN {z} = 1 THEN {n - 1} "
    return f"CAST(CASE WHEN {z} < 1 THEN CASE WHEN {z} >= 0 THEN floor({z} * {n}) ELSE -1 END {last}ELSE {n} END AS INTEGER)"


def dense(source: str, first: int, stop: int, agg: str = "count(*)", kind: str = "BIGINT") -> str:
    """One row per cell of one axis; source has i0 (and what agg needs)."""
    return f"""WITH rows AS ({source}), cells AS (SELECT i0, {agg} AS v FROM rows GROUP BY i0)
SELECT CAST(g.i AS INTEGER) AS i0, CAST(coalesce(v, 0) AS {kind}) AS value
FROM (SELECT unnest(generate_series({first}, {stop - 1})) AS i) g LEFT JOIN cells ON i0 = g.i"""


PRICE = reg("l_extendedprice", 20, "900.0::DOUBLE", "49100.0::DOUBLE")
PRICE8 = reg("l_extendedprice", 8, "0.0::DOUBLE", "104000.0::DOUBLE")
QTY5 = reg("l_quantity", 5, "0.0::DOUBLE", "50.0::DOUBLE")
DISC4 = reg("l_discount", 4, "0.0::DOUBLE", "0.08::DOUBLE")


def price_axis():
    return regular(20, 900, 50000, "price")


def price8():
    return regular(8, 0, 104000)


def qty5():
    return regular(5, 0, 50)


def disc4():
    return regular(4, 0, 0.08)


# --- axes


@query(dense(f"SELECT {PRICE} AS i0 FROM lineitem", -1, 21))
def hist_regular(spark, d):
    return Binned(price_axis()).fill(table(spark, d, "lineitem"), "l_extendedprice").table(dense=True)


@query(dense(f"SELECT * FROM (SELECT {reg('l_discount', 5, '0.0::DOUBLE', '0.1::DOUBLE', False)} AS i0 FROM lineitem) WHERE i0 BETWEEN 0 AND 4", 0, 5))
def hist_regular_noflow(spark, d):
    return Binned(regular(5, 0, 0.1, options=())).fill(table(spark, d, "lineitem"), "l_discount").table(dense=True)


@query(dense(f"SELECT * FROM (SELECT {PRICE} AS i0 FROM lineitem) WHERE i0 BETWEEN 0 AND 19", 0, 20))
def hist_inner_pushdown(spark, d):
    h = Binned(price_axis()).fill(table(spark, d, "lineitem"), "l_extendedprice", inner_only=True)
    return h.table(dense=True).where(h.axes[0].inner(F.col("i0")))


@query(dense(f"SELECT {reg('ln(o_totalprice)', 12, 'ln(1000.0::DOUBLE)', 'ln(500000.0::DOUBLE) - ln(1000.0::DOUBLE)')} AS i0 FROM orders", -1, 13))
def hist_log(spark, d):
    return Binned(regular(12, 1000, 500000, transform=Log())).fill(table(spark, d, "orders"), "o_totalprice").table(dense=True)


@query(dense(f"SELECT {reg('CASE WHEN c_acctbal < 0 THEN 1e300 ELSE sqrt(c_acctbal) END', 10, '0.0::DOUBLE', '100.0::DOUBLE')} AS i0 FROM customer", -1, 11))
def hist_sqrt(spark, d):
    return Binned(regular(10, 0, 10000, transform=Sqrt())).fill(table(spark, d, "customer"), "c_acctbal").table(dense=True)


@query(dense(f"SELECT {reg('CASE WHEN c_acctbal < 0 THEN 1e300 ELSE pow(c_acctbal, 0.5) END', 10, '0.0::DOUBLE', '100.0::DOUBLE')} AS i0 FROM customer", -1, 11))
def hist_pow(spark, d):
    return Binned(regular(10, 0, 10000, transform=Pow(power=0.5))).fill(table(spark, d, "customer"), "c_acctbal").table(dense=True)


@query(dense(f"SELECT {reg('l_extendedprice', 7, '50000.0::DOUBLE', '(900.0 - 50000.0)::DOUBLE')} AS i0 FROM lineitem", -1, 8))
def hist_inverted(spark, d):
    return Binned(regular(7, 50000, 900)).fill(table(spark, d, "lineitem"), "l_extendedprice").table(dense=True)


@query(dense(f"SELECT {reg('l_quantity', 7, '1.0::DOUBLE', '49.0::DOUBLE')} AS i0 FROM lineitem", -1, 8))
def hist_step(spark, d):
    return Binned(regular_step(7, 1, 51)).fill(table(spark, d, "lineitem"), "l_quantity").table(dense=True)


@query(dense("SELECT CAST(floor((t - floor(t)) * 24) AS INTEGER) AS i0 FROM (SELECT (epoch_us(ts) / 1000000) / 86400.0::DOUBLE AS t FROM events)", 0, 25))
def hist_circular_hour(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return Binned(circular(24, 0, 86400)).fill(table(spark, d, "events"), seconds).table(dense=True)


@query(dense("""SELECT CAST(CASE WHEN o_totalprice < 5000 THEN -1 WHEN o_totalprice < 20000 THEN 0 WHEN o_totalprice < 100000 THEN 1
WHEN o_totalprice < 150000 THEN 2 WHEN o_totalprice < 400000 THEN 3 ELSE 4 END AS INTEGER) AS i0 FROM orders""", -1, 5))
def hist_variable(spark, d):
    return Binned(variable([5000, 20000, 100000, 150000, 400000])).fill(table(spark, d, "orders"), "o_totalprice").table(dense=True)


@query(dense("SELECT CAST(CASE WHEN x < 2 THEN 0 ELSE 1 END AS INTEGER) AS i0 FROM (SELECT l_linenumber - floor((l_linenumber - 0) / 5.0) * 5 AS x FROM lineitem)", 0, 3))
def hist_variable_circular(spark, d):
    return Binned(variable([0, 2, 5], options={"overflow", "circular"})).fill(table(spark, d, "lineitem"), "l_linenumber").table(dense=True)


@query(dense("SELECT CAST(CASE WHEN p_size < 5 THEN -1 WHEN p_size >= 45 THEN 40 ELSE p_size - 5 END AS INTEGER) AS i0 FROM part", -1, 41))
def hist_integer(spark, d):
    return Binned(integer(5, 45)).fill(table(spark, d, "part"), "p_size").table(dense=True)


@query(dense("SELECT CAST(CASE WHEN x < 0 THEN -1 WHEN x < 30 THEN floor(x) ELSE 30 END AS INTEGER) AS i0 FROM (SELECT l_quantity * 1.1::DOUBLE - 10 AS x FROM lineitem)", -1, 31))
def hist_integer_floating(spark, d):
    return Binned(integer(10, 40, floating=True)).fill(table(spark, d, "lineitem"), F.col("l_quantity") * 1.1).table(dense=True)


@query(dense("SELECT CAST((l_linenumber - 1) % 3 AS INTEGER) AS i0 FROM lineitem", 0, 3))
def hist_integer_circular(spark, d):
    return Binned(integer(1, 4, options={"circular"})).fill(table(spark, d, "lineitem"), "l_linenumber").table(dense=True)


@query(dense("SELECT CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END AS INTEGER) AS i0 FROM orders", 0, 3))
def hist_category(spark, d):
    return Binned(category(["1-URGENT", "5-LOW"])).fill(table(spark, d, "orders"), "o_orderpriority").table(dense=True)


@query("""WITH first AS (SELECT event_type, min(event_id) AS f, count(*) AS v FROM events GROUP BY event_type)
SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS i0, event_type AS bin0, CAST(v AS BIGINT) AS value FROM first""")
def hist_category_grow(spark, d):
    h = Binned(category([], options={"growth"})).fill(table(spark, d, "events"), "event_type", order_by="event_id")
    return h.indexed().select("i0", "bin0", "value")


@query("""WITH keys AS (SELECT CAST(floor((value - 0.0) / 50.0::DOUBLE * 2) AS BIGINT) AS k FROM events), ends AS (SELECT least(0, min(k)) AS lo, greatest(1, max(k)) AS hi FROM keys),
cells AS (SELECT k, count(*) AS v FROM keys GROUP BY k)
SELECT CAST(g.k - lo AS INTEGER) AS i0, g.k * 25.0::DOUBLE AS lower0, CAST(coalesce(v, 0) AS BIGINT) AS value
FROM (SELECT lo, unnest(generate_series(lo, hi)) AS k FROM ends) g LEFT JOIN cells ON cells.k = g.k""")
def hist_regular_grow(spark, d):
    h = Binned(regular(2, 0, 50, options={"growth"})).fill(table(spark, d, "events"), "value")
    return h.indexed().select("i0", "lower0", "value")


@query("""WITH ends AS (SELECT least(3, min(p_size)) AS lo FROM part)
SELECT CAST(p_size - lo AS INTEGER) AS i0, CAST(count(*) AS BIGINT) AS value FROM part, ends GROUP BY p_size, lo""")
def hist_integer_grow(spark, d):
    return Binned(integer(3, 5, options={"growth"})).fill(table(spark, d, "part"), "p_size").table()


_GROWN = """WITH RECURSIVE seen AS (SELECT event_id, value AS x, max(value) OVER before AS top, min(value) OVER before AS low FROM events
WINDOW before AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
news AS (SELECT x, row_number() OVER (ORDER BY event_id) AS n FROM seen WHERE top IS NULL OR x > top OR x < low),
walk AS (SELECT 0 AS n, [0.0::DOUBLE, 1.0::DOUBLE, 5.0::DOUBLE] AS e UNION ALL
SELECT walk.n + 1, CASE WHEN x >= e[-1] THEN list_append(e, greatest(nextafter(x, 'Infinity'::DOUBLE), e[-1] + 0.5::DOUBLE * (e[-1] - e[-2])))
WHEN x < e[1] THEN list_prepend(least(x, e[1] - 0.5::DOUBLE * (e[2] - e[1])), e) ELSE e END FROM walk JOIN news ON news.n = walk.n + 1),
last AS (SELECT e FROM walk ORDER BY n DESC LIMIT 1),
cells AS (SELECT len(list_filter(e, lambda y: y <= value)) - 1 AS i, count(*) AS v FROM events, last GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS i0, e[g.i + 1] AS lower0, e[g.i + 2] AS upper0, CAST(coalesce(v, 0) AS BIGINT) AS value
FROM (SELECT e, unnest(generate_series(0, len(e) - 2)) AS i FROM last) g LEFT JOIN cells ON cells.i = g.i"""


@query(_GROWN)
def hist_variable_grow(spark, d):
    h = Binned(variable([0, 1, 5], options={"growth"})).fill(table(spark, d, "events"), "value", order_by="event_id")
    return h.indexed().select("i0", "lower0", "upper0", "value")


@query(dense("SELECT CAST(l_tax > 0.04 AS INTEGER) AS i0 FROM lineitem", 0, 2))
def hist_boolean(spark, d):
    return Binned(boolean()).fill(table(spark, d, "lineitem"), F.col("l_tax") > 0.04).table(dense=True)


@query(dense("SELECT CAST(CASE WHEN r < 25 THEN 0 ELSE 1 END AS INTEGER) AS i0 FROM (SELECT sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AS r FROM lineitem)", 0, 2))
def hist_multiarg(spark, d):
    circle = UserAxis(bins=2, arity=2, mapping=lambda x, y: F.when(F.sqrt(x * x + y * y) < 25, 0).otherwise(1))
    return Binned(circle).fill(table(spark, d, "lineitem"), "l_quantity", "l_linenumber").table(dense=True)


@query(dense("SELECT CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS INTEGER) AS i0 FROM orders", -1, 6))
def hist_parsed_axis(spark, d):
    axis = Adapted(base=integer(1, 6), convert=lambda c: F.substring(c, 1, 1).cast("int"))
    return Binned(axis).fill(table(spark, d, "orders"), "o_orderpriority").table(dense=True)


def cells_sql(*axes: str, agg: str = "CAST(count(*) AS BIGINT) AS value", source: str = "lineitem") -> str:
    names = [f"i{k}" for k in range(len(axes))]
    return f"SELECT {', '.join(f'{a} AS {n}' for a, n in zip(axes, names))}, {agg} FROM {source} GROUP BY {', '.join(str(k + 1) for k in range(len(axes)))}"


@query(cells_sql(PRICE8, QTY5))
def hist_2d(spark, d):
    return Binned(price8(), qty5()).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").table()


def hist3(spark, d):
    return Binned(price8(), qty5(), disc4()).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")


@query(cells_sql(PRICE8, QTY5, DISC4))
def hist_3d(spark, d):
    return hist3(spark, d).table()


TAX2 = reg("l_tax", 2, "0.0::DOUBLE", "0.08::DOUBLE")
LINE = "CAST(CASE WHEN l_linenumber < 1 THEN -1 WHEN l_linenumber >= 8 THEN 7 ELSE l_linenumber - 1 END AS INTEGER)"
FLAG = "CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS INTEGER)"


@query(cells_sql(PRICE8, QTY5, DISC4, TAX2, LINE, FLAG))
def hist_6d(spark, d):
    axes = [price8(), qty5(), disc4(), regular(2, 0, 0.08), integer(1, 8), category("ANR")]
    return Binned(*axes).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag").table()


@query(cells_sql(QTY5, "CAST(1 AS INTEGER)"))
def hist_constant(spark, d):
    return Binned(qty5(), integer(0, 3)).fill(table(spark, d, "lineitem"), "l_quantity", 1).table()


# --- accumulators

W = "l_quantity"


@query(cells_sql(PRICE8, agg=f"sum({W}) AS value"))
def hist_count_weighted(spark, d):
    return Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice", weight=W).table()


@query(cells_sql(PRICE8, agg=f"sum({W}) AS value, sum({W} * {W}) AS variance"))
def hist_weighted(spark, d):
    return Binned(price8(), accumulator=WeightedSum()).fill(table(spark, d, "lineitem"), "l_extendedprice", weight=W).table()


@query(cells_sql(PRICE8, agg="CAST(count(*) AS VARCHAR) AS value"))
def hist_bigcount(spark, d):
    return Binned(price8(), accumulator=BigCount()).fill(table(spark, d, "lineitem"), "l_extendedprice").table().withColumn("value", F.col("value").cast("string"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns))


def profile_of(spark, d):
    return Binned(price8(), accumulator=Mean()).fill(table(spark, d, "lineitem"), "l_extendedprice", sample=W)


@query(cells_sql(PRICE8, agg=f"CAST(count(*) AS DOUBLE) AS count, round(avg({W}), 6) AS value, round(var_samp({W}), 6) AS variance"))
def profile(spark, d):
    return rounded(profile_of(spark, d).table(), value=6, variance=6)


@query(cells_sql(PRICE8, agg="""sum(l_linenumber::DOUBLE) AS count, round(sum(l_linenumber * l_quantity) / sum(l_linenumber), 6) AS value,
round((sum(l_linenumber * l_quantity * l_quantity) - sum(l_linenumber * l_quantity) * sum(l_linenumber * l_quantity) / sum(l_linenumber)) / (sum(l_linenumber) - 1), 6) AS variance"""))
def profile_frequency(spark, d):
    return rounded(Binned(price8(), accumulator=Mean()).fill(table(spark, d, "lineitem"), "l_extendedprice", sample=W, weight="l_linenumber").table(), value=6, variance=6)


@query(cells_sql(PRICE8, agg="""sum(l_linenumber::DOUBLE) AS sum_of_weights, sum(l_linenumber::DOUBLE * l_linenumber) AS sum_of_weights_squared,
round(sum(l_linenumber::DOUBLE) * sum(l_linenumber) / sum(l_linenumber::DOUBLE * l_linenumber), 6) AS count, round(sum(l_linenumber * l_quantity) / sum(l_linenumber), 6) AS value,
round((sum(l_linenumber * l_quantity * l_quantity) - sum(l_linenumber * l_quantity) * sum(l_linenumber * l_quantity) / sum(l_linenumber)) / (sum(l_linenumber::DOUBLE) - sum(l_linenumber::DOUBLE * l_linenumber) / sum(l_linenumber)), 6) AS variance"""))
def profile_weighted(spark, d):
    return rounded(Binned(price8(), accumulator=WeightedMean()).fill(table(spark, d, "lineitem"), "l_extendedprice", sample=W, weight="l_linenumber").table(), value=6, variance=6, count=6)


def fraction_of(spark, d):
    return Binned(qty5(), accumulator=Fraction()).fill(table(spark, d, "lineitem"), "l_quantity", sample=F.col("l_returnflag") == "R")


COUNTS = f"SELECT {QTY5} AS i0, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS s, CAST(sum((l_returnflag <> 'R')::INT) AS BIGINT) AS f FROM lineitem GROUP BY 1"


@query(f"""WITH c AS ({COUNTS}), w AS (SELECT *, s + f AS n, (s + 0.5::DOUBLE) / (s + f + 1) AS a, 1.0::DOUBLE / (s + f + 1) * sqrt(s * f / (s + f)::DOUBLE + 0.25::DOUBLE) AS b FROM c)
SELECT i0, s AS successes, f AS failures, n AS count, round(s / n::DOUBLE, 9) AS value, round(s / n::DOUBLE * (1 - s / n::DOUBLE) / n, 9) AS variance, round(a - b, 9) AS lower, round(a + b, 9) AS upper FROM w""")
def fraction_wilson(spark, d):
    return rounded(fraction_of(spark, d).table(), value=9, variance=9, lower=9, upper=9)


def intervals_of(spark, d, method, z, digits=9):
    cells = fraction_of(spark, d).cells
    low, high = method(F.col("successes"), F.col("failures"), z)
    return cells.select("i0", F.round(low, digits).alias("lower"), F.round(high, digits).alias("upper"))


def wilson_sql(z: float, name: str) -> str:
    half, n = f"{z * z / 2!r}::DOUBLE", "(s + f)::DOUBLE"
    a, b = f"(s + {half}) / ({n} + 2 * {half})", f"{z!r}::DOUBLE / ({n} + 2 * {half}) * sqrt(s * f / {n} + {half} / 2)"
    return f"round({a} - {b}, 9) AS lower_{name}, round({a} + {b}, 9) AS upper_{name}"


@query(f"SELECT i0, {wilson_sql(1.959963984540054, 'level')}, {wilson_sql(1.5, 'back')}, 0.866385597::DOUBLE AS level FROM ({COUNTS})")
def fraction_levels(spark, d):
    """Intervals for a confidence level, and for a deviation that went through its level and back."""
    level = intervals.confidence_level(1.5)
    cells = fraction_of(spark, d).cells
    for name, z in (("level", intervals.deviation(0.95)), ("back", intervals.deviation(level))):
        low, high = intervals.wilson(F.col("successes"), F.col("failures"), z)
        cells = cells.withColumns({f"lower_{name}": F.round(low, 9), f"upper_{name}": F.round(high, 9)})
    return cells.drop("successes", "failures").withColumn("level", F.lit(round(level, 9)))


@query(f"WITH c AS ({COUNTS}) SELECT i0, round(s / n - b, 9) AS lower, round(s / n + b, 9) AS upper FROM (SELECT i0, s, (s + f)::DOUBLE AS n, 2.0::DOUBLE / (s + f) * sqrt(s * f / (s + f)::DOUBLE) AS b FROM c)")
def fraction_wald(spark, d):
    return intervals_of(spark, d, intervals.wald, 2.0)


def _beta_quantiles(low: tuple[str, str], high: tuple[str, str]) -> str:
    """Interval of one deviation between quantiles of beta distributions: the series of the distribution function, halved 45 times."""
    term = "exp(lgamma(a + b + j) - lgamma(a + b) + lgamma(a + 1) - lgamma(a + 1 + j) + j * ln((lo + hi) / 2))"
    front = "exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln((lo + hi) / 2) + b * ln(1 - (lo + hi) / 2)) / a"
    below = f"{front} * list_sum(list_transform(range(0, CAST(a + b AS BIGINT) + 200), lambda j: {term})) < p"
    return f"""WITH RECURSIVE c AS ({COUNTS}), t AS (SELECT 0.5::DOUBLE * (1 - 0.682689492137085897::DOUBLE) AS tail),
asked AS (SELECT i0, 'lower' AS side, tail AS p, ({low[0]})::DOUBLE AS a, ({low[1]})::DOUBLE AS b FROM c, t UNION ALL SELECT i0, 'upper', 1 - tail, ({high[0]})::DOUBLE, ({high[1]})::DOUBLE FROM c, t),
found AS (SELECT *, 0 AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM asked UNION ALL
SELECT i0, side, p, a, b, n + 1, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {below} AS below FROM found WHERE n < 45))
SELECT i0, round(max((lo + hi) / 2) FILTER (side = 'lower'), 7) AS lower, round(max((lo + hi) / 2) FILTER (side = 'upper'), 7) AS upper FROM found WHERE n = 45 GROUP BY i0"""


@query(_beta_quantiles(("s", "f + 1"), ("s + 1", "f")))
def fraction_clopper(spark, d):
    return intervals_of(spark, d, intervals.clopper_pearson, 1.0, digits=7)


@query(_beta_quantiles(("s + 0.5", "f + 0.5"), ("s + 0.5", "f + 0.5")))
def fraction_jeffreys(spark, d):
    return intervals_of(spark, d, intervals.jeffreys, 1.0, digits=7)


@query("""SELECT CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS INTEGER) AS i0,
array_to_string(list(CAST(quality AS INTEGER) ORDER BY doc_id), ',') AS items, CAST(count(*) AS BIGINT) AS count FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def collector_sorted(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    h = Binned(category(["de", "en", "es", "fr"]), accumulator=Collector()).fill(rows, "lang", sample="quality", order_by="doc_id")
    return h.table().withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("int").cast("string")), ","))


@query(cells_sql(QTY5, agg="round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS value"))
def sum_exact(spark, d):
    h = Binned(qty5(), accumulator=Sum()).fill(table(spark, d, "lineitem"), "l_quantity", weight="l_extendedprice")
    return rounded(h.table().select("i0", "value"), value=2)


@query("""SELECT CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS INTEGER) AS i0,
array_to_string(list(CAST(doc_id AS INTEGER) ORDER BY doc_id), ',') AS items, CAST(count(*) AS BIGINT) AS count FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def collector_merged(spark, d):
    """Lists of several cells put together keep their order."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("turn", F.col("doc_id") % 7)
    h = Binned(category(["de", "en", "es", "fr"]), integer(0, 7), accumulator=Collector()).fill(rows, "lang", "turn", sample="doc_id", order_by="doc_id").project(0)
    return h.table().withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("int").cast("string")), ","))


@query(cells_sql(QTY5, agg="greatest(max(l_extendedprice), 0) AS value"))
def hist_max(spark, d):
    return Binned(qty5(), accumulator=maximum()).fill(table(spark, d, "lineitem"), "l_quantity", sample="l_extendedprice").table()


@query(cells_sql(QTY5, agg="sum(l_linenumber::DOUBLE) AS weight, round(sum(l_linenumber * l_discount) / sum(l_linenumber), 9) AS mean0, round(sum(l_linenumber * l_tax) / sum(l_linenumber), 9) AS mean1"))
def hist_multi_mean(spark, d):
    h = Binned(qty5(), accumulator=means(2)).fill(table(spark, d, "lineitem"), "l_quantity", sample=["l_discount", "l_tax"], weight="l_linenumber")
    return rounded(h.table(), mean0=9, mean1=9)


@query(cells_sql(QTY5, agg="count(DISTINCT l_suppkey) AS distinct_suppliers"))
def hist_custom_aggregate(spark, d):
    acc = Custom([("distinct_suppliers", "bigint")], lambda w, s: [F.countDistinct(s[0])])
    return Binned(qty5(), accumulator=acc).fill(table(spark, d, "lineitem"), "l_quantity", sample="l_suppkey").table()


@query(f"SELECT i0, string_agg(bin || ':' || n, ' ' ORDER BY bin) AS bins, CAST(count(*) AS BIGINT) AS count FROM (SELECT {QTY5} AS i0, l_linenumber + 10 * l_suppkey AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY i0")
def hist_nested(spark, d):
    """A growing table in every cell, of the bins that it has met; projected from two axes."""
    h = Binned(qty5(), category("ANR"), accumulator=Nested(integer(0, 0, options={"growth"})))
    h = h.fill(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", sample=F.col("l_linenumber") + 10 * F.col("l_suppkey"))
    return nested_text(h.project(0))


def nested_text(h: Binned) -> DataFrame:
    return h.table().withColumn("bins", F.array_join(F.transform("bins", lambda b: F.concat_ws(":", b["bin"].cast("string"), b["value"].cast("string"))), " "))


@query(f"SELECT i0, string_agg(bin || ':' || n, ' ' ORDER BY bin) AS bins, CAST(count(*) AS BIGINT) AS count FROM (SELECT {QTY5} AS i0, {FLAG} AS bin, 2 * count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY i0")
def nested_stored(spark, d):
    """Nested cells filled, added up, written and read back."""
    from ..sources.store import load, save

    h = Binned(qty5(), accumulator=Nested(category("ANR"))).fill(table(spark, d, "lineitem"), "l_quantity", sample="l_returnflag")
    path = shared_folder(spark, "nested")
    save(h + h, path)
    return nested_text(load(spark, path))


# --- large cells, axes and tables


@query(f"""WITH x AS (SELECT CAST(l_orderkey % 3 AS INTEGER) AS i0, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY l_shipdate, l_extendedprice) - 1 AS place FROM lineitem)
SELECT i0, CAST(place // 1000 AS BIGINT) AS segment, CAST(1000 * (place // 1000) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS count, round(min(x), 2) AS least, round(sum(x), 2) AS total FROM x GROUP BY i0, place // 1000""")
def collector_segments(spark, d):
    """All prices of three cells by date, a thousand to a row; two halves put together."""
    from ..operators.collected import Collected

    rows, day = table(spark, d, "lineitem"), F.unix_date(F.col("l_shipdate").cast("date"))
    cell, whole = F.col("l_orderkey") % 3, integer(0, 3, options=())
    a, b = (Collected(whole, size=1000).fill(rows.where(c), cell, sample="l_extendedprice", order_by=day) for c in ("l_linestatus = 'O'", "l_linestatus <> 'O'"))
    out = (a + b).table()
    return rounded(out.select("i0", "segment", "first", "count", F.array_min("items").alias("least"), F.aggregate("items", F.lit(0.0), lambda s, x: s + x).alias("total")), least=2, total=2)


@query("SELECT CAST(CASE WHEN l_orderkey BETWEEN 1 AND 12000 THEN 12000 - l_orderkey ELSE 12000 END AS INTEGER) AS i0, CAST(count(*) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def hist_many_categories(spark, d):
    """Order keys as categories, in descending order: a table of values is joined."""
    return Binned(category(range(12000, 0, -1))).fill(table(spark, d, "lineitem"), "l_orderkey").table()


@query("SELECT CAST(g.i AS INTEGER) AS i0, CAST(h.i AS INTEGER) AS i1, CAST(count(l_orderkey) AS BIGINT) AS value FROM (SELECT unnest([2499, 2500]) AS i) g CROSS JOIN (SELECT unnest([11, 12, 13]) AS i) h LEFT JOIN lineitem ON floor(l_extendedprice / 10.0) = g.i AND l_partkey = h.i GROUP BY 1, 2")
def rectangle(spark, d):
    """Six of a thousand million cells."""
    h = Binned(regular(10_000, 0, 100_000), integer(0, 100_000)).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_partkey")
    return h.indexed(ranges=[(2499, 2501), (11, 14)]).select("i0", "i1", "value")


@query(f"SELECT i0, CAST(n AS VARCHAR) || repeat('0', 42) AS times, CAST(CAST(n AS HUGEINT) * 3 AS VARCHAR) || repeat('0', 42) AS sum FROM ({cells_sql(QTY5, agg='count(*) AS n')})")
def count_widened(spark, d):
    """Cells multiplied past 38 digits, and added up."""
    h = Binned(qty5()).fill(table(spark, d, "lineitem"), "l_quantity")
    ten14 = h.map_cells(value=F.lit(10**14))
    wide = h * ten14 * ten14 * ten14
    total = (wide + wide + wide).table().select("i0", F.col("digits").alias("sum"))
    return wide.table().where("digits <> '0'").select("i0", F.col("digits").alias("times")).join(total, "i0")


@query(f"SELECT i0, CAST(CAST(n AS HUGEINT) * 4000000000000000000 AS VARCHAR) AS value FROM ({cells_sql(QTY5, agg='count(*) AS n')})")
def count_past_bigint(spark, d):
    """Cells computed in decimals, and sums of them beyond 2**63 without a word from the caller."""
    h = Binned(qty5(), boolean()).fill(table(spark, d, "lineitem"), "l_quantity", F.col("l_orderkey") % 2 == 0)
    h = h.map_cells(value=F.col("value").cast("decimal(38,0)") * F.lit(10**14))
    out = h.project(0)
    for _ in range(2):
        out = out + out
    return (out * Binned(qty5()).fill(table(spark, d, "lineitem"), "l_quantity").map_cells(value=F.lit(10_000))).table().where("value > 0").select("i0", F.col("digits").alias("value"))


@query(f"SELECT i0, value, 'cell ' || i0 AS note FROM ({dense(f'SELECT {QTY5} AS i0 FROM lineitem', -1, 6)})")
def annotated_cells(spark, d):
    """Columns about cells beside their results."""
    h = Binned(qty5()).fill(table(spark, d, "lineitem"), "l_quantity")
    notes = h.dense().select("i0", F.concat(F.lit("cell "), F.col("i0").cast("string")).alias("note"))
    return h.annotated(notes, dense=True)


@query(cells_sql(QTY5, agg="greatest(max(l_extendedprice), 0) AS value"))
def stored_own_accumulator(spark, d):
    """The caller's own accumulator, registered, written and read back."""
    from ..operators.accumulator import register
    from ..sources.store import load, save

    register(maximum)
    path = shared_folder(spark, "own")
    save(Binned(qty5(), accumulator=maximum()).fill(table(spark, d, "lineitem"), "l_quantity", sample="l_extendedprice"), path)
    return load(spark, path).table()


# --- after the fill


@query(f"SELECT i1 AS i0, CAST(sum(value) AS BIGINT) AS value FROM ({cells_sql(PRICE8, QTY5, DISC4)}) GROUP BY i1")
def project_1d(spark, d):
    return hist3(spark, d).project(1).table()


@query(f"SELECT i2 AS i0, i0 AS i1, CAST(sum(value) AS BIGINT) AS value FROM ({cells_sql(PRICE8, QTY5, DISC4)}) GROUP BY i2, i0")
def project_swap(spark, d):
    return hist3(spark, d).project(2, 0).table()


@query(f"SELECT i1 AS i0, CAST(sum(n) AS DOUBLE) AS count, round(sum(s) / sum(n), 6) AS value, round((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1), 6) AS variance FROM ({cells_sql(PRICE8, DISC4, agg=f'count(*) AS n, sum({W}) AS s, sum({W} * {W}) AS q')}) GROUP BY i1")
def project_profile(spark, d):
    h = Binned(price8(), disc4(), accumulator=Mean()).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", sample=W)
    return rounded(h.project(1).table(), value=6, variance=6)


def hist2(spark, d):
    return Binned(price8(), qty5()).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


CELLS2 = cells_sql(PRICE8, QTY5)


def regrouped(i0: str, i1: str = "i1", where: str = "TRUE") -> str:
    return f"SELECT CAST({i0} AS INTEGER) AS i0, CAST({i1} AS INTEGER) AS i1, CAST(sum(value) AS BIGINT) AS value FROM ({CELLS2}) WHERE {where} GROUP BY 1, 2"


@query(regrouped("CASE WHEN i0 < 2 THEN -1 WHEN i0 >= 6 THEN 4 ELSE i0 - 2 END"))
def reduce_shrink(spark, d):
    return hist2(spark, d).reduce(R.shrink(0, 26000, 78000)).table()


@query(regrouped("i0 - 2", where="i0 BETWEEN 2 AND 5"))
def reduce_crop(spark, d):
    return hist2(spark, d).reduce(R.crop(0, 26000, 78000)).table()


@query(regrouped("CASE WHEN i0 < 1 THEN -1 WHEN i0 >= 4 THEN 3 ELSE i0 - 1 END", "CASE WHEN i1 < 0 THEN -1 WHEN i1 >= 3 THEN 3 ELSE i1 END"))
def reduce_slice(spark, d):
    return hist2(spark, d).reduce(R.slice_(0, 1, 4), R.slice_(1, 0, 3)).table()


@query(regrouped("CASE WHEN i0 < 0 THEN -1 WHEN i0 >= 8 THEN 4 ELSE floor(i0 / 2.0) END"))
def reduce_rebin(spark, d):
    return hist2(spark, d).reduce(R.rebin(0, 2)).table()


@query(regrouped("CASE WHEN i0 < 0 THEN -1 WHEN i0 >= 6 THEN 2 ELSE floor(i0 / 3.0) END", "CASE WHEN i1 < 0 THEN -1 WHEN i1 >= 4 THEN 2 ELSE floor(i1 / 2.0) END"))
def reduce_rebin_rem(spark, d):
    return hist2(spark, d).reduce(R.rebin(3), R.rebin(2)).table()


@query(regrouped("CASE WHEN i0 < 2 THEN -1 WHEN i0 >= 6 THEN 2 ELSE floor((i0 - 2) / 2.0) END"))
def reduce_shrink_rebin(spark, d):
    return hist2(spark, d).reduce(R.shrink_and_rebin(0, 26000, 78000, 2)).table()


@query(regrouped("CASE WHEN i0 < 2 THEN -1 WHEN i0 >= 6 THEN 2 ELSE floor((i0 - 2) / 2.0) END", "CASE WHEN i1 < 0 THEN -1 WHEN i1 >= 4 THEN 2 ELSE floor(i1 / 2.0) END"))
def reduce_fused(spark, d):
    """A range and a rebin of one axis, given apart and in any order, are one command."""
    return hist2(spark, d).reduce(R.rebin(0, 2), R.rebin(1, 2), R.shrink(0, 26000, 78000)).table()


@query(f"SELECT i0, value, 'quantity' AS axis, 'day' AS other FROM ({dense(f'SELECT {QTY5} AS i0 FROM lineitem', -1, 6)})")
def metadata_kept(spark, d):
    """What the caller notes about an axis stays with it through reductions, projections and the stored form."""
    from ..sources.store import binned_from, describe

    h = Binned(regular(8, 0, 104000, {"unit": "day"}), regular(5, 0, 50, "quantity")).fill(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    h = h.reduce(R.rebin(0, 2))
    h = binned_from(describe(h), h.cells)
    other = h.axis(0).metadata["unit"]
    out = h.project(1)
    return out.table(dense=True).withColumns({"axis": F.lit(out.axis(0).metadata), "other": F.lit(other)})


@query(f"SELECT * FROM ({dense(f'SELECT {PRICE8} AS i0 FROM lineitem', 0, 8)})")
def hist_by_bins(spark, d):
    """The bins that an axis is walked through say which rows a fill has put into them."""
    price, bins = F.col("l_extendedprice"), list(price8())
    counts = [F.count_if((price >= b.lower) & (price < b.upper)).alias(str(i)) for i, b in enumerate(bins)]
    found = table(spark, d, "lineitem").agg(F.array(*counts).alias("found"))
    return found.select(F.posexplode("found").alias("i0", "value"))


@query(f"SELECT CAST(CASE WHEN i0 = 1 THEN 0 ELSE 1 END AS INTEGER) AS i0, CAST(sum(value) AS BIGINT) AS value FROM ({cells_sql(FLAG)}) GROUP BY 1")
def reduce_cat(spark, d):
    return Binned(category("ANR")).fill(table(spark, d, "lineitem"), "l_returnflag").reduce(R.slice_(1, 2)).table()


def halves(spark, d, acc=None):
    rows = table(spark, d, "lineitem")
    fill = lambda s: Binned(price8(), accumulator=acc or Count()).fill(rows.where(F.col("l_linestatus") == s), "l_extendedprice", weight=W if acc else None)
    return fill("O"), fill("F")


HALVES = f"SELECT {PRICE8} AS i0, CAST(sum((l_linestatus = 'O')::INT) AS BIGINT) AS a, CAST(sum((l_linestatus = 'F')::INT) AS BIGINT) AS b FROM lineitem GROUP BY 1"


@query(f"SELECT i0, a + b AS value FROM ({HALVES})")
def op_add(spark, d):
    a, b = halves(spark, d)
    return (a + b).table()


@query(f"SELECT i0, a - b AS value FROM ({HALVES})")
def op_sub(spark, d):
    a, b = halves(spark, d)
    return (a - b).table()


@query(f"SELECT i0, a * b AS value FROM ({HALVES})")
def op_mul(spark, d):
    a, b = halves(spark, d)
    return (a * b).table().withColumn("value", F.col("value").cast("bigint"))


@query(f"SELECT CAST(g.i AS INTEGER) AS i0, round(CASE WHEN coalesce(b, 0) = 0 THEN CASE WHEN coalesce(a, 0) = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE a / b::DOUBLE END, 9) AS value FROM (SELECT unnest(generate_series(-1, 8)) AS i) g LEFT JOIN ({HALVES}) h ON h.i0 = g.i")
def op_div(spark, d):
    a, b = halves(spark, d)
    return rounded((a / b).table(), value=9)


@query(f"SELECT i0, a * 2.5::DOUBLE AS value FROM ({HALVES}) WHERE a > 0")
def op_scale(spark, d):
    return (halves(spark, d)[0] * 2.5).table()


@query(f"SELECT {PRICE8} AS i0, sum({W}) * 0.5::DOUBLE AS value, sum({W} * {W}) * 0.25::DOUBLE AS variance FROM lineitem GROUP BY 1")
def op_scale_weighted(spark, d):
    a, b = halves(spark, d, WeightedSum())
    return ((a + b) / 2).table()


@query(f"SELECT {PRICE8} AS i0, sum(CASE WHEN l_linestatus = 'O' THEN {W} ELSE 1 END) AS value, sum(CASE WHEN l_linestatus = 'O' THEN {W} * {W} ELSE 1 END) AS variance FROM lineitem GROUP BY 1")
def op_add_promoted(spark, d):
    return (halves(spark, d, WeightedSum())[0] + halves(spark, d)[1]).table()


@query("""WITH x AS (SELECT *, event_id % 2 AS h FROM events), o AS (SELECT event_type, min(CASE WHEN h = 0 THEN event_id END) AS a, min(CASE WHEN h = 1 THEN event_id END) AS b, count(*) AS v FROM x GROUP BY event_type)
SELECT CAST(row_number() OVER (ORDER BY a NULLS LAST, b) - 1 AS INTEGER) AS i0, event_type AS bin0, CAST(v AS BIGINT) AS value FROM o""")
def op_merge_category(spark, d):
    rows = table(spark, d, "events")
    a, b = (Binned(category([], options={"growth"})).fill(rows.where(F.col("event_id") % 2 == h), "event_type", order_by="event_id") for h in (0, 1))
    return (a + b).indexed().select("i0", "bin0", "value")


@query("SELECT CAST(count(*) AS BIGINT) AS value FROM lineitem")
def sum_all(spark, d):
    return hist3(spark, d).sum_state("all")


@query(f"SELECT CAST(sum(value) AS BIGINT) AS value FROM ({CELLS2}) WHERE i0 BETWEEN 0 AND 7 AND i1 BETWEEN 0 AND 4")
def sum_inner(spark, d):
    return hist2(spark, d).sum_state("inner")


@query("SELECT FALSE AS filled_is_empty, TRUE AS new_is_empty")
def is_empty(spark, d):
    h = hist2(spark, d)
    return spark.range(1).select(F.lit(h.empty()).alias("filled_is_empty"), F.lit(h.reset().empty()).alias("new_is_empty"))


@query(f"WITH c AS ({dense(f'SELECT {PRICE8} AS i0 FROM lineitem', -1, 9)}) SELECT i0, round(value / 13000.0::DOUBLE, 9) AS density FROM c WHERE i0 BETWEEN 0 AND 7")
def density(spark, d):
    return rounded(Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice").density().select("i0", "density"), density=9)


@query(f"WITH c AS ({dense(f'SELECT {PRICE8} AS i0 FROM lineitem', -1, 9)}) SELECT i0, value, CAST(sum(value) OVER (ORDER BY i0) AS BIGINT) AS cumulative FROM c WHERE i0 BETWEEN 0 AND 7")
def cdf(spark, d):
    return Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice").cumulative()


@query(f"SELECT i0, i1, value FROM ({CELLS2}) WHERE i0 BETWEEN 0 AND 7 AND i1 BETWEEN 0 AND 4 ORDER BY value DESC, i1, i0 LIMIT 1")
def top_cell(spark, d):
    return hist2(spark, d).top(1)


@query(f"SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS cosine FROM (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM ({HALVES}) WHERE i0 BETWEEN 0 AND 7)")
def cosine(spark, d):
    a, b = halves(spark, d)
    return spark.range(1).select(F.round(F.lit(a.cosine(b)), 9).alias("cosine"))


@query(f"""WITH c AS ({cells_sql(FLAG, "CAST(CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INTEGER)")})
SELECT i0, i1, CAST(sum(value) AS BIGINT) AS value FROM c GROUP BY GROUPING SETS ((i0, i1), (i0), (i1), ())""")
def grouping_sets(spark, d):
    h = Binned(category("ANR"), category("OF")).fill(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return h.grouping_sets([[0, 1], [0], [1], []])


@query(f"SELECT CAST(a.i AS INTEGER) AS i0, CAST(b.i AS INTEGER) AS i1, coalesce(value, 0) AS value FROM (SELECT unnest(generate_series(-1, 2)) AS i) a, (SELECT unnest(generate_series(3, 5)) AS i) b LEFT JOIN ({CELLS2}) c ON c.i0 = a.i AND c.i1 = b.i")
def indexed_range(spark, d):
    return hist2(spark, d).indexed(ranges=[(-1, 3), (3, 7)]).select("i0", "i1", "value")


@query(f"WITH c AS ({dense(f'SELECT {PRICE} AS i0 FROM lineitem', -1, 21)}) SELECT i0, value, round(900.0::DOUBLE + i0 * 2455.0, 6) AS lower0 FROM c WHERE i0 BETWEEN 0 AND 19")
def indexed_bins(spark, d):
    return rounded(Binned(price_axis()).fill(table(spark, d, "lineitem"), "l_extendedprice").indexed().select("i0", "value", "lower0"), lower0=6)


@query("SELECT CAST(0 AS INTEGER) AS i0, CAST(count(*) AS BIGINT) AS value FROM lineitem")
def uncounted_flow(spark, d):
    return Binned(regular(1, 0, 1e9)).fill(table(spark, d, "lineitem"), "l_extendedprice").table()


@query(cells_sql(f"CAST(label AS INTEGER)", reg("v", 10, "(-1.0)::DOUBLE", "2.0::DOUBLE"), source="(SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)"))
def hist_exploded(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v"))
    return Binned(integer(0, 10), regular(10, -1, 1)).fill(rows, "label", "v").table()


_BARS = """WITH cells AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, count(*) AS c FROM lineitem GROUP BY i),
every AS (SELECT g.i, ['A', 'N', 'other'][g.i + 1] AS label, coalesce(c, 0) AS c FROM (SELECT unnest([0, 1, 2]) AS i) g LEFT JOIN cells USING (i)),
wide AS (SELECT max(len(CAST(c AS VARCHAR))) AS w, max(c) AS hi FROM every)
"""


@query(_BARS + """SELECT CAST(i AS INTEGER) AS n, rpad(label, 5, ' ') || ' ' || lpad(CAST(c AS VARCHAR), CAST(w AS INTEGER), ' ') || ' |' || repeat('=', CAST(round_even(c / (hi / CAST(greatest(8, 78 - 5 - w - 4) AS DOUBLE)), 0) AS BIGINT)) AS line FROM every, wide""")
def text_bars(spark, d):
    from ..sources.text import bars

    h = Binned(category("AN")).fill(table(spark, d, "lineitem"), "l_returnflag")
    return spark.createDataFrame(list(enumerate(bars(h, ascii_only=True).splitlines()[1:])), "n int, line string")


@query(_BARS + """SELECT CAST(i AS INTEGER) AS n, '  (' || lpad(CAST(i AS VARCHAR), 2, ' ') || '): ' || CAST(c AS VARCHAR) AS line FROM every""")
def text_output(spark, d):
    from ..sources.text import table as listed

    h = Binned(category("AN")).fill(table(spark, d, "lineitem"), "l_returnflag")
    return spark.createDataFrame(list(enumerate(listed(h).splitlines()[2:-1])), "n int, line string")


@query("SELECT CAST(count(*) AS DOUBLE) AS value FROM customer")
def sum_real_cells(spark, d):
    """Every customer has cells of 1, 1e100 and -1e100: what is left of them survives the sum."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c"), F.posexplode(F.array(F.lit(1.0), F.lit(1e100), F.lit(-1e100))).alias("k", "w"))
    h = Binned(integer(0, 1 << 30), integer(0, 3, options=())).fill(rows, "c", "k", weight="w")
    return spark.createDataFrame([(h.sum()["value"],)], "value double")


@query(cells_sql(QTY5, agg="round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS value"))
def sum_compensated(spark, d):
    """Every price comes with 1e100 and -1e100."""
    rows = table(spark, d, "lineitem").select("l_quantity", F.explode(F.array(F.lit(1e100), F.col("l_extendedprice").cast("double"), F.lit(-1e100))).alias("x"))
    return rounded(Binned(qty5(), accumulator=Sum()).fill(rows, "l_quantity", weight="x").table().select("i0", "value"), value=2)


# --- streams of the events, read when all have arrived


def events_stream(spark, d) -> DataFrame:
    from ..streaming.running import stream_of

    return stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark, d, name: str, fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming aggregation of the events has given."""
    from ..streaming.running import RunningResult, finished

    out = RunningResult(shared_folder(spark, name))
    finished(out.start(fill(events_stream(spark, d))), expect_rows=not table(spark, d, "events").isEmpty())
    return out.read(spark)


def running(spark, d, name: str, h: Binned, *columns, **options) -> Binned:
    """A binned table kept over a stream of the events."""
    from ..streaming.running import RunningTable, finished

    out = RunningTable(h, shared_folder(spark, name))
    finished(out.start(events_stream(spark, d), *columns, **options), expect_rows=not table(spark, d, "events").isEmpty())
    return out.read(spark)


CLICKS = "CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER)"


@query(cells_sql(CLICKS, source="events"))
def stream_fill(spark, d):
    """A running binned table."""
    return running(spark, d, "cells", Binned(category(["click", "view"])), "event_type").table()


@query(cells_sql(CLICKS, source="events"))
def stream_cells(spark, d):
    """The same cells as one streaming aggregation."""
    from ..streaming.fill import fill_stream

    return streamed(spark, d, "counts", lambda s: fill_stream(s, [category(["click", "view"])], ["event_type"]))


@query("SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS i0, CAST(floor(value / 25.0::DOUBLE) - min(floor(value / 25.0::DOUBLE)) OVER () AS INTEGER) AS i1, CAST(1 AS BIGINT) AS one FROM events".join(("SELECT i0, i1, CAST(sum(one) AS BIGINT) AS value FROM (", ") GROUP BY i0, i1")))
def stream_growing(spark, d):
    """Axes that grow with the stream: categories in their own order, and bins of 25."""
    grow = {"growth"}
    return running(spark, d, "growing", Binned(category([], options=grow), regular(1, 0, 25, options=grow)), "event_type", "value").table()


@query(cells_sql(CLICKS, agg="round(CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE), 4) AS value", source="events"))
def stream_sum(spark, d):
    """Exact sums of a stream, in which every value also comes with 1e100 and -1e100."""
    from ..streaming.fill import fill_stream

    axes = [category(["click", "view"])]
    far = lambda s: s.select("event_type", F.explode(F.array(F.lit(1e100), "value", F.lit(-1e100))).alias("x"))
    cells = streamed(spark, d, "sums", lambda s: fill_stream(far(s), axes, ["event_type"], Sum(), weight="x"))
    return rounded(Binned(*axes, accumulator=Sum(), cells=cells).table().select("i0", "value"), value=4)


@query("""SELECT CAST(day * 86400 AS BIGINT) AS start, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER) AS i0, CAST(count(*) AS BIGINT) AS value
FROM (SELECT event_type, floor(epoch(ts) / 86400) - back AS day FROM events, (SELECT unnest([0, 1]) AS back)) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    """Counts of two days, every day."""
    from ..streaming.fill import fill_windows

    out = streamed(spark, d, "windows", lambda s: fill_windows(s, "ts", "2 days", "1 hour", [category(["click", "view"])], ["event_type"], slide="1 day"))
    return out.select(F.unix_timestamp("window_start").alias("start"), "i0", "value")


# --- inspection, storage, equality


@query(dense(f"SELECT {reg('l_quantity * l_quantity', 5, '0.0::DOUBLE', '2500.0::DOUBLE')} AS i0 FROM lineitem", -1, 6))
def hist_own_transform(spark, d):
    square = UserTransform(on_column=lambda x: x * x, to=lambda x: x * x, back=lambda y: y**0.5)
    return Binned(regular(5, 0, 50, transform=square)).fill(table(spark, d, "lineitem"), "l_quantity").table(dense=True)


@query(dense(f"SELECT {reg('sqrt(l_quantity)', 7, '1.0::DOUBLE', 'sqrt(50.0::DOUBLE) - 1.0')} AS i0 FROM lineitem", -1, 8))
def hist_step_transform(spark, d):
    return Binned(regular_step(7, 1, 51, transform=Sqrt())).fill(table(spark, d, "lineitem"), "l_quantity").table(dense=True)


@query(dense("SELECT CAST(CASE WHEN o_totalprice < 0 THEN -1 WHEN o_totalprice >= 300000 THEN 300 ELSE floor(o_totalprice / 1000.0) END AS INTEGER) AS i0 FROM orders", -1, 301))
def hist_many_edges(spark, d):
    return Binned(variable([1000.0 * k for k in range(301)])).fill(table(spark, d, "orders"), "o_totalprice").table(dense=True)


@query(cells_sql(PRICE8, "CAST(CASE WHEN sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) < 25 THEN 0 ELSE 1 END AS INTEGER)"))
def hist_tuple(spark, d):
    """An axis of one column beside one of two, whose values come as a tuple."""
    circle = UserAxis(bins=2, arity=2, mapping=lambda x, y: F.when(F.sqrt(x * x + y * y) < 25, 0).otherwise(1))
    return Binned(price8(), circle).fill(table(spark, d, "lineitem"), "l_extendedprice", ("l_quantity", "l_linenumber")).table()


@query(f"""SELECT CAST(g.i AS INTEGER) AS i0, round(10.0::DOUBLE ** g.i, 6) AS lower0, round(10.0::DOUBLE ** (g.i + 1), 6) AS upper0, round(9 * 10.0::DOUBLE ** g.i, 6) AS width0, CAST(count(o_orderkey) AS BIGINT) AS value
FROM (SELECT unnest(generate_series(0, 5)) AS i) g LEFT JOIN orders ON {reg('ln(o_totalprice)', 6, '0.0::DOUBLE', 'ln(1000000.0::DOUBLE)')} = g.i GROUP BY g.i""")
def bins_log(spark, d):
    """Bins of a transformed axis beside their cells."""
    h = Binned(regular(6, 1, 1_000_000, transform=Log())).fill(table(spark, d, "orders"), "o_totalprice")
    return rounded(h.indexed().select("i0", "lower0", "upper0", "width0", "value"), lower0=6, upper0=6, width0=6)


@query("""SELECT CAST(g.i AS INTEGER) AS i0, CASE WHEN g.i < 0 THEN '-Infinity'::DOUBLE ELSE [0, 10, 40, 90][g.i + 1]::DOUBLE END AS lower0, CASE WHEN g.i > 2 THEN 'Infinity'::DOUBLE ELSE [0, 10, 40, 90][g.i + 2]::DOUBLE END AS upper0, CAST(count(event_id) AS BIGINT) AS value
FROM (SELECT unnest([-1, 0, 1, 2, 3]) AS i) g LEFT JOIN events ON (CASE WHEN value < 0 THEN -1 WHEN value < 10 THEN 0 WHEN value < 40 THEN 1 WHEN value < 90 THEN 2 ELSE 3 END) = g.i GROUP BY g.i""")
def bins_variable(spark, d):
    return Binned(variable([0, 10, 40, 90])).fill(table(spark, d, "events"), "value").indexed("all").select("i0", "lower0", "upper0", "value")


@query("SELECT CAST(floor((value - 360 * floor(value / 360.0::DOUBLE)) / 90) AS INTEGER) AS i0, CAST(floor(value / 90.0::DOUBLE) AS BIGINT) AS unwound, floor(value / 90.0::DOUBLE) * 90 AS lower, CAST(count(*) AS BIGINT) AS value FROM (SELECT value * 20 - 500 AS value FROM events) GROUP BY ALL")
def values_circular(spark, d):
    """A circular axis goes on beyond its ends: the value of a number outside is that of the turn it lies in."""
    axis, value = circular(4, 0, 360), F.col("value") * 20 - 500
    rows = table(spark, d, "events").select(value.alias("value")).withColumn("unwound", F.floor(F.col("value") / 90).cast("bigint"))
    cells = rows.groupBy(axis.index(F.col("value")).alias("i0"), "unwound").agg(F.count(F.lit(1)).alias("value"))
    return cells.select("i0", "unwound", axis.value_column(F.col("unwound")).alias("lower"), "value")


@query("SELECT CAST(g.i AS INTEGER) AS i0, CASE WHEN g.i BETWEEN 0 AND 3 THEN CAST(g.i + 3 AS VARCHAR) END AS bin0, CAST(count(l_orderkey) AS BIGINT) AS value FROM (SELECT unnest(generate_series(-1, 4)) AS i) g LEFT JOIN lineitem ON greatest(-1, least(4, l_linenumber - 3)) = g.i GROUP BY g.i")
def bins_integer(spark, d):
    return Binned(integer(3, 7)).fill(table(spark, d, "lineitem"), "l_linenumber").indexed("all").select("i0", "bin0", "value")


@query(f"SELECT i0, '[' || printf('%g', 13000.0::DOUBLE * i0) || ', ' || printf('%g', 13000.0::DOUBLE * (i0 + 1)) || ')' AS bin0, 'mean(' || printf('%g', count(*)::DOUBLE) || ', ' || printf('%g', avg({W})) || ', ' || printf('%g', var_samp({W})) || ')' AS cell FROM (SELECT *, {PRICE8} AS i0 FROM lineitem) WHERE i0 BETWEEN 0 AND 7 GROUP BY i0 HAVING count(*) > 1")
def cells_as_text(spark, d):
    from ..sources.text import cells_text

    return cells_text(profile_of(spark, d), "inner").where("cell not like '%none%'")


@query(f"""SELECT 'inner' AS cell, coalesce(sum(value) FILTER (i0 = 2 AND i1 = 1), 0)::BIGINT AS value FROM ({CELLS2}) UNION ALL
SELECT 'corner', coalesce(sum(value) FILTER (i0 = 0 AND i1 = 0), 0)::BIGINT FROM ({CELLS2}) UNION ALL SELECT 'flow', coalesce(sum(value) FILTER (i0 = -1 AND i1 = -1), 0)::BIGINT FROM ({CELLS2})""")
def at_cells(spark, d):
    h = hist2(spark, d).cached()
    return spark.createDataFrame([("inner", h.at(2, 1)["value"]), ("corner", h[0, 0]["value"]), ("flow", h.at(-1, -1)["value"])], "cell string, value bigint")


@query(f"SELECT bool_or(value > 1000) AS many, bool_or(value < 0) AS negative FROM ({CELLS2}) WHERE i0 BETWEEN 0 AND 7 AND i1 BETWEEN 0 AND 4")
def any_cells(spark, d):
    h = hist2(spark, d).cached()
    return spark.createDataFrame([(h.any_of(F.col("value") > 1000), h.any_of(F.col("value") < 0))], "many boolean, negative boolean")


@query("SELECT TRUE AS sum_is_whole, FALSE AS half_is_whole, FALSE AS other_axis, TRUE AS axes_agree, TRUE AS accumulators_agree")
def equality(spark, d):
    a, b = halves(spark, d)
    whole = Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice")
    row = (a + b == whole, a == whole, Binned(regular(8, 0, 1)) == whole.reset(), price8() == whole.axis(0), Mean() == Mean())
    return spark.createDataFrame([row], "sum_is_whole boolean, half_is_whole boolean, other_axis boolean, axes_agree boolean, accumulators_agree boolean")


@query(f"SELECT i0, CASE WHEN i0 BETWEEN 0 AND 7 THEN value END AS value FROM ({dense(f'SELECT {PRICE8} AS i0 FROM lineitem', -1, 9)}) WHERE i0 BETWEEN 0 AND 7")
def described(spark, d):
    """Axes and accumulator through their stored form."""
    from ..sources.store import binned_from, describe

    h = Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice")
    return binned_from(describe(h), h.cells).indexed().select("i0", "value")


@query(cells_sql(PRICE8, agg=f"CAST(count(*) AS DOUBLE) AS count, round(avg({W}), 6) AS value, round(var_samp({W}), 6) AS variance"))
def stored_profile(spark, d):
    """Written below the shared folder and read back; only a local session may have none."""
    from ..sources.store import load, save

    path = shared_folder(spark, "stored")
    save(profile_of(spark, d), path)
    return rounded(load(spark, path).table(), value=6, variance=6)


_WEIGHTS = ", ".join(f"sum(CASE WHEN l_linestatus = '{s}' THEN {v} ELSE 0 END)::DOUBLE AS {n}" for s, v, n in (("O", W, "a"), ("F", W, "b"), ("O", f"{W} * {W}", "va"), ("F", f"{W} * {W}", "vb")))


@query(f"SELECT i0, round(a / b, 9) AS value, round((va / (a * a) + vb / (b * b)) * (a / b) * (a / b), 9) AS variance FROM (SELECT {PRICE8} AS i0, {_WEIGHTS} FROM lineitem GROUP BY 1) WHERE i0 BETWEEN 0 AND 7 AND b > 0")
def op_div_weighted(spark, d):
    a, b = halves(spark, d, WeightedSum())
    return rounded((a / b).table().where("i0 between 0 and 7 and value < double('Infinity')"), value=9, variance=9)


@query(f"SELECT i0, count, value, variance FROM (SELECT i0, count(*)::DOUBLE AS count, round(avg({W}), 6) AS value, round(var_samp({W}), 6) AS variance FROM (SELECT *, {PRICE8} AS i0 FROM lineitem) GROUP BY i0) WHERE i0 <> 3 UNION ALL SELECT 3, 10.0::DOUBLE, 2.5::DOUBLE, 4.0::DOUBLE")
def cell_from_moments(spark, d):
    return rounded(profile_of(spark, d).with_cell(3, **Mean.from_moments(10, 2.5, 4.0)).table(), value=6, variance=6)


@query(f"SELECT {QTY5} AS i0, CAST(count(*) AS BIGINT) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def reset_and_filled(spark, d):
    rows = table(spark, d, "lineitem")
    h = Binned(qty5()).fill(rows, "l_quantity")
    return h.reset().fill(rows.where("l_returnflag = 'R'"), "l_quantity").table()


@query(f"SELECT CAST(3 AS INTEGER) AS rank, CAST(10 * 7 * 6 AS BIGINT) AS size, CAST(8 AS INTEGER) AS bins, CAST(10 AS INTEGER) AS extent, CAST(count(*) AS BIGINT) AS touched, CAST(sum(value) AS BIGINT) AS rows FROM ({cells_sql(PRICE8, QTY5, DISC4)})")
def shape(spark, d):
    """Cells there could be, and those that the rows have touched."""
    h, a = hist3(spark, d), hist3(spark, d).axis(0)
    assert a.continuous and a.inclusive
    fixed = {"rank": F.lit(h.rank), "size": F.lit(h.size).cast("bigint"), "bins": F.lit(a.size), "extent": F.lit(a.extent)}
    return h.table().agg(F.count(F.lit(1)).alias("touched"), F.sum("value").alias("rows")).withColumns(fixed)


@query(f"SELECT i0, value * 2 + 1 AS value FROM ({dense(f'SELECT {PRICE8} AS i0 FROM lineitem', -1, 9)})")
def mapped_cells(spark, d):
    return Binned(price8()).fill(table(spark, d, "lineitem"), "l_extendedprice").map_cells(value=F.col("value") * 2 + 1).table()


@query(f"SELECT i0, value, TRUE AS too_few, TRUE AS too_many, TRUE AS too_long, TRUE AS no_sample FROM ({cells_sql(PRICE8)})")
def rejected_fills(spark, d):
    """What doesn't fit the axes or the accumulator is refused, and the right fill goes on as if nothing had been tried."""
    rows = table(spark, d, "lineitem")
    h, g, m = Binned(price8()), Binned(price8(), qty5()), Binned(price8(), accumulator=Mean())

    def refused(f) -> bool:
        try:
            f()
        except (ValueError, TypeError):
            return True
        return False

    tries = {"too_few": lambda: g.fill(rows, "l_extendedprice"), "too_many": lambda: g.fill(rows, "l_extendedprice", "l_quantity", "l_tax"), "too_long": lambda: g.fill(rows, ("l_extendedprice", "l_tax"), "l_quantity"), "no_sample": lambda: m.fill(rows, "l_extendedprice")}
    return h.fill(rows, "l_extendedprice").table().withColumns({k: F.lit(refused(f)) for k, f in tries.items()})


# --- more streams


@query(f"SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, {CLICKS} AS i0, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    from ..streaming.fill import fill_windows

    out = streamed(spark, d, "tumbling", lambda s: fill_windows(s, "ts", "1 day", "1 hour", [category(["click", "view"])], ["event_type"]))
    return out.select(F.unix_timestamp("window_start").alias("start"), "i0", "value")


@query(f"""WITH x AS (SELECT {CLICKS} AS i0, epoch_us(ts) AS t FROM events), y AS (SELECT *, CASE WHEN t - lag(t) OVER w < 600000000 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY i0 ORDER BY t)),
z AS (SELECT *, sum(new) OVER (PARTITION BY i0 ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM y)
SELECT min(t) AS start, max(t) + 600000000 AS stop, i0, CAST(count(*) AS BIGINT) AS value FROM z GROUP BY i0, s""")
def stream_sessions(spark, d):
    from ..streaming.fill import fill_sessions

    out = streamed(spark, d, "sessions", lambda s: fill_sessions(s, "ts", "10 minutes", "1 hour", [category(["click", "view"])], ["event_type"]))
    return out.select(F.unix_micros("session_start").alias("start"), F.unix_micros("session_end").alias("stop"), "i0", "value")


@query("SELECT CAST(floor((value - 0.0) / 50.0::DOUBLE * 2) AS BIGINT) AS key, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1")
def stream_keys(spark, d):
    """A growing axis: counts under its unbounded bin numbers."""
    from ..streaming.fill import fill_keys

    return streamed(spark, d, "keys", lambda s: fill_keys(s, regular(2, 0, 50, options={"growth"}), "value"))


@query(cells_sql(CLICKS, agg="CAST(count(*) AS DOUBLE) AS count, round(avg(value), 6) AS value, round(var_samp(value), 6) AS variance", source="events"))
def stream_profile(spark, d):
    """Means of a running stream."""
    from ..streaming.fill import fill_stream

    axes = [category(["click", "view"])]
    cells = streamed(spark, d, "profile", lambda s: fill_stream(s, axes, ["event_type"], Mean(), sample="value"))
    return rounded(Binned(*axes, accumulator=Mean(), cells=cells).table(), value=6, variance=6)


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quantity by price and discount."""
    rows = table(spark, folder, "lineitem")
    h = Binned(regular(20, 900, 50000, "price"), regular(5, 0, 0.1, "discount"), accumulator=Mean()).fill(rows, "l_extendedprice", "l_discount", sample="l_quantity")
    return h.table()
