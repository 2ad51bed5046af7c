"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from binweave.operators.accumulator import Mean, WeightedSum
from binweave.operators.axis import category, integer, regular
from binweave.operators.binned import Binned
from binweave.operators.reduce import rebin, shrink

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def row_groups(folder: str, low: float, high: float) -> dict:
    """Row groups of the ordered copy, and those that a range of prices can lie in."""
    groups = [m.row_group(g).column(m.schema.to_arrow_schema().get_field_index("l_extendedprice")).statistics for f in glob.glob(f"{folder}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    return {"all": len(groups), "in_range": sum(g.min <= high and g.max >= low for g in groups)}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    hundred = spark.read.parquet(*[f"{FOLDER}/lineitem.parquet"] * 100)  # a hundred times the rows: the slope leaves out what a job costs by itself
    ordered = f"{tempfile.mkdtemp(prefix='spark-')}/ordered"
    rows.repartitionByRange(4, "l_extendedprice").sortWithinPartitions("l_extendedprice").write.option("parquet.block.size", 1 << 20).parquet(ordered)
    by_price = spark.read.parquet(ordered)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    price, quantity, discount = regular(100, 900, 105000), regular(100, 0, 51), regular(100, 0, 0.11)
    tens = [regular(10, 900, 105000), regular(10, 0, 51), regular(10, 0, 0.11), regular(10, 0, 0.09), integer(1, 8), category("ANR")]
    columns = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]
    three = Binned(price, quantity, discount).fill(rows, *columns[:3])
    queries = {
        "fill_1d": lambda: Binned(price).fill(rows, columns[0]).table(),
        "fill_1d_inner": lambda: Binned(regular(100, 50000, 51000)).fill(rows, columns[0], inner_only=True).table(),
        "fill_2d": lambda: Binned(price, quantity).fill(rows, *columns[:2]).table(),
        "fill_3d": lambda: three.table(),
        "fill_6d": lambda: Binned(*tens).fill(rows, *columns).table(),
        "fill_weighted": lambda: Binned(price, accumulator=WeightedSum()).fill(rows, columns[0], weight="l_quantity").table(),
        "profile": lambda: Binned(price, accumulator=Mean()).fill(rows, columns[0], sample="l_quantity").table(),
        "category": lambda: Binned(category(["1-URGENT", "5-LOW"])).fill(orders, "o_orderpriority").table(),
        "project": lambda: three.project(0).table(),
        "reduce": lambda: three.reduce(shrink(0, 20000, 80000), rebin(1, 4)).table(),
        "dense_2d": lambda: Binned(price, quantity).fill(rows, *columns[:2]).table(dense=True),
    }
    apart = {  # not in the total
        "fill_1d_times_100": lambda: Binned(price).fill(hundred, columns[0]).table(),
        "fill_3d_times_100": lambda: Binned(price, quantity, discount).fill(hundred, *columns[:3]).table(),
        "fill_6d_times_100": lambda: Binned(*tens).fill(hundred, *columns).table(),
        "fill_ordered": lambda: Binned(regular(100, 50000, 51000)).fill(by_price, columns[0]).table(),
        "fill_ordered_inner": lambda: Binned(regular(100, 50000, 51000)).fill(by_price, columns[0], inner_only=True).table(),
    }
    times = {}
    for name, make in (queries | apart).items():
        make().write.format("noop").mode("overwrite").save()  # compiled and warm
        best = float("inf")
        for _ in range(3):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        times[name] = round(best, 4)
    n = rows.agg(F.count(F.lit(1))).first()[0]
    fills = [v for k, v in times.items() if k.startswith("fill_") and k in queries]
    slopes = {k: round(1e9 * (times[f"{k}_times_100"] - times[k]) / (99 * n), 2) for k in ("fill_1d", "fill_3d", "fill_6d")}
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(times[k] for k in queries), 4), "unit": "sec", "queries": {k: times[k] for k in queries}, "sf": os.path.basename(FOLDER.rstrip("/")), "rows": n,
        "fill_ns_per_row": round(1e9 * sum(fills) / len(fills) / n, 1), "slope_ns_per_row": slopes, "apart": {k: times[k] for k in apart}, "row_groups": row_groups(ordered, 50000, 51000),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
