"""Storing and loading a binned table: cells as Parquet, axes and accumulator as one JSON row beside them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.accumulator import BY_NAME
from ..operators.axis import axis_from_json
from ..operators.binned import Binned


def describe(h: Binned) -> str:
    """Axes and accumulator; the caller's own accumulators as far as they are registered."""
    if h.accumulator.name not in BY_NAME:
        raise TypeError(f"{h.accumulator.name} can't be stored; register() it")
    return json.dumps({"axes": [a.to_json() for a in h.axes], "accumulator": h.accumulator.name, "parameters": h.accumulator.parameters()})


def binned_from(description: str, cells) -> Binned:
    d = json.loads(description)
    return Binned(*map(axis_from_json, d["axes"]), accumulator=BY_NAME[d["accumulator"]](**d["parameters"]), cells=cells)


def save(h: Binned, path: str) -> None:
    """Written by Spark, so any store that Spark reaches will do."""
    h.cells.write.mode("overwrite").parquet(f"{path}/cells")
    h.cells.sparkSession.createDataFrame([(describe(h),)], "description string").coalesce(1).write.mode("overwrite").text(f"{path}/axes")


def load(spark: SparkSession, path: str) -> Binned:
    return binned_from(spark.read.text(f"{path}/axes").first()[0], spark.read.parquet(f"{path}/cells"))
