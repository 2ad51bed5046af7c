"""A binned table of a stream that survives stops, restarts and repeated batches: cells in a folder that all executors share.

Every batch's cells are written below the batch's number, so a batch that runs again replaces what it wrote before.  The axes
after a batch are written with its cells: axes that grow go on from those of the batch before, and no value is ever counted under
another's bin.  Reading adds the batches up; now and then a batch also writes the sum of all so far, and older cells are not read again.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.axis import axis_from_json
from ..operators.binned import Binned
from ..sources.store import binned_from, describe


def stream_of(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream of a Parquet table, be it one file or a folder of part files (the last letter is a pattern, so that either is listed)."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def finished(query: StreamingQuery, expect_rows: bool = True) -> StreamingQuery:
    """Wait for a query; one that should have seen rows and saw none is an error, not an empty result."""
    query.awaitTermination()
    if expect_rows and not any(p["numInputRows"] for p in query.recentProgress):
        raise RuntimeError("the stream saw no rows")
    return query


class RunningTable:
    """Cells of a stream, kept in `path`; `start` runs the stream, `read` gives the binned table so far.

    `every`: after so many batches the sum of all is written, too.
    """

    def __init__(self, h: Binned, path: str, every: int = 20):
        self.empty, self.path, self.every = h.reset(), path, every

    # --- what is stored

    def _listed(self, spark: SparkSession, kind: str) -> dict[int, str]:
        """Descriptions by batch number."""
        try:
            rows = spark.read.schema("description string, batch long").json(f"{self.path}/{kind}-axes").collect()
        except AnalysisException:  # nothing yet
            return {}
        return {r["batch"]: r["description"] for r in rows}

    def _write(self, h: Binned, kind: str, batch: int) -> None:
        """Cells first: a batch counts once its axes are there."""
        h.cells.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")
        line = h.cells.sparkSession.createDataFrame([(describe(h),)], "description string")
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/{kind}-axes/batch={batch}")

    def _stored(self, spark: SparkSession, kind: str, batch: int, description: str) -> Binned:
        own = binned_from(description, None)
        return binned_from(description, spark.read.schema(own.schema).parquet(f"{self.path}/{kind}/batch={batch}"))

    def read(self, spark: SparkSession, before: int | None = None) -> Binned:
        """The sum of all batches (below `before`), in the axes of the last."""
        batches, sums = self._listed(spark, "cells"), self._listed(spark, "sums")
        batches = {b: d for b, d in batches.items() if before is None or b < before}
        sums = {b: d for b, d in sums.items() if before is None or b < before - 1}  # the sum at before - 1 is the one to be written
        base = max(sums, default=-1)
        parts = [self._stored(spark, "sums", base, sums[base])] if sums else []
        parts += [self._stored(spark, "cells", b, batches[b]) for b in sorted(batches) if b > base]
        if not parts:
            return self.empty
        last = parts[-1].axes
        moved = [p._moved_to(last) for p in parts]
        acc = moved[0].accumulator
        for m in moved[1:]:
            acc = m._common(acc, m.accumulator)
        moved = [m._promoted(acc) for m in moved]
        cells = moved[0].cells
        for m in moved[1:]:
            cells = cells.unionByName(m.cells)
        return Binned(*last, accumulator=acc, cells=acc.merged(cells, moved[0].keys))

    # --- the stream

    def _axes_before(self, spark: SparkSession, batch: int) -> list:
        kept = {**self._listed(spark, "sums"), **self._listed(spark, "cells")}
        earlier = [b for b in kept if b < batch]
        return [axis_from_json(a) for a in json.loads(kept[max(earlier)])["axes"]] if earlier else self.empty.axes

    def add(self, rows: DataFrame, batch: int, columns: list, **options) -> None:
        """One batch; what it wrote when it ran before is replaced."""
        spark = rows.sparkSession
        started = Binned(*self._axes_before(spark, batch), accumulator=self.empty.accumulator)
        if any(a.growth for a in started.axes):
            rows = rows.persist()  # read for the axes and for the cells
        self._write(started.fill(rows, *columns, **options), "cells", batch)
        rows.unpersist()
        if self.every and batch % self.every == self.every - 1:
            self._write(self.read(spark, batch + 1), "sums", batch)

    def start(self, stream: DataFrame, *columns: str | Column, **options) -> StreamingQuery:
        """Run over what has arrived (trigger availableNow), from where the last run stopped.  Options are those of Binned.fill."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch, list(columns), **options))
        return writer.option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).start()


class RunningResult:
    """The rows of a streaming aggregation (windows, sessions, keys) as they stand after the last batch, kept in `path`."""

    def __init__(self, path: str):
        self.path = path

    def _keep(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        rows.sparkSession.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{self.path}/last")

    def start(self, result: DataFrame) -> StreamingQuery:
        return result.writeStream.outputMode("complete").foreachBatch(self._keep).option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).start()

    def read(self, spark: SparkSession) -> DataFrame:
        last = spark.read.schema("batch long").json(f"{self.path}/last").first()[0]
        return spark.read.parquet(f"{self.path}/rows/batch={last}")
