"""Counts of a run, observed while its tables are written: what was read, made and found is known without another scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import graph

EVENTS = "seq int, event string, metric string, value long"


class Run:
    """The events of a run, in order; each has metrics, which are aggregates over the rows of one written table."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, dict[str, int]]] = []

    def written(self, df: DataFrame, event: str, **metrics: Column) -> DataFrame:
        """`df`, written as by graph.cut_lineage; `rows` and the metrics are taken in the same pass. A metric over no row counts as 0."""
        watch = Observation(f"{event}-{uuid.uuid4().hex}")
        out = graph.cut_lineage(df.observe(watch, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(name) for name, c in metrics.items())))
        self.seen.append((event, {name: int(value or 0) for name, value in watch.get.items()}))
        return out

    def count(self, event: str, metric: str = "rows") -> int:
        """A metric of the last event of a name."""
        return next(found[metric] for name, found in reversed(self.seen) if name == event)

    def events(self, spark: SparkSession) -> DataFrame:
        """(seq, event, metric, value): a row per metric."""
        rows = [(seq, event, name, value) for seq, (event, found) in enumerate(self.seen) for name, value in found.items()]
        return spark.createDataFrame(rows, EVENTS)
