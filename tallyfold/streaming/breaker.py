"""The breaker over a stream of events, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tallyfold.operators.health import EMPTIES, Breaker

OUTPUT = "source bigint, event_id bigint, ts timestamp, outcome string"
STATE = "failed int, empty int, until double"


def breaker_stream(events: DataFrame) -> DataFrame:
    """breaker() of a stream (source, event_id, ts, kind): what a source went through is kept as state between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, empty, until = state.get if state.exists else (0, 0, None)
        own = Breaker(empties=EMPTIES.get(key[0], 5), state=(failed, empty, until))
        group = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        group = group.assign(outcome=[own.see(t.timestamp(), k) for t, k in zip(group.ts, group.kind, strict=True)])
        state.update(own.state)
        yield group[["source", "event_id", "ts", "outcome"]]

    return events.groupBy("source").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def ingest_stream(arrivals: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """The table at path is what fold makes of all arrivals so far (with a run_id), as if they had come at once.

    Arrivals are kept beside it, at path + "-arrivals", a folder a batch; a batch that is tried again writes its folder again.
    Only the runs that a batch touches are read and folded anew, from all their arrivals; the partitions of others stay.
    """
    landed = f"{path}-arrivals"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{landed}/arrived={batch_id}"
        batch.write.mode("overwrite").partitionBy("run_id").parquet(own)
        touched = spark.read.schema(batch.schema).parquet(own).select("run_id").distinct()
        every = spark.read.schema(StructType([*batch.schema, StructField("arrived", LongType())])).parquet(landed).drop("arrived")
        again = every.join(touched, every.run_id.eqNullSafe(touched.run_id), "left_semi").select(batch.columns)
        fold(again).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
