"""Stateful streams with the semantics of the batch queue operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.queues import MOVES


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def machine_states(events: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """(key, state, moves) after each trigger: the state machine of the batch operator, kept per key between triggers.
    Events of a trigger are taken in order; a stream must deliver a key's events in order from trigger to trigger."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, moves = state.get if state.exists else ("IDLE", 0)
        for e in pd.concat(list(frames)).sort_values(order)["_e"]:
            to = MOVES.get((now, e), now)
            now, moves = to, moves + (to != now)
        state.update((now, moves))
        yield pd.DataFrame({key: [k[0]], "state": [now], "moves": [moves]})

    rows = events.select(key, *order, F.col(event).alias("_e"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, state string, moves long", "state string, moves long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind, with rows later than ``late`` left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> None:
    """Run a stream over all that is there into a memory table."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
