"""Keyed list state with event-time timers: rows of a window are kept until its end has passed, then ranked and forgotten."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class WindowRows(StatefulProcessor):
    """Per (window, lane): a list of scored rows, packed as the batches they come in, and one timer at the window's end."""

    def __init__(self, columns: Sequence[str], by: Sequence[str], item: str, score: str, n: int):
        self.columns, self.by, self.item, self.score, self.n = list(columns), list(by), item, score, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "batch binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.rows.appendValue((_packed(part[self.columns]),))
        # A timer of the same time is the same timer, however often it is set.
        self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = pd.concat([pa.ipc.open_stream(batch).read_pandas() for (batch,) in self.rows.get()], ignore_index=True)
        self.rows.clear()
        held = held.sort_values([*self.by, self.score, self.item], ascending=[True] * len(self.by) + [False, True], ignore_index=True)
        held["rn"] = held.groupby(self.by, dropna=False).cumcount() + 1
        held.insert(0, "window_end", key[0])
        yield held[held["rn"] <= self.n]

    def close(self) -> None:
        pass


def timed_top_n(scored: DataFrame, by: Sequence[str], item: str, score: str, n: int = 3, lanes: int = 4) -> DataFrame:
    """Best ``n`` items per window and key of a stream of window scores: (window_end, *by, item, score, rn), when the window's end has passed.

    ``scored`` comes from ``windows.sliding_score`` in append mode and still has its window column ``w``. The rows of a
    window are spread over ``lanes`` groups by a hash of ``by``, so no task keeps a whole window. Ties go to the smaller item. Rows that
    come after their window's timer are late and already dropped by the watermark. State is empty once all windows have ended.
    """
    columns = [*by, item, score]
    timed = scored.select("window_end", *columns, F.window_time("w").alias("_at")).withColumn("_lane", F.pmod(F.xxhash64(*by), F.lit(lanes)).cast("int"))
    out = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in columns)
    return timed.groupBy("window_end", "_lane").transformWithStateInPandas(
        WindowRows(columns, by, item, score, n), outputStructType=f"window_end timestamp, {out}, rn long", outputMode="Append", timeMode="EventTime"
    )


def start_timed(ranked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the stream into files. List state needs the RocksDB store; the session's own choice stands again afterwards."""
    conf = ranked.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return ranked.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
