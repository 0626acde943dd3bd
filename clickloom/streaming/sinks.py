"""Stream outputs: files, keyed stores, top-n of closed windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.recommend import interest
from clickloom.session import fresh_dir
from clickloom.streaming.windows import closed_windows, window_top_n


def start_sink(
    df: DataFrame, mode: str, fmt: str, path: str | None, checkpoint: str, available_now: bool = True, interval: str | None = None
) -> StreamingQuery:
    """Start a stream into a sink; append for rows, complete for a whole result."""
    writer = df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    if path:
        writer = writer.option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def process_then_commit(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, mode: str = "append"
) -> StreamingQuery:
    """Run ``fn`` on each micro-batch and commit its offsets afterwards (at least once).

    A batch that failed comes again with the same number, so ``fn`` should write under that number.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A write that can be repeated: every batch replaces its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def start_window_top_n(
    scored: DataFrame, by: Sequence[str], item: str, score: str, n: int, path: str, checkpoint: str, available_now: bool = True,
    size: str = "1 day", slide: str = "5 minutes",
) -> StreamingQuery:
    """Top ``n`` per window and key, written once the watermark has passed the window's end.

    A stream made by ``sliding_score`` with ``runs`` keeps its rows beside the checkpoint and is ranked as runs of that ``size`` and ``slide``.
    """
    write = by_batch(path)
    closed = closed_windows(f"{checkpoint}-rows", [*by, item], size, slide, runs=True) if "_closes" in scored.columns else lambda df, _batch: df

    def rank(df: DataFrame, batch: int) -> None:
        write(window_top_n(closed(df, batch), by, item, score, n, size, slide), batch)

    return process_then_commit(scored, rank, checkpoint, available_now)


class KeyedStore:
    """A keyed table for dashboards: every micro-batch adds its rows as a partition, readers take each key's newest values.

    Nothing is rewritten and nothing is kept in the driver: a batch that was committed before is left alone, one that broke
    off is written again, and any session can read the folder.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def read(self) -> DataFrame | None:
        """One row per key, each field as the newest batch that has a value for it says."""
        if not self._exists(self.path):
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        fields = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in fields]
        return rows.groupBy(*self.keys).agg(*newest)

    def write(self, df: DataFrame, batch: int, expires_at: Column) -> None:
        target = f"{self.path}/batch={batch}"
        if not self._exists(f"{target}/_SUCCESS"):
            df.withColumn("expires_at", expires_at).write.mode("overwrite").parquet(target)


def run_to_table(
    df: DataFrame, mode: str, purpose: str, fn: Callable[[DataFrame, int], None] | None = None, step: Callable[[DataFrame, int], DataFrame] | None = None
) -> str:
    """Drain a finite stream into a new folder of the shared directory and return its path.

    ``step`` makes the rows to write of each micro-batch, which then has a folder of its own (column ``batch``).
    """
    spark = df.sparkSession
    out, state = fresh_dir(spark, purpose), fresh_dir(spark, f"{purpose}-state")
    if step is not None:
        write = by_batch(out)
        fn = lambda b, i: write(step(b, i), i)
    if fn is None and mode == "append":
        q = start_sink(df, mode, "parquet", out, state)
    else:
        q = process_then_commit(df, fn or (lambda b, _i: b.write.mode("overwrite").parquet(out)), state, True, mode)
    q.awaitTermination()
    return out


def live_interest(
    stream: DataFrame,
    user: str,
    tag: str,
    action: str,
    ts: str,
    weights: Mapping[str, float],
    half_life: float,
    as_of: Column,
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Weighted, decayed interest of each micro-batch as of one time; batches add up, because the decay
    of a sum is the sum of the decays."""
    write = by_batch(path)

    def step(df: DataFrame, batch: int) -> None:
        clean = df.where(F.col(user).isNotNull() & F.col(tag).isNotNull())
        write(interest(clean, user, tag, action, ts, weights, half_life, as_of), batch)

    return process_then_commit(stream, step, checkpoint, True)
