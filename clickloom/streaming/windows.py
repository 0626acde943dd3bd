"""Event-time windows, for streams and for the same data in batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.relational import weight_of
from clickloom.plans.ranks import top_n


def with_event_time(df: DataFrame, epoch_seconds: str, delay: str = "0 seconds", name: str = "ts") -> DataFrame:
    """Epoch seconds as event time; rows more than ``delay`` behind the newest are late."""
    return df.withColumn(name, F.timestamp_seconds(epoch_seconds)).withWatermark(name, delay)


def _watermarked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Event time of a stream with its watermark; times without a zone are read in the session's.

    Without a delay the stream already carries its watermark.
    """
    if delay is None:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sliding_score(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    action: str,
    weights: Mapping[str, float],
    size: str = "1 day",
    slide: str = "5 minutes",
    delay: str | None = "0 seconds",
    runs: bool = False,
) -> DataFrame:
    """Weighted score per key in every sliding window that holds one of its rows: (window_end, keys, score).

    In batch, rows are first summed into panes one slide long, and a key's windows of one score in a row form a run that is
    opened into windows where it stands: no window row is shuffled or kept. With ``runs`` the runs themselves come back, (since,
    until, keys, score) with window ends from ``since`` to before ``until``; ``window_top_n`` takes them. A stream uses Spark's
    window; its state is keys x windows, with size / slide windows open per key. With ``runs`` a stream keeps no key as state: its
    rows come at once as (_at, keys, score), beside one row per window that the watermark closes, which has its end in ``_closes``;
    ``closed_windows`` makes the windows of both.
    """
    weight = weight_of(action, weights)
    if df.isStreaming:
        timed = _watermarked(df, ts, delay)
        if runs:
            rows = timed.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_at"), *keys, weight.alias("score"), F.lit(None).cast("timestamp").alias("_closes"))
            ends = timed.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
            nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_at", *keys, "score")]
            return rows.union(ends.select(*nothing, F.col("w.end").alias("_closes")))
        out = timed.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.sum(weight).alias("score"))
        return out.select(F.col("w.end").alias("window_end"), *keys, "score", "w")
    found = _runs(df, ts, keys, weight, size, slide)
    return found if runs else opened(found, slide)


def _runs(df: DataFrame, ts: str, keys: Sequence[str], weight: Column, size: str, slide: str) -> DataFrame:
    """The windows of every key that hold a row, as runs of one score: (since, until, keys, score)."""
    held, step = _lengths(df.sparkSession, size, slide)
    panes = df.groupBy(F.window(ts, slide).alias("_p"), *keys).agg(F.sum(weight).alias("score"))
    # Placed by key, all that follows happens where the key is.
    panes = panes.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    enters = F.struct(F.col("_p.end").alias("_at"), F.col("score").alias("_s"), F.lit(1).alias("_n"))
    leaves = F.struct((F.col("_p.end") + _span(held)).alias("_at"), F.lit(None).cast(panes.schema["score"].dataType).alias("_s"), F.lit(0).alias("_n"))
    turns = panes.select(*keys, F.explode(F.array(enters, leaves)).alias("_t")).groupBy(*keys, "_t._at").agg(F.sum("_t._s").alias("_s"), F.sum("_t._n").alias("_n"))
    by = ", ".join(f"`{k}`" for k in keys)
    # The panes of the newest window, summed anew at every turn: sums of fractions must not drift.
    inside = f"OVER (PARTITION BY {by} ORDER BY _at RANGE BETWEEN INTERVAL {held - step} MICROSECONDS PRECEDING AND CURRENT ROW)"
    until = F.expr(f"lead(_at) OVER (PARTITION BY {by} ORDER BY _at)").alias("until")
    found = turns.select(F.col("_at").alias("since"), until, *keys, F.expr(f"sum(_s) {inside}").alias("score"), F.expr(f"sum(_n) {inside}").alias("_n"))
    return found.where("_n > 0").drop("_n")


def closed_windows(path: str, keys: Sequence[str], size: str = "1 day", slide: str = "5 minutes", runs: bool = False) -> Callable[[DataFrame, int], DataFrame]:
    """The windows that close with a micro-batch of a stream made by ``sliding_score`` with ``runs``, of that ``size`` and ``slide``.

    The rows of every micro-batch are kept under ``path``, each once and not once per window; a batch that comes again replaces its
    own. A window that closes now has all its rows in the batches so far, and only those of its time are read. Rows that come
    when their window has closed are late for it, not for later ones.
    """

    def step(df: DataFrame, batch: int) -> DataFrame:
        spark = df.sparkSession
        held, one = _lengths(spark, size, slide)
        if held != _lengths(spark, size, size)[1]:
            raise ValueError("the size of a window must be a whole number of slides")
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long").parquet(path).where(F.col("batch") <= batch)
        low, high = kept.where((F.col("batch") == batch) & F.col("_closes").isNotNull()).agg(F.min("_closes"), F.max("_closes")).first()
        rows = kept.where(F.col("_at").isNotNull())
        if low is None:
            found = _runs(rows.where(F.lit(False)), "_at", keys, F.col("score"), size, slide)
            return found if runs else opened(found, slide)
        first, last = F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")
        found = _runs(rows.where((F.col("_at") >= first - _span(held)) & (F.col("_at") < last)), "_at", keys, F.col("score"), size, slide)
        found = found.withColumns({"since": F.greatest("since", first), "until": F.least("until", last + _span(one))}).where("since < until")
        return found if runs else opened(found, slide)

    return step


def _lengths(spark: SparkSession, size: str, slide: str) -> tuple[int, int]:
    """Microseconds that a pane stays in windows, a whole number of slides, and those of a slide."""
    r = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {size}) AS a, unix_micros(timestamp_seconds(0) + interval {slide}) AS b").first()
    return r.a // r.b * r.b, r.b


def _span(micros: int) -> Column:
    return F.expr(f"INTERVAL {micros} MICROSECONDS")


def opened(runs: DataFrame, slide: str) -> DataFrame:
    """One row per window of every run: (window_end, the other columns)."""
    ends = F.sequence(F.col("since"), F.col("until") - _span(1), F.expr(f"interval {slide}"))
    return runs.select(F.explode(ends).alias("window_end"), *[c for c in runs.columns if c not in ("since", "until")])


def window_top_n(scored: DataFrame, by: Sequence[str], item: str, score: str, n: int = 3, size: str = "1 day", slide: str = "5 minutes") -> DataFrame:
    """Best ``n`` items per window and key of a batch, or of the closed windows of one micro-batch.

    In append mode all rows of a window leave in the batch in which it closes, so ranking that batch
    ranks whole windows; see ``start_window_top_n``. Runs of ``sliding_score`` (of that ``size`` and ``slide``) are cut wherever a run
    of the same ``by`` begins or ends: between two cuts the order stays, so it is made once, and only the best are opened into windows.
    """
    if "since" not in scored.columns:
        return top_n(scored, ["window_end", *by], [f"-{score}", item], n)
    held, _ = _lengths(scored.sparkSession, size, slide)
    # A run is no longer than a block of time, so it lies in one or two of them; a block has at most size / slide cuts.
    first = scored.withColumn("_b0", F.window("since", f"{held} microseconds").start)
    both = first.withColumn("_last", F.col("until") - _span(1)).withColumn("_b1", F.window("_last", f"{held} microseconds").start)
    rows = both.withColumn("_b", F.explode(F.array_distinct(F.array("_b0", "_b1")))).drop("_b0", "_b1", "_last")
    rows = rows.withColumns({"since": F.greatest("since", "_b"), "until": F.least("until", F.col("_b") + _span(held))})
    cuts = rows.select(*by, "_b", F.explode(F.array("since", "until")).alias("_c")).distinct()
    cuts = cuts.groupBy(*by, "_b").agg(F.sort_array(F.collect_list("_c")).alias("_cuts"))
    cuts = cuts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_cb"), "_cuts")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_b") == F.col("_cb")]
    inner = F.filter("_cuts", lambda c: (c >= F.col("since")) & (c <= F.col("until")))
    pieces = rows.join(cuts, same).withColumn("_cuts", inner).drop("_cb", *[f"_by{i}" for i in range(len(by))])
    ends = F.arrays_zip(F.slice("_cuts", 1, F.size("_cuts") - 1).alias("since"), F.slice("_cuts", 2, F.size("_cuts") - 1).alias("until"))
    pieces = pieces.select(F.inline(ends).alias("since", "until"), *by, item, score)
    return opened(top_n(pieces, [*by, "since"], [f"-{score}", item], n), slide)


def tumbling_mean(df: DataFrame, ts: str, key: str, value: str, size: str = "15 minutes", delay: str | None = "0 seconds") -> DataFrame:
    rows = _watermarked(df, ts, delay) if df.isStreaming else df
    out = rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.avg(value).alias("mean"), F.count(value).alias("cnt"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "mean", "cnt")


def running_counts(df: DataFrame, word: str) -> DataFrame:
    """Counts so far, most frequent first; a stream runs this in complete mode."""
    return df.groupBy(word).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), word)
