"""Access logs, request metrics, table checks and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.numeric import seconds_of
from clickloom.functions.text import last_segment
from clickloom.plans.ranks import exact_quantiles
from clickloom.plans.scans import OrderedRows, running_sum
from clickloom.plans.skew import salted_join, with_group

# The two log layouts.
SERVICE_LINE = (
    r'^(\d{1,3}(?:\.\d{1,3}){3}) .*\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\] '
    r'"(\S+) ([^\s?"]+)[^"]*" (\d+|-) (\d+|-) (\d+)$'
)
PROXY_LINE = r"^([^\s\[\]]+)-\[([^\]]+)\]-(\S+) (\S+)(?: [^\s]+)?-(\d{3})-(\d+(?:\.\d+)?)$"


# Stands between the fields of a matched line; lines that hold it themselves do not fit any pattern.
_MARK = "\x01"


def _fields(df: DataFrame, line: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """The rows with ``_f``, the pattern's groups by name, or null where the line does not fit; one regular expression pass per line."""
    text = F.trim(F.col(line))
    parts = F.split(F.regexp_replace(text, pattern, _MARK.join(f"${i}" for i in range(1, len(names) + 1))), _MARK)
    fits = (F.size(parts) == len(names)) & ~F.contains(text, F.lit(_MARK))
    # A list of one element gives the split line a name, so it is split once for all its fields.
    named = F.transform(F.array(parts), lambda p: F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]))
    return df.withColumn("_f", F.when(fits, F.get(named, 0)))


def parse_service_log(df: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that do not fit): client, time, method, path, status, bytes and response time; ``-`` means null."""
    raw = _fields(df, line, SERVICE_LINE, ["client_ip", "time", "method", "path", "status", "bytes", "ms"])
    good = raw.where(F.col("_f").isNotNull()).select(
        *[c for c in df.columns if c != line],
        "_f.client_ip",
        F.to_timestamp("_f.time", "dd/MMM/yyyy:HH:mm:ss Z").alias("ts"),
        "_f.method",
        "_f.path",
        F.col("_f.status").try_cast("int").alias("status"),
        F.col("_f.bytes").try_cast("long").alias("bytes"),
        F.col("_f.ms").try_cast("int").alias("response_time"),
    )
    return good, raw.where(F.col("_f").isNull()).select(*df.columns)


def parse_proxy_log(df: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that do not fit); the time is turned into milliseconds."""
    raw = _fields(df, line, PROXY_LINE, ["source", "time", "method", "uri", "status", "sec"])
    rest = [c for c in df.columns if c != line]
    good = raw.where(F.col("_f").isNotNull()).select(
        *rest, "_f.source", "_f.method", "_f.status", last_segment(F.col("_f.uri")).alias("path"), (F.col("_f.sec").cast("double") * 1000).alias("ms")
    )
    return good, raw.where(F.col("_f").isNull()).select(*df.columns)


def api_metrics(df: DataFrame, ts: str, path: str, status: str, ms: str, bucket: str = "15 minutes") -> DataFrame:
    """Calls, mean time, error count and share of all calls per bucket and API."""
    cells = df.groupBy(F.window(ts, bucket).alias("w"), path).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"),
        F.count_if(F.col(status) >= 500).alias("errors"),
    )
    cells = cells.select(F.col("w.start").alias("bucket"), path, "calls", "mean_ms", "max_ms", "errors")
    out = with_group(cells.dropna(subset=["bucket"]), ["bucket"], _all=F.sum("calls"))
    return out.withColumn("share", F.col("calls") / F.col("_all")).drop("_all")


def status_mix(df: DataFrame, path: str, status: str) -> DataFrame:
    """Share of each response status per API."""
    cells = df.groupBy(path, status).agg(F.count(F.lit(1)).alias("calls"))
    out = with_group(cells.dropna(subset=[path]), [path], _all=F.sum("calls"))
    return out.withColumn("share", F.col("calls") / F.col("_all")).drop("_all")


def latency_quantiles(df: DataFrame, by: Sequence[str], ms: str) -> DataFrame:
    return exact_quantiles(df, by, ms, [0.5, 0.9, 0.99], ["p50", "p90", "p99"])


def table_check(
    spark: SparkSession, tables: Mapping[str, DataFrame | str], date: str, threshold: int = 10_000, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Row count of one date per table: ok above the threshold, else low; a table that cannot be read or fails while it
    is counted is reported and does not stop the others.

    Every table is one job of its own, run here, and only its count comes back. The date column is ``dt`` for names ending in
    ``_feature`` and ``biz_date`` otherwise, unless given.
    """
    rows = []
    for name, source in tables.items():
        try:
            df = spark.read.parquet(source) if isinstance(source, str) else source
            day = (columns or {}).get(name) or ("dt" if name.endswith("_feature") else "biz_date")
            count = df.where(F.to_date(F.col(day)) == F.to_date(F.lit(date))).count()
            rows.append((name, date, count, "ok" if count > threshold else "low"))
        except (PySparkException, Py4JJavaError) as e:
            reason = e.getCondition() if isinstance(e, PySparkException) else None
            rows.append((name, date, None, f"error: {reason or 'unreadable'}"))
    return spark.createDataFrame(rows, "table_name string, day string, cnt long, status string")


def streak_alerts(
    df: DataFrame, by: Sequence[str], ts: str, value: str, threshold: float = 90, length: int = 300, tie: Sequence[str] = ()
) -> DataFrame:
    """The rows that complete ``length`` samples in a row above the threshold; the count then restarts."""
    breach = F.col(value) > threshold
    calm = (~F.coalesce(breach, F.lit(False))).cast("int")
    scan = OrderedRows(df, by, [ts, *tie]).add(_island=running_sum(calm), _all=running_sum(F.lit(1)))
    # Inside an island the calm row comes first, so the place after it is the streak length.
    hot = scan.rows().where(breach)
    islands = hot.groupBy(*by, "_island").agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("_len"))
    long = salted_join(hot, islands.where(F.col("_len") >= length), [*by, "_island"])
    streak = F.col("_all") - F.col("_first") + 1
    out = long.withColumn("streak", streak.cast("long")).where(F.col("streak") % length == 0)
    return out.drop("_island", "_all", "_first", "_len")


def top_consumer(df: DataFrame, host: str, ts: str, pid: str, cpu: str) -> DataFrame:
    """The process with the highest cpu per host and time; of equals the smallest pid."""
    best = df.groupBy(host, ts).agg(F.min(F.struct((-F.col(cpu)).alias("neg"), F.col(pid).alias("pid"))).alias("_b"))
    return best.select(host, ts, F.col("_b.pid").alias(pid), (-F.col("_b.neg")).alias(cpu))


def request_rate(df: DataFrame, ts: str, bucket: str = "1 second") -> DataFrame:
    """Requests per second in each bucket that has any."""
    w = F.window(ts, bucket)
    out = df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    seconds = seconds_of(F.col("w.end")) - seconds_of(F.col("w.start"))
    return out.select(F.col("w.start").alias("bucket"), "requests", (F.col("requests") / seconds).alias("qps"))
