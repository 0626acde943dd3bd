"""Filters, joins, rankings and set operations on behaviour tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.ranks import numbered, top_n
from clickloom.plans.scans import OrderedRows, last_known, previous_row
from clickloom.plans.skew import salted_join

ITEMS_PER_ROW = 100_000


# ---- filters ---------------------------------------------------------------------------------------


def byte_length_between(df: DataFrame, col: str, lo_excl: int, hi_incl: int) -> DataFrame:
    """Rows whose text has more than ``lo_excl`` and at most ``hi_incl`` UTF-8 bytes."""
    size = F.octet_length(col)
    return df.where((size > lo_excl) & (size <= hi_incl))


def threshold_filter(
    df: DataFrame,
    score: str,
    min_score: float,
    rank: str,
    max_rank: int,
    stop_words: Sequence[str] = (),
    word: str | None = None,
) -> DataFrame:
    out = df.where((F.col(score) > min_score) & (F.col(rank) <= max_rank))
    return out.where(~F.col(word).isin(*stop_words)) if stop_words and word else out


def having_all(df: DataFrame, id: str, attr: str, selected: Sequence[str]) -> DataFrame:
    """Ids that carry every selected attribute; no selection selects nothing."""
    wanted = list(dict.fromkeys(selected))
    if not wanted:
        return df.select(id).limit(0)
    hits = df.where(F.col(attr).isin(*wanted)).groupBy(id).agg(F.countDistinct(attr).alias("_n"))
    return hits.where(F.col("_n") == len(wanted)).select(id)


def route(df: DataFrame, text: str, routes: Mapping[str, str], default: str = "general") -> DataFrame:
    """One row per route whose pattern occurs in the text; ``default`` where none does."""
    hits = F.filter(
        F.array(*[F.when(F.col(text).rlike(p), F.lit(r)) for r, p in routes.items()]),
        lambda r: r.isNotNull(),
    )
    found = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))
    return df.withColumn("route", F.explode(found))


# ---- joins -----------------------------------------------------------------------------------------


def join_labels(impressions: DataFrame, actions: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
    """Impressions with the client's label for the same keys; 0 where the client sent none.

    Several actions on one impression count once, with the highest label.
    """
    best = actions.groupBy(*on).agg(F.max(label).alias(label))
    return impressions.join(best, list(on), "left").fillna(0, [label])


def asof_join(
    samples: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    ts: str,
    feature_ts: str,
    strict: bool = True,
) -> DataFrame:
    """Latest feature row before each sample (at the same instant too, unless ``strict``).

    Both inputs go through one ordered scan per key, so there is no range join and a hot key can be
    split. Feature columns are null where nothing came before.
    """
    keys = list(keys)
    value_cols = [c for c in features.columns if c not in (*keys, feature_ts)]
    sample_rows = samples.select(
        *keys, F.col(ts).alias("_t"), F.lit(0 if strict else 1).alias("_kind"),
        F.struct(*samples.columns).alias("_sample"),
    )
    value = F.struct(F.col(feature_ts), *value_cols)
    feature_rows = features.select(
        *keys, F.col(feature_ts).alias("_t"), F.lit(1 if strict else 0).alias("_kind"), value.alias("_feature")
    )
    both = sample_rows.unionByName(feature_rows, allowMissingColumns=True)
    scan = OrderedRows(both, keys, ["_t", "_kind", "_feature"]).add(_last=last_known(F.col("_feature")))
    out = scan.rows().where(F.col("_sample").isNotNull())
    return out.select("_sample.*", *[F.col(f"_last.{c}").alias(c) for c in (feature_ts, *value_cols)])


def enrich(df: DataFrame, *sides: tuple[DataFrame, str | Sequence[str]]) -> DataFrame:
    """Left join feature tables one after the other; Spark broadcasts those measured small."""
    return reduce(lambda acc, s: acc.join(s[0], [s[1]] if isinstance(s[1], str) else list(s[1]), "left"), sides, df)


def exclude(df: DataFrame, served: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates without those already served."""
    return df.join(served.select(*keys).distinct(), list(keys), "left_anti")


def compute_missing(df: DataFrame, content: str, cache: DataFrame, fn, now: Column, ttl: str = "30 days") -> DataFrame:
    """Result per row by content hash; ``fn`` runs once per distinct content absent from the cache.

    ``cache`` holds (hash, result, stored_at); entries older than ``ttl`` do not count, and of several for
    one hash the newest does. ``fn`` maps a (hash, content) DataFrame to (hash, result).
    """
    live = cache.where(F.col("stored_at") > now - F.expr(f"interval {ttl}"))
    live = live.groupBy("hash").agg(F.max_by("result", F.struct("stored_at", "result")).alias("result"))
    hashed = df.withColumn("hash", F.sha2(F.col(content), 256))
    todo = (
        hashed.join(live, "hash", "left_anti").groupBy("hash").agg(F.first(content).alias(content))
    )
    fresh = fn(todo).select("hash", "result", F.lit(False).alias("cached"))
    known = live.withColumn("cached", F.lit(True)).unionByName(fresh)
    return salted_join(hashed, known, ["hash"], "left")


def fuse_profiles(a: DataFrame, b: DataFrame, key: str, authoritative: Mapping[str, str]) -> DataFrame:
    """One profile per key; each field from its authoritative side, the other side as fallback."""
    left = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in authoritative])
    right = b.select(key, *[F.col(f).alias(f"_b_{f}") for f in authoritative])
    fields = [
        (F.coalesce(f"_a_{f}", f"_b_{f}") if side == "a" else F.coalesce(f"_b_{f}", f"_a_{f}")).alias(f)
        for f, side in authoritative.items()
    ]
    return left.join(right, key, "full").select(key, *fields)


# ---- aggregates ------------------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str, by: str | None = None, top: int | None = None) -> DataFrame:
    """How often each value occurs, most frequent first; optionally the top values per group."""
    keys = ([by] if by else []) + [col]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    if top is None:
        return counts
    if by is None:
        return counts.orderBy(F.col("cnt").desc(), col).limit(top)
    return top_n(counts, [by], ["-cnt", col], top)


def weight_of(action: str | Column, weights: Mapping[str, float], default: float = 0) -> Column:
    """Weight of an action; unknown actions get ``default``."""
    col = F.col(action) if isinstance(action, str) else action
    expr = None
    for name, w in weights.items():
        expr = F.when(col == name, F.lit(w)) if expr is None else expr.when(col == name, F.lit(w))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def behavior_score(df: DataFrame, keys: Sequence[str], action: str, weights: Mapping[str, float]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(weight_of(action, weights)).alias("score"))


def distinct_records(df: DataFrame) -> DataFrame:
    """Distinct rows; maps count as equal whatever the order of their entries."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    plain = df.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps}) if maps else df
    out = plain.dropDuplicates()
    return out.withColumns({m: F.map_from_entries(m) for m in maps}) if maps else out


def label_summary(df: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*labels).agg(
        F.count(value).alias("cnt"), F.sum(value).alias("total"), F.max(value).alias("max_value")
    )


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram rows (labels, le, cnt); the last bound is +Inf."""
    counts = df.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("_inf"),
    )
    cells = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_{i}").alias("cnt")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("cnt")))
    return counts.select(*labels, F.inline(F.array(*cells)))


def term_frequency(df: DataFrame, text: str, sep: str = r"\s+") -> DataFrame:
    return (
        df.select(F.explode(F.split(text, sep)).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def collect_sorted(df: DataFrame, keys: Sequence[str], value: str, per_row: int = ITEMS_PER_ROW) -> DataFrame:
    """Sorted distinct values per key as arrays of at most ``per_row``; ``part`` numbers the arrays."""
    unique = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    placed = numbered(unique, keys, [value])
    part = F.floor((F.col("rn") - 1) / per_row).alias("part")
    return placed.groupBy(*keys, part).agg(F.sort_array(F.collect_list(value)).alias("items"))


# ---- windows ---------------------------------------------------------------------------------------


def lag_diff(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Absolute difference to the previous row's value; null on the first row."""
    rows = OrderedRows(df, by, [ts, *tie]).add(_prev=previous_row(F.col(value))).rows()
    return rows.withColumn("diff", F.abs(F.col(value) - F.col("_prev"))).drop("_prev")


def history_before(
    df: DataFrame, user: str, ts: str, item: str, n: int, tie: Sequence[str] = ()
) -> DataFrame:
    """Each row with its user's last ``n`` items strictly before it, oldest first.

    Positions are exact row numbers; ranges of ``stride`` positions (plus the ``n`` rows before each)
    are the window groups, so a user of any size is spread over many of them.
    """
    stride = max(10_000, 10 * n)
    placed = numbered(df, [user], [ts, *tie], "_pos")
    own = F.floor((F.col("_pos") - 1) / stride)
    halo = F.floor((F.col("_pos") - 1 + n) / stride)
    chunks = F.when(own == halo, F.array(own)).otherwise(F.array(own, halo))
    spread = placed.withColumn("_own", own).withColumn("_chunk", F.explode(chunks))
    w = Window.partitionBy(user, "_chunk").orderBy("_pos").rowsBetween(-n, -1)
    out = spread.withColumn("history", F.collect_list(item).over(w))
    return out.where(F.col("_own") == F.col("_chunk")).drop("_pos", "_own", "_chunk")


# ---- sorts and sets --------------------------------------------------------------------------------


def contiguous(df: DataFrame, key: str, partitions: int, order: Sequence[str] = ()) -> DataFrame:
    """Rows of a key next to each other; a key too large for one partition runs on into the next."""
    cols = [F.col(key), *[F.col(c) for c in order]]
    return df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols)


def merge_routes(
    routes: Sequence[tuple[str, DataFrame]], user: str, item: str, score: str, n: int
) -> DataFrame:
    """Union of candidate lists; an item keeps its best route and rank, then top ``n`` per user."""
    ranked = [
        top_n(df.select(user, item, score), [user], [f"-{score}", item], n, "rank").withColumn(
            "route", F.lit(name)
        )
        for name, df in routes
    ]
    merged = reduce(DataFrame.unionByName, ranked)
    best = merged.groupBy(user, item).agg(F.min(F.struct("rank", "route", score)).alias("_b"))
    flat = best.select(user, item, "_b.rank", "_b.route", f"_b.{score}")
    return top_n(flat, [user], ["rank", "route", item], n, "pos")
