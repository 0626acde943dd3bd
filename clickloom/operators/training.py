"""Sample selection and training tables for ranking models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import stable_uniform
from clickloom.operators.relational import enrich, history_before, join_labels, weight_of
from clickloom.plans.ranks import numbered, top_n
from clickloom.plans.scans import OrderedRows, last_known, next_known
from clickloom.plans.skew import cut_groups, with_group
from clickloom.session import pair_block


def cap_per_user(df: DataFrame, user: str, cap: int, seed: int, id: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows per user, chosen by a seeded hash of the row's id."""
    drawn = df.withColumn("_u", stable_uniform(seed, *[F.col(c) for c in id]))
    return top_n(drawn, [user], ["_u", *id], cap).drop("_u", "rn")


def skip_above(df: DataFrame, request: Sequence[str], pos: str, clicked: str) -> DataFrame:
    """Clicks, and the unclicked items above the last clicked position; the rest is dropped."""
    last = F.max(F.when(F.col(clicked) == 1, F.col(pos)))
    seen = with_group(df.dropna(subset=list(request)), request, _last=last)
    return seen.where((F.col(clicked) == 1) | (F.col(pos) < F.col("_last"))).drop("_last")


def sample_ratio(df: DataFrame, label: str, pos: int, neg: int, seed: int, id: Sequence[str]) -> DataFrame:
    """All positives and ``neg`` negatives for every ``pos`` positives, chosen by a seeded hash."""
    quota = df.agg(F.floor(F.count_if(F.col(label) == 1) * neg / pos)).scalar()
    negatives = df.where(F.col(label) == 0).withColumn("_u", stable_uniform(seed, *[F.col(c) for c in id]))
    ranked = numbered(negatives, [], ["_u", *id]).withColumn("_q", quota)
    kept = ranked.where(F.col("rn") <= F.col("_q")).select(*df.columns)
    return df.where(F.col(label) == 1).unionByName(kept)


def resolve_conflicts(
    df: DataFrame, user: str, item: str, ts: str, label: str, span: str = "24 hours", tie: Sequence[str] = ()
) -> DataFrame:
    """Drop a negative with a positive of the same (user, item) within ``span`` on either side, or with a
    later negative within ``span``."""
    width = F.expr(f"interval {span}")
    good = F.when(F.col(label) == 1, F.col(ts))
    bad = F.when(F.col(label) == 0, F.col(ts))
    scan = OrderedRows(df, [user, item], [ts, *tie]).add(
        _before=last_known(good), _after=next_known(good), _later=next_known(bad, inclusive=False)
    )
    near = lambda c: F.coalesce(c <= width, F.lit(False))
    drop = (
        near(F.col(ts) - F.col("_before")) | near(F.col("_after") - F.col(ts)) | near(F.col("_later") - F.col(ts))
    )
    return scan.rows().where((F.col(label) == 1) | ~drop).drop("_before", "_after", "_later")


def query_group_sizes(df: DataFrame, query: str, partitions: int) -> DataFrame:
    """Rows per query group, by the partition ``repartition(partitions, query)`` would send it to, in
    sorted order.

    The partition is computed from the key, so groups are counted before anything moves.
    """
    sizes = df.groupBy(query).agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.hash(query), F.lit(partitions)).alias("part")
    return numbered(sizes.select(part, query, "size"), ["part"], [query], "seq")


def pairwise(df: DataFrame, query: str, label: str, features: Sequence[str], id: str) -> DataFrame:
    """Preference pairs inside a query: feature differences of a better and a worse row.

    Each row is compared with the rows of other labels only; large queries are joined block by block. Without large queries both
    sides of the join are the same rows by query, which Spark shuffles once, and sums per query and row need no further shuffle.
    """
    sized = cut_groups(df, [query], pair_block(df.sparkSession))
    if sized is None:
        sides = [df.select(query, F.col(id).alias(i), F.col(label).alias(f"_l{n}"), *[F.col(f).alias(f"_{n}{f}") for f in features]) for n, i in ((1, "better"), (2, "worse"))]
        return _differences(sides[0].join(sides[1], query), query, features)
    own = F.pmod(F.xxhash64(id), F.col("_of")).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.col("_of") - 1))
    good = sized.select(
        query, own.alias("_b1"), spread.alias("_b2"), F.col(id).alias("better"), F.col(label).alias("_l1"),
        *[F.col(f).alias(f"_1{f}") for f in features],
    )
    bad = sized.select(
        query, spread.alias("_b1"), own.alias("_b2"), F.col(id).alias("worse"), F.col(label).alias("_l2"),
        *[F.col(f).alias(f"_2{f}") for f in features],
    )
    return _differences(good.join(bad, [query, "_b1", "_b2"]), query, features)


def _differences(met: DataFrame, query: str, features: Sequence[str]) -> DataFrame:
    return met.where(F.col("_l1") > F.col("_l2")).select(query, "better", "worse", *[(F.col(f"_1{f}") - F.col(f"_2{f}")).alias(f) for f in features])


def pairwise_fit(pairs: DataFrame, features: Sequence[str], iters: int = 20):
    """Linear ranker on preference pairs; each pair also enters reversed, as the negative class."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    flip = F.transform(x, lambda v: -v)
    rows = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), x.alias("x")), F.struct(F.lit(0.0).alias("label"), flip.alias("x"))))
    data = pairs.select(rows.alias("r")).select("r.label", array_to_vector("r.x").alias("features"))
    return LogisticRegression(fitIntercept=False, maxIter=iters, regParam=0.001).fit(data)


def label_weight(df: DataFrame, action: str, weights: Mapping[str, float], name: str = "weight") -> DataFrame:
    return df.withColumn(name, weight_of(action, weights))


def hash_split(
    df: DataFrame, key: Sequence[str], fractions: Mapping[str, float], seed: int, strata: str | None = None
) -> DataFrame:
    """Named part of every row by a seeded hash of its key; with ``strata`` the parts hold their share of
    each stratum exactly (to one row)."""
    drawn = df.withColumn("_u", stable_uniform(seed, *[F.col(c) for c in key]))
    if strata is None:
        place = F.col("_u")
    else:
        drawn = with_group(numbered(drawn, [strata], ["_u", *key], "_rn"), [strata], _n=F.count(F.lit(1)))
        place = (F.col("_rn") - 1) / F.col("_n")
    total, upto, part = sum(fractions.values()), 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name] / total
        part = F.when(place < upto, name) if part is None else part.when(place < upto, name)
    part = F.lit(names[-1]) if part is None else part.otherwise(names[-1])
    return drawn.withColumn("part", part).drop("_u", "_rn", "_n")


def training_table(
    impressions: DataFrame,
    actions: DataFrame,
    on: Sequence[str],
    sides: Sequence[tuple[DataFrame, str]],
    user: str,
    ts: str,
    item: str,
    history: int,
    tie: Sequence[str],
) -> DataFrame:
    """Impressions with client labels, feature tables and the user's items before the impression."""
    labelled = join_labels(impressions, actions, on)
    return history_before(enrich(labelled, *sides), user, ts, item, history, tie)


