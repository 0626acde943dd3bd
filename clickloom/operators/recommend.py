"""Candidate lists, item similarity, interest scores, exploration and ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import seconds_of, sigmoid, stable_uniform
from clickloom.operators.relational import enrich, exclude, weight_of
from clickloom.operators.vectors import similar_items
from clickloom.plans.ranks import numbered, top_n
from clickloom.plans.scans import OrderedRows, running_sum
from clickloom.plans.skew import BROADCAST_ROWS, salted_join, within_group_pairs
from clickloom.plans.stage import written
from clickloom.session import pair_block

# Attempts of a rejection sampler that takes over 95 % of them.
ATTEMPTS = 32
# Items in the baskets that meet in one group; columns of a dense matrix.
BASKET_BLOCK = 1_000_000
# Item places in the baskets that one round sends to their items.
ROUND_ITEMS = 500_000_000
ITEM_SPAN = 4_096


def _profiles(clicks: DataFrame, user: str, item: str) -> DataFrame:
    """Users with the same item set collapse into one profile: (profile, mult, size).

    The set is compared by size and two independent 64-bit digests, all of them partial aggregates.
    """
    digest = clicks.groupBy(user).agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64(item)).alias("_d1"),
        F.sum(F.xxhash64(F.lit(17), item).cast("decimal(20,0)")).alias("_d2"),
    )
    return (
        digest.where(F.col("size") > 1)
        .groupBy("size", "_d1", "_d2")
        .agg(F.min(user).alias("profile"), F.count(F.lit(1)).alias("mult"))
        .select("profile", "mult", "size")
    )


class _Baskets:
    """Profiles of one block: their multiplicities and their items as positions in a common list."""

    def __init__(self, t: pa.Table, items: np.ndarray):
        lists = t.column("items").combine_chunks()
        self.mult = t.column("mult").to_numpy().astype(np.float64)
        self.rows = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        self.columns = np.searchsorted(items, lists.flatten().to_numpy(zero_copy_only=False))

    def dense(self, start: int, stop: int) -> np.ndarray:
        """The 0/1 matrix of profiles and the items from ``start`` to ``stop``."""
        out = np.zeros((len(self.mult), stop - start))
        here = (self.columns >= start) & (self.columns < stop)
        out[self.rows[here], self.columns[here] - start] = 1.0
        return out


def _partial_swing(alpha: float, self_users: bool, top_k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the profiles of an item add to its similarity with every other item: sums over pairs of profiles of one or two blocks.

    An item of one block has its whole sums here and hands back only its ``top_k`` best and their equals, rounded as they are ranked.
    """

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("i").type if left.num_rows else right.schema.field("i").type
        same = left.num_rows > 0 and left.column("a")[0] == left.column("b")[0]
        right = left if same else right
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names=["i", "j", "s"])
        flat = [t.column("items").combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in (left, right)]
        items = np.unique(np.concatenate(flat))
        x = _Baskets(left, items)
        y = x if same else _Baskets(right, items)
        spans = [(c, min(c + ITEM_SPAN, len(items))) for c in range(0, len(items), ITEM_SPAN)]
        common = sum(x.dense(*c) @ y.dense(*c).T for c in spans)
        pairs = x.mult[:, None] * y.mult[None, :] * (1.0 if same else 2.0)
        if same and not self_users:
            np.fill_diagonal(pairs, x.mult * (x.mult - 1))
        weight = pairs / (alpha + common)
        # Both profiles of a pair have the item itself, so what counts for j are the pairs in which both have j.
        sums = np.concatenate([(x.dense(*c) * (weight @ y.dense(*c))).sum(axis=0) for c in spans])
        keep = (np.arange(len(items)) != np.searchsorted(items, left.column("i")[0].as_py())) & (sums > 0)
        if left.column("of")[0].as_py() == 1 and keep.sum() > top_k:
            # A margin over the rounding, so that the final ranking sees everything that can be among the best.
            keep &= sums >= np.partition(sums[keep], -top_k)[-top_k] - 2e-9
        return pa.table([pa.array([left.column("i")[0].as_py()] * int(keep.sum()), kind), pa.array(items[keep], kind), pa.array(sums[keep], pa.float64())], names=["i", "j", "s"])

    return add


def swing(
    df: DataFrame, user: str, item: str, alpha: float = 1.0, top_k: int = 30, include_self_users: bool = True
) -> DataFrame:
    """Item similarity ``s(i,j) = sum over user pairs who took both of 1 / (alpha + shared items)``.

    Ordered user pairs, a user paired with itself included unless told otherwise. Only users with two
    items or more can add to a pair of different items, and users with equal item sets count once with
    their number. The profiles of an item meet as 0/1 matrices: one product gives the numbers of shared items, a
    second one the sums for all items j. Pairs of profiles are never rows; an item with many profiles is cut into blocks, every
    pair of blocks is a group of its own, and their partial sums are added up. All others are ranked where they are summed,
    so no more than their best are shuffled. A basket goes to each of its items, so what is sent grows with the squares of their
    sizes: beyond ``ROUND_ITEMS`` places the items are dealt into rounds by a hash, each written before the next, and a round's shuffles go with it.
    """
    clicks = df.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct()
    clicks = written(clicks, "swing-clicks", drop_shuffles=True)
    profiles = _profiles(clicks, user, item)
    held = salted_join(clicks.withColumnRenamed(user, "profile"), profiles, ["profile"])
    baskets = held.groupBy("profile").agg(F.first("mult").alias("mult"), F.collect_list(item).alias("items"))
    baskets = written(baskets, "swing-baskets", drop_shuffles=True)
    # Blocks of an item by the number of its profiles and of the items they hold; most items have one.
    sized = baskets.select(F.explode("items").alias("i"), F.size("items").alias("n")).groupBy("i")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / pair_block(df.sparkSession)), F.ceil(F.sum("n") / BASKET_BLOCK)).cast("int")
    large = written(sized.agg(blocks.alias("of")).where("of > 1"), "swing-blocks", drop_shuffles=True)
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    large = F.broadcast(large) if few else large
    kind = df.schema[item].dataType.simpleString()

    def similar(mine: Column) -> DataFrame:
        members = baskets.select(F.explode(mine).alias("i"), "profile", "mult", "items")
        members = members.join(large, "i", "left").withColumn("of", F.coalesce("of", F.lit(1)))
        members = members.withColumn("own", F.pmod(F.xxhash64("profile"), F.col("of")).cast("int"))
        left = members.select("i", F.col("own").alias("a"), F.explode(F.sequence(F.col("own"), F.col("of") - 1)).alias("b"), "of", "mult", "items")
        right = members.where("own > 0").select("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("a"), F.col("own").alias("b"), "of", "mult", "items")
        right = right.toDF(*right.columns)
        partial = left.groupBy("i", "a", "b").cogroup(right.groupBy("i", "a", "b")).applyInArrow(_partial_swing(alpha, include_self_users, top_k), f"i {kind}, j {kind}, s double")
        score = partial.groupBy("i", "j").agg(F.sum("s").alias("similarity"))
        # Rounded for ranking: the order of a distributed sum must not decide between equal scores.
        ranked = score.withColumn("_r", F.round("similarity", 9))
        out = top_n(ranked, ["i"], ["-_r", "j"], top_k)
        return out.select(F.col("i").alias("base_id"), F.col("j").alias("rec_id"), "similarity", "rn")

    places = baskets.agg(F.sum(F.size("items").cast("double") * F.size("items"))).first()[0] or 0
    rounds = max(1, math.ceil(places / ROUND_ITEMS))
    if rounds == 1:
        return similar(F.col("items"))
    of_round = lambda r: F.filter("items", lambda i: F.pmod(F.xxhash64(F.lit(29), i), F.lit(rounds)) == r)
    done = [written(similar(of_round(r)), "swing-round", drop_shuffles=True) for r in range(rounds)]
    return reduce(DataFrame.unionByName, done)


def cooccurrence(df: DataFrame, basket: str | Sequence[str], item: str) -> DataFrame:
    """In how many baskets two different items occur together; each pair once with ``a < b``."""
    keys = [basket] if isinstance(basket, str) else list(basket)
    members = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    return within_group_pairs(members, keys, item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def als_similar(df: DataFrame, user: str, item: str, rating: str, k: int, rank: int = 16, seed: int = 7) -> DataFrame:
    """Similar items by matrix-factorisation item factors."""
    summed = df.groupBy(user, item).agg(F.sum(rating).cast("float").alias("rating"))
    # The factorisation wants small whole numbers as ids, whatever the ids are.
    users, items = (numbered(summed.select(c).distinct(), [], [c], f"_{c}") for c in (user, item))
    ratings = salted_join(salted_join(summed, users, [user]), items, [item]).select(
        F.col(f"_{user}").cast("int").alias("user"), F.col(f"_{item}").cast("int").alias("item"), "rating"
    )
    model = ALS(
        rank=rank, maxIter=5, regParam=0.1, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="rating", seed=seed
    ).fit(ratings)
    near = similar_items(model.itemFactors.select(F.col("id").cast("long").alias("id"), F.col("features").alias("vec")), k)
    names = items.select(F.col(f"_{item}").alias("id"), F.col(item))
    named = salted_join(near, names.withColumnRenamed(item, "rec_id"), ["id"]).drop("id").withColumnRenamed("query_id", "id")
    return salted_join(named, names.withColumnRenamed(item, "base_id"), ["id"]).select("base_id", "rec_id", "score", "rn")


def interest(
    df: DataFrame, user: str, tag: str, action: str, ts: str, weights: Mapping[str, float], half_life: float, as_of: Column
) -> DataFrame:
    """Tag weight per user: behaviour weight halved every ``half_life`` seconds, up to ``as_of``."""
    age = seconds_of(as_of) - seconds_of(F.col(ts))
    return (
        df.where(F.col(ts) <= as_of)
        .groupBy(user, tag)
        .agg(F.sum(weight_of(action, weights, 0.0) * F.pow(F.lit(0.5), age / half_life)).alias("interest"))
    )


def filter_served(
    cands: DataFrame,
    served: DataFrame,
    user: str,
    item: str,
    last_requests: int | None = None,
    ttl: str | None = None,
    now: Column | None = None,
    request: str = "request_id",
    served_at: str = "served_at",
) -> DataFrame:
    """Candidates without items of the user's last requests, or without items whose hold has not ended."""
    if last_requests is not None:
        requests = served.groupBy(user, request).agg(F.max(served_at).alias("_at"))
        recent = top_n(requests, [user], ["-_at", f"-{request}"], last_requests).select(user, request)
        held = served.join(recent, [user, request], "left_semi")
    else:
        held = served.where(F.col(served_at) > now - F.expr(f"interval {ttl}"))
    return exclude(cands, held, [user, item])


def _list_of(popular: DataFrame, n: int) -> Column:
    """The ``n`` most popular (item, cnt) rows as one array value."""
    first = popular.orderBy(F.col("cnt").desc(), "item").limit(n)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "item")))
    return first.agg(ranked.alias("_l")).scalar()


def fill_cold_users(recs: DataFrame, users: DataFrame, popular: DataFrame, user: str, n: int) -> DataFrame:
    """Recommendations (user, item, rn), with the ``n`` popular items for users who have none."""
    cold = users.select(user).distinct().join(recs.select(user).distinct(), user, "left_anti")
    filled = cold.withColumn("_l", _list_of(popular, n)).select(user, F.posexplode("_l").alias("_p", "_i"))
    filled = filled.select(user, F.col("_i.item").alias("item"), (F.col("_p") + 1).cast("long").alias("rn"), F.lit(1).alias("fallback"))
    return recs.select(user, "item", "rn", F.lit(0).alias("fallback")).unionByName(filled)


def group_popular(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Top ``n`` items per group; groups with fewer are filled from the overall list."""
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("cnt"))
    own = top_n(counts.withColumnRenamed(item, "item"), [group], ["-cnt", "item"], n)
    own = own.select(group, "item", F.lit(0).alias("level"), F.col("rn").alias("place"))
    overall = df.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    # n own items can hide at most n of the overall list, so 2 n overall items always suffice.
    every = df.select(group).distinct().withColumn("_l", _list_of(overall, 2 * n))
    filler = every.select(group, F.posexplode("_l").alias("_p", "_i")).select(
        group, F.col("_i.item").alias("item"), F.lit(1).alias("level"), (F.col("_p") + 1).cast("long").alias("place")
    )
    best = own.unionByName(filler).groupBy(group, "item").agg(F.min(F.struct("level", "place")).alias("_b"))
    return top_n(best.select(group, "item", "_b.*"), [group], ["level", "place"], n).drop("place")


def weighted_shuffle(
    df: DataFrame, by: Sequence[str], score: str, id: Sequence[str], seed: int, n: int | None = None
) -> DataFrame:
    """Random order in which a row comes first with a chance proportional to its score."""
    draw = -F.log(stable_uniform(seed, *[F.col(c) for c in (*by, *id)])) / F.col(score)
    keyed = df.where(F.col(score) > 0).withColumn("_draw", F.round(draw, 12))
    out = numbered(keyed, by, ["_draw", *id], "pos") if n is None else top_n(keyed, by, ["_draw", *id], n, "pos")
    return out.drop("_draw")


def beta_posterior(
    df: DataFrame, keys: Sequence[str], success: str, prior: tuple[float, float] = (1, 1)
) -> DataFrame:
    """Beta parameters and mean per key from 0/1 outcomes and a prior."""
    a, b = prior
    hits, total = F.sum(F.col(success)), F.count(success)
    out = df.groupBy(*keys).agg((hits + F.lit(float(a))).alias("alpha"), (total - hits + F.lit(float(b))).alias("beta"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def gamma_draw(shape: Column, seed: str, *keys: Column) -> Column:
    """One draw from the gamma distribution of this shape; it depends on the values and the seed only.

    Rejection from a squeezed normal: with d = shape - 1/3 and v = (1 + x / sqrt(9 d))^3 the value d v is taken if
    ln u < x^2 / 2 + d - d v + d ln v, which holds in over 95 % of the attempts; further attempts are only computed after a
    rejection, ``ATTEMPTS`` at most. Shapes below 1 are drawn one higher and scaled back. Uniforms are hashes, so SQL can repeat
    them and no row keeps a generator.
    """
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3
    uniform = lambda i, use: stable_uniform(seed, *keys, F.concat(i.cast("string"), F.lit(use)))
    # A list of one element gives its value a name inside the expression, so hashes are computed once.
    named = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def attempt(i: Column) -> Column:
        def judge(s: Column) -> Column:
            accepted = (s["t"] > 0) & (F.log(s["u"]) < s["x"] * s["x"] / 2 + d - d * s["t"] * s["t"] * s["t"] + 3 * d * F.log(s["t"]))
            return F.when(accepted, d * s["t"] * s["t"] * s["t"])

        x = F.sqrt(-2 * F.log(uniform(i, "a"))) * F.cos(2 * math.pi * uniform(i, "b"))
        placed = named(x, lambda x: F.struct(x.alias("x"), (1 + x / F.sqrt(9 * d)).alias("t"), uniform(i, "c").alias("u")))
        return named(placed, judge)

    tries = F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))
    drawn = F.aggregate(tries, F.lit(None).cast("double"), lambda found, i: F.when(found.isNotNull(), found).otherwise(attempt(i)))
    small = F.pow(stable_uniform(seed, *keys, F.lit("d")), 1 / shape)
    return F.when(shape < 1, drawn * small).otherwise(drawn)


def thompson_rank(post: DataFrame, user: str, item: str, n: int = 10, seed: int = 7) -> DataFrame:
    """Top ``n`` items per user by one draw from each posterior; the draw depends on (user, item, seed)."""
    keys = (F.col(user), F.col(item))
    a, b = gamma_draw(F.col("alpha"), f"{seed}x", *keys), gamma_draw(F.col("beta"), f"{seed}y", *keys)
    drawn = post.withColumns({"_a": a, "_b": b}).withColumn("draw", F.round(F.col("_a") / (F.col("_a") + F.col("_b")), 12)).drop("_a", "_b")
    return top_n(drawn, [user], ["-draw", item], n)


def exploration_slot(
    recs: DataFrame, exposures: DataFrame, user: str, item: str, slot: int, seed: int
) -> DataFrame:
    """Put one little-exposed item of the user at place ``slot`` of the list (user, item, rn).

    The chance of an item falls with its exposures; items already in the list are not drawn. Items from
    the slot on move back by one.
    """
    free = exposures.join(recs.select(user, item), [user, item], "left_anti")
    weighted = free.withColumn("_w", 1.0 / (1.0 + F.col("exposures")))
    pick = weighted_shuffle(weighted, [user], "_w", [item], seed, n=1)
    known = pick.join(recs.select(user).distinct(), user, "left_semi")
    moved = recs.join(known.select(user, F.lit(1).alias("_has")), user, "left").select(
        user, item,
        (F.col("rn") + F.when(F.col("_has").isNotNull() & (F.col("rn") >= slot), 1).otherwise(0)).alias("rn"),
        F.lit(0).alias("explored"),
    )
    added = known.select(user, item, F.lit(slot).cast("long").alias("rn"), F.lit(1).alias("explored"))
    return moved.unionByName(added)


def cold_item_vector(
    new: DataFrame, items: DataFrame, vectors: DataFrame, on: Sequence[str], id: str, price: str, n: int = 3
) -> DataFrame:
    """Mean vector of the ``n`` items nearest in price among those that agree on ``on``.

    The nearest items are the ``n`` neighbours on each side in price order, so a new item is joined with
    2 n positions and not with its whole group. Ties go to the smaller id.
    """
    on = list(on)
    held = items.select(*on, F.col(id).alias("_id"), F.col(price).alias("_price"))
    above = numbered(held, on, ["_price", "_id"], "_pos").withColumn("_side", F.lit(1))
    below = numbered(held, on, ["_price", "-_id"], "_pos").withColumn("_side", F.lit(0))
    marks = new.select(*on, F.col(price).alias("_price"), F.lit(0).alias("_held"), F.col(id).alias("_id"))
    both = marks.unionByName(held.withColumn("_held", F.lit(1)).select(*marks.columns))
    placed = OrderedRows(both, on, ["_price", "_held", "_id"]).add(_less=running_sum(F.col("_held")))
    cuts = placed.rows().where(F.col("_held") == 0).select(
        *on, F.col("_id").alias(id), F.col("_price").alias("_mine"), "_less"
    )
    spots = F.array(
        *[F.struct(F.lit(1).alias("_side"), (F.col("_less") + d).alias("_pos")) for d in range(1, n + 1)],
        *[F.struct(F.lit(0).alias("_side"), (F.col("_less") - d).alias("_pos")) for d in range(n)],
    )
    near = cuts.select("*", F.inline(spots)).join(above.unionByName(below), on + ["_side", "_pos"])
    near = near.withColumn("_gap", F.abs(F.col("_price") - F.col("_mine")))
    best = top_n(near, [id], ["_gap", "_id"], n).select(id, "_id")
    vec = vectors.select(F.col(vectors.columns[0]).alias("_id"), F.col("vector"))
    dims = best.join(vec, "_id").select(id, F.posexplode("vector").alias("dim", "x"))
    mean = dims.groupBy(id, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector")
    )


def favorite_types(df: DataFrame, user: str, type: str, min_count: int = 3, n: int = 3) -> DataFrame:
    """The user's most frequent types with at least ``min_count`` events, as ``type:count`` text."""
    counts = df.groupBy(user, type).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)
    best = top_n(counts, [user], ["-cnt", type], n)
    cell = F.concat_ws(":", F.col(type), F.col("cnt").cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("rn", cell.alias("cell"))))
    return best.groupBy(user).agg(F.array_join(F.transform(ordered, lambda c: c["cell"]), ",").alias("types"))


def fm_score(features: Sequence[Column], intercept: float, linear: Sequence[float], factors: Sequence[Sequence[float]]) -> Column:
    """Raw factorisation-machine score as one arithmetic expression over the feature columns."""
    raw = F.lit(float(intercept))
    for x, w in zip(features, linear, strict=True):
        raw = raw + x * F.lit(float(w))
    for f in range(len(factors[0])):
        terms = [x * F.lit(float(row[f])) for x, row in zip(features, factors, strict=True)]
        total, squares = F.lit(0.0), F.lit(0.0)
        for t in terms:
            total, squares = total + t, squares + t * t
        raw = raw + (total * total - squares) * 0.5
    return raw


def fm_fit(df: DataFrame, features: Sequence[str], label: str, factors: int = 8, seed: int = 7, iters: int = 20):
    """Factorisation-machine classifier with log loss."""
    data = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*[F.col(c).cast("double") for c in features])).alias("features"))
    return FMClassifier(factorSize=factors, maxIter=iters, stepSize=0.05, seed=seed).fit(data)


def fm_apply(df: DataFrame, features: Sequence[str], model) -> DataFrame:
    """Score rows with a fitted model's parameters as a plain column expression."""
    raw = fm_score(
        [F.col(c).cast("double") for c in features],
        model.intercept,
        model.linear.toArray().tolist(),
        model.factors.toArray().tolist(),
    )
    return df.withColumn("raw", raw).withColumn("prob", sigmoid(F.col("raw")))


def rank_batch(
    cands: DataFrame, sides: Sequence[tuple[DataFrame, str]], user: str, item: str, score: Column, n: int
) -> DataFrame:
    """Join features, score, and keep the ``n`` best candidates per user."""
    scored = enrich(cands, *sides).withColumn("score", score)
    ranked = scored.withColumn("_r", F.round("score", 9))
    return top_n(ranked, [user], ["-_r", item], n).drop("_r")


def linear_contributions(df: DataFrame, id: str, coef: Mapping[str, float]) -> DataFrame:
    """Per row and feature ``coef * (x - mean)``: how far the feature moves a linear score."""
    means = df.agg(*[F.avg(c).alias(c) for c in coef])
    shifted = df.withColumns({f"_m_{c}": means.select(c).scalar() for c in coef})
    cells = [
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.col(f"_m_{c}"))).alias("contribution"))
        for c, w in coef.items()
    ]
    return shifted.select(id, F.inline(F.array(*cells)))
