"""One key holds a third of all rows: results against brute force, and work that is really spread."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from clickloom.operators import recommend, sequences
from clickloom.plans.ranks import exact_quantiles, numbered
from clickloom.plans.scans import OrderedRows, following_row, last_known, next_known, previous_row, running_sum
from clickloom.plans.skew import hot_keys, salted_join, with_group, within_group_pairs
from clickloom.streaming.chunks import flush_chunks


@pytest.fixture
def skewed(spark):
    """900 rows over 40 keys, a third of them under key 0; times with ties."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).alias("k"),
        F.floor(F.col("id") * 7 % 450).alias("t"),
        "id",
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"),
    )


def brute(rows, fn):
    groups = defaultdict(list)
    for r in rows:
        groups[r.k].append(r)
    out = {}
    for g in groups.values():
        out.update(fn(sorted(g, key=lambda r: (r.t, r.id))))
    return out


def test_scans_agree_with_brute_force(tiny_limits, skewed):
    scan = OrderedRows(skewed, ["k"], ["t", "id"])
    assert scan.split
    ranges = scan.df.where("k = 0").groupBy("_part").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 300
    got = scan.add(
        n=running_sum(F.lit(1)), before=running_sum(F.col("id"), inclusive=False), last=last_known(F.col("v")),
        nxt=next_known(F.col("v"), inclusive=False), prev=previous_row(F.col("v")), follow=following_row(F.col("id")),
    ).rows()

    def expect(g):
        out, total, last = {}, 0, None
        for i, r in enumerate(g):
            last = r.v if r.v is not None else last
            nxt = next((x.v for x in g[i + 1 :] if x.v is not None), None)
            out[r.id] = (i + 1, total, last, nxt, g[i - 1].v if i else None, g[i + 1].id if i + 1 < len(g) else None)
            total += r.id
        return out

    want = brute(skewed.collect(), expect)
    assert {r.id: (r.n, r.before, r.last, r.nxt, r.prev, r.follow) for r in got.collect()} == want


def test_scans_in_descending_and_text_order(tiny_limits, skewed):
    rows = skewed.collect()
    down = numbered(skewed, ["k"], ["-t", "id"])
    groups = defaultdict(list)
    for r in rows:
        groups[r.k].append(r)
    want = {r.id: n for g in groups.values() for n, r in enumerate(sorted(g, key=lambda r: (-r.t, r.id)), 1)}
    assert {r.id: r.rn for r in down.collect()} == want
    text = numbered(skewed.withColumn("s", F.concat(F.lit("é"), F.col("t").cast("string"))), ["k"], ["s", "id"])
    want = {r.id: n for g in groups.values() for n, r in enumerate(sorted(g, key=lambda r: (str(r.t).encode(), r.id)), 1)}
    assert {r.id: r.rn for r in text.collect()} == want


def test_global_order_is_cut_too(tiny_limits, skewed):
    got = numbered(skewed, [], ["t", "id"])
    want = {r.id: n for n, r in enumerate(sorted(skewed.collect(), key=lambda r: (r.t, r.id)), 1)}
    assert {r.id: r.rn for r in got.collect()} == want


def test_hot_keys_are_salted(tiny_limits, skewed):
    blocks = {r.k: r._blocks for r in hot_keys(skewed, ["k"]).collect()}
    assert blocks[0] == 43
    side = skewed.groupBy("k").agg(F.max("id").alias("top"))
    got = salted_join(skewed, side, ["k"])
    top = {r.k: r.top for r in side.collect()}
    assert sorted((r.id, r.top) for r in got.collect()) == sorted((r.id, top[r.k]) for r in skewed.collect())
    left = salted_join(skewed, side.where("k != 0"), ["k"], "left").where("k = 0")
    assert left.count() == 300 and left.where("top is not null").count() == 0
    stats = with_group(skewed, ["k"], n=F.count(F.lit(1)))
    assert {r.k: r.n for r in stats.collect()}[0] == 300


def test_pairs_in_blocks_are_complete_and_single(tiny_limits, skewed):
    members = skewed.select("k", "t").distinct().withColumn("c", F.col("t") + 1)
    got = Counter((r.k, r.a, r.b, r.c_a, r.c_b) for r in within_group_pairs(members, ["k"], "t", ["c"]).collect())
    groups = defaultdict(set)
    for r in members.collect():
        groups[r.k].add(r.t)
    want = Counter((k, a, b, a + 1, b + 1) for k, g in groups.items() for a, b in combinations(sorted(g), 2))
    assert got == want


@pytest.mark.parametrize("limits", ["tiny", "plain"])
def test_swing_agrees_with_the_formula(spark, request, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    rows = [(u, i) for u in range(30) for i in range(12) if (u * 7 + i * 5) % 4 == 0 or i == 0 or u == 3]
    rows += [(u, i) for u in (50, 51, 52) for i in (1, 2)]  # equal item sets
    df = spark.createDataFrame(rows + rows[:20], "u long, i long")
    items, users = defaultdict(set), defaultdict(set)
    for u, i in rows:
        items[u].add(i)
        users[i].add(u)
    for self_users in (True, False):
        got = {(r.base_id, r.rec_id): r.similarity for r in recommend.swing(df, "u", "i", 0.5, 100, self_users).collect()}
        want = {}
        for i in users:
            for j in users:
                both = users[i] & users[j]
                s = sum(1 / (0.5 + len(items[u] & items[v])) for u in both for v in both if self_users or u != v)
                if i != j and s > 0:
                    want[i, j] = s
        assert set(got) == set(want)
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_quantiles_of_a_hot_group(tiny_limits, skewed):
    got = {r.k: (r.q1, r.m) for r in exact_quantiles(skewed, ["k"], "t", [0.25, 0.5], ["q1", "m"]).collect()}
    groups = defaultdict(list)
    for r in skewed.collect():
        groups[r.k].append(r.t)

    def q(xs, p):
        xs, pos = sorted(xs), p * (len(xs) - 1)
        lo = int(pos)
        return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (pos - lo)

    assert all(got[k] == pytest.approx((q(g, 0.25), q(g, 0.5))) for k, g in groups.items())


def test_long_conversation_in_blocks(spark):
    rows = spark.range(700).select(
        F.when(F.col("id") < 500, "a").otherwise(F.concat(F.lit("c"), (F.col("id") % 20).cast("string"))).alias("c"),
        F.col("id").alias("t"),
        F.timestamp_seconds(F.col("id") * 600 + F.pmod(F.col("id") * 37, F.lit(11)) * 50).alias("ts"),
    )
    plain = {(r.c, r.t): r.chunk for r in flush_chunks(rows, "c", "t", "ts").collect()}
    cut = {(r.c, r.t): r.chunk for r in flush_chunks(rows, "c", "t", "ts", block_rows=13).collect()}
    assert plain == cut and len(plain) == 700


def test_negative_samples_never_hit_the_context(tiny_limits):
    spark = tiny_limits
    pairs = spark.range(400).select((F.col("id") % 5).alias("centre"), (F.col("id") % 9).alias("context"), "id")
    freq = spark.range(9).select(F.col("id").alias("item"), F.pow(F.lit(2), F.col("id")).alias("cnt"))
    out = sequences.negative_samples(pairs, freq, 3, 1).collect()
    assert len(out) == 1200 and all(r.negative != r.context for r in out)
    drawn = Counter(r.negative for r in out)
    assert drawn[8] > drawn[5] > drawn[2]
    again = sequences.negative_samples(pairs.repartition(7), freq.repartition(3), 3, 1).collect()
    assert sorted(out) == sorted(again)


HOT = {
    "nan": lambda: F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 11).cast("double")),
    "null": lambda: F.when(F.col("id") % 2 == 0, F.lit(None).cast("double")).otherwise((F.col("id") % 11).cast("double")),
    "tied": lambda: F.lit(5.0),
    "prefix": lambda: F.concat(F.lit("one long common beginning "), F.lpad((F.col("id") * 37 % 1000).cast("string"), 4, "0")),
    "zoned": lambda: F.timestamp_seconds(F.col("id") * 7 % 300),
    "plain": lambda: F.timestamp_seconds(F.col("id") * 7 % 300).cast("timestamp_ntz"),
}


@pytest.mark.parametrize("down", ["", "-"])
@pytest.mark.parametrize("kind", list(HOT))
def test_dealt_ranges_agree_with_plain_windows(spark, kind, down):
    """Whatever the values of a hot key (or the null key) look like, its rows spread and the result is that of one window."""
    rows = spark.range(1200).select(F.when(F.col("id") % 5 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 2).alias("k"), HOT[kind]().alias("s"), "id")
    found = []
    for limit in (str(1 << 40), "0"):
        spark.conf.set("spark.clickloom.scanBytes", limit)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        try:
            scan = OrderedRows(rows, ["k"], [f"{down}s", "id"])
            if scan.split:
                sizes = [r["count"] for r in scan.df.where("k = 1").groupBy("_part").count().collect()]
                assert len(sizes) >= 4 and max(sizes) < 300
            ids = F.when(F.col("id") % 9 == 0, F.col("id"))
            out = scan.add(n=running_sum(F.lit(1)), last=last_known(ids, inclusive=False), nxt=next_known(ids), prev=previous_row(F.col("id")), follow=following_row(F.col("id")))
            out = out.add(again=running_sum(F.col("n"), inclusive=False)).rows()
            found.append(sorted((r.id, r.n, r["last"], r.nxt, r.prev, r.follow, r.again) for r in out.drop("s").collect()))
        finally:
            spark.conf.unset("spark.clickloom.scanBytes")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == 1200


def test_dealt_rows_may_be_used_twice(tiny_limits, skewed):
    placed = numbered(skewed, ["k"], ["t", "id"])
    most = with_group(placed, ["k"], most=F.max("rn"))
    assert most.where("rn = most").count() == skewed.select("k").distinct().count()
    assert placed.where("k = 0").join(placed, ["id", "rn"]).count() == 300
    empty = skewed.where("id < 0")
    assert numbered(empty, ["k"], ["t"]).count() == 0 and numbered(empty, [], ["t"]).count() == 0


def test_plans_hand_no_rows_to_the_driver():
    from pathlib import Path

    import clickloom.plans

    assert not [p for p in Path(clickloom.plans.__file__).parent.glob("*.py") if ".collect(" in p.read_text() or ".toPandas(" in p.read_text()]
