"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at several points (virtual nodes); a key belongs to the first one clockwise from its own point. A
shard takes its own keys up to its bound; the rest walks on clockwise to virtual nodes of shards that still have room. The room
of a shard is dealt evenly to its virtual nodes, which makes the walk a matter of two running sums over the ring: the n-th key
that walks takes the n-th free place. No step depends on how many keys a shard or a point has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.plans.scans import OrderedRows, running_sum
from clickloom.plans.stage import written

CELL_BITS = 16
POINT_BITS = 60
NODES = 128
COPIES = 1_000
STEPS = 4_096


def point(name: Column) -> Column:
    """A place on the ring, 60 bits."""
    return F.conv(F.substring(F.md5(name), 1, POINT_BITS // 4), 16, 10).cast("long")


def cell(place: Column) -> Column:
    """The part of the ring a place lies in, 0 to 2^16 - 1."""
    return F.shiftright(place, POINT_BITS - CELL_BITS).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """(node, at, shard), numbered clockwise; of two that fall into one cell the one of the smaller shard stays. At most shards x nodes rows."""
    all_nodes = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("i"))
    spots = all_nodes.groupBy(cell(point(F.concat_ws(":", F.lit("node"), "shard", "i"))).alias("at")).agg(F.min("shard").alias("shard"))
    return spots.withColumn("node", F.row_number().over(Window.orderBy("at")) - 1)


def owners(nodes: DataFrame) -> DataFrame:
    """(cell, turned, node, home): the next virtual node of each of the 2^16 cells; ``turned`` counts cells from behind the last node."""
    ring = nodes.sparkSession.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"))
    marked = ring.join(nodes, ring["cell"] == nodes["at"], "left")
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.when(F.col("node").isNotNull(), F.struct("node", "shard"))
    found = marked.select(
        "cell",
        F.coalesce(F.last(here, ignorenulls=True).over(ahead), F.first(here, ignorenulls=True).over(whole)).alias("n"),
        F.max("at").over(whole).alias("last"),
    )
    return found.select("cell", F.pmod(F.col("cell") - F.col("last") - 1, F.lit(1 << CELL_BITS)).alias("turned"), F.col("n.node").alias("node"), F.col("n.shard").alias("home"))


def _bounds(spark: SparkSession, natural: DataFrame, shards: int, slack: float) -> DataFrame:
    """(shard, own, bound, room) of every shard; without slack the bounds add up to all rows and differ by at most one."""
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(natural, "shard", "left").fillna(0, ["own"])
    all_of_them = Window.partitionBy()
    total = F.sum("own").over(all_of_them)
    rank = F.row_number().over(Window.orderBy(F.desc("own"), "shard"))
    even = F.floor(total / shards) + (rank <= total % shards).cast("long")
    bound = even if slack == 0 else F.ceil(total * (1 + slack) / shards)
    bounded = every.withColumn("bound", bound)
    return bounded.select("shard", F.least("own", "bound").alias("own"), "bound", F.greatest(F.col("bound") - F.col("own"), F.lit(0)).alias("room"))


def _free_places(nodes: DataFrame, bounds: DataFrame, walking: DataFrame) -> DataFrame:
    """(node, shard, first_walk, first_free, n_free, first_slot) per virtual node, in the order of the walk."""
    each = nodes.join(bounds, "shard").join(walking, "node", "left").fillna(0, ["walk"])
    mine = Window.partitionBy("shard")
    nth = F.row_number().over(mine.orderBy("node")) - 1
    per = F.count(F.lit(1)).over(mine)
    each = each.withColumn("places", F.floor(F.col("room") / per) + (nth < F.col("room") % per).cast("long"))
    # Two rounds: in the second one what arrives from behind the first node is known. A node fills as many places as keys reach it.
    rounds = each.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    along = Window.orderBy("lap", "node")
    rounds = rounds.withColumn("d", F.sum(F.col("walk") - F.col("places")).over(along))
    rounds = rounds.withColumn("leaving", F.col("d") - F.least(F.lit(0), F.min("d").over(along)))
    rounds = rounds.withColumn("used", F.least(F.col("places"), F.coalesce(F.lag("leaving").over(along), F.lit(0)) + F.col("walk")))
    used = rounds.where("lap = 1").select("node", "shard", "own", "walk", "used")
    # Start where nobody passes: after the node at which the sum of keys less places is smallest.
    whole = Window.partitionBy()
    used = used.withColumn("level", F.sum(F.col("walk") - F.col("used")).over(Window.orderBy("node")))
    used = used.withColumn("cut", F.max_by("node", F.struct(-F.col("level"), F.col("node"))).over(whole))
    used = used.withColumn("turn", F.pmod(F.col("node") - F.col("cut") - 1, F.count(F.lit(1)).over(whole)))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own_before = Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return used.select(
        "node", "shard", F.coalesce(F.sum("walk").over(before), zero).alias("first_walk"), F.coalesce(F.sum("used").over(before), zero).alias("first_free"),
        F.col("used").alias("n_free"), (F.col("own") + F.coalesce(F.sum("used").over(own_before), zero)).alias("first_slot"),
    )


def place(docs: DataFrame, shards: int, nodes: int = NODES, slack: float = 0.0, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in every shard).

    Size is the UTF-8 bytes of the text and 16 more; a null text counts as empty. A shard holds at most (1 + slack) times its even
    share, rounded up; without slack the shards' counts differ by at most one. The point of a row on the ring follows from its
    id, size and checksum, so rows without an id spread too; rows that agree in all three are counted before anything is
    moved. Changing the number of shards moves the rows of the new shard and about those that walk. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{row_id}`").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    keys = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    keys = keys.withColumn("part", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})")))
    keys = keys.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("part") * COPIES))
    name = F.concat_ws(":", F.lit("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "part")
    keys = written(keys.withColumn("point", point(name)).withColumn("cell", cell(F.col("point"))), "keys")

    stops = written(virtual_nodes(spark, shards, nodes), "nodes")
    homed = keys.join(F.broadcast(written(owners(stops), "owners")), "cell")
    bounds = written(_bounds(spark, homed.groupBy(F.col("home").alias("shard")).agg(F.sum("copies").alias("own")), shards, slack), "bounds")

    # Who stays does not depend on the place in the arc: the low bits of the point decide.
    homed = homed.withColumn("rank", F.col("point").bitwiseAND((1 << (POINT_BITS - CELL_BITS)) - 1))
    ranked = OrderedRows(homed, ["home"], ["rank", "doc_id", "size", "text_crc32", "part"]).add(upto=running_sum(F.col("copies"))).rows()
    single = ranked.withColumn("slot", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)))
    limits = F.broadcast(bounds.select(F.col("shard").alias("home"), "bound"))
    single = written(single.join(limits, "home").select("doc_id", "size", "text_crc32", "home", "slot", "bound", "node", "turned", "point"), "placed")
    stay = single.where("slot < bound").select("doc_id", "size", "text_crc32", F.col("home").alias("shard"), "slot")

    walkers = single.where("slot >= bound")
    places = written(_free_places(stops, bounds, walkers.groupBy("node").agg(F.count(F.lit(1)).alias("walk"))), "places")
    walkers = OrderedRows(walkers, ["node"], ["turned", "point", "doc_id", "size", "text_crc32", "slot"]).add(nth=running_sum(F.lit(1))).rows()
    walkers = walkers.join(F.broadcast(places.select("node", "first_walk")), "node").withColumn("n", F.col("first_walk") + F.col("nth") - 1)
    # A node's places are an interval of the walk; intervals meet keys by steps of it, at most nodes + 2 x STEPS of them.
    width = places.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("n_free") / STEPS))).scalar()
    taken = places.where("n_free > 0").withColumn("width", width)
    taken = taken.withColumn("step", F.explode(F.expr("sequence(first_free div width, (first_free + n_free - 1) div width)")))
    walkers = walkers.withColumn("width", width).withColumn("step", F.expr("n div width")).drop("node", "width")
    inside = (walkers["step"] == taken["step"]) & (F.col("n") >= F.col("first_free")) & (F.col("n") < F.col("first_free") + F.col("n_free"))
    moved = walkers.join(F.broadcast(taken.drop("first_walk")), inside)
    return stay.unionByName(moved.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("n") - F.col("first_free")).alias("slot")))
