"""Hard negatives by a cover tree: for an anchor and each of its positives the best rows of other labels inside a score window.

Candidates get one more component that brings all vectors of a shard to one norm, so inner products follow from distances. A
node of the tree covers its rows within a radius; the children of a node are a net whose points lie farther apart than the
radius of their level. The radius bounds the inner product of a query with all rows below from both sides. Nodes that lie outside a
window are skipped, the others are opened best bound first until no bound reaches the k-th score, and rows are judged by their
exact products. Trees are built once, where a shard is packed, and stored with it.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.segment_search import products
from clickloom.plans.skew import with_blocks
from clickloom.plans.stage import written

SHARD_ROWS = 4_096
BLOCK_ROWS = 512
LANE_BLOCKS = 16
LEAF = 64
BASE = 1.5
SHARD = "dim int, pure boolean, family string, n long, vectors binary, ids binary, labels binary, centers binary, radii binary, first binary, count binary, start binary, stop binary"
BLOCK = "dim int, pure boolean, family string, block int, n long, vectors binary, ids binary, labels binary, rows binary, windows binary, lows binary, highs binary, positives binary"
FOUND = "anchor_id long, anchor_row long, positive_id long, vec_id long, score long"


class Tree(NamedTuple):
    """Nodes level by level: centre (a row), covering radius, where the children begin and how many, and the rows of a leaf."""

    centers: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    count: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with one more component that gives all the largest norm, and that norm."""
    length = np.linalg.norm(vectors, axis=1)
    norm = float(length.max(initial=0.0))
    return np.hstack([vectors, np.sqrt(np.maximum(0, norm * norm - length * length))[:, None]]), norm


def build(points: np.ndarray, leaf: int = LEAF, base: float = BASE) -> tuple[Tree, np.ndarray]:
    """The tree over the rows of ``points`` and the order in which its leaves list the rows."""
    centers, members = [0], [np.arange(len(points))]
    radii, first, count, start, stop, order = [], [], [], [], [], []
    i = 0
    while i < len(centers):
        rows = members[i]
        far = np.linalg.norm(points[rows] - points[centers[i]], axis=1)
        radius = float(far.max(initial=0.0))
        members[i] = rows[:0]
        radii.append(radius)
        first.append(len(centers))
        if len(rows) > leaf and 0 < radius < math.inf:
            # The centre stays a centre one level down; then each row that none of the net covers joins it.
            near = far <= radius / base
            centers.append(centers[i])
            members.append(rows[near])
            left = rows[~near]
            while len(left):
                near = np.linalg.norm(points[left] - points[left[0]], axis=1) <= radius / base
                near[0] = True
                centers.append(int(left[0]))
                members.append(left[near])
                left = left[~near]
            rows = rows[:0]
        count.append(len(centers) - first[-1])
        start.append(sum(map(len, order[-1:])) + (start[-1] if start else 0))
        order.append(rows)
        stop.append(start[-1] + len(rows))
        i += 1
    arrays = [np.array(x, t) for x, t in ((centers, np.int64), (radii, np.float64), (first, np.int64), (count, np.int64), (start, np.int64), (stop, np.int64))]
    return Tree(*arrays), np.concatenate(order)


class Shard:
    """The candidates of one shard in leaf order, with their tree."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, tree: Tree):
        self.vectors, self.ids, self.labels, self.tree = vectors, ids, labels, tree
        self.norm = float(np.sqrt((vectors**2).sum(axis=1).max(initial=0.0)))

    def bounds(self, q: np.ndarray, length: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of ``q`` with any row below each node."""
        tree, norm = self.tree, self.norm
        at, r = self.vectors[tree.centers[nodes]] @ q, tree.radii[nodes]
        low, high = at - length * r, at + length * r
        if norm > 0 and length > 0:
            # On the sphere of radius norm the query lies this far from the centres; rows lie at most r nearer or farther.
            far = np.sqrt(np.maximum(0, 2 * norm * norm - 2 * at * (norm / length)))
            per = length / norm
            high = np.fmin(high, per * (norm * norm - np.maximum(0, far - r) ** 2 / 2))
            low = np.fmax(low, per * (norm * norm - (far + r) ** 2 / 2))
        slack = 1e-9 * (length * norm + 1)
        return low - slack, high + slack

    def best(self, q: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and exact scores of the k best allowed rows inside each window, ties to the smaller id."""
        length = float(np.sqrt((q**2).sum()))
        tree, opened = self.tree, {}

        def children(node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if node not in opened:
                nodes = np.arange(tree.first[node], tree.first[node] + tree.count[node])
                opened[node] = (nodes, *self.bounds(q, length, nodes))
            return opened[node]

        def search(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            heap = [(-math.inf, 0)]
            while heap:
                worth, node = heapq.heappop(heap)
                floor = scores[-1] if len(scores) == k else -math.inf
                if -worth < floor:
                    break
                if tree.count[node]:
                    nodes, least, most = children(node)
                    most = np.minimum(most, high)
                    # "Not outside" instead of "inside": bounds that overflowed rule nothing out.
                    open_ = ~((most < low) | (least > high) | (most < floor))
                    inner = open_ & (tree.count[nodes] > 0)
                    for n, m in zip(nodes[inner].tolist(), most[inner].tolist(), strict=True):
                        heapq.heappush(heap, (-m if m == m else -math.inf, n))
                    leaves = nodes[open_ & ~inner]
                else:
                    leaves = np.array([node])
                sizes = tree.stop[leaves] - tree.start[leaves]
                rows = np.repeat(tree.start[leaves] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(leaves) else sizes
                rows = rows[allowed[rows]]
                if not len(rows):
                    continue
                exact = products(q, self.vectors[rows])
                fit = (exact >= max(low, floor)) & (exact <= high)
                if not fit.any():
                    continue
                ids, scores = np.concatenate([ids, self.ids[rows[fit]]]), np.concatenate([scores, exact[fit]])
                if len(scores) > 4 * k:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[scores >= edge], scores[scores >= edge]
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            return ids, scores

        return [search(*w) for w in windows]


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, dim)


def _row(values: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(part.split() for part in schema.split(", ")), strict=True)
    return pa.table([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[k]) for v, k in zip(values, types, strict=True)], names=list(names))


def _pack_shard(leaf: int, base: float):
    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, pure, family, _ = (k.as_py() for k in key)
        t = t.sort_by([("id", "ascending"), ("label", "ascending")])
        vectors = _matrix(t, dim)
        tree, order = build(augmented(vectors)[0], leaf, base)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tree = tree._replace(centers=place[tree.centers])
        ids, labels = (t.column(c).to_numpy().astype(np.int64)[order] for c in ("id", "label"))
        return _row([dim, pure, family, len(order), vectors[order], ids, labels, *tree], SHARD)

    return pack


def _pack_block(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    dim, pure, family, block = (k.as_py() for k in key)
    t = t.sort_by([("id", "ascending"), ("row", "ascending")])
    ids, labels, rows = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "label", "row"))
    windows = t.column("windows").to_pylist()
    sizes = np.array([len(w) for w in windows], np.int64)
    flat = [np.array([w[c] for ws in windows for w in ws], d) for c, d in (("low", np.float64), ("high", np.float64), ("id", np.int64))]
    return _row([dim, pure, family, block, t.num_rows, _matrix(t, dim), ids, labels, rows, sizes, *flat], BLOCK)


def _answer(k: int, same_label: bool):
    """What a group of blocks finds in one shard."""

    def arrays(row: dict, names: str) -> list[np.ndarray]:
        real = ("vectors", "radii", "lows", "highs")
        return [np.frombuffer(row[n], np.float64 if n in real else np.int64) for n in names.split()]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in range(5)]
        for s in left.to_pylist():
            vectors, ids, labels, *tree = arrays(s, "vectors ids labels centers radii first count start stop")
            shard = Shard(vectors.reshape(s["n"], s["dim"]), ids, labels, Tree(*tree))
            for i in range(right.num_rows):
                b = right.slice(i, 1).to_pylist()[0]
                queries, q_ids, q_labels, q_rows, sizes, lows, highs, positives = arrays(b, "vectors ids labels rows windows lows highs positives")
                ends = np.cumsum(sizes)
                for j, q in enumerate(queries.reshape(b["n"], s["dim"])):
                    allowed = ((labels == q_labels[j]) == same_label) & (ids != q_ids[j])
                    if not sizes[j] or not allowed.any():
                        continue
                    mine = slice(ends[j] - sizes[j], ends[j])
                    windows = list(zip(lows[mine].tolist(), highs[mine].tolist(), strict=True))
                    for positive, (found, scores) in zip(positives[mine], shard.best(q, allowed, windows, k), strict=True):
                        for column, values in zip(out, (np.full(len(found), q_ids[j]), np.full(len(found), q_rows[j]), np.full(len(found), positive), found, scores), strict=True):
                            column.append(values)
        return pa.table([np.concatenate(c) for c in out], names=[part.split()[0] for part in FOUND.split(", ")])

    return answer


def _meet(shards: DataFrame, n_shards: int, anchors: DataFrame, k: int, same_label: bool, block_rows: int) -> DataFrame:
    """Every block of anchors against the shards that can hold its rows; a shard is read once per ``LANE_BLOCKS`` blocks."""
    anchors = written(anchors, "anchors")
    n_blocks = max(1, math.ceil(anchors.count() / block_rows))
    groups = ["dim", "pure", "family", "block"]
    if not same_label:  # all shards of the dimension: the family does not matter
        anchors = anchors.withColumns({"pure": F.lit(False), "family": F.lit("")})
    blocks = anchors.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(n_blocks)).cast("int"))
    blocks = blocks.groupBy(*groups).applyInArrow(_pack_block, BLOCK)
    blocks = blocks.withColumn("lane", F.expr(f"block div {LANE_BLOCKS}").cast("int"))
    if same_label:
        blocks = blocks.join(shards.select("dim", "pure", "family", "shard"), ["dim", "pure", "family"])
    else:
        blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards)).cast("array<int>")))
    lanes = F.sequence(F.lit(0), F.lit((n_blocks - 1) // LANE_BLOCKS))
    left = shards.withColumn("lane", F.explode(lanes))
    keys = ["dim", "shard", "lane"]
    blocks = blocks.toDF(*blocks.columns)  # both sides come from the shards: give the columns identities of their own
    return left.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_answer(k, same_label), FOUND)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int,
    row_id: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, base: float = BASE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of every anchor row.

    Scores are inner products of integers held as doubles. An anchor's positives are the first ``positives`` other rows of
    its label by falling score, then id. For each of them come the first ``negatives`` rows of other labels that lie between
    ``low`` and ``high`` hundredths of the positive's score, in the same order. Rows without an id or label, or whose vector is null
    or holds null or non-finite components, take no part; repeated rows count once; rows that share the anchor's id or have vectors
    of another length are neither positives nor negatives of it. An id with several different rows is an anchor once for each of
    them. Labels are compared by a 64-bit hash. No anchors, positives or negatives in a window: no rows.
    """
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    named = F.when(F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`").cast("string")))
    rows = vectors.select(
        F.col(f"`{row_id}`").cast("long").alias("id"), named.alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
    rows = written(rows.dropDuplicates(["id", "label", "vec", "anchor"]).withColumn("dim", F.size("vec")), "rows")
    total = rows.count()

    # A label with more rows than a shard holds has shards of its own; the others share some.
    shared = F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(total / shard_rows)))).cast("string")
    homed = with_blocks(rows, ["label"], shard_rows, "of").withColumn("pure", F.col("of") > 1)
    homed = homed.withColumn("family", F.when(F.col("pure"), F.col("label").cast("string")).otherwise(shared))
    candidates = homed.dropDuplicates(["id", "label", "vec"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    shards = candidates.select("dim", "pure", "family", "bucket", "id", "label", "vec").groupBy("dim", "pure", "family", "bucket").applyInArrow(_pack_shard(leaf, base), SHARD)
    shards = written(shards.withColumn("key", F.xxhash64("ids", "labels", "vectors")), "trees")
    # One short row per shard is numbered.
    numbers = written(shards.select("key", F.row_number().over(Window.orderBy("key")).alias("shard")), "numbers")
    n_shards = max(1, numbers.count())
    shards = shards.join(numbers, "key").drop("key")

    anchors = homed.where("anchor").withColumn("row", F.xxhash64("label", "vec")).select("dim", "pure", "family", "id", "label", "row", "vec")
    everything = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(0).cast("long").alias("id")))
    near = _meet(shards, n_shards, anchors.withColumn("windows", everything), positives, True, block_rows)
    order = Window.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = written(near.select("anchor_id", "anchor_row", F.col("n").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # floor and ceiling of hundredths in whole numbers; decimals keep products of large scores exact.
    share = lambda f, part: f((F.col("positive_score").cast("decimal(38,0)") * part) / F.lit(100)).cast("double")
    window = F.struct(share(F.ceil, low).alias("low"), share(F.floor, high).alias("high"), F.col("positive").cast("long").alias("id"))
    windows = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    found = _meet(shards, n_shards, anchors.join(windows, ["id", "row"]), negatives, False, block_rows)
    found = found.select("anchor_id", "anchor_row", F.col("positive_id").alias("positive"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    order = Window.partitionBy("anchor_id", "anchor_row", "positive").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(near, ["anchor_id", "anchor_row", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
