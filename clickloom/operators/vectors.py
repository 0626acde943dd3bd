"""Nearest neighbours over embedding tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import dot, stable_uniform
from clickloom.operators.evaluation import classification_report
from clickloom.plans.ranks import top_n
from clickloom.plans.skew import hot_keys
from clickloom.plans.stage import written

QUERY_BLOCK = 128
VECTOR_BLOCK = 8_192
EXACT_ROWS = 65_536
STRIP = 64
MOST_CENTRES = 65_536
# Bytes of vectors, in single and their own precision, that a task of an exact search holds.
HELD_BYTES = 32 << 20
# Scores in single precision are taken up to this size of a component and rounded by this much.
LARGEST_SINGLE, ROUNDED = 1e15, 2.0**-24
# Places per query and tile above which the tile is scored in double precision.
MANY = 64


def _near(score: np.ndarray, k: int, margin: np.ndarray | float) -> np.ndarray:
    """Flat places of all scores that can be among the ``k`` smallest of their row, given how far a score may be off.

    The k-th smallest of the smallest scores of strips of a row is no less than its k-th smallest score; it takes one pass.
    """
    n = score.shape[1]
    strips = max(min(k, n), n // STRIP)
    least = np.fmin.reduceat(score, np.arange(strips) * n // strips, axis=1)
    last = min(k, n) - 1
    bound = np.partition(least, last, axis=1)[:, last]
    bound[np.isnan(bound)] = np.inf
    return np.flatnonzero(score <= (bound + margin)[:, None])


def _finite(m: np.ndarray) -> np.ndarray:
    """The rows as they are, those that hold a component that is infinite or no number as no number throughout."""
    odd = ~np.isfinite(m).all(axis=1)
    return np.where(odd[:, None], np.nan, m) if odd.any() else m


class _Held:
    """The vectors of one group, made ready once for many queries.

    A tile of scores comes from one product in single precision. Smallest scores of strips bound the k-th best of a query from
    above; what lies within that bound and the rounding of the product is scored again in double precision. Where that would be
    too much, as with many near copies, and where components are too large, the tile's product is taken in double precision.
    """

    def __init__(self, vm: np.ndarray, vid: np.ndarray, metric: str, same_table: bool, k: int):
        self.metric, self.k, self.vid, n = metric, k, vid, len(vm)
        vm = _finite(vm)
        if metric == "cosine":
            vm = vm.astype(np.float64, copy=False)
            vm = vm / np.linalg.norm(vm, axis=1, keepdims=True)
        self.vm = vm
        self.place_of = np.unique(vid, return_inverse=True)[1]
        self.order = np.argsort(vid, kind="stable") if same_table else None
        self.strip = max(1, min(STRIP, n // (4 * k)))
        self.tile = VECTOR_BLOCK // self.strip * self.strip
        self.single = bool(np.nanmax(np.abs(vm), initial=0.0) <= LARGEST_SINGLE)
        if not self.single:
            return
        wide = vm.shape[1] + (metric == "l2")
        self.ready = np.full((-(-n // self.strip) * self.strip, wide), np.nan, np.float32)
        self.most = 0.0
        for i in range(0, n, VECTOR_BLOCK):
            part = vm[i : i + VECTOR_BLOCK].astype(np.float64, copy=False)
            squares = (part**2).sum(1)
            self.most = max(self.most, float(np.nanmax(squares, initial=0.0)))
            self.ready[i : i + len(part), : vm.shape[1]] = -2 * part if metric == "l2" else -part
            if metric == "l2":
                self.ready[i : i + len(part), -1] = squares

    def _own(self, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal ids, found by order, without a comparison of all with all: (query, vector)."""
        if self.order is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = np.searchsorted(self.vid, qid, "left", self.order), np.searchsorted(self.vid, qid, "right", self.order)
        rows = np.flatnonzero(high > low)
        cols = [self.order[low[r] : high[r]] for r in rows]
        return np.repeat(rows, [len(c) for c in cols]), np.concatenate([np.empty(0, np.int64), *cols])

    def _exact(self, qm: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), EXACT_ROWS):
            r, c = qm[rows[i : i + EXACT_ROWS]], self.vm[cols[i : i + EXACT_ROWS]].astype(np.float64, copy=False)
            out[i : i + EXACT_ROWS] = np.sqrt(((r - c) ** 2).sum(1)) if self.metric == "l2" else -np.einsum("ij,ij->i", r, c)
        return out

    def _double(self, qm: np.ndarray, first: int, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of one tile, among them the best of every query, by a product in double precision."""
        vm = self.vm[first : first + self.tile].astype(np.float64, copy=False)
        score = qm @ vm.T
        margin = 2e-9
        if self.metric == "l2":
            q2, v2 = (qm**2).sum(1), (vm**2).sum(1)
            score *= -2
            score += v2[None, :]
            score += q2[:, None]
            # Expanding the square loses digits: all that can be among the k best are taken again, exactly.
            largest = q2 + v2[np.isfinite(v2)].max(initial=0.0)
            margin = 1e-13 * qm.shape[1] * largest + 1e-8 * (1 + np.sqrt(largest))
        else:
            np.negative(score, out=score)
        here = (own[1] >= first) & (own[1] < first + len(vm))
        score[own[0][here], own[1][here] - first] = np.inf
        rows, cols = np.divmod(_near(score, self.k, margin), score.shape[1])
        # Scores that are no number or infinite are no neighbours.
        fine = np.isfinite(score[rows, cols])
        rows, cols = rows[fine], cols[fine] + first
        return self._cut(rows, cols, self._exact(qm, rows, cols))

    def _cut(self, rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fine = np.isfinite(score)
        rows, cols, score = rows[fine], cols[fine], np.round(score[fine], 9)
        order = np.lexsort((self.place_of[cols], score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        return rows[keep], cols[keep], score[keep]

    def best(self, qm: np.ndarray, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the ``k`` best vectors per query, smaller is better, ties to the smaller id."""
        qm = _finite(qm.astype(np.float64, copy=False))
        if self.metric == "cosine":
            qm = qm / np.linalg.norm(qm, axis=1, keepdims=True)
        own = self._own(qid)
        sure, maybe = [], []
        if self.single and np.nanmax(np.abs(qm), initial=0.0) <= LARGEST_SINGLE:
            q2 = (qm**2).sum(1)
            product = np.sqrt(q2 * self.most)
            size = self.most + 2 * product if self.metric == "l2" else product
            # Both the bound and the score can be off by the rounding of a product of this length.
            margin = 2 * (self.ready.shape[1] + 8) * ROUNDED * size + 1e-8 * (1 + np.sqrt(q2 + self.most))
            q32 = np.ones((self.ready.shape[1], len(qm)), np.float32)
            q32[: qm.shape[1]] = qm.T
            low = np.full((self.k, len(qm)), np.inf, np.float32)
            for first in range(0, len(self.ready), self.tile):
                score = self.ready[first : first + self.tile] @ q32
                here = (own[1] >= first) & (own[1] < first + len(score))
                score[own[1][here] - first, own[0][here]] = np.nan
                strips = score.reshape(len(score) // self.strip, self.strip, len(qm))
                least = np.fmin.reduce(strips, axis=1)
                low = np.partition(np.concatenate([low, np.where(np.isnan(least), np.float32(np.inf), least)]), self.k - 1, axis=0)[: self.k]
                bound = low[-1] + margin
                s, r = np.nonzero(least <= bound)
                inside = strips[s, :, r]
                a, b = np.nonzero(inside <= bound[r][:, None])
                if len(a) > MANY * max(len(qm), self.k):
                    sure.append(self._double(qm, first, own))
                else:
                    maybe.append((r[a], first + s[a] * self.strip + b, inside[a, b]))
            rows, cols, rough = (np.concatenate(x) for x in zip(*maybe, strict=True)) if maybe else (np.empty(0, np.int64),) * 3
            near = rough <= (low[-1] + margin)[rows]
            rows, cols = rows[near], cols[near]
            sure.append((rows, cols, self._exact(qm, rows, cols)))
        else:
            sure = [self._double(qm, first, own) for first in range(0, len(self.vm), self.tile)]
        rows, cols, score = self._cut(*(np.concatenate(x) for x in zip(*sure, strict=True)))
        return qid[rows], self.vid[cols], score


def _best(qm: np.ndarray, qid: np.ndarray, vm: np.ndarray, vid: np.ndarray, k: int, metric: str, same_table: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the ``k`` best vectors per query, smaller is better, ties to the smaller id."""
    return _Held(vm, vid, metric, same_table, k).best(qm, qid)


def _matrix(vec: pa.Array, rows: int) -> np.ndarray:
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(flat.dtype if flat.dtype in (np.float32, np.float64) else np.float64, copy=False).reshape(rows, -1)


def _held_rows(vectors: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and how many of them one task holds."""
    n, wide = vectors.where("vec IS NOT NULL").agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    return n, max(VECTOR_BLOCK, HELD_BYTES // (8 * max(wide or 1, 1)))


def _met(q: DataFrame, v: DataFrame, keys: list[str], k: int, metric: str, same_table: bool, groups_made: int = 0) -> DataFrame:
    """Best vectors of every group for the group's queries: (query_id, id, score).

    Vectors are dealt by ``keys`` once and come first inside their group, the queries run past them in batches: a task holds the
    vectors of one group and one batch of queries, however many queries there are. Groups must have bounded numbers of vectors.
    """
    parts = max(groups_made, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = [*keys, "dim"]

    def tagged(df: DataFrame, kind: int) -> DataFrame:
        return df.where("vec IS NOT NULL").select(*keys, F.size("vec").alias("dim"), F.lit(kind).alias("kind"), "id", "vec")

    both = tagged(v, 0).union(tagged(q, 1)).repartition(parts, *groups).sortWithinPartitions(*groups, "kind")
    id_type = v.schema["id"].dataType.simpleString()
    schema = f"query_id {q.schema['id'].dataType.simpleString()}, id {id_type}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready, types = None, [], None, None
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            new[:1] = True
            for c in (*groups, "kind"):
                column = b.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(new)
            for start, stop in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here = tuple(b.column(c)[start].as_py() for c in groups)
                if here != group:
                    group, held, ready = here, [], None
                ids = b.column("id").slice(start, stop - start)
                vec = _matrix(b.column("vec").slice(start, stop - start), stop - start)
                if b.column("kind")[start].as_py() == 0:
                    held.append((ids, vec))
                    continue
                if ready is None:
                    if not held:
                        continue
                    types = (ids.type, held[0][0].type, pa.float64())
                    known = pa.concat_arrays([i for i, _ in held]).to_numpy(zero_copy_only=False)
                    ready, held = _Held(np.concatenate([m for _, m in held]), known, metric, same_table, k), []
                for i in range(0, len(vec), QUERY_BLOCK):
                    mine = slice(i, i + QUERY_BLOCK)
                    found = ready.best(vec[mine], ids.to_numpy(zero_copy_only=False)[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)], names=["query_id", "id", "score"])

    return both.mapInArrow(run, schema)


def _top(found: DataFrame, k: int, metric: str) -> DataFrame:
    best = top_n(found, ["query_id"], ["score", "id"], k)
    return best if metric == "l2" else best.withColumn("score", -F.col("score"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2", same_table: bool = False) -> DataFrame:
    """Exact ``k`` nearest vectors (id, vec) for every query (id, vec): (query_id, id, score, rn).

    Vectors are dealt into blocks, every query visits all blocks, and a block hands back only its ``k`` best per query. A block
    holds as many vectors as a task may, so queries are repeated as seldom as can be; where there are fewer blocks than cores, the
    queries of a block are cut into parts too. ``metric`` is ``l2`` (distance), ``dot`` or ``cosine`` (similarity); ties go to the
    smaller id. Rows without a vector take no part; vectors of different length never meet.
    """
    n, most = _held_rows(vectors)
    asked = n if queries is vectors else queries.count()
    wanted = 8 * queries.sparkSession.sparkContext.defaultParallelism
    # Rows are repeated least when both sides are cut alike.
    blocks = max(1, -(-n // most), min(-(-n // VECTOR_BLOCK), math.isqrt(wanted)))
    parts = max(1, min(-(-wanted // blocks), -(-asked // (16 * QUERY_BLOCK))))
    q = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"))
    v = vectors.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("vb"))
    return _top(_met(q, v, ["qb", "vb"], k, metric, same_table, blocks * parts), k, metric)


def coarse_centres(vectors: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` vectors drawn by a seeded hash of their id, as (centre, vec): fixed coarse centres for ``inverted_lists``."""
    drawn = vectors.where("vec IS NOT NULL").withColumn("_u", stable_uniform(seed, F.col("id")))
    return drawn.orderBy("_u", "id").limit(n).select(F.col("id").alias("centre"), "vec")


def nearest_centres(df: DataFrame, centres: DataFrame, n: int, metric: str = "l2") -> DataFrame:
    """The rows (id, vec) once for each of their ``n`` nearest centres: (id, vec, centre); ties go to the smaller centre.

    The centres come to every task: their number is a parameter of the index, checked against ``MOST_CENTRES``.
    """
    known = centres.orderBy("centre").limit(MOST_CENTRES + 1).toArrow()
    if known.num_rows > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    names = known.column("centre").combine_chunks()
    points = _matrix(known.column("vec").combine_chunks(), known.num_rows) if known.num_rows else np.empty((0, 0))
    schema = df.select("id", "vec", F.lit(None).cast(centres.schema["centre"].dataType).alias("centre")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(points, np.arange(len(points)), metric, False, n)
        for b in batches:
            for i in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(i, QUERY_BLOCK)
                vec = _matrix(part.column("vec"), part.num_rows)
                rows, near, _ = held.best(vec, np.arange(len(vec)))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("vec"), names.take(pa.array(near))], names=["id", "vec", "centre"])

    if not known.num_rows:
        return df.select("id", "vec", F.lit(None).cast(centres.schema["centre"].dataType).alias("centre")).limit(0)
    return df.where(F.size("vec") == points.shape[1]).select("id", "vec").mapInArrow(run, schema)


def inverted_lists(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Every vector at its nearest centre, written once, list by list: (id, vec, centre, part).

    The rows of a list lie next to each other in one file, and a file holds many lists, so the number of files does not grow with
    that of centres. A list longer than ``VECTOR_BLOCK`` is cut into parts by a hash of the id, so a centre that draws a third of
    all vectors costs no task more than the others.
    """
    spark = vectors.sparkSession
    placed = written(nearest_centres(vectors, centres, 1), "placed")
    # One row per centre, a number that the index fixes.
    sizes = placed.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(sizes), "centre").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    near = cut.select("id", "vec", "part", "parts", "centre").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "centre", "part")
    return written(near.sortWithinPartitions("centre", "part"), "inverted")


def ivf_search(queries: DataFrame, lists: DataFrame, centres: DataFrame, k: int = 5, probes: int = 10, metric: str = "l2", same_table: bool = False) -> DataFrame:
    """The ``k`` nearest vectors among the lists of the ``probes`` nearest centres, by exact scores: (query_id, id, score, rn).

    Probing is a join of queries and list parts on the centre. With as many probes as centres the search is exact. For
    ``cosine`` give vectors of one length to the index and the search; ``dot`` probes the centres with the largest product.
    """
    probed = nearest_centres(queries, centres, probes, metric)
    parts = lists.groupBy("centre").agg(F.max("parts").alias("parts"))
    q = probed.join(F.broadcast(parts), "centre").select("id", "vec", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return _top(_met(q, lists.select("id", "vec", "centre", "part"), ["centre", "part"], k, metric, same_table), k, metric)


def unit_length(vectors: DataFrame) -> DataFrame:
    """(id, vec) with vectors divided by their length; zero vectors leave."""
    length = F.sqrt(dot(F.col("vec"), F.col("vec")))
    return vectors.withColumn("_l", length).where("_l > 0").select("id", F.transform("vec", lambda x: x.cast("double") / F.col("_l")).alias("vec"))


def similar_items(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar other items by cosine."""
    return knn(vectors, vectors, k, "cosine", same_table=True)


def knn_lsh(
    queries: DataFrame, vectors: DataFrame, k: int = 5, width: float = 1.0, tables: int = 4, seed: int = 7
) -> DataFrame:
    """Approximate ``k`` nearest by L2: exact search among vectors that share a hash bucket."""
    def as_ml(df: DataFrame) -> DataFrame:
        return df.select("id", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))

    lsh = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed
    ).fit(as_ml(vectors))

    def buckets(df: DataFrame) -> DataFrame:
        hashed = lsh.transform(as_ml(df)).select("id", "vec", F.posexplode("h").alias("tab", "hv"))
        return written(hashed.select("id", "vec", "tab", vector_to_array("hv")[0].alias("bucket")), "buckets")

    v = buckets(vectors)
    q = v if queries is vectors else buckets(queries)
    # The vectors of a bucket that a task can not hold are cut into parts, its queries too, and every part meets every part.
    home, most = ["tab", "bucket"], _held_rows(v)[1]
    cut = F.broadcast(hot_keys(v, home, most).withColumnRenamed("_blocks", "_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    own, other = F.pmod(F.xxhash64("id"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    v = v.join(cut, home, "left").select("id", "vec", *home, own.alias("vb"), other.alias("qb"))
    q = q.join(cut, home, "left").select("id", "vec", *home, other.alias("vb"), own.alias("qb"))
    # A pair can meet in several tables; its rows go to the query's place at once, where they are made one and ranked.
    found = _met(q, v, [*home, "vb", "qb"], k, "l2", False)
    found = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    return _top(found.distinct(), k, "l2")


def recall_against(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate list also holds, per query."""
    hit = approx.select("query_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )


def cosine_to(df: DataFrame, a: str, b: str, name: str = "cosine") -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.withColumn(name, dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def vector_quality(vectors: DataFrame, label: str, seed: int, train: float = 0.8) -> DataFrame:
    """Predict the category from the vector; precision, recall and f1 on the held-out part."""
    data = vectors.select(
        "id", F.col(label).cast("double").alias("label"), array_to_vector(F.col("vec").cast("array<double>")).alias("features")
    )
    held_in = stable_uniform(seed, F.col("id")) < train
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(data.where(held_in))
    scored = model.transform(data.where(~held_in))
    return classification_report(scored, "label", "prediction")
