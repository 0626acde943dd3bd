"""A stated set of query vectors against all vectors: shards of vectors, blocks of queries, and the merge of their answers.

Equal vectors are one row with their smallest ids, so a vector that a third of all rows share costs one comparison and ties go
to the smaller id exactly. A shard and a block are matrices of bounded size; each pair of them is one row of work.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.stage import written

SHARD_ROWS = 8_192
BLOCK_ROWS = 512
CHUNK_BLOCKS = 64
PACKED = "dim int, {part} int, n long, vectors binary, counts binary, ids binary"


def usable(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, vec): rows with an id and a vector of finite components; repeated rows once."""
    x = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return x.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)


def most_vectors(vectors: DataFrame) -> int:
    """The largest number of different vectors that one id has: so many of them may stand before the next id."""
    found = vectors.groupBy("id").agg(F.count_distinct(F.xxhash64("vec")).alias("n")).agg(F.max("n")).first()[0]
    return int(found or 1)


def _packed(rows: DataFrame, part: str) -> DataFrame:
    """One row per (dim, part): its matrix, how many ids each vector has, and the ids."""

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        t = t.sort_by([("first", "ascending")])
        flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        ids = t.column("ids").combine_chunks()
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        out = [[dim], [key[1].as_py()], [t.num_rows], [flat.astype(np.float64).tobytes()], [counts.tobytes()], [ids.flatten().to_numpy().astype(np.int64).tobytes()]]
        return pa.table([pa.array(v, k) for v, k in zip(out, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["dim", part, "n", "vectors", "counts", "ids"])

    return rows.withColumn("first", F.col("ids")[0]).groupBy("dim", part).applyInArrow(pack, PACKED.format(part=part))


def shards(vectors: DataFrame, keep_ids: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """All vectors in shards of about ``shard_rows`` different ones, each with its ``keep_ids`` smallest ids; and how many shards."""
    order = Window.partitionBy("vec").orderBy("id")
    few = vectors.withColumn("rn", F.dense_rank().over(order)).where(F.col("rn") <= keep_ids)
    unique = few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    unique = written(unique.withColumn("dim", F.size("vec")), "vectors")
    n = max(1, math.ceil(unique.count() / shard_rows))
    return _packed(unique.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")), "shard"), n


def blocks(queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The query vectors in blocks of about ``block_rows``; equal query vectors meet in one row."""
    # The queries are a stated set; those that share a vector are cut into rows of bounded length.
    queries = queries.dropDuplicates(["id", "vec"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(64)))
    unique = written(queries.groupBy("vec", "cut").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vec")), "queries")
    n = max(1, math.ceil(unique.count() / block_rows))
    return _packed(unique.withColumn("block", F.pmod(F.xxhash64("vec", "cut"), F.lit(n)).cast("int")), "block")


def unpack(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, where each vector's ids start, and the ids."""
    matrix = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], dim)
    starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int64))])
    return matrix, starts, np.frombuffer(row["ids"], np.int64)


def meet(index: DataFrame, n_shards: int, queries: DataFrame, answer: Callable[[dict, dict, int], tuple[np.ndarray, np.ndarray, np.ndarray]], score: pa.DataType) -> DataFrame:
    """(query_id, vec_id, score) of every block against every shard of its dimension; ``answer`` gives the best of one pair.

    A group is one shard and a chunk of up to ``CHUNK_BLOCKS`` blocks: a block is sent once to every shard, a shard once to every chunk,
    both by shuffles. A join would be free to broadcast the sent blocks, whose size grows with queries times shards.
    """
    queries = written(queries, "query-blocks")
    last = queries.agg(F.max("block")).first()[0] or 0
    packed = [c for c in index.columns if c not in ("dim", "shard")]
    key = ["dim", "shard", "chunk"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    sent = queries.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS).cast("int")).withColumn("shard", every(n_shards - 1)).select(*key, *packed)
    near = index.withColumn("chunk", every(last // CHUNK_BLOCKS)).select(*key, *packed)
    kind = "double" if pa.types.is_floating(score) else "long"

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, score.to_pandas_dtype()))]
        for shard in s.to_pylist():
            found += [answer(q.slice(i, 1).to_pylist()[0], shard, shard["dim"]) for i in range(q.num_rows)]
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), score], strict=True)], names=["query_id", "vec_id", "score"])

    return sent.groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query over all shards: query_id, rank, vec_id, score."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def name_ids(rows: np.ndarray, vectors: np.ndarray, scores: np.ndarray, query: tuple[np.ndarray, np.ndarray], shard: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids for (query row, vector row, score): every query id with the k best ids that are not its own, ties to the smaller."""
    (q_starts, q_ids), (v_starts, v_ids) = query, shard
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort((vectors, -scores, rows))
    rows, vectors, scores = rows[order], vectors[order], scores[order]
    edges = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        if a == b:
            continue
        counts = v_starts[vectors[a:b] + 1] - v_starts[vectors[a:b]]
        ids = np.concatenate([v_ids[v_starts[v] : v_starts[v + 1]] for v in vectors[a:b]])
        worth = np.repeat(scores[a:b], counts)
        place = np.lexsort((ids, -worth))
        ids, worth = ids[place], worth[place]
        once = np.sort(np.unique(ids, return_index=True)[1])  # an id with several vectors counts with its best score
        ids, worth = ids[once], worth[once]
        for q in q_ids[q_starts[rows[a]] : q_starts[rows[a] + 1]]:
            other = np.flatnonzero(ids != q)[:k]
            out.append((np.full(len(other), q), ids[other], worth[other]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), scores[:0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
