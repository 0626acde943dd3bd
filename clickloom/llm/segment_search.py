"""Exact top-k search by inner product with segment statistics from coarse to fine.

A vector cut into segments has a mean and a deviation per segment. From these follows a lower bound of the squared distance,
|q - x|^2 >= sum of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), and with both norms an upper bound of the inner product. Each
level halves the segments' length and is only computed for what the level before could not rule out; the survivors get
their exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.blocks import BLOCK_ROWS, SHARD_ROWS, best, blocks, meet, most_vectors, name_ids, shards, unpack, usable

LEVELS = (4, 8, 16)
SCALE = 256
EXACT = 2.0**53
QUERIES_AT_ONCE = 32
MOST_AT_ONCE = 1_000


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles (exact integers)."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # From 2^53 on every double is an integer; NaN and infinities stay what they are.
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(EXACT), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of every segment, side by side per row."""
    out = []
    for piece in np.array_split(x, min(parts, x.shape[1]), axis=1):
        root = np.sqrt(piece.shape[1])
        out += [root * piece.mean(axis=1), root * piece.std(axis=1)]
    return np.stack(out, axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles; beyond 2^53 they are computed as Python integers, cut to 64 bits."""
    if float(np.abs(q).sum()) * float(np.abs(x).max(initial=0)) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in whole], np.int64)


def survivors(q: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], norms: tuple[float, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` that can be among the k best of ``q``, with their exact scores."""
    q_norm, x_norm = norms
    slack = 1e-9 * (q_norm + float(x_norm.max(initial=0)))
    alive, floor = np.arange(len(x)), -np.inf
    for of_q, of_x in levels:
        distance = ((of_x[alive] - of_q) ** 2).sum(axis=1)
        most = (q_norm + x_norm[alive] - distance) / 2 + slack
        if len(alive) > k:
            # The k most promising give a floor that every later candidate has to reach.
            first = alive[np.argpartition(-most, k - 1)[:k]]
            floor = max(floor, float(products(q, x[first]).min()))
        alive = alive[most >= floor]
    return alive, products(q, x[alive])


def survivors_at_once(q: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], norms: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``survivors`` of every row of ``q``: a level is one product over the rows of ``x`` that it still has to look at for some query."""
    if k > MOST_AT_ONCE or float(np.abs(q).sum(axis=1).max()) * float(np.abs(x).max(initial=0)) >= EXACT:
        return [survivors(one, x, [(a[i], b) for a, b in levels], (float(norms[0][i]), norms[1]), k) for i, one in enumerate(q)]
    q_norm, x_norm = norms[0][:, None], norms[1]
    slack = 1e-9 * (q_norm + float(x_norm.max(initial=0)))
    rows, alive, floor = np.arange(len(x)), np.ones((len(q), len(x)), bool), np.full((len(q), 1), -np.inf)
    for of_q, of_x in levels:
        near = of_x if len(rows) == len(of_x) else of_x[rows]
        # (q_norm + x_norm - distance) / 2 + slack, with the squares of the distance taken to their side.
        most = of_q @ near.T
        most += (q_norm - (of_q**2).sum(axis=1)[:, None]) / 2 + slack
        most += (x_norm[rows] - (near**2).sum(axis=1)) / 2
        most[~alive] = -np.inf
        enough = alive.sum(axis=1) > k
        if enough.any():
            # The k most promising give a floor that every later candidate has to reach.
            first = rows[np.argpartition(most, len(rows) - k, axis=1)[:, len(rows) - k :]]
            least = np.matmul(x[first], q[:, :, None])[:, :, 0].min(axis=1)
            floor = np.where(enough[:, None], np.maximum(floor, least[:, None]), floor)
        alive &= most >= floor
        some = alive.any(axis=0)
        rows, alive = rows[some], alive[:, some]
    score = q @ x[rows].T
    alive &= score >= floor
    return [(rows[a], s[a].astype(np.int64)) for a, s in zip(alive, score, strict=True)]


def nearest(vectors: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding", levels: tuple[int, ...] = LEVELS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest integer inner products of every query row: query_id, rank (from 1), vec_id, score (long).

    ``vector`` holds integers as doubles (see ``integers``). Vectors that are null or hold null or non-finite components take
    no part, nor do rows without an id; vectors of another length are no candidates. Rows that share an id are never each
    other's result, and an id with several vectors counts with its best score. Ties go to the smaller id.
    """
    rows = usable(vectors, row_id, vector)
    index, n = shards(rows, k + 1, shard_rows)
    enough = k * most_vectors(rows) + 1
    asked = blocks(usable(vectors.where(is_query), row_id, vector), block_rows)

    prepared: dict = {}

    def answer(q: dict, s: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        queries, q_starts, q_ids = unpack(q, dim)
        if prepared.get("shard") is not s:  # the blocks of a chunk meet the same shard
            near, v_starts, v_ids = unpack(s, dim)
            prepared.update(shard=s, near=near, starts=v_starts, ids=v_ids, of_x=[segments(near, n) for n in levels if dim], norm=(near**2).sum(axis=1))
        near, v_starts, v_ids, of_x = (prepared[c] for c in ("near", "starts", "ids", "of_x"))
        of_q, q_norm = [segments(queries, n) for n in levels if dim], (queries**2).sum(axis=1)
        lines, found, scores = [], [], []
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            kept = survivors_at_once(queries[part], near, [(a[part], b) for a, b in zip(of_q, of_x, strict=True)], (q_norm[part], prepared["norm"]), enough)
            for i, (alive, score) in enumerate(kept, at):
                if len(alive) > enough:
                    pick = np.argpartition(-score, enough - 1)[:enough]
                    pick = np.flatnonzero(score >= score[pick].min())  # all that tie at the border
                    alive, score = alive[pick], score[pick]
                lines.append(np.full(len(alive), i))
                found.append(alive)
                scores.append(score)
        none = np.empty(0, np.int64)
        return name_ids(np.concatenate([none, *lines]), np.concatenate([none, *found]), np.concatenate([none, *scores]), (q_starts, q_ids), (v_starts, v_ids), k)

    return best(meet(index, n, asked, answer, pa.int64()), k)
