"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Largest inner product becomes smallest distance by one more component, which brings all vectors of a shard to one norm. Inside a
ball tree the triangle inequality bounds the distance to a subtree from below; a subtree is left out if the bound exceeds
``factor`` times the k-th distance so far. Factor 1 is exact on any vectors; smaller ones lose neighbours where norms differ,
vectors form clusters or lie in few dimensions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.blocks import BLOCK_ROWS, SHARD_ROWS, best, blocks, meet, most_vectors, name_ids, shards, unpack, usable

LEAF = 128
FACTOR = 1.0


class Node(NamedTuple):
    """A vantage point with, per child, the smallest and largest distance to it; a leaf has rows only."""

    rows: np.ndarray
    vantage: int
    children: tuple
    bounds: tuple


def build(points: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over the rows of ``points``; the vantage point is the row farthest from the first one, halves split at the median."""

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows, -1, (), ())
        from_first = np.linalg.norm(points[rows] - points[rows[0]], axis=1)
        vantage = int(rows[np.argmax(from_first)])
        far = np.linalg.norm(points[rows] - points[vantage], axis=1)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        parts = order[:half], order[half:]
        return Node(rows[:0], vantage, tuple(grow(rows[p]) for p in parts), tuple((far[p[0]], far[p[-1]]) for p in parts))

    return grow(np.arange(len(points)))


def search(tree: Node, vectors: np.ndarray, points: np.ndarray, queries: np.ndarray, norm: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best vectors found per query and of all that score as much as the last of them.

    All queries of a block walk the tree together. First each goes down to the leaf it lies in, for a first k-th distance;
    then the whole tree is walked, each subtree with the queries that cannot leave it out. A last walk with the final k-th
    distances collects the rows, ties at the border included.
    """
    n = len(queries)
    scale = norm / np.linalg.norm(queries, axis=1)
    aimed = np.hstack([queries * scale[:, None], np.zeros((n, 1))])
    top = np.full((n, k), -np.inf)
    limit = np.full(n, np.inf)
    done = np.full(n, -1)
    leaves: dict[int, int] = {}

    def look(node: Node, who: np.ndarray) -> None:
        s = np.hstack([top[who], queries[who] @ vectors[node.rows].T])
        top[who] = -np.partition(-s, k - 1, axis=1)[:, :k]
        worst = top[who].min(axis=1)
        known = np.isfinite(worst)
        limit[who[known]] = np.sqrt(np.maximum(0, 2 * norm * norm - 2 * scale[who[known]] * worst[known]))

    def distance(node: Node, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * norm * norm - 2 * (aimed[who] @ points[node.vantage])))

    def below(node: Node, who: np.ndarray, far: np.ndarray, child: int) -> np.ndarray:
        low, high = node.bounds[child]
        return np.maximum(np.maximum(far - high, low - far), 0)

    def descend(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.children:
            done[who] = leaves.setdefault(id(node), len(leaves))
            look(node, who)
            return
        far = distance(node, who)
        inner = below(node, who, far, 0) <= below(node, who, far, 1)
        descend(node.children[0], who[inner])
        descend(node.children[1], who[~inner])

    def walk(node: Node, who: np.ndarray, leaf: Callable[[Node, np.ndarray], None]) -> None:
        if not node.children:
            leaf(node, who)
            return
        far = distance(node, who)
        for child in (0, 1):
            near = below(node, who, far, child) <= factor * limit[who] + 1e-9 * norm
            if near.any():
                walk(node.children[child], who[near], leaf)

    def improve(node: Node, who: np.ndarray) -> None:
        who = who[done[who] != leaves.get(id(node), -2)]
        if len(who):
            look(node, who)

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def collect(node: Node, who: np.ndarray) -> None:
        q, r = np.nonzero(queries[who] @ vectors[node.rows].T >= bar[who][:, None])
        found.append((who[q], node.rows[r]))

    everyone = np.arange(n)
    descend(tree, everyone)
    walk(tree, everyone, improve)
    # Products that differ in their last digits only, by the order of addition, count as ties here.
    bar = top.min(axis=1) - 1e-12 * norm * np.linalg.norm(queries, axis=1)
    walk(tree, everyone, collect)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(vectors: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding", factor: float = FACTOR, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest found of every query row: query_id, rank (from 1), vec_id, score (inner product in double precision).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
    another length than the query's are no candidates. Rows that share an id are never each other's neighbours, and an id with
    several vectors counts with its best score. Ties go to the smaller id. No queries or no candidates: no rows.
    """
    rows = usable(vectors, row_id, vector).where(F.exists("vec", lambda c: c != 0))
    asked = usable(vectors.where(is_query), row_id, vector).where(F.exists("vec", lambda c: c != 0))
    index, n = shards(rows, k + 1, shard_rows)
    many = most_vectors(rows)

    def answer(q: dict, s: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (queries, q_starts, q_ids), (near, v_starts, v_ids) = unpack(q, dim), unpack(s, dim)
        length = np.linalg.norm(near, axis=1)
        norm = float(length.max())
        points = np.hstack([near, np.sqrt(np.maximum(0, norm * norm - length * length))[:, None]])
        r, v = search(build(points, leaf), near, points, queries, norm, min(k * many + 1, len(near)), factor)
        exact = (queries[r] * near[v]).sum(axis=1)  # the same order of addition wherever the vector lies
        return name_ids(r, v, exact, (q_starts, q_ids), (v_starts, v_ids), k)

    return best(meet(index, n, blocks(asked, block_rows), answer, pa.float64()), k)
