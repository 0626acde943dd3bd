"""Ordered scans per key: running totals, previous / next rows, last known values.

A small input (by the size of the files behind it) is scanned with plain window functions. A larger one is dealt by
``repartitionByRange`` over all keys and sort columns, so a key with many rows spreads over as many partitions as it needs,
whatever its values look like. Each partition is a window partition of its own, and one short row per partition carries the
state of its last (or first) key into the next (or previous) one. Spark samples the ranges anew whenever such a plan runs, so
the dealt rows are written once to the shared folder: rows and carries must see the same ranges. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clickloom.plans.stage import written
from clickloom.session import input_bytes, scan_bytes


@dataclass(frozen=True)
class Carry:
    """One column to compute in an ordered scan."""

    kind: str  # "sum" | "last" | "next" | "prev_row" | "next_row"
    value: Column
    inclusive: bool = True

    @property
    def upward(self) -> bool:
        """Whether the state comes from later rows."""
        return self.kind in ("next", "next_row")


def running_sum(value: Column, inclusive: bool = True) -> Carry:
    return Carry("sum", value, inclusive)


def last_known(value: Column, inclusive: bool = True) -> Carry:
    """Latest non-null value so far."""
    return Carry("last", value, inclusive)


def next_known(value: Column, inclusive: bool = True) -> Carry:
    """Earliest non-null value from here on."""
    return Carry("next", value, inclusive)


def previous_row(value: Column) -> Carry:
    return Carry("prev_row", value, False)


def following_row(value: Column) -> Carry:
    return Carry("next_row", value, False)


def sort_columns(order: Sequence[str], reverse: bool = False) -> list[Column]:
    cols = []
    for spec in order:
        desc, col = spec.startswith("-"), F.col(spec.lstrip("-"))
        cols.append(col.desc() if desc != reverse else col.asc())
    return cols


class OrderedRows:
    """Rows grouped by ``keys`` and sorted by ``order`` (``"-name"`` sorts descending, nulls first ascending and last descending).

    The order should be total within a key. Rows that agree on all of it are told apart by a hash of their values; only rows that
    agree in everything stay in one partition.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self.split = input_bytes(df) > scan_bytes(df.sparkSession)
        self.df = self._dealt(df) if self.split else df

    def _dealt(self, df: DataFrame) -> DataFrame:
        """The rows with their place over all (``_at``) and their partition (``_part``), in key and sort order."""
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        marked = df.withColumn("_tie", F.xxhash64(*plain))
        where = [*sort_columns(self.keys), *sort_columns(self.order), F.col("_tie")]
        dealt = marked.repartitionByRange(parts, *where).sortWithinPartitions(*where).drop("_tie")
        placed = dealt.withColumn("_at", F.monotonically_increasing_id())
        return written(placed.withColumn("_part", F.shiftright("_at", 33).cast("int")), "dealt")

    def _window(self, reverse: bool = False) -> WindowSpec:
        if self.split:
            return Window.partitionBy(*self.keys, "_part").orderBy(*sort_columns(["_at"], reverse))
        return Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order, reverse))

    def _local(self, c: Carry, value: Column) -> Column:
        end = 0 if c.inclusive else -1
        frame = (Window.unboundedPreceding, end)
        if c.kind == "sum":
            return F.sum(value).over(self._window().rowsBetween(*frame))
        if c.kind == "last":
            return F.last(value, ignorenulls=True).over(self._window().rowsBetween(*frame))
        if c.kind == "next":
            return F.last(value, ignorenulls=True).over(self._window(reverse=True).rowsBetween(*frame))
        if c.kind == "prev_row":
            return F.lag(F.struct(value.alias("v"))).over(self._window())
        return F.lead(F.struct(value.alias("v"))).over(self._window())

    def add(self, **carries: Carry) -> OrderedRows:
        """Add one column per carry; the new columns can feed the next ``add``."""
        out = object.__new__(OrderedRows)
        out.keys, out.order, out.split = self.keys, self.order, self.split
        if self.split:
            local = self.df.withColumns({f"_v_{n}": c.value for n, c in carries.items()})
            local = local.withColumns({n: self._local(c, F.col(f"_v_{n}")) for n, c in carries.items()})
            local = self._carry_over(local, carries).drop(*[f"_v_{n}" for n in carries])
        else:
            local = self.df.withColumns({n: self._local(c, c.value) for n, c in carries.items()})
        done = {}
        for n, c in carries.items():
            if c.kind == "sum":
                done[n] = F.coalesce(F.col(n), F.lit(0))
            elif c.kind.endswith("_row"):
                done[n] = F.col(f"{n}.v")
        out.df = local.withColumns(done) if done else local
        return out

    def _handed_on(self, name: str, c: Carry) -> Column:
        """What the outermost row of a partition hands on: the state including that row."""
        value, so_far = F.col(f"_v_{name}"), F.col(name)
        if c.kind.endswith("_row"):
            return F.struct(value.alias("v"))
        if c.kind == "sum":
            return F.coalesce(so_far, F.lit(0)) + (F.lit(0) if c.inclusive else F.coalesce(value, F.lit(0)))
        return so_far if c.inclusive else F.coalesce(value, so_far)

    def _carry_over(self, local: DataFrame, carries: dict[str, Carry]) -> DataFrame:
        out, before = local, (Window.unboundedPreceding, Window.currentRow)
        for upward in (False, True):
            mine = {n: c for n, c in carries.items() if c.upward == upward}
            if not mine:
                continue
            # One row per partition: its outermost key and the state there.
            state = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *[self._handed_on(n, c).alias(f"_c_{n}") for n, c in mine.items()])
            edges = local.groupBy("_part").agg((F.min_by if upward else F.max_by)(state, "_at").alias("_edge")).select("_part", "_edge.*")
            names = [f"_k{i}" for i in range(len(self.keys))]
            along = F.col("_part").desc() if upward else F.col("_part").asc()
            same = Window.partitionBy(*names).orderBy(along).rowsBetween(*before)
            totals = [(F.sum(f"_c_{n}") if c.kind == "sum" else F.last(f"_c_{n}", ignorenulls=True)).over(same).alias(f"_c_{n}") for n, c in mine.items()]
            # The neighbour that goes on; a window over as many rows as there are partitions.
            edges = edges.select(F.lead("_part").over(Window.orderBy(along)).alias("_to"), *names, *totals)
            on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)] + [F.col("_part") == F.col("_to")]
            out = out.join(F.broadcast(edges), on, "left").drop("_to", *names)
        merged = {}
        for n, c in carries.items():
            if c.kind == "sum":
                merged[n] = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
            else:
                merged[n] = F.coalesce(F.col(n), F.col(f"_c_{n}"))
        return out.withColumns(merged).drop(*[f"_c_{n}" for n in carries])

    def rows(self) -> DataFrame:
        return self.df.drop("_at", "_part") if self.split else self.df
