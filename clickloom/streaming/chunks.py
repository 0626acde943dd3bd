"""Conversation turns cut into chunks: flushed after some turns or after some time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.functions.numeric import seconds_of
from clickloom.operators.sequences import sessionize
from clickloom.plans.ranks import numbered
from clickloom.plans.skew import with_blocks

BLOCK_ROWS = 500_000


def _in_order(conv: str, turn: str, max_turns: int, max_age: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Number the chunks of sorted islands, keeping only the open chunk between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, turns, chunk = None, 0.0, 0, 0
        for pdf in batches:
            ids = []
            for k, s in zip(zip(pdf[conv], pdf["_island"], strict=True), pdf["_sec"], strict=True):
                if k != key:
                    key, start, turns, chunk = k, s, 0, 0
                elif turns >= max_turns or s - start >= max_age:
                    start, turns, chunk = s, 0, chunk + 1
                turns += 1
                ids.append(chunk)
            yield pdf[[conv, turn, "_island"]].assign(_chunk=ids)

    return run


def _chunk_lengths(pdf: pd.DataFrame, max_turns: int, max_age: float) -> np.ndarray:
    """For each of the block's own rows: how many turns a chunk that starts there would hold."""
    sec, n = pdf["_sec"].to_numpy(), int(pdf["_mine"].sum())
    length = np.full(n, max_turns)
    for d in range(max_turns - 1, 0, -1):
        last = min(n, len(sec) - d)
        old = sec[d : d + last] - sec[:last] >= max_age
        length[:last][old] = d
    return length


def _walk(length: np.ndarray, entry: int) -> list[int]:
    spots, p = [], entry
    while p < len(length):
        spots.append(p)
        p += int(length[p])
    return [*spots, p]


def flush_chunks(
    df: DataFrame,
    conv: str,
    turn: str,
    ts: str | None = None,
    max_turns: int = 5,
    max_age_seconds: int = 3600,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Chunk number of every turn: a chunk is flushed after ``max_turns`` turns, or when a turn comes
    ``max_age_seconds`` or more after its first.

    With times, a pause that long always ends a chunk, so conversations are first cut there into islands.
    An island of more than ``block_rows`` turns is cut into blocks. The first chunk of a block can begin
    at one of its first ``max_turns`` rows only: each block reports for each of them where the next block
    is entered, those short reports are followed in order, and then every block is numbered by itself.
    """
    if ts is None:
        placed = numbered(df, [conv], [turn], "_n")
        return placed.withColumn("chunk", F.floor((F.col("_n") - 1) / max_turns)).drop("_n")
    age = float(max_age_seconds)
    # A pause of exactly the age ends the chunk too, so the gap rule is one microsecond below it.
    islands = sessionize(df, conv, ts, f"{max_age_seconds * 1_000_000 - 1} microseconds", [turn])
    rows = islands.select(conv, turn, F.col("session").alias("_island"), seconds_of(F.col(ts)).alias("_sec"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key = f"{conv} {types[conv]}, _island long"
    out = f"{conv} {types[conv]}, {turn} {types[turn]}, _island long, _chunk long"

    marked = with_blocks(rows, [conv, "_island"], block_rows)
    small = marked.where(F.col("_of") == 1).drop("_of")
    sorted_rows = small.repartition(F.col(conv), F.col("_island")).sortWithinPartitions(conv, "_island", "_sec", turn)
    chunks = sorted_rows.mapInPandas(_in_order(conv, turn, max_turns, age), out)

    big = marked.where(F.col("_of") > 1).drop("_of")
    chunks = chunks.unionByName(_blockwise(big, conv, turn, max_turns, age, block_rows, key, out))

    firsts = chunks.select(conv, "_island", "_chunk").distinct()
    order = numbered(firsts, [conv], ["_island", "_chunk"], "_c").withColumn("chunk", F.col("_c") - 1).drop("_c")
    named = chunks.join(order, [conv, "_island", "_chunk"]).select(conv, turn, "chunk")
    return df.join(named, [conv, turn])


def _blockwise(
    rows: DataFrame, conv: str, turn: str, max_turns: int, age: float, block_rows: int, key: str, out: str
) -> DataFrame:
    placed = numbered(rows, [conv, "_island"], ["_sec", turn], "_pos")
    own = F.floor((F.col("_pos") - 1) / block_rows)
    # The first rows of a block are also seen by the block before it.
    ahead = F.pmod(F.col("_pos") - 1, F.lit(block_rows)) < max_turns
    seen = F.when((own > 0) & ahead, F.array(own, own - 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(seen))
    spread = spread.withColumn("_mine", F.col("_own") == F.col("_block")).drop("_own")
    ids = [conv, "_island", "_block"]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        length = _chunk_lengths(pdf, max_turns, age)
        walks = [_walk(length, e) for e in range(max_turns)]
        head = pdf[ids].head(1)
        return head.assign(exits=[[w[-1] - len(length) for w in walks]], starts=[[len(w) - 1 for w in walks]])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, entry, base = None, 0, 0
        for pdf in batches:
            entries, bases = [], []
            for c, i, exits, starts in zip(pdf[conv], pdf["_island"], pdf["exits"], pdf["starts"], strict=True):
                if (c, i) != at:
                    at, entry, base = (c, i), 0, 0
                entries.append(entry)
                bases.append(base)
                entry, base = int(exits[entry]), base + int(starts[entry])
            yield pdf[ids].assign(entry=entries, base=bases)

    def number(_key: tuple, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or at.empty:
            return pdf[[conv, turn, "_island"]].head(0).assign(_chunk=pd.Series(dtype="int64"))
        pdf = pdf.sort_values("_pos")
        length = _chunk_lengths(pdf, max_turns, age)
        marks = np.zeros(len(length), dtype="int64")
        marks[_walk(length, int(at["entry"].iloc[0]))[:-1]] = 1
        mine = pdf[pdf["_mine"]]
        return mine[[conv, turn, "_island"]].assign(_chunk=int(at["base"].iloc[0]) - 1 + np.cumsum(marks))

    reports = spread.groupBy(*ids).applyInPandas(report, f"{key}, _block long, exits array<long>, starts array<long>")
    entered = (
        reports.repartition(F.col(conv), F.col("_island"))
        .sortWithinPartitions(*ids)
        .mapInPandas(follow, f"{key}, _block long, entry long, base long")
    )
    return spread.groupBy(*ids).cogroup(entered.groupBy(*ids)).applyInPandas(number, out)


def flush_stream(
    df: DataFrame, conv: str, turn: str, ts: str, max_turns: int = 5, max_age_seconds: int = 3600, delay: str | None = "0 seconds"
) -> DataFrame:
    """The same rule on a stream: one row per flushed chunk, (conv, chunk, first_turn, last_turn, turns).

    State per conversation is the open chunk, at most ``max_turns`` turns. A chunk left open is flushed
    when the watermark passes its age.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    t = types[turn]
    out = f"{conv} {types[conv]}, chunk long, first_turn {t}, last_turn {t}, turns int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, turns, opened = state.get if state.exists else (0, [], 0.0)
        turns, done = list(turns), []

        def flush() -> None:
            nonlocal chunk, turns
            done.append((key[0], chunk, turns[0], turns[-1], len(turns)))
            chunk, turns = chunk + 1, []

        if state.hasTimedOut:
            flush()
        else:
            rows = pd.concat(list(batches)).sort_values(["_sec", turn])
            for x, sec in zip(rows[turn].tolist(), rows["_sec"].tolist(), strict=True):
                if turns and sec - opened >= max_age_seconds:
                    flush()
                opened = opened if turns else sec
                turns.append(x)
                if len(turns) == max_turns:
                    flush()
        ends = int((opened + max_age_seconds) * 1000) + 1
        if turns and ends <= state.getCurrentWatermarkMs():
            flush()
        state.update((chunk, turns, opened))
        if turns:
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(done, columns=[conv, "chunk", "first_turn", "last_turn", "turns"])

    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        rows = rows.withWatermark(ts, delay)
    rows = rows.select(conv, turn, ts, seconds_of(F.col(ts)).alias("_sec"))
    return rows.groupBy(conv).applyInPandasWithState(
        step, out, f"chunk long, turns array<{t}>, opened double", "append", GroupStateTimeout.EventTimeTimeout
    )
