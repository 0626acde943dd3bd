"""Removal of byte strings that also start elsewhere, by suffix arrays over shards.

Sharding: every window of ``length`` bytes is assigned to its anchor, the smallest hash of ``ANCHOR`` bytes inside it. Equal windows
have equal anchors at the same place, so repeats only have to be looked for among the regions (windows in a row with one
anchor) that share an anchor. Equal regions are counted and sorted once.

Sorting: a shard's window starts are sorted in two stages. Starts whose suffix is smaller than the next one are sorted directly; the
others are put in place by one scan over the buckets of first bytes, each before the one it is larger than. Neighbours with
``length`` common bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.batches import short_batches
from clickloom.plans.stage import written

LENGTH = 200
ANCHOR = 32
CHUNK = 4_000_000
SHARD_BYTES = 3_000_000
HOT_REGIONS = 20_000
# Fixed odd factors of the anchor hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)


def _anchor_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes at every position."""
    n = len(data) - ANCHOR + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for i, factor in enumerate(MIX):
        h ^= words[8 * i : 8 * i + n]
        h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
    return h


def _regions(data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(first window start, number of starts, anchor hash) for the windows of ``data``, in order."""
    for base in range(0, len(data) - length + 1, CHUNK):
        part = data[base : base + CHUNK + length - 1]
        starts, width = len(part) - length + 1, length - ANCHOR + 1
        h = _anchor_hashes(part)
        # Smallest hash, then leftmost: the place fills the low 24 bits.
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        room = -len(key) % width
        rows = np.concatenate([key, np.full(room, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        size = np.diff(first, append=starts)
        for s, n, a in zip((first + base).tolist(), size.tolist(), h[place[first]].view(np.int64).tolist(), strict=True):
            yield s, n, a


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def find_regions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, body, start, n, anchor, region): the regions of every text, with 64-bit hashes of anchor and content."""
    schema = "doc long, body long, start int, n int, anchor long, region long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, body, text in zip(b.column("doc").to_pylist(), b.column("body").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                view = memoryview(data)
                out += [(doc, body, s, n, a, _signed(xxhash.xxh3_64_intdigest(view[s : s + n + length - 1]))) for s, n, a in _regions(data, length)]
                if len(out) > 100_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc": pa.int64(), "body": pa.int64(), "start": pa.int32(), "n": pa.int32(), "anchor": pa.int64(), "region": pa.int64()}
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return docs.mapInArrow(run, schema)


def smaller_than_next(text: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Per position, whether its suffix is smaller than the next one: the first byte that differs decides; none up to the end of the stretch: yes.

    ``lasts`` are the last positions of the stretches.
    """
    stop = np.empty(len(text), bool)
    stop[:-1] = text[:-1] != text[1:]
    stop[lasts] = True
    stops = np.flatnonzero(stop)
    after = np.append(text, 0)
    smaller = after[stops] < after[stops + 1]
    at_end = np.zeros(len(text), bool)
    at_end[lasts] = True
    return np.repeat(smaller | at_end[stops], np.diff(stops, prepend=-1))


def two_stage_order(text: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray, depth: int) -> np.ndarray:
    """The positions from ``starts[i]`` to ``ends[i]`` (exclusive) of every stretch i, in order of the first ``depth`` bytes of their suffixes.

    A stretch's bytes go on to ``limits[i]``. ``small`` is ``smaller_than_next``; it must hold for the last position of each
    stretch that is sorted, so that every larger suffix has its successor among the sorted ones.
    """
    size = len(text)
    chosen = np.zeros(size + 1, np.int8)
    np.add.at(chosen, starts, 1)
    np.add.at(chosen, ends, -1)
    places = np.flatnonzero(np.cumsum(chosen[:size]))
    is_large = np.zeros(size, bool)
    is_large[places] = ~small[places]
    raw = text.tobytes()
    limit = np.repeat(limits, ends - starts)
    directly = small[places]
    # Stage one: direct comparison.
    keyed = [raw[p : min(p + depth, e)] for p, e in zip(places[directly].tolist(), limit[directly].tolist(), strict=True)]
    order = np.array(sorted(range(len(keyed)), key=keyed.__getitem__), np.int64)
    del keyed
    direct = places[directly][order]
    edges = np.searchsorted(text[direct], np.arange(257))
    # Stage two: a larger suffix stands, within its bucket, in the order of the suffixes that follow it.
    is_first = np.zeros(size, bool)
    is_first[starts] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        here = waiting[byte]
        wave = np.concatenate(here) if here else np.empty(0, np.int64)
        larger = []
        while len(wave):
            larger.append(wave)
            wave = wave[~is_first[wave]] - 1
            wave = wave[is_large[wave] & (text[wave] == byte)]
        bucket = np.concatenate([*larger, direct[edges[byte] : edges[byte + 1]]])
        out.append(bucket)
        before = bucket[~is_first[bucket]] - 1
        before = before[is_large[before] & (text[before] > byte)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For every position in ``order`` but the first, the bytes it has in common with the one before, up to ``depth``, by 8-byte words."""
    words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    out = np.zeros(max(0, len(order) - 1), np.int32)
    alive = np.arange(len(out))
    for i in range(0, depth, 8):
        a, b = words[order[alive] + i], words[order[alive + 1] + i]
        differ = a ^ b
        same = differ == 0
        odd = differ[~same]
        low = odd & (~odd + np.uint64(1))
        out[alive[~same]] = i + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
        alive = alive[same]
        out[alive] = i + 8
        if not len(alive):
            break
    return np.minimum(out, depth)


def repeated_starts(regions: list[bytes], counts: np.ndarray, many: np.ndarray, length: int) -> list[np.ndarray]:
    """Per region, which of its first ``counts`` starts begin a window that also starts elsewhere; all do in a region that is there ``many`` times."""
    sizes = np.array([len(r) for r in regions])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(regions) + bytes(8), np.uint8)
    # A stretch goes on behind its last window to the next position that is sorted directly.
    small = smaller_than_next(text[:-8], starts + sizes - 1)
    places = np.flatnonzero(small)
    ends = places[np.searchsorted(places, starts + counts - 1)] + 1
    order = two_stage_order(text[:-8], small, starts, ends, starts + sizes, length)
    order = order[order < np.repeat(starts + counts, sizes)[order]]
    equal = common_prefixes(text, order, length) >= length
    found = np.zeros(len(text), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    return [np.ones(n, bool) if m else found[s : s + n] for s, n, m in zip(starts.tolist(), counts.tolist(), many.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """(doc, body, starts, sizes): runs of window starts of each text (doc id, hash of the text) that also start elsewhere."""
    found = written(find_regions(docs, length), "regions")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1").select("anchor")
    shared = written(shared, "shared-anchors")  # a plain shuffle on both sides lets adaptive execution split hot anchors
    found = written(found.join(shared, "anchor", "left_semi"), "shared-regions")
    # Equal regions count once; the first place stands for them.
    kinds = found.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("doc", "body", "start", "n")).alias("at"))
    kinds = written(kinds.select("anchor", "region", (F.col("cnt") > 1).alias("many"), "at.*"), "region-kinds")
    # Anchors with very many different regions are not sorted in one shard: their windows are counted by hash (see below).
    hot = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > hot_regions).select("anchor", F.lit(True).alias("hot"))
    kinds = kinds.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    total = kinds.agg(F.sum(F.col("n") + length - 1)).first()
    n_shards = max(1, -(-int(total[0] or 0) // shard_bytes))
    wanted = kinds.groupBy("doc", "body").agg(F.collect_list(F.struct("start", "n", "anchor", "region", "many", "hot")).alias("wanted"))
    wanted = written(wanted, "wanted").withColumnsRenamed({"doc": "_doc", "body": "_body"})
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    texts = docs.join(wanted, same).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "anchor", "region", "many", "hot", "n", "data"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
        for b in batches:
            for text, wanted in zip(b.column("text"), b.column("wanted"), strict=True):
                data = text.as_py().encode()
                rows = [(r["anchor"] % n_shards, r["anchor"], r["region"], r["many"], r["hot"], r["n"], data[r["start"] : r["start"] + r["n"] + length - 1]) for r in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)

    cuts = written(texts.mapInArrow(cut, "shard int, anchor long, region long, many boolean, hot boolean, n int, data binary"), "cuts")

    def sort_shard(t: pa.Table) -> pa.Table:
        unique = {(a, r): i for i, (a, r) in enumerate(zip(t["anchor"].to_pylist(), t["region"].to_pylist(), strict=True))}
        t = t.take(pa.array(sorted(unique.values()), pa.int64()))
        masks = repeated_starts(t["data"].to_pylist(), t["n"].to_numpy().astype(np.int64), t["many"].to_numpy(zero_copy_only=False), length)
        runs = [_runs(m) for m in masks]
        out = pa.table({"anchor": t["anchor"], "region": t["region"], "starts": pa.array([r[0] for r in runs], pa.list_(pa.int32())), "sizes": pa.array([r[1] for r in runs], pa.list_(pa.int32()))})
        return out.filter(pa.array([bool(r[0]) for r in runs], pa.bool_()))

    kept = "anchor long, region long, starts array<int>, sizes array<int>"
    sorted_runs = cuts.where("NOT hot").groupBy("shard").applyInArrow(sort_shard, kept)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                view = memoryview(r["data"])
                digests = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(r["n"])]
                n = len(digests)
                arrays = [pa.array([r["anchor"]] * n, pa.int64()), pa.array([r["region"]] * n, pa.int64()), pa.array([r["many"]] * n, pa.bool_()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "region", "many", "start", "window"])

    each = cuts.where("hot").dropDuplicates(["anchor", "region"]).mapInArrow(windows, "anchor long, region long, many boolean, start int, window binary")
    # Windows of a hot anchor: one row per window, spread by the window's own hash.
    twice = each.groupBy("window").agg(F.count(F.lit(1)).alias("cnt"), F.max("many").alias("any")).where("cnt > 1 OR any").select("window")
    hot_runs = each.join(twice, "window").select("anchor", "region", F.array("start").alias("starts"), F.array(F.lit(1)).alias("sizes"))
    runs = written(sorted_runs.union(hot_runs), "runs")
    placed = found.join(runs, ["anchor", "region"]).select("doc", "body", F.transform("starts", lambda s: s + F.col("start")).alias("starts"), "sizes")
    return placed.groupBy("doc", "body").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


def _cut_spans(data: bytes, starts: list[int] | None, sizes: list[int] | None, length: int) -> tuple[bytes, int]:
    """What is left of ``data`` and the number of maximal removed runs."""
    if not starts:
        return data, 0
    a = np.array(starts, np.int64)
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, a, 1)
    np.add.at(cover, a + np.array(sizes, np.int64) + length - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """Every text without the bytes that lie in a ``length``-byte string which also starts anywhere else.

    Columns: doc_id, kept (binary), n_bytes, n_removed, n_spans (maximal removed runs). Texts are UTF-8 bytes, a null text is
    empty; strings are judged on the input, the same text included, and never cross texts; all copies go, the first one too. Texts
    shorter than ``length`` stay. Rows are told apart by id and text: repeated rows and null ids are rows like any other.
    """
    if length < ANCHOR + 8 or length % 8:
        raise ValueError(f"length must be a multiple of 8 of at least {ANCHOR + 8}")
    rows = short_batches(docs).select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    spans = written(repeated_spans(rows, length, shard_bytes, hot_regions), "spans").withColumnsRenamed({"doc": "_doc", "body": "_body"})
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    joined = rows.join(spans, same, "left").select("doc", "text", "starts", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for b in batches:
            out = []
            for doc, text, starts, sizes in zip(b.column("doc").to_pylist(), b.column("text"), b.column("starts"), b.column("sizes"), strict=True):
                data = (text.as_py() or "").encode()
                kept, n = _cut_spans(data, starts.as_py(), sizes.as_py(), length)
                out.append((doc, kept, len(data), len(data) - len(kept), n))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=names)

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
