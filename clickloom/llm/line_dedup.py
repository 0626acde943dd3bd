"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches. The runs hold, for every line key seen so far, the document that holds it first. A batch is
merge-joined with the runs: its keys that are in no run form a new run, and its lines whose key belongs to an earlier
document are dropped. Once a level has as many runs as the fan-out, they are merged into one run of the next level, so a key is
rewritten a logarithmic number of times. All work is column code; runs are Parquet under the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.stage import written

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
FAN_OUT = 4
KEY = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(_doc, _body, _line, _h1, _h2): a row per line whose key is long enough; the key is a 128-bit hash, ``_body`` a hash of the text. Rows without an id have none."""
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_body"), F.posexplode(F.split(text, "\n")).alias("_line", "_text"))
    keys = lines.select("_doc", "_body", "_line", line_key(F.col("_text")).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keys.select("_doc", "_body", "_line", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))


class LineRuns:
    """The levelled runs: each run is (key, first document), sorted by key, and a key is in one run only."""

    def __init__(self, fan_out: int = FAN_OUT):
        self.fan_out = fan_out
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> DataFrame:
        return written(df.repartition(*KEY).sortWithinPartitions(*KEY), "line-run")

    def _put(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            merged = reduce(DataFrame.union, self.levels[level])
            self.levels[level] = []
            self._put(self._write(merged), level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``line_rows`` and return its lines to drop: (_doc, _body, _line).

        Within a batch the smallest document holds the key; documents of later batches must not have smaller ids.
        """
        firsts = lines.groupBy(*KEY).agg(F.min("_doc").alias("_first"))
        old = self.runs()
        for run in old:
            firsts = firsts.join(run.select(*KEY), KEY, "left_anti")
        self._put(self._write(firsts))
        # Each key is in one run, so this is a look-up; the lines of a hot key are split by adaptive execution.
        seen = reduce(DataFrame.union, self.runs())
        return lines.join(seen, KEY).where(F.col("_first") < F.col("_doc")).select("_doc", "_body", "_line")


def drop_lines(docs: DataFrame, drops: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten, ``n_lines`` (before) and ``n_dropped``. Rows without drops stay as they are."""
    gone = drops.groupBy("_doc", "_body").agg(F.collect_set("_line").alias("_gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The row travels as one struct, so its column names cannot clash with those of the join.
    rows = docs.select(F.struct(*kept).alias("row"), F.split(F.coalesce(text, F.lit("")), "\n").alias("_lines"))
    rows = rows.join(gone, (F.col(f"row.{doc_id}") == F.col("_doc")) & (F.xxhash64(f"row.{text}") == F.col("_body")), "left")
    # Positions that stay, by hashing; then one look-up per line: linear in the text however much is dropped.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    return rows.select(
        *[(F.when(F.col("_gone").isNull(), F.col(f"row.{c}")).otherwise(rest).alias(c) if c == text else F.col(f"row.`{c}`")) for c in kept],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = 4, fan_out: int = FAN_OUT) -> DataFrame:
    """Drop every line whose key also stands in a document with a smaller id; see ``line_key``.

    ``docs`` is taken in ``batches`` ranges of ascending ids (approximate quantiles; their number changes the work, not the
    result). A null or empty text is one empty line. Rows without an id keep their text and hold no key; rows that share an id are
    one document: a key is dropped from none of them or from all. A key twice in one document only is no repeat.
    An empty table gives an empty table.
    """
    ids = docs.where(F.col(doc_id).isNotNull())
    cuts = sorted(set(ids.approxQuantile(doc_id, [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    bounds = [None, *(int(c) for c in cuts), None]
    store, drops = LineRuns(fan_out), []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = ids
        if low is not None:
            part = part.where(F.col(doc_id) > low)
        if high is not None:
            part = part.where(F.col(doc_id) <= high)
        drops.append(store.add(written(line_rows(part, doc_id, text, min_chars), "lines")))
    return drop_lines(docs, reduce(DataFrame.union, drops), doc_id, text)
