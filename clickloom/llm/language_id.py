"""Language identification by compression with one raw-content dictionary per language.

A text belongs to the language whose dictionary makes it smallest. The dictionaries are bounded samples of labelled text;
everything else reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.batches import short_batches

UNKNOWN = "und"
SAMPLE_DOCUMENTS = 64
PIECE_CHARS = 2_000
DICTIONARY_BYTES = 112_640
PIECE_BYTES = 2_048
LEVEL = 6
MIN_MARGIN = 0.002
SHORT_BYTES = 64


def _normal(text: str) -> bytes:
    """Lower-case letters with single spaces: marks, digits and capitals say little about the language."""
    words = re.sub(r"[\W\d_]+", " ", text.lower())
    if not words.replace(" ", "").isalpha():  # number signs such as fractions and Roman numerals are word characters, not letters
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.strip().encode()


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    learn: Column | None = None,
    sample_documents: int = SAMPLE_DOCUMENTS,
    piece_chars: int = PIECE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """One dictionary per language from the rows where ``learn`` holds and text and language are given.

    Bounds: ``sample_documents`` texts per language, cut into pieces of ``piece_chars`` characters, and
    ``dictionary_bytes`` of those pieces, all in the order of a hash of the text. Only the dictionaries reach the driver:
    their size is the number of languages times that bound. No labelled rows: no languages.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)).alias("learn"))
    rows = rows.where("learn AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", "text", F.xxhash64("text").alias("h"))
    # Copies count once: the hashes are made distinct before texts are taken.
    order = Window.partitionBy("lang").orderBy("h")
    first = rows.select("lang", "h").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_documents)
    sample = rows.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    starts = F.expr(f"sequence(0, (char_length(text) - 1) div {piece_chars})")
    pieces = sample.select("lang", "text", F.explode(starts).alias("i"))
    pieces = pieces.select("lang", F.expr(f"substring(text, i * {piece_chars} + 1, {piece_chars})").alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    most = max(1, dictionary_bytes // piece_chars + 1)
    few = pieces.distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    found = few.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rn", "piece"))).alias("pieces")).toArrow().to_pylist()
    return {r["lang"]: b"\n".join(_normal(p["piece"]) for p in r["pieces"])[:dictionary_bytes] for r in found}


def _compressors(dictionaries: Mapping[str, bytes], level: int) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for name, raw in sorted(dictionaries.items()):
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out[name] = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def _predict(text: str | None, compressors: Mapping[str, zstandard.ZstdCompressor], min_margin: float) -> tuple[str, float, bool]:
    raw = _normal(text or "")
    if not raw or not compressors:
        return UNKNOWN, 0.0, False
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in compressors.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    margin = 1.0 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], margin, margin >= min_margin or (margin == 0 and len(raw) <= SHORT_BYTES)


def classify(docs: DataFrame, dictionaries: Mapping[str, bytes], text: str = "text", level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` (relative margin to the second smallest, 0 to 1) and ``accepted``.

    A text that is null or has no letter is ``und`` with score 0. ``accepted`` is false for ``und`` and for margins under
    ``min_margin``. Equal sizes go to the first name in alphabetical order (margin 0); they are accepted only for texts of at most
    ``SHORT_BYTES`` bytes of letters, in which whole bytes cannot tell languages apart. A column of ``docs``
    with one of the three names is replaced. Long texts are compressed in pieces, so memory does not follow their length.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value, level)
        for b in batches:
            found = [_predict(t.as_py(), compressors, min_margin) for t in b.column(text)]
            new = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, names=[*kept, "lang_pred", "score", "accepted"])

    return short_batches(docs).select(*kept).mapInArrow(run, schema)
