"""From raw documents to token ids in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A stage's
result is written as Parquet and read again as the next one's input. Extra columns pass through; rows without an id are kept unless a
rule says otherwise, and an empty table runs through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join
from clickloom.llm.queries import POWERS, topic, vocabulary
from clickloom.plans.stage import written

# Expected tokens of the mix as a part of all tokens; a value that holds too few for its target gives all it has.
BUDGET = 1.0
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def extra_columns_aside(stage: Stage) -> Stage:
    """The stage with the input's further columns under neutral names while it runs, so that none of its own can replace them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in DOCUMENTS else f"_extra{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


@extra_columns_aside
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose two best languages are too close to tell apart."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return language_id.classify(docs, language_id.train(docs, learn=learn)).where("accepted").select(*docs.columns)


@extra_columns_aside
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that stand in a document with a smaller id; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@extra_columns_aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, rows without an id last; rows that agree in id and
    text count once. Groups are made of rows, not of ids: different texts under one id part or join by their words alone."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = ngram_join.near_duplicates(keyed, doc_id="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    named = keyed.select("_row", "doc_id").distinct().join(groups, "_row")
    best = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("best"))
    stay = written(best.select("best._row"), "stay")
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


@extra_columns_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics come near to flattened shares of the tokens."""
    marked = docs.withColumns({"_topic": topic(F.col("text")), "_tokens": mixing.word_count(F.col("text"))})
    dims = {"source": POWERS["source"], "lang": POWERS["lang"], "_topic": POWERS["topic"]}
    cells = written(mixing.cell_tokens(marked, list(dims), "_tokens"), "cells")
    targets = {d: mixing.flattened(cells, d, p) for d, p in dims.items()}
    return mixing.mix(marked, list(dims), targets, BUDGET, tokens="_tokens").where("sampled").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit integers), and whether decoding gives the text back."""
    full = byte_bpe.encode_checked(docs.select("doc_id", "source", "lang", "text"), vocabulary())
    return full.select("doc_id", "source", "lang", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_tokens),
]

# The first stage compresses texts, which SQL cannot say; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
