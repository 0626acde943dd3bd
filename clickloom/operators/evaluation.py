"""Model and judgement reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.scans import OrderedRows, running_sum
from clickloom.sources.keyed import upsert


def auc_logloss(df: DataFrame, label: str, prob: str) -> DataFrame:
    """AUC by average ranks and mean log loss, one row.

    Equal scores are counted first, so the ordered pass sees distinct scores only.
    """
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    by_score = df.groupBy(F.col(prob).alias("_p")).agg(
        F.sum(F.col(label)).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"), F.sum(loss).alias("_loss")
    )
    ranked = OrderedRows(by_score, [], ["_p"]).add(_below=running_sum(F.col("_neg"), inclusive=False)).rows()
    won = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)
    sums = ranked.agg(
        F.sum(won).alias("won"), F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"), F.sum("_loss").alias("loss")
    )
    return sums.select(
        (F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"),
        (F.col("loss") / (F.col("pos") + F.col("neg"))).alias("logloss"),
    )


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, f1 and support per class, and the overall accuracy on every row."""
    cells = df.groupBy(F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.explode(
        F.array(
            F.struct(F.col("_l").alias("class"), F.lit(1).alias("is_label")),
            F.struct(F.col("_p").alias("class"), F.lit(0).alias("is_label")),
        )
    ).alias("s")
    hit = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)
    long = cells.select(sides, "_n", hit.alias("_hit"))
    per = long.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.is_label") == 1, F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_label") == 0, F.col("_n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.is_label") == 1, F.col("_hit")).otherwise(0)).alias("tp"),
    )
    accuracy = cells.agg((F.sum(hit) / F.sum("_n")).alias("accuracy")).scalar()
    zero = F.lit(0.0)
    return per.select(
        "class",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zero).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero).alias("recall"),
        F.when(
            F.col("predicted") + F.col("support") > 0, 2 * F.col("tp") / (F.col("predicted") + F.col("support"))
        ).otherwise(zero).alias("f1"),
        F.col("support").cast("long").alias("support"),
    ).withColumn("accuracy", accuracy)


def verdict_tally(df: DataFrame, verdict: str, state: str) -> DataFrame:
    """Judged rows per verdict, and how many rows still wait for one."""
    remaining = df.agg((F.count(F.lit(1)) - F.sum(state)).alias("remaining")).scalar()
    counts = df.where(F.col(state) == 1).groupBy(verdict).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("remaining", remaining)


def unpivot_providers(df: DataFrame, id: Sequence[str], fields: Sequence[str], providers: Sequence[str]) -> DataFrame:
    """Columns ``<field>_<provider>`` to one row per id and provider with a column per field."""
    per = [
        F.struct(F.lit(p).alias("provider"), *[F.col(f"{f}_{p}").cast("string").alias(f) for f in fields])
        for p in providers
    ]
    return df.select(*id, F.inline(F.array(*per)))


def mark_judged(df: DataFrame, judged: DataFrame, key: str, score: str, now: Column) -> DataFrame:
    """Write the verdict of the judged keys with state 1 and the time."""
    updates = judged.select(key, F.col(score), F.lit(1).alias("state"), now.alias("score_time"))
    return upsert(df, updates, [key])
