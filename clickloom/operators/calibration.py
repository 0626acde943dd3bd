"""Probabilities for classifier scores: cross-fitted scores, pool-adjacent-violators per class, and a report on held-out rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from clickloom.functions.numeric import stable_uniform
from clickloom.operators.evaluation import classification_report
from clickloom.operators.search import with_grams
from clickloom.plans.stage import written
from clickloom.session import input_bytes, scan_bytes

BINS = 1_000
FITS_AT_ONCE = 8


def score_code(score: Column, bins: int = BINS) -> Column:
    """The bin, 0 to ``bins`` - 1, of a score of any size: equal steps of its logistic curve. No score has no bin."""
    return F.when(score.isNotNull(), F.least(F.lit(bins - 1), F.floor(F.lit(float(bins)) / (1 + F.exp(-score))))).cast("int")


def pooled(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The non-decreasing rates closest to ``positives / totals``: neighbours that fall are pooled until none do."""
    sums, sizes, spans = [], [], []
    for p, n in zip(positives.tolist(), totals.tolist(), strict=True):
        sums.append(p)
        sizes.append(n)
        spans.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            p, n, s = sums.pop(), sizes.pop(), spans.pop()
            sums[-1], sizes[-1], spans[-1] = sums[-1] + p, sizes[-1] + n, spans[-1] + s
    return np.repeat(np.array(sums, float) / np.array(sizes, float), spans)


def calibration_table(scored: DataFrame, score: str, target: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(*by, code, n, positives, rate): per class and score bin the calibrated rate of rows whose ``target`` is 1.

    Rows meet as counts per bin, so a class costs at most ``bins`` short rows whatever its size; only bins with rows are listed.
    Rows without a score or target take no part.
    """
    by = list(by)
    rows = scored.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    counted = rows.groupBy(*by, score_code(F.col(score), bins).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("positives"))

    def pool(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("code", ignore_index=True)
        return group.assign(rate=pooled(group["positives"].to_numpy(), group["n"].to_numpy()))

    schema = counted.withColumn("rate", F.lit(0.0)).schema
    return counted.groupBy(*by).applyInPandas(pool, schema)


def calibrated(df: DataFrame, table: DataFrame, score: str, by: Sequence[str] = (), bins: int = BINS, name: str = "probability") -> DataFrame:
    """The rows with the rate of their score: that of the highest listed bin at or below it, else of the lowest one.

    A class that the table does not know has no rate. The filled table has ``bins`` rows per class; Spark sees its size and decides how to join.
    """
    by = list(by)
    spark = df.sparkSession
    codes = spark.range(bins).select(F.col("id").cast("int").alias("code"))
    classes = table.select(*by).distinct() if by else spark.range(1).select(F.lit(1).alias("_one"))
    grid = classes.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else codes
    filled = grid.join(table.select(*by, "code", "rate"), [*by, "code"], "left")
    up, down = Window.partitionBy(*by).orderBy("code"), Window.partitionBy(*by).orderBy(F.desc("code"))
    filled = filled.withColumn(name, F.coalesce(F.last("rate", ignorenulls=True).over(up), F.last("rate", ignorenulls=True).over(down)))
    filled = written(filled.select(*by, F.col("code").alias("_code"), name), "calibration")
    return df.withColumn("_code", score_code(F.col(score), bins)).join(filled, [*by, "_code"], "left").drop("_code")


def _hashed(hashing: HashingTF, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(*keep, features): the rows' own ``features``, or those of their grams."""
    rows = rows if "features" in rows.columns else hashing.transform(rows.select(*keep, "grams"))
    return rows.select(*keep, "features")


def _margin_model(rows: DataFrame, label_index: str, iters: int, width: int, classes: Sequence[str]) -> tuple[HashingTF, np.ndarray, np.ndarray]:
    """One linear margin per class against all others: the hashing, a row of weights and an intercept per class."""
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=width)
    data = _hashed(hashing, rows, [label_index])
    spark = rows.sparkSession

    @inheritable_thread_target(spark)
    def fit(i: int) -> LinearSVCModel:
        return LinearSVC(maxIter=iters, regParam=0.01, labelCol="_is").fit(data.withColumn("_is", (F.col(label_index) == i).cast("double")))

    # A fit is a chain of short jobs, which leave most cores idle on small tables; large ones fill them, and each fit keeps its rows.
    with ThreadPool(FITS_AT_ONCE if input_bytes(data) <= scan_bytes(spark) else 1) as pool:
        fits = pool.map(fit, range(len(classes)), chunksize=1)
    return hashing, np.array([m.coefficients.toArray() for m in fits]).reshape(len(fits), width), np.array([m.intercept for m in fits])


def class_scores(model: tuple[HashingTF, np.ndarray, np.ndarray], rows: DataFrame, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(*keep, class, place, score): one row per class with the row's margin. Only the weights go to the tasks, no fitted model."""
    hashing, weights, intercepts = model
    hashed = _hashed(hashing, rows, keep)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, places, counts = b.column("features").flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
            at, x = places.flatten().to_numpy(), counts.flatten().to_numpy()
            found = np.stack([np.bincount(row, w[at] * x, b.num_rows) for w in weights], axis=1) + intercepts
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(weights), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], names=[*keep, "margins"])

    scored = hashed.mapInArrow(margins, T.StructType([*[hashed.schema[c] for c in keep], T.StructField("margins", T.ArrayType(T.DoubleType()))]))
    named = F.transform(F.lit(list(classes)), lambda c, i: F.struct(c.alias("class"), i.alias("place"), F.get("margins", i).alias("score")))
    return scored.select(*keep, F.inline(named))


def cross_fitted_scores(rows: DataFrame, id: Sequence[str], label: str, folds: int, seed: int, iters: int, width: int, classes: Sequence[str]) -> DataFrame:
    """(*id, label, class, place, score): every row is scored by a model that has not seen its fold."""
    marked = rows.withColumn("_fold", F.floor(stable_uniform(seed, *[F.col(c) for c in id]) * folds).cast("int"))
    out = None
    for fold in range(folds):
        model = _margin_model(marked.where(F.col("_fold") != fold), "_label", iters, width, classes)
        part = class_scores(model, marked.where(F.col("_fold") == fold), classes, [*id, label])
        out = part if out is None else out.unionByName(part)
    return out


def calibrated_intents(df: DataFrame, id: Sequence[str], text: str, label: str, held_out: float = 0.3, folds: int = 3, seed: int = 5, iters: int = 10, width: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(predictions, report) on the held-out rows of a margin classifier over character n-grams with calibrated probabilities.

    A hash of ``id`` holds out the share ``held_out``. The rest is scored crosswise in ``folds``; each class's scores are calibrated against
    its labels, and the model fitted on all of the rest scores the held-out rows. Probabilities of a row are scaled to sum 1
    (equal ones if all rates are 0); the prediction is the most likely class, ties in alphabetical order. The report gives
    precision, recall, f1 and support per class. Rows without a label or text take no part. The number of classes must be that of
    labels, not of rows: they come to the driver.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(*id, text, label)
    rows = rows.withColumn("_held", stable_uniform(seed + 1, *[F.col(c) for c in id]) < held_out)
    # Every fit reads the rows several times and scoring again: grams are made and hashed once.
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=width)
    rows = written(hashing.transform(with_grams(rows, text)).drop("grams", text), "features")
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows.where("NOT _held"))
    classes = list(index.labels)
    train, test = index.transform(rows.where("NOT _held")), index.transform(rows.where("_held"))
    crossed = written(cross_fitted_scores(train, id, label, folds, seed, iters, width, classes), "cross-fitted")
    table = calibration_table(crossed.withColumn("_hit", (F.col("class") == F.col(label)).cast("int")), "score", "_hit", ["class"])
    final = _margin_model(train, "_label", iters, width, classes)
    scored = calibrated(class_scores(final, test, classes, [*id, label]), table, "score", ["class"])
    best = F.max_by("class", F.struct("probability", -F.col("place"))).alias("prediction")
    whole = F.sum("probability")
    top = F.when(whole > 0, F.max("probability") / whole).otherwise(F.lit(1.0 / max(1, len(classes))))
    predictions = written(scored.groupBy(*id, label).agg(best, top.alias("probability")), "predictions")
    return predictions, written(classification_report(predictions, label, "prediction"), "report")


def log_loss_by_class(scored: DataFrame, probability: str, target: str, by: Sequence[str]) -> DataFrame:
    """(*by, logloss): mean negative logarithm of the probability given to what happened, cut at 1e-9."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(probability)))
    return scored.groupBy(*by).agg(F.avg(-F.when(F.col(target) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"))
