"""Feature statistics, encodings and feature tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.numeric import stable_uniform
from clickloom.functions.text import words
from clickloom.plans.ranks import exact_quantiles
from clickloom.plans.scans import OrderedRows, running_sum
from clickloom.plans.skew import salted_join, with_group

GRAM_ROWS = 10_000


def corr_cov(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"), F.covar_samp(x, y).alias("covariance"))


def anova_f(df: DataFrame, x: str, group: str) -> DataFrame:
    """One-way ANOVA from per-group moments: F and both degrees of freedom."""
    parts = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")
    )
    sums = parts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    df_b, df_w = F.col("k") - 1, F.col("total") - F.col("k")
    return sums.select(
        ((between / df_b) / (F.col("within") / df_w)).alias("f"), df_b.alias("df_between"), df_w.alias("df_within")
    )


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency cells with both margins and the total on every cell."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.dropna(subset=[a, b])
    both = with_group(with_group(cells, [a], na=F.sum("n")), [b], nb=F.sum("n"))
    return both.withColumn("total", cells.agg(F.sum("n")).scalar())


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic; cells that never occur add their expected count."""
    cells = _cells(df, a, b)
    expected = F.col("na") * F.col("nb") / F.col("total")
    sums = cells.agg(
        F.sum(F.col("n") * F.col("n") / expected).alias("s"),
        F.max("total").alias("total"),
        F.countDistinct(a).alias("ka"),
        F.countDistinct(b).alias("kb"),
    )
    # sum (n - e)^2 / e over all cells equals sum n^2 / e - total, empty cells included.
    return sums.select(
        (F.col("s") - F.col("total")).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof")
    )


def mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information in nats."""
    p = F.col("n") / F.col("total")
    ratio = F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))
    return _cells(df, a, b).agg(F.sum(p * F.log(ratio)).alias("mi"))


def box_stats(df: DataFrame, x: str, group: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and outlier count per level."""
    q = exact_quantiles(df, [group], x, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    joined = salted_join(df.select(group, x).where(F.col(x).isNotNull()), q, [group])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col(x) >= lo) & (F.col(x) <= hi)
    return joined.groupBy(group).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(x))).alias("low_whisker"),
        F.max(F.when(inside, F.col(x))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def discretize(
    df: DataFrame,
    x: str,
    bounds: Sequence[float] | None = None,
    bins: int | None = None,
    quantiles: int | None = None,
    name: str = "bucket",
) -> DataFrame:
    """Bucket number by given bounds, by equal width, or by quantile; bucket b holds lower <= x."""
    if bounds is not None:
        edges = F.array(*[F.lit(float(b)) for b in bounds])
        return df.withColumn(name, F.size(F.filter(edges, lambda e: e <= F.col(x))))
    if bins is not None:
        span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
        step = F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        out = df.withColumns({"_lo": lo, "_hi": hi})
        return out.withColumn(name, F.least(step, F.lit(bins - 1)).cast("int")).drop("_lo", "_hi")
    names = [f"q{i}" for i in range(1, quantiles)]
    cuts = exact_quantiles(df, [], x, [i / quantiles for i in range(1, quantiles)], names)
    edges = cuts.select(F.array(*names)).scalar()
    return df.withColumn("_e", edges).withColumn(
        name, F.size(F.filter("_e", lambda e: e <= F.col(x)))
    ).drop("_e")


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column per given level."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in levels})


def levels_of(df: DataFrame, col: str, most: int = 1_000) -> list:
    """The different values of a column in order, null left out; more than ``most`` are an error, not a cut."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} levels")
    return sorted(found)


def cross(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{a}_x_{b}", F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string")))


def poly_cross(df: DataFrame, cols: Sequence[str], degree: int) -> DataFrame:
    """All products of the columns up to ``degree``, as array ``poly``."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    out = PolynomialExpansion(degree=degree, inputCol="_v", outputCol="_p").transform(vec)
    return out.withColumn("poly", vector_to_array("_p")).drop("_v", "_p")


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name).transform(df)


def target_mean(df: DataFrame, cat: str, label: str, name: str = "encoded") -> DataFrame:
    return with_group(df, [cat], **{name: F.avg(label)})


def target_mean_prior(df: DataFrame, cat: str, label: str, a: float, p: float | None = None, name: str = "encoded") -> DataFrame:
    """Category mean pulled towards the prior: ``(sum + a p) / (n + a)``; p defaults to the overall mean."""
    prior = F.lit(p) if p is not None else df.agg(F.avg(label)).scalar()
    out = with_group(df, [cat], _sum=F.sum(label), _n=F.count(label)).withColumn("_p", prior)
    return out.withColumn(name, (F.col("_sum") + a * F.col("_p")) / (F.col("_n") + a)).drop("_sum", "_n", "_p")


def ordered_target(
    df: DataFrame, cat: str, label: str, id: Sequence[str], a: float, p: float, seed: int, name: str = "encoded"
) -> DataFrame:
    """Target mean from the rows before this one in a seeded permutation, so a row never sees its label."""
    drawn = df.withColumn("_u", stable_uniform(seed, *[F.col(c) for c in id]))
    scan = OrderedRows(drawn, [cat], ["_u", *id]).add(
        _sum=running_sum(F.col(label), inclusive=False), _n=running_sum(F.lit(1), inclusive=False)
    )
    value = (F.col("_sum") + a * p) / (F.col("_n") + a)
    return scan.rows().withColumn(name, value).drop("_u", "_sum", "_n")


def _grams_in(text: str, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different n-grams of a text and their counts, per length; a gram is a row of code points."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    for n in range(low, min(high, len(points)) + 1):
        # Equal grams are found on numbers, three code points in each.
        cells = np.lib.stride_tricks.sliding_window_view(points, n)
        packed = [sum(cells[:, j].astype(np.int64) << (21 * (j - i)) for j in range(i, min(i + 3, n))) for i in range(0, n, 3)]
        if len(packed) == 1:
            _, first, counts = np.unique(packed[0], return_index=True, return_counts=True)
        else:
            _, first, counts = np.unique(np.stack(packed, axis=1), axis=0, return_index=True, return_counts=True)
        yield cells[first], counts


def char_ngrams(df: DataFrame, id: str, text: str, low: int = 1, high: int = 3) -> DataFrame:
    """Counts of the character n-grams of each text: (id, gram, cnt).

    Texts are placed by their id and counted one by one; what leaves a text are its different grams, and no row per character is
    made, shuffled or kept. Texts of one id come after each other and are counted together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(id, text).where(F.col(text).isNotNull()).repartition(max(parts, 4 * df.sparkSession.sparkContext.defaultParallelism), id).sortWithinPartitions(id)
    schema = T.StructType([df.schema[id], T.StructField("gram", T.StringType()), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, of = None, None, None

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            pieces = [(list(more), list(more.values()))] if more is not None else ((_words(g), c) for g, c in _grams_in(held, low, high))
            for grams, counts in pieces:
                for i in range(0, len(grams), GRAM_ROWS):
                    part = pa.array(grams[i : i + GRAM_ROWS], pa.string())
                    ids = pa.array([of], kind).take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, part, pa.array(counts[i : i + GRAM_ROWS], pa.int64())], names=[id, "gram", "cnt"])

        def add(t: str) -> None:
            for grams, counts in _grams_in(t, low, high):
                more.update(dict(zip(_words(grams), counts.tolist(), strict=True)))

        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is not None and i == of:
                    if more is None:
                        more = Counter()
                        add(held)
                    add(t)
                    continue
                if held is not None:
                    yield from out(kind)
                held, more, of = t, None, i
        if held is not None:
            yield from out(kind)

    return placed.mapInArrow(run, schema)


def _words(grams: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    n = grams.shape[1] if len(grams) else 1
    whole = np.ascontiguousarray(grams).tobytes().decode("utf-32-le")
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def hashed_text(df: DataFrame, text: str, size: int = 4096) -> DataFrame:
    return HashingTF(numFeatures=size, inputCol="_w", outputCol="tf").transform(
        df.withColumn("_w", words(F.lower(text)))
    ).drop("_w")


def tfidf_text(df: DataFrame, text: str, size: int = 4096) -> DataFrame:
    tf = hashed_text(df, text, size)
    return IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Every character of the texts with an id from 1, most frequent first."""
    chars = df.select(F.explode(F.split(F.col(text), "")).alias("ch")).where(F.col("ch") != "")
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = OrderedRows(counts, [], ["-cnt", "ch"]).add(char_id=running_sum(F.lit(1))).rows()
    return ranked.withColumn("char_id", F.col("char_id").cast("int"))


def char_ids(df: DataFrame, id: str, text: str, vocab: DataFrame, max_len: int = 10) -> DataFrame:
    """First ``max_len`` characters of every row as ids, padded at the end; unknown and padding are both 0, so is a missing text.

    The vocabulary holds single characters, so it has at most as many rows as there are code points; it comes to the rows as two
    lists in the order of the ids, in which frequent characters are found early. Nothing is shuffled.
    """
    known = vocab.agg(F.array_sort(F.collect_list(F.struct("char_id", "ch"))).alias("_k"))
    chars, numbers = known.select("_k.ch").scalar(), known.select("_k.char_id").scalar()
    first = F.filter(F.slice(F.split(F.col(text), ""), 1, max_len), lambda c: c != "")
    place = lambda c: F.array_position(F.col("_chars"), c).cast("int")
    ids = F.transform(first, lambda c: F.coalesce(F.get(F.col("_numbers"), place(c) - 1), F.lit(0)).cast("int"))
    padded = F.slice(F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array_repeat(F.lit(0), max_len)), 1, max_len)
    return df.withColumns({"_chars": chars, "_numbers": numbers}).select(id, padded.alias("ids"))


def rolling_stats(
    df: DataFrame, item: str, ts: str, spans: Mapping[str, int], tie: Sequence[str] = ()
) -> DataFrame:
    """Events of the item within the last span seconds before each event (the event itself left out).

    Every event enters at its time and leaves when its span has passed; a running sum over these marks
    is the count, with no range frame over a whole item.
    """
    names = list(spans)
    ties = [f"_tie{i}" for i in range(len(tie))]

    def mark(kind: int, wait: int, steps: Mapping[str, int]) -> Column:
        deltas = [F.lit(steps.get(n, 0)).alias(f"_d_{n}") for n in names]
        return F.struct(F.lit(kind).alias("kind"), F.lit(wait).alias("wait"), *deltas)

    # At one instant: spans that ended, then the event looks, then it counts.
    marks = [mark(1, 0, {}), mark(2, 0, dict.fromkeys(names, 1)), *[mark(0, spans[n], {n: -1}) for n in names]]
    rows = df.select(
        F.struct(*df.columns).alias("_row"), F.col(item).alias("_item"), F.col(ts).alias("_t"),
        *[F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)], F.inline(F.array(*marks)),
    )
    gone = F.col("_t") + F.make_dt_interval(secs=F.col("wait")) + F.expr("interval 1 microsecond")
    rows = rows.withColumns({
        "_row": F.when(F.col("kind") == 1, F.col("_row")),
        "_t": F.when(F.col("kind") == 0, gone).otherwise(F.col("_t")),
    })
    scan = OrderedRows(rows, ["_item"], ["_t", "kind", *ties]).add(**{f"_c_{n}": running_sum(F.col(f"_d_{n}")) for n in names})
    seen = scan.rows().where(F.col("kind") == 1)
    return seen.select("_row.*", *[F.col(f"_c_{n}").cast("long").alias(n) for n in names])


def category_share(
    df: DataFrame,
    query: str,
    cat: str,
    ts: str,
    as_of: Column,
    long: int = 30,
    short: int = 7,
    w: tuple[float, float] = (0.5, 0.5),
) -> DataFrame:
    """Predicted category of a query: weighted mean of its click shares over two look-back spans."""
    age_days = F.date_diff(F.to_date(as_of), F.to_date(ts))
    # Bounds of the column's own type reach the scan, which a function of the column would not.
    day = lambda back: F.date_sub(F.to_date(as_of), back).cast(df.schema[ts].dataType)
    clicks = df.where((F.col(ts) >= day(long - 1)) & (F.col(ts) < day(-1)))
    counts = clicks.groupBy(query, cat).agg(F.count(F.lit(1)).alias("_l"), F.count_if(age_days < short).alias("_s"))
    both = with_group(counts.dropna(subset=[query]), [query], _tl=F.sum("_l"), _ts=F.sum("_s"))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    return both.select(query, cat, (w[0] * share("_l", "_tl") + w[1] * share("_s", "_ts")).alias("share"))


def min_max(df: DataFrame, value: str, by: Sequence[str], name: str = "scaled") -> DataFrame:
    out = with_group(df, by, _lo=F.min(value), _hi=F.max(value))
    width = F.col("_hi") - F.col("_lo")
    return out.withColumn(name, F.when(width != 0, (F.col(value) - F.col("_lo")) / width).otherwise(0.0)).drop("_lo", "_hi")
