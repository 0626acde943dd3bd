"""Query co-occurrence, suggestions and correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.text import ngrams_of, normalize_query, paren_text, strip_punctuation, words
from clickloom.operators.relational import byte_length_between, threshold_filter
from clickloom.plans.ranks import numbered, top_n
from clickloom.plans.skew import mirror, salted_join, with_group, within_group_pairs
from clickloom.plans.stage import written


def query_cooccurrence_tfidf(
    df: DataFrame, session: Sequence[str], query: str, min_bytes: int = 3, max_bytes: int = 15
) -> DataFrame:
    """Which queries go with which: TF-IDF of the other queries in a query's sessions, ranked.

    Repeats inside a session are counted first, so a session meets itself only on distinct queries. The
    pair count is symmetric: it is formed for one half, summed, then mirrored.
    """
    kept = byte_length_between(df.where(F.col(query).isNotNull()), query, min_bytes, max_bytes)
    counted = kept.groupBy(*session, query).agg(F.count(F.lit(1)).alias("c"))
    pairs = within_group_pairs(counted, session, query, ["c"])
    half = pairs.groupBy("a", "b").agg(F.sum(F.col("c_a") * F.col("c_b")).alias("tf"))
    # Totals, document frequencies and scores all read the pair counts: write them once.
    half = written(half, "cooccurrence")
    tf = mirror(half, "a", "b").withColumnsRenamed({"a": "base_query", "b": "rec_query"})
    n_docs = tf.agg(F.countDistinct("base_query")).scalar()
    scored = with_group(tf, ["base_query"], _total=F.sum("tf"))
    scored = with_group(scored, ["rec_query"], _df=F.count(F.lit(1))).withColumn("_n", n_docs)
    scored = scored.withColumn("normalized_tf", F.col("tf") / F.col("_total")).withColumn("idf", F.log10(F.col("_n") / F.col("_df")))
    scored = scored.withColumn("tf_idf", F.col("normalized_tf") * F.col("idf"))
    # Rounded for ranking, so that equal scores are ordered by the word on every run.
    scored = scored.withColumn("_r", F.round("tf_idf", 9))
    ranked = numbered(scored, ["base_query"], ["-_r", "rec_query"])
    return ranked.select("base_query", "rec_query", "normalized_tf", "idf", "tf_idf", "rn")


def recommend_for(df: DataFrame, query: str, n: int = 20, date: tuple[str, str] | None = None) -> DataFrame:
    """First ``n`` recommendations of one base query (and one date partition)."""
    rows = df.where(F.col("base_query") == query)
    if date:
        rows = rows.where(F.col(date[0]) == date[1])
    return rows.orderBy("rn").limit(n)


def diversify_suggestions(
    df: DataFrame,
    base: str,
    rec: str,
    rank: str,
    score: str,
    edit: int = 1,
    n: int = 10,
    min_score: float = 0.01,
    stop: Sequence[str] = (),
) -> DataFrame:
    """Greedy pass over a base query's recommendations in rank order, then the thresholds.

    Left out: text that contains or is contained in the base or a word already kept, and words within
    ``edit`` of one. Only ranks up to ``n`` survive the thresholds and a decision depends on earlier
    ranks alone, so the pass stops at rank ``n`` with no effect on the result.
    """
    first = df.where(F.col(rank) <= n)
    lists = first.groupBy(base).agg(F.sort_array(F.collect_list(F.struct(rank, rec, score))).alias("_l"))

    def step(kept: Column, row: Column) -> Column:
        text, word = row[rec], paren_text(row[rec])
        clash = F.exists(
            kept,
            lambda k: F.contains(text, k) | F.contains(k, text) | (F.levenshtein(word, k) <= edit),
        )
        inside = F.contains(F.col(base), text) | F.contains(text, F.col(base))
        return F.when(inside | clash, kept).otherwise(F.array_append(kept, word))

    kept = F.aggregate("_l", F.array().cast("array<string>"), step)
    rows = lists.withColumn("_kept", kept).select(base, "_kept", F.inline("_l"))
    out = rows.where(F.array_contains("_kept", F.col(rec))).drop("_kept")
    return threshold_filter(out, score, min_score, rank, n, stop, rec)


def frequent_queries(
    df: DataFrame, query: str, user: str, log_type: Column, freq: Column, min_users: int = 10
) -> DataFrame:
    """Click count of the queries that more than ``min_users`` distinct users clicked."""
    hits = df.where(log_type & freq)
    return (
        hits.groupBy(query)
        .agg(F.count(F.lit(1)).alias("freq"), F.countDistinct(user).alias("_users"))
        .where(F.col("_users") > min_users)
        .drop("_users")
    )


def _prefixes(text: Column) -> Column:
    return F.when(
        F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, F.lit(1), i))
    ).otherwise(F.array().cast("array<string>"))


def suggestion_keys(df: DataFrame, query: str, syllables: DataFrame | None = None) -> DataFrame:
    """(query, key): the texts under which a query is found while typing.

    Tokens are split on spaces before the punctuation is stripped. ``syllables`` is (token, syllables
    array) for transliterated scripts; a token without an entry is one syllable itself.
    """
    base = df.select(F.col(query).alias("query")).distinct()
    tok = base.withColumn(
        "_tokens", F.filter(F.transform(words(F.col("query")), strip_punctuation), lambda w: w != "")
    )
    tok = tok.where(F.size("_tokens") > 0)
    if syllables is None:
        syl = tok.withColumn("_py", F.transform("_tokens", lambda t: F.lower(t)))
    else:
        flat = tok.select("query", F.posexplode("_tokens").alias("_i", "token")).join(syllables, "token", "left")
        per = flat.groupBy("query").agg(
            F.sort_array(F.collect_list(F.struct("_i", F.coalesce("syllables", F.array(F.lower("token"))).alias("s")))).alias("_s")
        )
        syl = salted_join(tok, per.select("query", F.flatten(F.transform("_s", lambda x: x["s"])).alias("_py")), ["query"])
    py, plain = F.col("_py"), F.array_join("_tokens", "")
    first, second = py[0], F.get(py, F.lit(1))
    several = F.concat(
        F.array(F.array_join(py, ""), F.array_join(py, " "), F.array_join(F.transform(py, lambda s: F.substring(s, 1, 1)), "")),
        _prefixes(first),
        F.transform(_prefixes(second), lambda p: F.concat(first, p)),
        F.transform(_prefixes(second), lambda p: F.concat(F.substring(plain, 1, 1), p)),
        F.array(F.concat(first, F.substring(plain, 2, 1))),
    )
    keys = F.concat(F.array("query"), "_tokens", F.when(F.size(py) > 1, several).otherwise(_prefixes(first)))
    return syl.select("query", F.explode(F.array_distinct(keys)).alias("key"))


def prefix_index(df: DataFrame, key: str, word: str, freq: str, n: int = 10) -> DataFrame:
    """Suggestions ready for lookup: the ``n`` most frequent words for every prefix of every key."""
    keyed = df.select(normalize_query(F.col(key)).alias("_k"), F.col(word).alias("word"), F.col(freq).alias("freq"))
    spread = keyed.select(F.explode(_prefixes(F.col("_k"))).alias("prefix"), "word", "freq")
    unique = spread.groupBy("prefix", "word").agg(F.max("freq").alias("freq"))
    return top_n(unique, ["prefix"], ["-freq", "word"], n)


def suggest(index: DataFrame, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Suggestions for typed prefixes; an empty prefix gets none."""
    asked = prefixes.select(F.col(prefix).alias("typed"), normalize_query(F.col(prefix)).alias("prefix")).distinct()
    return asked.where(F.col("prefix") != "").join(index, "prefix").select("typed", "word", "freq", "rn")


def intent_stages(text: str, label: str, algo: str = "logistic", width: int = 1 << 16) -> Pipeline:
    """Character 1- to 3-gram counts, hashed to ``width`` columns, into a text classifier (logistic, svm, bayes or gbt)."""
    base = {
        "logistic": lambda: LogisticRegression(maxIter=30, regParam=0.01),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01)),
        "bayes": lambda: NaiveBayes(),
        "gbt": lambda: OneVsRest(classifier=GBTClassifier(maxIter=10)),
    }[algo]()
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"),
            HashingTF(inputCol="grams", outputCol="features", numFeatures=width),
            base,
        ]
    )


def with_grams(df: DataFrame, text: str, low: int = 1, high: int = 3) -> DataFrame:
    return df.withColumn("grams", ngrams_of(F.col(text), low, high))


def intent_features(df: DataFrame, text: str, width: int = 1 << 16) -> DataFrame:
    """The rows with their hashed gram counts in ``features``, written once: fitting reads them more than once and scoring again."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=width).transform(with_grams(df, text))
    return written(hashed.drop("grams", text), "intent-features")


def intent_fit(df: DataFrame, text: str, label: str, algo: str = "logistic"):
    """A fitted model of the texts, or of the ``features`` of ``intent_features``, which it then scores too."""
    pipeline = intent_stages(text, label, algo)
    if "features" not in df.columns:
        return pipeline.fit(with_grams(df, text))
    return Pipeline(stages=[x for x in pipeline.getStages() if not isinstance(x, HashingTF)]).fit(df)


def _deletions(text: Column) -> Column:
    """The text and every text with one character less."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text))),
    )
    return F.array_distinct(F.array_append(F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>")), text))


def correct_queries(df: DataFrame, query: str, vocab: DataFrame, word: str, freq: str) -> DataFrame:
    """Most frequent known word within one edit of each unknown query.

    Two texts within one edit share the text itself or a text with one character less, so candidates
    meet by equality on those keys; vocabulary entries of one key are few even if a query is frequent,
    because queries are made distinct first.
    """
    known = vocab.select(F.col(word).alias("word"), F.col(freq).alias("freq"))
    asked = df.select(F.col(query).alias("query")).where(F.col("query").isNotNull()).distinct()
    unknown = asked.join(known.select(F.col("word").alias("query")), "query", "left_anti")
    left = unknown.select("query", F.explode(_deletions(F.col("query"))).alias("_k"))
    right = known.select("word", "freq", F.explode(_deletions(F.col("word"))).alias("_k"))
    near = left.join(right, "_k").where(F.levenshtein("query", "word", 1) >= 0)
    best = near.groupBy("query").agg(F.min(F.struct((-F.col("freq")).alias("neg"), "word")).alias("_b"))
    return best.select("query", F.col("_b.word").alias("word"), (-F.col("_b.neg")).alias("freq"))


def fallback_queries(df: DataFrame, query: str, n_results: str, synonyms: DataFrame) -> DataFrame:
    """Synonym or hypernym to run instead where a query found nothing; (query, term) in ``synonyms``.

    Of several terms for a query the first in alphabetical order counts; every row stays one row.
    """
    table = synonyms.select(F.col(synonyms.columns[0]).alias(query), F.col(synonyms.columns[1]).alias("_term"))
    joined = df.join(table.groupBy(query).agg(F.min("_term").alias("_term")), query, "left")
    used = F.when((F.col(n_results) == 0) & F.col("_term").isNotNull(), F.col("_term")).otherwise(F.col(query))
    return joined.withColumn("run_query", used).drop("_term")


def text_rank(positions: DataFrame, id: str, pos: str, word: str, window: int = 2, iters: int = 10, damping: float = 0.85) -> DataFrame:
    """Word weight by PageRank on the graph of words that stand close together, over all texts.

    Edges are summed per word pair before the first step; a step is one join on the word and one sum.
    """
    shifts = F.explode(F.array(*[F.lit(d) for d in range(1, window + 1)]))
    ahead = positions.select(id, F.col(pos), F.col(word).alias("src"), shifts.alias("_d"))
    ahead = ahead.select(id, (F.col(pos) + F.col("_d")).alias(pos), "src")
    near = ahead.join(positions.select(id, pos, F.col(word).alias("dst")), [id, pos]).where(F.col("src") != F.col("dst"))
    half = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.count(F.lit(1)).alias("w")
    )
    edges = mirror(half, "src", "dst")
    edges = with_group(edges, ["src"], _out=F.sum("w")).select("src", "dst", (F.col("w") / F.col("_out")).alias("p"))
    # Written once to the shared folder: every step reads it again.
    edges = written(edges, "textrank")
    rank = edges.select(F.col("src").alias("word"), F.lit(1.0).alias("weight")).distinct()
    for _ in range(iters):
        sent = edges.join(rank.withColumnRenamed("word", "src"), "src")
        got = sent.groupBy(F.col("dst").alias("word")).agg(F.sum(F.col("p") * F.col("weight")).alias("_g"))
        rank = got.select("word", (F.lit(1 - damping) + damping * F.col("_g")).alias("weight"))
    return rank


