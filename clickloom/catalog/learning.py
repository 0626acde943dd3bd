"""Queries on feature statistics, encodings, training sets and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.catalog.registry import EV, IMP, WEIGHTS, WSQL, Tables, query, r6, uniform_sql
from clickloom.functions.numeric import sigmoid
from clickloom.operators import evaluation, features, training, trees

LABELLED = "(SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_linestatus, l_returnflag, CAST(l_returnflag = 'R' AS INTEGER) AS label, p_type, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"


def labelled(t: Tables) -> DataFrame:
    li = t.lineitem.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return li.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


@query(
    "fe1_corr_cov",
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem",
)
def fe1(t: Tables) -> DataFrame:
    out = features.corr_cov(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select(r6("pearson").alias("pearson"), r6("covariance", 2).alias("covariance"))


@query(
    "fe2_anova_f",
    f"WITH g AS (SELECT p_type, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM {LABELLED} x GROUP BY 1), a AS (SELECT count(*) AS k, sum(n) AS t, sum(n * m) / sum(n) AS gm, sum(n * v) AS w FROM g) "
    "SELECT round((SELECT sum(n * pow(m - gm, 2)) FROM g, a) / (k - 1) / (w / (t - k)), 5) AS f, CAST(k - 1 AS BIGINT) AS df_between, CAST(t - k AS BIGINT) AS df_within FROM a",
)
def fe2(t: Tables) -> DataFrame:
    return features.anova_f(labelled(t), "l_extendedprice", "p_type").withColumn("f", r6("f", 5))


CELLS = (
    f"c AS (SELECT p_brand AS a, l_returnflag AS b, count(*) AS n FROM {LABELLED} x GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), "
    "rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), tt AS (SELECT sum(n) AS t FROM c)"
)


@query(
    "fe3_chi_square",
    f"WITH {CELLS} SELECT round(sum(pow(coalesce(n, 0) - na * nb / t, 2) / (na * nb / t)), 5) AS chi2, CAST((count(DISTINCT ra.a) - 1) * (count(DISTINCT rb.b) - 1) AS BIGINT) AS dof FROM ra CROSS JOIN rb CROSS JOIN tt LEFT JOIN c ON c.a = ra.a AND c.b = rb.b",
)
def fe3(t: Tables) -> DataFrame:
    out = features.chi_square(labelled(t), "p_brand", "l_returnflag")
    return out.select(r6("chi2", 5).alias("chi2"), F.col("dof").cast("long").alias("dof"))


@query("fe4_mutual_info", f"WITH {CELLS} SELECT round(sum(n / t * ln(n * t / (na * nb))), 9) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b) CROSS JOIN tt")
def fe4(t: Tables) -> DataFrame:
    return features.mutual_info(labelled(t), "p_brand", "l_returnflag").select(r6("mi", 9).alias("mi"))


@query(
    "fe5_box_stats",
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, "
    "round(any_value(q3), 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS low_whisker, max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS high_whisker, "
    "count(*) FILTER (NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1",
)
def fe5(t: Tables) -> DataFrame:
    out = features.box_stats(t.events, "value", "event_type")
    return out.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("fe6_discretize_bounds", "SELECT event_id, CAST(CASE WHEN value >= 90 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS INTEGER) AS bucket FROM events")
def fe6(t: Tables) -> DataFrame:
    return features.discretize(t.events, "value", bounds=[10, 50, 90]).select("event_id", "bucket")


@query(
    "fe6_discretize_width",
    "SELECT event_id, CAST(least(floor((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 10), 9) AS INTEGER) AS bucket FROM events",
)
def fe6_width(t: Tables) -> DataFrame:
    return features.discretize(t.events, "value", bins=10).select("event_id", "bucket")


@query(
    "fe6_discretize_quantile",
    "WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS c FROM events) SELECT event_id, CAST(CAST(value >= c[1] AS INTEGER) + CAST(value >= c[2] AS INTEGER) + CAST(value >= c[3] AS INTEGER) AS INTEGER) AS bucket FROM events, q",
)
def fe6_quantile(t: Tables) -> DataFrame:
    return features.discretize(t.events, "value", quantiles=4).select("event_id", "bucket")


@query("fe7_one_hot", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type_click, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM events")
def fe7(t: Tables) -> DataFrame:
    return features.one_hot(t.events.select("event_id", "event_type"), "event_type", ["click", "view"]).drop("event_type")


@query(
    "fe7_one_hot_levels",
    "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders",
)
def fe7_levels(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return features.one_hot(rows, "o_orderstatus", features.levels_of(rows, "o_orderstatus")).drop("o_orderstatus")


@query("fe8_cross", "SELECT p_partkey, p_brand || '_' || p_type AS bt FROM part")
def fe8(t: Tables) -> DataFrame:
    return features.cross(t.part, "p_brand", "p_type", "bt").select("p_partkey", "bt")


@query(
    "fe9_poly_cross",
    "SELECT p_partkey, round(x, 6) AS p1, round(x * x, 6) AS p2, round(y, 6) AS p3, round(x * y, 6) AS p4, round(y * y, 6) AS p5 FROM (SELECT p_partkey, p_size / 10.0 AS x, p_retailprice / 1000 AS y FROM part)",
)
def fe9(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    out = features.poly_cross(rows, ["x", "y"], 2)
    return out.select("p_partkey", *[r6(F.col("poly")[i]).alias(f"p{i + 1}") for i in range(5)])


@query("fe10_target_mean", f"SELECT l_orderkey, l_partkey, p_brand, round(avg(label) OVER (PARTITION BY p_brand), 6) AS encoded FROM {LABELLED} x")
def fe10(t: Tables) -> DataFrame:
    rows = labelled(t).select("l_orderkey", "l_partkey", "p_brand", "label")
    return features.target_mean(rows, "p_brand", "label").drop("label").withColumn("encoded", r6("encoded"))


@query(
    "fe11_target_mean_prior",
    f"SELECT l_orderkey, l_partkey, p_brand, round((sum(label) OVER (PARTITION BY p_brand) + 20 * (SELECT avg(label) FROM {LABELLED} y)) / (count(*) OVER (PARTITION BY p_brand) + 20), 6) AS encoded FROM {LABELLED} x",
)
def fe11(t: Tables) -> DataFrame:
    rows = labelled(t).select("l_orderkey", "l_partkey", "p_brand", "label")
    return features.target_mean_prior(rows, "p_brand", "label", 20.0).drop("label").withColumn("encoded", r6("encoded"))


@query(
    "fe12_ordered_target",
    f"SELECT event_id, round((coalesce(sum(label) OVER w, 0) + 2.0 * 0.2) / (count(*) OVER w + 2.0), 6) AS encoded FROM (SELECT event_id, k, CAST(event_type = 'purchase' AS INTEGER) AS label, {uniform_sql(5, 'event_id')} AS u FROM {EV} e) "
    "WINDOW w AS (PARTITION BY k ORDER BY u, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def fe12(t: Tables) -> DataFrame:
    rows = t.ev.select("event_id", "k", (F.col("event_type") == "purchase").cast("int").alias("label"))
    out = features.ordered_target(rows, "k", "label", ["event_id"], 2.0, 0.2, 5)
    return out.select("event_id", r6("encoded").alias("encoded"))


@query(
    "fe13_char_ngrams",
    "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents), "
    "g AS (SELECT doc_id, c AS g1, c || lead(c, 1) OVER w AS g2, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS g3 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)) "
    "SELECT gram, CAST(count(*) AS BIGINT) AS cnt, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, g1 AS gram FROM g UNION ALL SELECT doc_id, g2 FROM g UNION ALL SELECT doc_id, g3 FROM g) WHERE gram IS NOT NULL GROUP BY 1",
)
def fe13(t: Tables) -> DataFrame:
    grams = features.char_ngrams(t.texts, "doc_id", "text", 1, 3)
    return grams.groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("docs"))


@query("fe14_tfidf_text")
def fe14(t: Tables) -> DataFrame:
    out = features.tfidf_text(t.texts, "text", 1024)
    return out.select("doc_id", r6(F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda s, x: s + x)).alias("weight"))


VOCAB = "(SELECT ch, row_number() OVER (ORDER BY count(*) DESC, ch) AS id FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1)"


@query(
    "fe15_char_ids",
    f"WITH v AS {VOCAB}, c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, generate_subscripts(string_split(p_name, ''), 1) AS pos FROM part), g AS (SELECT p_partkey, list(coalesce(id, 0) ORDER BY pos) AS ids FROM c LEFT JOIN v USING (ch) GROUP BY 1) "
    "SELECT p_partkey, array_to_string(list_resize(ids, 10, 0), ',') AS ids FROM g",
)
def fe15(t: Tables) -> DataFrame:
    vocab = features.vocabulary(t.part, "p_name")
    out = features.char_ids(t.part, "p_partkey", "p_name", vocab, 10)
    return out.select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("fe16_assemble", "SELECT p_partkey, round(p_size + p_retailprice, 6) AS total FROM part")
def fe16(t: Tables) -> DataFrame:
    out = features.assemble(t.part, ["p_size", "p_retailprice"]).withColumn("_a", vector_to_array("features"))
    return out.select("p_partkey", r6(F.col("_a")[0] + F.col("_a")[1]).alias("total"))


@query(
    "fe17_rolling_stats",
    "SELECT event_id, (SELECT count(*) FROM " + EV + " f WHERE f.k = e.k AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 86400 SECOND) AS last_day, "
    "(SELECT count(*) FROM " + EV + " f WHERE f.k = e.k AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 604800 SECOND) AS last_week FROM " + EV + " e",
)
def fe17(t: Tables) -> DataFrame:
    rows = t.ev.select("event_id", "k", "ts")
    out = features.rolling_stats(rows, "k", "ts", {"last_day": 86400, "last_week": 604800}, ["event_id"])
    return out.select("event_id", "last_day", "last_week")


@query(
    "fe18_category_share",
    f"WITH c AS (SELECT k, event_type, count(*) AS l, count(*) FILTER (date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') < 7) AS s FROM {EV} e WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') BETWEEN 0 AND 29 GROUP BY 1, 2) "
    "SELECT k, event_type, round(0.5 * l / sum(l) OVER (PARTITION BY k) + 0.5 * CASE WHEN sum(s) OVER (PARTITION BY k) > 0 THEN s / sum(s) OVER (PARTITION BY k) ELSE 0 END, 6) AS share FROM c",
)
def fe18(t: Tables) -> DataFrame:
    out = features.category_share(t.ev, "k", "event_type", "ts", F.lit("2024-01-30"))
    return out.withColumn("share", r6("share"))


@query(
    "tr1_cap_per_user",
    f"SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {uniform_sql(4, 'event_id')}, event_id) AS rn FROM events) WHERE rn <= 20",
)
def tr1(t: Tables) -> DataFrame:
    return training.cap_per_user(t.events.select("event_id", "user_id"), "user_id", 20, 4, ["event_id"])


@query("tr2_skip_above", f"SELECT request, item, pos, clicked FROM (SELECT *, max(CASE WHEN clicked = 1 THEN pos END) OVER (PARTITION BY request) AS m FROM {IMP} i) WHERE clicked = 1 OR pos < m")
def tr2(t: Tables) -> DataFrame:
    return training.skip_above(t.imp.select("request", "item", "pos", "clicked"), ["request"], "pos", "clicked")


@query(
    "tr3_sample_ratio",
    f"WITH l AS (SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events), n AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(6, 'event_id')}, event_id) AS rn FROM l WHERE label = 0) "
    "SELECT event_id, label FROM l WHERE label = 1 UNION ALL SELECT event_id, label FROM n WHERE rn <= (SELECT floor(sum(label) * 3 / 2) FROM l)",
)
def tr3(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return training.sample_ratio(rows, "label", 2, 3, 6, ["event_id"])


@query(
    "tr4_resolve_conflicts",
    f"WITH e AS (SELECT event_id, user_id, k, ts, CAST(event_type = 'click' AS INTEGER) AS label FROM {EV} x WHERE event_type IN ('click', 'view')) SELECT event_id, label FROM e WHERE label = 1 OR (NOT EXISTS (SELECT 1 FROM e p WHERE p.user_id = e.user_id AND p.k = e.k "
    "AND p.label = 1 AND p.ts BETWEEN e.ts - INTERVAL 24 HOUR AND e.ts + INTERVAL 24 HOUR) AND NOT EXISTS (SELECT 1 FROM e n WHERE n.user_id = e.user_id AND n.k = e.k AND n.label = 0 AND n.ts > e.ts AND n.ts <= e.ts + INTERVAL 24 HOUR))",
)
def tr4(t: Tables) -> DataFrame:
    rows = t.ev.where("event_type IN ('click', 'view')").withColumn("label", (F.col("event_type") == "click").cast("int"))
    out = training.resolve_conflicts(rows, "user_id", "k", "ts", "label", tie=["event_id"])
    return out.select("event_id", "label")


@query("tr6_query_group_sizes")
def tr6(t: Tables) -> DataFrame:
    return training.query_group_sizes(t.lineitem.select("l_orderkey"), "l_orderkey", 8)


@query(
    "tr7_pairwise",
    f"SELECT a.request, a.pos AS better, b.pos AS worse, round(a.l_quantity - b.l_quantity, 6) AS l_quantity FROM {IMP} a JOIN {IMP} b ON a.request = b.request AND a.clicked > b.clicked",
)
def tr7(t: Tables) -> DataFrame:
    return training.pairwise(t.imp, "request", "clicked", ["l_quantity"], "pos").withColumn("l_quantity", r6("l_quantity"))


@query("tr7_pairwise_fit")
def tr7_fit(t: Tables) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice"]
    scaled = t.imp.withColumns({"l_quantity": F.col("l_quantity") / 50, "l_extendedprice": F.col("l_extendedprice") / 100_000})
    model = training.pairwise_fit(training.pairwise(scaled, "request", "clicked", cols, "pos"), cols)
    w = model.coefficients.toArray().tolist()
    score = sum((F.lit(x) * F.col(c) for x, c in zip(w, cols, strict=True)), F.lit(0.0))
    return scaled.select("request", "pos", r6(score).alias("score"))


BOOSTED = ["l_quantity", "l_extendedprice"]


def _boost_sql(depth: int = 3, eta: float = 0.1, bins: int = 32, reg: float = 1.0, least: float = 1.0) -> str:
    """The first tree, level by level: gradients of equal scores, histograms, best splits."""
    cuts = ", ".join(f"cut{i} AS (SELECT list(DISTINCT c ORDER BY c) AS c{i} FROM (SELECT round(unnest(quantile_cont(CAST({f} AS DOUBLE), [{', '.join(f'{b}.0 / {bins}' for b in range(1, bins))}])), 6) AS c FROM imp))" for i, f in enumerate(BOOSTED))
    bin_of = ", ".join(f"len(list_filter(c{i}, lambda c: c < {f})) AS b{i}" for i, f in enumerate(BOOSTED))
    steps, last = [], "n0"
    for d in range(depth):
        steps.append(
            f"h{d} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h FROM (SELECT node, g, h, unnest([0, 1]) AS f, unnest([b0, b1]) AS bin FROM {last}) GROUP BY ALL), "
            f"w{d} AS (SELECT node, f, bin, sum(g) OVER a AS gl, sum(h) OVER a AS hl, sum(g) OVER p AS ga, sum(h) OVER p AS ha FROM h{d} WINDOW a AS (PARTITION BY node, f ORDER BY bin), p AS (PARTITION BY node, f)), "
            f"s{d} AS (SELECT node, f, bin, round((gl * gl / (hl + {reg}) + (ga - gl) * (ga - gl) / (ha - hl + {reg}) - ga * ga / (ha + {reg})) / 2, 9) AS gain FROM w{d}, cut0, cut1 "
            f"WHERE bin < CASE WHEN f = 0 THEN len(c0) ELSE len(c1) END AND hl >= {least} AND ha - hl >= {least} AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1), "
            f"n{d + 1} AS (SELECT n.* REPLACE (CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + CAST(CASE WHEN s.f = 0 THEN b0 ELSE b1 END > s.bin AS INTEGER) END AS node) FROM {last} AS n LEFT JOIN s{d} AS s USING (node))"
        )
        last = f"n{d + 1}"
    inner = " UNION ALL ".join(f"SELECT s.node, f, bin, cover FROM s{d} AS s JOIN (SELECT node, sum(h) AS cover FROM n{d} GROUP BY node) USING (node)" for d in range(depth))
    names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(BOOSTED))
    return (
        f"WITH imp AS (SELECT * FROM {IMP}), {cuts}, "
        "slopes AS (SELECT a.request, a.pos, sum(CASE WHEN a.clicked > b.clicked THEN -0.5 ELSE 0.5 END) AS g, 0.25 * count(*) AS h FROM imp AS a JOIN imp AS b ON a.request = b.request AND a.clicked <> b.clicked GROUP BY ALL), "
        f"n0 AS (SELECT 1 AS node, CAST(coalesce(g, 0) AS DOUBLE) AS g, CAST(coalesce(h, 0) AS DOUBLE) AS h, {bin_of} FROM imp LEFT JOIN slopes USING (request, pos), cut0, cut1), "
        f"{', '.join(steps)} "
        f"SELECT node, CASE f {names} END AS feature, round(CASE WHEN f = 0 THEN c0[bin + 1] ELSE c1[bin + 1] END, 6) AS threshold, NULL::DOUBLE AS value, round(cover, 6) AS cover FROM ({inner}), cut0, cut1 "
        f"UNION ALL SELECT node, NULL, NULL, round(-{eta} * sum(g) / (sum(h) + {reg}), 6), round(sum(h), 6) FROM {last} GROUP BY node"
    )


@query("tr7_boosted_first_tree", _boost_sql())
def tr7_first_tree(t: Tables) -> DataFrame:
    model = trees.boost_pairwise(t.imp, "request", "pos", "clicked", BOOSTED, rounds=1)
    return model.select(F.col("node"), "feature", r6("threshold").alias("threshold"), r6("value").alias("value"), r6("cover").alias("cover"))


@query("tr7_boosted_scores")
def tr7_boosted(t: Tables) -> DataFrame:
    model = trees.boost_pairwise(t.imp, "request", "pos", "clicked", BOOSTED)
    return t.imp.select("request", "pos", r6(trees.tree_score(model)).alias("score"))


@query("tr8_label_weight", f"SELECT event_id, {WSQL} AS weight FROM events")
def tr8(t: Tables) -> DataFrame:
    return training.label_weight(t.events.select("event_id", "event_type"), "event_type", WEIGHTS).drop("event_type")


@query("tr9_hash_split", f"SELECT event_id, CASE WHEN {uniform_sql(8, 'event_id')} < 0.7 THEN 'train' ELSE 'test' END AS part FROM events")
def tr9(t: Tables) -> DataFrame:
    return training.hash_split(t.events.select("event_id"), ["event_id"], {"train": 0.7, "test": 0.3}, 8)


@query(
    "tr9_stratified_split",
    f"SELECT event_id, event_type, CASE WHEN (row_number() OVER (PARTITION BY event_type ORDER BY {uniform_sql(8, 'event_id')}, event_id) - 1) / count(*) OVER (PARTITION BY event_type) < 0.8 THEN 'train' ELSE 'test' END AS part FROM events",
)
def tr9_strata(t: Tables) -> DataFrame:
    return training.hash_split(t.events.select("event_id", "event_type"), ["event_id"], {"train": 0.8, "test": 0.2}, 8, "event_type")


@query(
    "tr10_training_table",
    "WITH i AS (SELECT e.event_id, e.user_id, e.k, e.ts, coalesce(a.label, 0) AS label, c_mktsegment, p_brand FROM " + EV + " e LEFT JOIN (SELECT user_id, k, 1 AS label FROM " + EV + " x WHERE event_type = 'purchase' GROUP BY 1, 2) a "
    "ON e.user_id = a.user_id AND e.k = a.k LEFT JOIN customer ON e.user_id = c_custkey LEFT JOIN part ON e.k = p_partkey WHERE event_type = 'view') "
    "SELECT event_id, label, c_mktsegment, p_brand, coalesce(array_to_string(list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS history FROM i",
)
def tr10(t: Tables) -> DataFrame:
    views = t.ev.where("event_type = 'view'").select("event_id", "user_id", "k", "ts")
    buys = t.ev.where("event_type = 'purchase'").select("user_id", "k", F.lit(1).alias("label"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    items = t.part.select(F.col("p_partkey").alias("k"), "p_brand")
    out = training.training_table(views, buys, ["user_id", "k"], [(users, "user_id"), (items, "k")], "user_id", "ts", "k", 3, ["event_id"])
    return out.select("event_id", "label", "c_mktsegment", "p_brand", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


PRED = "(SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, round(1 / (1 + exp(-(l_quantity - 25) / 20)), 6) AS p FROM lineitem)"


def _predicted(t: Tables) -> DataFrame:
    p = r6(sigmoid((F.col("l_quantity") - 25) / 20))
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("label"), p.alias("p"))


@query(
    "ev1_auc_logloss",
    f"WITH s AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM {PRED} x GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) "
    f"SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, (SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) FROM {PRED} y) AS logloss FROM w",
)
def ev1(t: Tables) -> DataFrame:
    out = evaluation.auc_logloss(_predicted(t), "label", "p")
    return out.select(r6("auc").alias("auc"), r6("logloss").alias("logloss"))


@query(
    "ev2_classification_report",
    "WITH d AS (SELECT lang AS l, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p FROM documents), c AS (SELECT DISTINCT l AS class FROM d UNION SELECT DISTINCT p FROM d), "
    "s AS (SELECT class, (SELECT count(*) FROM d WHERE l = class) AS support, (SELECT count(*) FROM d WHERE p = class) AS pred, (SELECT count(*) FROM d WHERE l = class AND p = class) AS tp FROM c) "
    "SELECT class, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(2.0 * tp / (pred + support), 6) AS f1, support, "
    "(SELECT round(avg(CAST(l = p AS INTEGER)), 6) FROM d) AS accuracy FROM s",
)
def ev2(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("pred"))
    out = evaluation.classification_report(rows, "lang", "pred")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})


@query("ev3_verdict_tally", "SELECT quality AS verdict, count(*) AS cnt, (SELECT CAST(count(*) - sum(1 - toxic) AS BIGINT) FROM labels) AS remaining FROM labels WHERE toxic = 0 GROUP BY 1")
def ev3(t: Tables) -> DataFrame:
    rows = t.labels.select(F.col("quality").alias("verdict"), (1 - F.col("toxic")).alias("state"))
    return evaluation.verdict_tally(rows, "verdict", "state")


@query(
    "ev4_unpivot_providers",
    "SELECT l_orderkey, l_partkey, 'a' AS provider, CAST(l_linenumber AS VARCHAR) AS score, l_returnflag AS note FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'b', CAST(l_suppkey AS VARCHAR), l_linestatus FROM lineitem",
)
def ev4(t: Tables) -> DataFrame:
    wide = t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").alias("score_a"), F.col("l_suppkey").alias("score_b"),
        F.col("l_returnflag").alias("note_a"), F.col("l_linestatus").alias("note_b"),
    )
    return evaluation.unpivot_providers(wide, ["l_orderkey", "l_partkey"], ["score", "note"], ["a", "b"])


@query(
    "ev5_mark_judged",
    "SELECT d.doc_id, CAST(quality AS VARCHAR) AS score, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def ev5(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", F.lit(None).cast("string").alias("score"), F.lit(0).alias("state"), F.lit(None).cast("timestamp").alias("score_time"))
    judged = t.labels.select("doc_id", F.col("quality").cast("string").alias("score"))
    return evaluation.mark_judged(base, judged, "doc_id", "score", F.lit("2024-02-01").cast("timestamp")).drop("score_time")
