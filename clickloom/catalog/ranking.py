"""Queries on sessions, sequences, streams and recommendations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.catalog.registry import EV, WEIGHTS, WSQL, Tables, query, r6, uniform_sql
from clickloom.functions.numeric import sigmoid
from clickloom.operators import recommend, relational, sequences, trees, vectors
from clickloom.plans.ranks import top_n
from clickloom.plans.skew import mirror, with_group
from clickloom.session import fresh_dir
from clickloom.sources import tables
from clickloom.streaming import chunks, keyed_state, sinks, windows


def sessions_sql(hours: str) -> str:
    return (
        f"(SELECT *, CAST(sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL {hours} THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, lag(ts) OVER "
        f"(PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {EV} e))"
    )


S12 = sessions_sql("12 HOUR")
POS = (
    f"(SELECT user_id, session, k, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, k) AS pos FROM "
    f"(SELECT DISTINCT user_id, session, ts, k FROM {S12} s))"
)


def sessions(t: Tables, gap: str = "12 hours") -> DataFrame:
    return sequences.sessionize(t.ev.select("user_id", "ts", "event_id", "k", "event_type"), "user_id", "ts", gap, ["event_id"])


def positions(t: Tables) -> DataFrame:
    return sequences.session_positions(sessions(t), "user_id", "session", "ts", "k")


@query("se1_sessionize", "SELECT event_id, user_id, session FROM " + sessions_sql("30 MINUTE"))
def se1(t: Tables) -> DataFrame:
    return sessions(t, "30 minutes").select("event_id", "user_id", "session")


@query("se1_sessionize_12h", "SELECT event_id, user_id, session FROM " + S12)
def se1_12h(t: Tables) -> DataFrame:
    return sessions(t).select("event_id", "user_id", "session")


@query(
    "se2_session_sequences",
    "SELECT user_id, session, CAST(0 AS BIGINT) AS part, string_agg(k, ',' ORDER BY pos) AS items FROM " + POS + " GROUP BY 1, 2",
)
def se2(t: Tables) -> DataFrame:
    out = sequences.session_sequences(sessions(t), "user_id", "session", "ts", "k")
    return out.select("user_id", "session", "part", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("se3_item_embeddings")
def se3(t: Tables) -> DataFrame:
    seqs = sequences.session_sequences(sessions(t, "3 days"), "user_id", "session", "ts", "k")
    return sequences.item_embeddings(seqs, "items").select("word", vector_to_array("vector").alias("vector"))


@query(
    "se4_skipgram_pairs",
    f"SELECT a.user_id, a.session, a.pos, a.k AS centre, b.k AS context, CAST(b.pos - a.pos AS INTEGER) AS distance FROM {POS} a JOIN {POS} b ON a.user_id = b.user_id "
    "AND a.session = b.session AND abs(a.pos - b.pos) BETWEEN 1 AND 2",
)
def se4(t: Tables) -> DataFrame:
    return sequences.skipgram_pairs(positions(t), ["user_id", "session"], "k", 2).select("user_id", "session", "pos", "centre", "context", "distance")


@query(
    "se5_negative_samples",
    f"WITH p AS (SELECT a.user_id, a.session, a.pos, a.k AS centre, b.k AS context FROM {POS} a JOIN {POS} b ON a.user_id = b.user_id AND a.session = b.session AND abs(a.pos - b.pos) = 1), "
    f"w AS (SELECT k AS item, CAST(round(pow(count(*), 0.75) * 1000000) AS BIGINT) AS w FROM {EV} e GROUP BY 1), c AS (SELECT item, CAST(sum(w) OVER (ORDER BY w DESC, item) - w AS BIGINT) AS before, "
    "(SELECT CAST(sum(w) AS BIGINT) FROM w) AS total, lead(item) OVER (ORDER BY w DESC, item) AS nxt, first_value(item) OVER (ORDER BY w DESC, item) AS top FROM w), "
    "t AS (SELECT item, coalesce(nxt, top) AS nxt, before / total AS lo, coalesce(lead(before) OVER (ORDER BY before) / total, 1.0) AS hi FROM c), "
    f"d AS (SELECT *, {uniform_sql(11, 'user_id', 'session', 'pos', 'centre', 'context', 'draw')} AS u FROM p, (VALUES (1), (2)) v(draw)) "
    "SELECT user_id, session, pos, centre, context, draw, CASE WHEN item = context THEN nxt ELSE item END AS negative FROM d JOIN t ON u >= lo AND u < hi",
)
def se5(t: Tables) -> DataFrame:
    pairs = sequences.skipgram_pairs(positions(t), ["user_id", "session"], "k", 1)
    pairs = pairs.select("user_id", "session", "pos", "centre", "context")
    freq = t.ev.groupBy(F.col("k").alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    return sequences.negative_samples(pairs, freq, 2, 11)


EMB = "(SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


def _weights(t: Tables) -> DataFrame:
    rows = t.ev.where(F.col("k").isNotNull())
    return rows.withColumn("w", relational.weight_of("event_type", WEIGHTS).cast("double") + 1)


def _pooled(t: Tables, how: str) -> DataFrame:
    vec = t.embeddings.select(F.col("vec_id").alias("k"), F.col("embedding").alias("vector"))
    out = sequences.pool_vectors(_weights(t), "user_id", "k", vec, how, "w" if how == "weighted" else None)
    return out.select("user_id", F.posexplode("vector").alias("dim", "x")).select("user_id", "dim", r6("x").alias("x"))


def _pool_sql(agg: str) -> str:
    return (
        f"SELECT user_id, CAST(dim AS INTEGER) AS dim, round({agg}, 6) AS x FROM (SELECT user_id, k, {WSQL} + 1.0 AS w FROM {EV} e) e JOIN "
        f"(SELECT vec_id, dim, CAST(x AS DOUBLE) AS x FROM {EMB} q) v ON k = vec_id GROUP BY 1, 2"
    )


@query("se6_pool_avg", _pool_sql("avg(x)"))
def se6(t: Tables) -> DataFrame:
    return _pooled(t, "avg")


@query("se6_pool_max", _pool_sql("max(x)"))
def se6_max(t: Tables) -> DataFrame:
    return _pooled(t, "max")


@query("se6_pool_weighted", _pool_sql("sum(x * w) / sum(w)"))
def se6_weighted(t: Tables) -> DataFrame:
    return _pooled(t, "weighted")


def _walks_sql(length: int, walks: int, seed: int) -> str:
    sql = (
        f"WITH c AS (SELECT DISTINCT user_id, k FROM {EV} e), x AS (SELECT a.k AS src, b.k AS dst, count(*) AS w FROM c a JOIN c b ON a.user_id = b.user_id AND a.k <> b.k GROUP BY 1, 2), "
        "y AS (SELECT src, dst, CAST(sum(w) OVER (PARTITION BY src ORDER BY dst) - w AS BIGINT) AS before, CAST(sum(w) OVER (PARTITION BY src) AS BIGINT) AS total FROM x), "
        "t AS (SELECT src, dst, before / total AS lo, coalesce(lead(before) OVER (PARTITION BY src ORDER BY dst) / total, 1.0) AS hi FROM y), "
        f"w1 AS (SELECT DISTINCT src AS start, CAST(n AS INTEGER) AS walk, src AS node, CAST(src AS VARCHAR) AS path FROM t, range(1, {walks + 1}) r(n))"
    )
    for step in range(1, length):
        u = uniform_sql(seed, "start", "walk", str(step))
        sql += (
            f", u{step} AS (SELECT *, {u} AS u FROM w{step}), w{step + 1} AS (SELECT start, walk, dst AS node, path || ',' || dst AS path FROM u{step} JOIN t ON src = node AND u >= lo AND u < hi)"
        )
    return sql + f" SELECT start, walk, path FROM w{length}"


@query("se7_random_walks", _walks_sql(5, 3, 5))
def se7(t: Tables) -> DataFrame:
    pairs = recommend.cooccurrence(t.ev, "user_id", "k")
    edges = mirror(pairs.withColumnsRenamed({"a": "src", "b": "dst", "cnt": "weight"}), "src", "dst")
    out = sequences.random_walks(edges, 5, 3, 5)
    return out.select("start", "walk", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(
    "se8_change_points",
    "WITH d AS (SELECT user_id, ts, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS diff, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    "SELECT user_id, event_id, round(diff, 6) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY diff DESC, ts) AS rn FROM d WHERE diff IS NOT NULL) WHERE rn <= n // 5",
)
def se8(t: Tables) -> DataFrame:
    rows = with_group(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], n=F.count(F.lit(1)))
    out = sequences.change_points(rows, ["user_id"], "ts", "value", F.floor(F.col("n") / 5))
    return out.select("user_id", "event_id", r6("diff").alias("diff"))


def _clicks(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("user"))
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    return li.join(o, "o_orderkey").select("user", "item")


CLICKS = "(SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def swing_sql(clicks: str, self_users: bool) -> str:
    diagonal = "" if self_users else " WHERE a.u <> b.u"
    return (
        f"WITH c AS MATERIALIZED {clicks}, big AS (SELECT * FROM c WHERE u IN (SELECT u FROM c GROUP BY u HAVING count(*) > 1)), "
        f"p AS MATERIALIZED (SELECT a.u, b.u AS v, list(a.i ORDER BY a.i) AS items, count(*) AS n FROM big a JOIN big b ON a.i = b.i{diagonal} GROUP BY 1, 2 HAVING count(*) > 1), "
        "x AS (SELECT u, v, n, unnest(items) AS i FROM p), "
        "s AS (SELECT a.i, b.i AS j, sum(1.0 / (1.0 + a.n)) AS s FROM x a JOIN x b ON a.u = b.u AND a.v = b.v AND a.i <> b.i GROUP BY 1, 2) "
        "SELECT base_id, rec_id, similarity, rn FROM (SELECT i AS base_id, j AS rec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS rn FROM s) WHERE rn <= 30"
    )


@query("re1_swing_purchases", swing_sql(CLICKS, True))
def re1(t: Tables) -> DataFrame:
    return recommend.swing(_clicks(t), "user", "item").withColumn("similarity", r6("similarity"))


DAY_CLICKS = "(SELECT DISTINCT CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS u, k AS i FROM " + EV + " e)"


@query("re1_swing_days", swing_sql(DAY_CLICKS, False))
def re1_days(t: Tables) -> DataFrame:
    rows = t.ev.select(F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("user"), F.col("k").alias("item"))
    return recommend.swing(rows, "user", "item", include_self_users=False).withColumn("similarity", r6("similarity"))


@query(
    "re2_cooccurrence",
    "WITH b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS cnt FROM b a JOIN b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2",
)
def re2(t: Tables) -> DataFrame:
    return recommend.cooccurrence(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("re3_als_similar")
def re3(t: Tables) -> DataFrame:
    ratings = t.ev.withColumn("w", relational.weight_of("event_type", WEIGHTS))
    return recommend.als_similar(ratings, "user_id", "k", "w", 5).select("base_id", "rec_id", "rn")


VEC = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vec(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _knn_sql(score: str, direction: str, k: int, other: str = "") -> str:
    return (
        f"SELECT query_id, id, round(s, 5) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {direction}, id) AS rn FROM "
        f"(SELECT q.id AS query_id, e.id, round({score}, 9) AS s FROM {VEC} q, {VEC} e{other})) WHERE rn <= {k}"
    )


@query("re4_similar_items", _knn_sql("list_cosine_similarity(q.v, e.v)", "DESC", 10, " WHERE q.id <> e.id"))
def re4(t: Tables) -> DataFrame:
    return vectors.similar_items(_vec(t), 10).withColumn("score", r6("score", 5))


@query("re5_knn_l2", _knn_sql("list_distance(q.v, e.v)", "", 5))
def re5(t: Tables) -> DataFrame:
    return vectors.knn(_vec(t), _vec(t), 5).withColumn("score", r6("score", 5))


@query("re6_knn_lsh_recall")
def re6(t: Tables) -> DataFrame:
    v = _vec(t)
    return vectors.recall_against(vectors.knn_lsh(v, v, 5, width=2.0, tables=4), vectors.knn(v, v, 5))


@query("re7_inner_product", _knn_sql("list_inner_product(q.v, e.v)", "DESC", 10))
def re7(t: Tables) -> DataFrame:
    return vectors.knn(_vec(t), _vec(t), 10, "dot").withColumn("score", r6("score", 5))


# Every 40th vector is a coarse centre, and ten lists are probed.
CENTRE_EVERY, PROBES = 40, 10
UNIT = f"(SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM {VEC} WHERE list_inner_product(v, v) > 0)"


def _ivf_sql(score: str, direction: str, k: int, vec: str = VEC, other: str = "") -> str:
    return (
        f"WITH v AS {vec}, c AS (SELECT id AS centre, v FROM v WHERE id % {CENTRE_EVERY} = 0), "
        "lists AS (SELECT e.id, e.v, centre FROM v AS e, c QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY round(list_distance(e.v, c.v), 9), centre) = 1), "
        f"probes AS (SELECT q.id, q.v, centre FROM v AS q, c AS e QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round({score}, 9) {direction}, centre) <= {PROBES}), "
        f"s AS (SELECT q.id AS query_id, e.id, round({score}, 9) AS s FROM probes AS q JOIN lists AS e USING (centre){other}) "
        f"SELECT query_id, id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s {direction}, id) AS rn FROM s QUALIFY rn <= {k}"
    )


def _ivf(t: Tables, vec: DataFrame, k: int, metric: str, same_table: bool = False) -> DataFrame:
    centres = vec.where(F.col("id") % CENTRE_EVERY == 0).select(F.col("id").alias("centre"), "vec")
    return vectors.ivf_search(vec, vectors.inverted_lists(vec, centres), centres, k, PROBES, metric, same_table)


@query("re4_ivf_similar_items", _ivf_sql("list_cosine_similarity(q.v, e.v)", "DESC", 10, UNIT, " WHERE q.id <> e.id"))
def re4_ivf(t: Tables) -> DataFrame:
    return _ivf(t, vectors.unit_length(_vec(t)), 10, "cosine", same_table=True).withColumn("score", r6("score", 5))


@query("re6_ivf_l2", _ivf_sql("list_distance(q.v, e.v)", "", 5))
def re6_ivf(t: Tables) -> DataFrame:
    return _ivf(t, _vec(t), 5, "l2").withColumn("score", r6("score", 5))


@query(
    "re6_ivf_recall",
    f"SELECT e.query_id, round(avg(CAST(a.id IS NOT NULL AS INTEGER)), 6) AS recall FROM ({_knn_sql('list_distance(q.v, e.v)', '', 5)}) AS e "
    f"LEFT JOIN ({_ivf_sql('list_distance(q.v, e.v)', '', 5)}) AS a USING (query_id, id) GROUP BY 1",
)
def re6_ivf_recall(t: Tables) -> DataFrame:
    found = vectors.recall_against(_ivf(t, _vec(t), 5, "l2"), vectors.knn(_vec(t), _vec(t), 5))
    return found.withColumn("recall", r6("recall"))


@query("re7_ivf_inner_product", _ivf_sql("list_inner_product(q.v, e.v)", "DESC", 10))
def re7_ivf(t: Tables) -> DataFrame:
    return _ivf(t, _vec(t), 10, "dot").withColumn("score", r6("score", 5))


AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    "re8_interest",
    f"SELECT user_id, k, round(sum({WSQL} * pow(0.5, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1000000.0 / 604800.0)), 6) AS interest FROM {EV} e "
    f"WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2",
)
def re8(t: Tables) -> DataFrame:
    out = recommend.interest(t.ev, "user_id", "k", "event_type", "ts", WEIGHTS, 7 * 86400.0, _as_of())
    return out.withColumn("interest", r6("interest"))


SERVED = "(SELECT user_id, CAST(ts AS DATE) AS request_id, k, ts AS served_at FROM " + EV + " e WHERE event_type = 'view')"


def _served(t: Tables) -> DataFrame:
    return t.ev.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("request_id"), "k", F.col("ts").alias("served_at"))


@query(
    "re9_filter_last_requests",
    f"WITH s AS {SERVED}, r AS (SELECT user_id, request_id, row_number() OVER (PARTITION BY user_id ORDER BY max(served_at) DESC, request_id DESC) AS n FROM s GROUP BY 1, 2) "
    f"SELECT DISTINCT user_id, k FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM s JOIN r ON s.user_id = r.user_id AND s.request_id = r.request_id AND r.n <= 3 WHERE s.user_id = e.user_id AND s.k = e.k)",
)
def re9(t: Tables) -> DataFrame:
    return recommend.filter_served(t.ev.select("user_id", "k").distinct(), _served(t), "user_id", "k", last_requests=3)


@query(
    "re9_filter_ttl",
    f"SELECT DISTINCT user_id, k FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {SERVED} s WHERE s.user_id = e.user_id AND s.k = e.k AND served_at + INTERVAL 5 DAY > TIMESTAMP '2024-01-30 00:00:00')",
)
def re9_ttl(t: Tables) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return recommend.filter_served(t.ev.select("user_id", "k").distinct(), _served(t), "user_id", "k", ttl="5 days", now=now)


TOP_VALUE = (
    "(SELECT user_id, k AS item, rn FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(value), 4) DESC, k) AS rn FROM "
    + EV + " e WHERE event_type = 'purchase' GROUP BY 1, 2) WHERE rn <= 10)"
)


def _recs(t: Tables) -> DataFrame:
    bought = t.ev.where("event_type = 'purchase'").groupBy("user_id", F.col("k").alias("item")).agg(r6(F.sum("value"), 4).alias("s"))
    return top_n(bought, ["user_id"], ["-s", "item"], 10).select("user_id", "item", "rn")


@query(
    "re10_fill_cold_users",
    f"WITH r AS {TOP_VALUE}, p AS (SELECT k AS item, row_number() OVER (ORDER BY count(*) DESC, k) AS rn FROM {EV} e GROUP BY k QUALIFY rn <= 5) "
    "SELECT user_id, item, rn, 0 AS fallback FROM r UNION ALL SELECT c_custkey, item, rn, 1 FROM customer, p WHERE c_custkey NOT IN (SELECT user_id FROM r)",
)
def re10(t: Tables) -> DataFrame:
    popular = t.ev.groupBy(F.col("k").alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    return recommend.fill_cold_users(_recs(t), users, popular, "user_id", 5)


SCORED = f"(SELECT user_id, k, CAST(sum({WSQL}) AS BIGINT) AS score FROM {EV} e GROUP BY 1, 2)"


def _scored(t: Tables) -> DataFrame:
    return relational.behavior_score(t.ev, ["user_id", "k"], "event_type", WEIGHTS)


@query(
    "re11_weighted_shuffle",
    f"SELECT user_id, k, score, row_number() OVER (PARTITION BY user_id ORDER BY round(-ln({uniform_sql(3, 'user_id', 'k')}) / score, 12), k) AS pos FROM {SCORED} s WHERE score > 0",
)
def re11(t: Tables) -> DataFrame:
    return recommend.weighted_shuffle(_scored(t), ["user_id"], "score", ["k"], 3)


@query(
    "re12_beta_posterior",
    f"SELECT user_id, k, CAST(sum(CAST(event_type IN ('click', 'purchase') AS INTEGER)) + 1 AS DOUBLE) AS alpha, CAST(count(*) - sum(CAST(event_type IN ('click', 'purchase') AS INTEGER)) + 1 AS DOUBLE) AS beta, "
    f"round((sum(CAST(event_type IN ('click', 'purchase') AS INTEGER)) + 1.0) / (count(*) + 2.0), 6) AS mean FROM {EV} e GROUP BY 1, 2",
)
def re12(t: Tables) -> DataFrame:
    return _posterior(t).withColumn("mean", r6("mean"))


def _posterior(t: Tables) -> DataFrame:
    rows = t.ev.withColumn("hit", F.col("event_type").isin("click", "purchase").cast("int"))
    return recommend.beta_posterior(rows, ["user_id", "k"], "hit")


def _gamma_sql(shape: str, seed: str) -> str:
    """The same draw in SQL: the first accepted attempt."""
    u = lambda use: f"((CAST('0x' || substr(md5('{seed}:' || user_id || ':' || k || ':' || i || '{use}'), 1, 13) AS UBIGINT) + 0.5) / 4503599627370496.0)"
    d = f"({shape} - 1.0 / 3)"
    return (
        f"list_filter(list_transform(list_transform(list_transform(range({recommend.ATTEMPTS}), lambda i: struct_pack(x := sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')}), u := {u('c')})), "
        f"lambda s: struct_pack(x := s.x, u := s.u, t := 1 + s.x / sqrt(9 * {d}))), lambda s: CASE WHEN s.t > 0 AND ln(s.u) < s.x * s.x / 2 + {d} - {d} * s.t * s.t * s.t + 3 * {d} * ln(abs(s.t)) "
        f"THEN {d} * s.t * s.t * s.t END), lambda v: v IS NOT NULL)[1]"
    )


_HITS = "sum(CAST(event_type IN ('click', 'purchase') AS INTEGER))"


@query(
    "sl5_thompson_rank",
    f"WITH p AS (SELECT user_id, k, CAST({_HITS} + 1 AS DOUBLE) AS a, CAST(count(*) - {_HITS} + 1 AS DOUBLE) AS b FROM {EV} e GROUP BY 1, 2), "
    f"d AS (SELECT user_id, k, {_gamma_sql('a', '7x')} AS x, {_gamma_sql('b', '7y')} AS y FROM p) "
    "SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY round(x / (x + y), 12) DESC, k) AS rn FROM d QUALIFY rn <= 10",
)
def sl5(t: Tables) -> DataFrame:
    return recommend.thompson_rank(_posterior(t), "user_id", "k").select("user_id", "k", "rn")


@query(
    "re13_exploration_slot",
    f"WITH r AS {TOP_VALUE}, x AS (SELECT user_id, k AS item, count(*) AS n FROM {EV} e WHERE event_type = 'view' GROUP BY 1, 2), f AS (SELECT x.* FROM x WHERE NOT EXISTS "
    f"(SELECT 1 FROM r WHERE r.user_id = x.user_id AND r.item = x.item)), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(-ln({uniform_sql(9, 'user_id', 'item')}) / (1.0 / (1.0 + n)), 12), item) AS o FROM f), "
    "g AS (SELECT * FROM d WHERE o = 1 AND user_id IN (SELECT user_id FROM r)) SELECT r.user_id, r.item, CAST(rn + CASE WHEN g.user_id IS NOT NULL AND rn >= 3 THEN 1 ELSE 0 END AS BIGINT) AS rn, 0 AS explored "
    "FROM r LEFT JOIN g ON r.user_id = g.user_id UNION ALL SELECT user_id, item, CAST(3 AS BIGINT), 1 FROM g",
)
def re13(t: Tables) -> DataFrame:
    views = t.ev.where("event_type = 'view'").groupBy("user_id", F.col("k").alias("item")).agg(F.count(F.lit(1)).alias("exposures"))
    return recommend.exploration_slot(_recs(t), views, "user_id", "item", 3, 9)


@query(
    "re14_cold_item_vector",
    "WITH n AS (SELECT * FROM part WHERE p_size <= 10), h AS (SELECT * FROM part WHERE p_size > 10), c AS (SELECT n.p_partkey, h.p_retailprice AS a, h.p_size AS b, row_number() OVER "
    "(PARTITION BY n.p_partkey ORDER BY abs(h.p_retailprice - n.p_retailprice), h.p_partkey) AS rn FROM n JOIN h ON n.p_brand = h.p_brand AND n.p_type = h.p_type) "
    "SELECT p_partkey, round(avg(a), 6) AS price, round(avg(b), 6) AS size FROM c WHERE rn <= 3 GROUP BY 1",
)
def re14(t: Tables) -> DataFrame:
    p = t.part
    vec = p.select("p_partkey", F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("vector"))
    out = recommend.cold_item_vector(p.where("p_size <= 10"), p.where("p_size > 10"), vec, ["p_brand", "p_type"], "p_partkey", "p_retailprice")
    return out.select("p_partkey", r6(F.col("vector")[0]).alias("price"), r6(F.col("vector")[1]).alias("size"))


@query(
    "re15_group_popular",
    "WITH e AS (SELECT o_custkey AS g, p_brand AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), "
    "own AS (SELECT g, item, 0 AS level, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, item) AS place FROM e GROUP BY 1, 2 QUALIFY place <= 20), "
    "al AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS place FROM e GROUP BY 1), "
    "un AS (SELECT * FROM own UNION ALL SELECT g, item, 1, place FROM (SELECT DISTINCT g FROM e), al), "
    "b AS (SELECT g, item, min((level, place)) AS m FROM un GROUP BY 1, 2) SELECT g AS o_custkey, item, m[1] AS level, row_number() OVER (PARTITION BY g ORDER BY m) AS rn FROM b QUALIFY rn <= 20",
)
def re15(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey")
    rows = (
        li.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return recommend.group_popular(rows.select("o_custkey", "p_brand"), "o_custkey", "p_brand", 20)


@query(
    "re16_favorite_types",
    "SELECT user_id, string_agg(event_type || ':' || cnt, ',' ORDER BY rn) AS types FROM (SELECT user_id, event_type, count(*) AS cnt, row_number() OVER "
    "(PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2 HAVING count(*) >= 3) WHERE rn <= 3 GROUP BY 1",
)
def re16(t: Tables) -> DataFrame:
    return recommend.favorite_types(t.events, "user_id", "event_type")


@query("re17_vector_quality")
def re17(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return vectors.vector_quality(v, "label", 3)


# Parameters of the factorisation-machine example.
FM_FACTORS = [
    [-0.11845343057966201, -0.128103126655331, -0.12515688603786665],
    [-0.0461855438264623, 0.00334141008463275, 0.07812878096995332],
    [-0.12804740862909733, -0.12026609557880016, -0.11485173480056374],
    [-0.12470980244830876, -0.12803173709417073, -0.11880307016121176],
]
FM_LINEAR = [-0.12226160429501477, -0.10521983182258769, 0.08552796118362704, 0.08819288177147111]
FM_INTERCEPT = -0.1138868819483221


def _fm_sql() -> str:
    x = ["l_quantity / 10", "l_discount * 10", "l_tax * 10", "CAST(l_linenumber AS DOUBLE)"]
    raw = f"{FM_INTERCEPT}" + "".join(f" + ({w}) * ({v})" for w, v in zip(FM_LINEAR, x, strict=True))
    for f in range(3):
        s = " + ".join(f"({FM_FACTORS[i][f]!r}::DOUBLE) * ({x[i]})" for i in range(4))
        q = " + ".join(f"pow(({FM_FACTORS[i][f]!r}::DOUBLE) * ({x[i]}), 2)" for i in range(4))
        raw += f" + 0.5 * (pow({s}, 2) - ({q}))"
    return f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round({raw}, 5) AS raw, round(1 / (1 + exp(-({raw}))), 5) AS prob FROM lineitem"


@query("re18_fm_score", _fm_sql())
def re18(t: Tables) -> DataFrame:
    x = [F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber").cast("double")]
    raw = recommend.fm_score(x, FM_INTERCEPT, FM_LINEAR, FM_FACTORS)
    out = t.lineitem.withColumn("raw", raw)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", r6("raw", 5).alias("raw"), r6(sigmoid(F.col("raw")), 5).alias("prob"))


@query("re19_fm_train")
def re19(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"),
        (F.col("l_linestatus") == "F").cast("double").alias("label"),
    )
    model = recommend.fm_fit(rows, ["q", "d", "x"], "label", factors=8, iters=5)
    return recommend.fm_apply(rows, ["q", "d", "x"], model).groupBy("label").agg(F.avg("prob").alias("mean_prob"), F.count(F.lit(1)).alias("n"))


@query(
    "re20_rank_batch",
    f"SELECT user_id, k, round(score, 6) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, k) AS rn FROM (SELECT user_id, k, "
    f"1 / (1 + exp(-(0.3 * s.score + 0.01 * p_size - 0.001 * p_retailprice + 0.0001 * c_acctbal))) AS score FROM {SCORED} s LEFT JOIN part ON k = p_partkey LEFT JOIN customer ON user_id = c_custkey)) WHERE rn <= 10",
)
def re20(t: Tables) -> DataFrame:
    cands = _scored(t).withColumnRenamed("score", "s")
    items = t.part.select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    raw = 0.3 * F.col("s") + 0.01 * F.col("p_size") - 0.001 * F.col("p_retailprice") + 0.0001 * F.col("c_acctbal")
    out = recommend.rank_batch(cands, [(items, "k"), (users, "user_id")], "user_id", "k", sigmoid(raw), 10)
    return out.select("user_id", "k", r6("score").alias("score"), "rn")


@query(
    "re21_linear_contributions",
    "SELECT c_custkey AS id, 'c_acctbal' AS feature, round(0.5 * (c_acctbal - (SELECT avg(c_acctbal) FROM customer)), 4) AS contribution FROM customer UNION ALL "
    "SELECT c_custkey, 'c_nationkey', round(-2.0 * (c_nationkey - (SELECT avg(c_nationkey) FROM customer)), 4) FROM customer",
)
def re21(t: Tables) -> DataFrame:
    out = recommend.linear_contributions(t.customer, "c_custkey", {"c_acctbal": 0.5, "c_nationkey": -2.0})
    return out.select(F.col("c_custkey").alias("id"), "feature", r6("contribution", 4).alias("contribution"))


# Two small trees: (tree, node, feature, threshold, value, cover).
TREES = [
    (0, 1, "c_acctbal", 4000.0, None, 100.0), (0, 2, "c_nationkey", 10.0, None, 45.0), (0, 3, "c_acctbal", 7000.0, None, 55.0), (0, 4, None, None, 1.5, 20.0),
    (0, 5, None, None, -0.5, 25.0), (0, 6, None, None, 0.25, 30.0), (0, 7, None, None, 2.0, 25.0),
    (1, 1, "c_nationkey", 17.0, None, 80.0), (1, 2, None, None, -1.0, 60.0), (1, 3, "c_acctbal", 0.0, None, 20.0), (1, 6, None, None, 0.75, 5.0), (1, 7, None, None, -0.25, 15.0),
]
# The same as leaves with conditions, and the Shapley sum over subsets.
_TREE_SQL = """
WITH leaf(leaf, value, m) AS (VALUES (4, 1.5, 2), (5, -0.5, 2), (6, 0.25, 1), (7, 2.0, 1), (12, -1.0, 1), (16, 0.75, 2), (17, -0.25, 2)),
cond(leaf, j, feature, lo, hi, share) AS (VALUES (4, 0, 'c_acctbal', NULL, 4000.0, 0.45), (4, 1, 'c_nationkey', NULL, 10.0, 20.0 / 45), (5, 0, 'c_acctbal', NULL, 4000.0, 0.45),
    (5, 1, 'c_nationkey', 10.0, NULL, 25.0 / 45), (6, 0, 'c_acctbal', 4000.0, 7000.0, 0.3), (7, 0, 'c_acctbal', 7000.0, NULL, 0.25), (12, 0, 'c_nationkey', NULL, 17.0, 0.75),
    (16, 0, 'c_nationkey', 17.0, NULL, 0.25), (16, 1, 'c_acctbal', NULL, 0.0, 0.25), (17, 0, 'c_nationkey', 17.0, NULL, 0.25), (17, 1, 'c_acctbal', 0.0, NULL, 0.75)),
x AS (SELECT c_custkey AS id, 'c_acctbal' AS feature, CAST(c_acctbal AS DOUBLE) AS x FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer),
f AS (SELECT id, leaf, j, feature, CAST(share AS DOUBLE) AS share, CASE WHEN (lo IS NULL OR x > lo) AND (hi IS NULL OR x <= hi) THEN 1.0 ELSE 0.0 END AS one FROM cond JOIN x USING (feature)),
v AS (SELECT id, leaf, mask, product(CASE WHEN (mask >> j) & 1 = 1 THEN one ELSE share END) AS p FROM (SELECT leaf, unnest(range(1 << m)) AS mask FROM leaf) JOIN f USING (leaf) GROUP BY ALL),
c AS (SELECT f.id, f.feature, CAST(value AS DOUBLE) * factorial(CAST(bit_count(a.mask) AS INTEGER)) * factorial(CAST(m - bit_count(a.mask) - 1 AS INTEGER)) / factorial(m) * (b.p - a.p) AS part
    FROM f JOIN leaf USING (leaf) JOIN v AS a ON a.id = f.id AND a.leaf = f.leaf AND (a.mask >> j) & 1 = 0 JOIN v AS b ON b.id = f.id AND b.leaf = f.leaf AND b.mask = a.mask + (1 << j))
SELECT x.id, x.feature, round(sum(coalesce(part, 0)), 6) AS contribution FROM x LEFT JOIN c USING (id, feature) GROUP BY ALL"""


@query("re21_tree_contributions", _TREE_SQL)
def re21_trees(t: Tables) -> DataFrame:
    model = t.spark.createDataFrame(TREES, trees.MODEL)
    out = trees.tree_contributions(t.customer, "c_custkey", model, ["c_acctbal", "c_nationkey"])
    return out.withColumn("contribution", r6("contribution"))


# ---- windows over event time ------------------------------------------------------------------------


def _windows_sql(size: str, slide: str, closed: bool = False) -> str:
    keep = " HAVING window_end <= (SELECT max(ts) FROM events)" if closed else ""
    return (
        f"SELECT window_end, user_id, k, CAST(sum(w) AS BIGINT) AS score FROM (SELECT user_id, k, {WSQL} AS w, unnest(generate_series(time_bucket(INTERVAL {slide}, ts) + INTERVAL {slide}, "
        f"time_bucket(INTERVAL {slide}, ts) + INTERVAL {size}, INTERVAL {slide})) AS window_end FROM {EV} e) GROUP BY 1, 2, 3{keep}"
    )


@query(
    "st1_sliding_score",
    "SELECT window_end, count(*) AS cells, CAST(sum(score) AS BIGINT) AS score, CAST(sum(score * (k + 1) * (user_id + 1)) AS BIGINT) AS checksum FROM "
    f"({_windows_sql('1 DAY', '5 MINUTE')}) GROUP BY 1",
)
def st1(t: Tables) -> DataFrame:
    cells = windows.sliding_score(t.ev, "ts", ["user_id", "k"], "event_type", WEIGHTS)
    return cells.groupBy("window_end").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("score").alias("score"),
        F.sum(F.col("score") * (F.col("k") + 1) * (F.col("user_id") + 1)).alias("checksum"),
    )


def _stream(t: Tables) -> DataFrame:
    raw = tables.read_topic(t.spark, "parquet", {}, t.events.schema, t.path("events") + "*")
    # One large file comes as few splits; its rows go to all cores before their payload is parsed.
    raw = raw.repartition(4 * t.spark.sparkContext.defaultParallelism, "event_id")
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


def _no_zone(df: DataFrame) -> DataFrame:
    """Window bounds as times without a zone, like the times in the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c.startswith("window_")})


@query("st1_sliding_score_stream", _windows_sql("1 DAY", "1 HOUR", closed=True))
def st1_stream(t: Tables) -> DataFrame:
    scored = windows.sliding_score(_stream(t), "ts", ["user_id", "k"], "event_type", WEIGHTS, slide="1 hour", runs=True)
    closed = windows.closed_windows(fresh_dir(t.spark, "sliding-rows"), ["user_id", "k"], slide="1 hour")
    return _no_zone(t.spark.read.parquet(sinks.run_to_table(scored, "append", "sliding", step=closed)).drop("batch"))


# One row per window stands for all its ranked rows, of which there are millions: their number, scores and a sum over all columns.
@query(
    "st2_window_top_n",
    "SELECT window_end, count(*) AS cells, CAST(sum(score) AS BIGINT) AS score, CAST(sum(score * (k + 1) * (user_id + 1) * rn) AS BIGINT) AS checksum FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY window_end, user_id ORDER BY score DESC, k) AS rn FROM ({_windows_sql('1 DAY', '5 MINUTE')})) WHERE rn <= 3 GROUP BY 1",
)
def st2(t: Tables) -> DataFrame:
    runs = windows.sliding_score(t.ev, "ts", ["user_id", "k"], "event_type", WEIGHTS, runs=True)
    best = windows.window_top_n(runs, ["user_id"], "k", "score")
    return best.groupBy("window_end").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("score").alias("score"),
        F.sum(F.col("score") * (F.col("k") + 1) * (F.col("user_id") + 1) * F.col("rn")).alias("checksum"),
    )


@query(
    "st2_window_top_n_stream",
    f"SELECT window_end, user_id, k, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY window_end, user_id ORDER BY score DESC, k) AS rn FROM ({_windows_sql('1 DAY', '1 HOUR', closed=True)})) WHERE rn <= 3",
)
def st2_stream(t: Tables) -> DataFrame:
    scored = windows.sliding_score(_stream(t), "ts", ["user_id", "k"], "event_type", WEIGHTS, slide="1 hour", runs=True)
    out = fresh_dir(t.spark, "topn")
    sinks.start_window_top_n(scored, ["user_id"], "k", "score", 3, out, fresh_dir(t.spark, "topn-state"), slide="1 hour").awaitTermination()
    return _no_zone(t.spark.read.parquet(out).drop("batch"))


@query(
    "st8_keyed_list_state",
    f"SELECT window_end, user_id, k, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY window_end, user_id ORDER BY score DESC, k) AS rn FROM ({_windows_sql('1 DAY', '6 HOUR', closed=True)})) WHERE rn <= 3",
)
def st8(t: Tables) -> DataFrame:
    scored = windows.sliding_score(_stream(t), "ts", ["user_id", "k"], "event_type", WEIGHTS, slide="6 hours")
    out = fresh_dir(t.spark, "timed")
    keyed_state.start_timed(keyed_state.timed_top_n(scored, ["user_id"], "k", "score"), out, fresh_dir(t.spark, "timed-state")).awaitTermination()
    return _no_zone(t.spark.read.parquet(out))


MEAN = (
    "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, event_type, round(avg(value), 6) AS mean, count(value) AS cnt "
    "FROM events GROUP BY 1, 2, 3"
)


@query("st3_tumbling_mean", MEAN)
def st3(t: Tables) -> DataFrame:
    return windows.tumbling_mean(t.events, "ts", "event_type", "value").withColumn("mean", r6("mean"))


@query("st3_tumbling_mean_stream", MEAN + " HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def st3_stream(t: Tables) -> DataFrame:
    means = windows.tumbling_mean(_stream(t), "ts", "event_type", "value", delay="10 minutes")
    out = t.spark.read.parquet(sinks.run_to_table(means, "append", "means"))
    return _no_zone(out).withColumn("mean", r6("mean"))


@query("st4_split_words_stream", "SELECT unnest(string_split(p_name, ' ')) AS word FROM part")
def st4(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {}, t.part.schema, t.path("part") + "*")
    return t.spark.read.parquet(sinks.run_to_table(tables.split_words(stream, "p_name", " "), "append", "words"))


@query("st5_running_counts_stream", "SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def st5(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {}, t.part.schema, t.path("part") + "*")
    counts = windows.running_counts(tables.split_words(stream, "p_name", " "), "word")
    return t.spark.read.parquet(sinks.run_to_table(counts, "complete", "wordcount"))


@query("st6_event_time_stream", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def st6(t: Tables) -> DataFrame:
    secs = _stream(t).select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("secs"))
    timed = windows.with_event_time(secs, "secs", name="at").select("event_id", "at")
    out = t.spark.read.parquet(sinks.run_to_table(timed, "append", "timed"))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("st7_paced_stream", "SELECT count(*) AS cnt, CAST(6 AS BIGINT) AS batches FROM events")
def st7(t: Tables) -> DataFrame:
    files = fresh_dir(t.spark, "paced-in")
    t.events.select("event_id").repartition(6).write.parquet(files)
    pace = tables.trigger_options(max_per_trigger=1, fmt="parquet")
    stream = tables.read_topic(t.spark, "parquet", pace["source"], "event_id long", files)
    out = fresh_dir(t.spark, "paced")
    sinks.process_then_commit(stream, sinks.by_batch(out), fresh_dir(t.spark, "paced-state"), True).awaitTermination()
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("batch").alias("batches"))


@query(
    "st10_flush_by_turns",
    "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 5) AS BIGINT) AS chunk FROM conversations",
)
def st10(t: Tables) -> DataFrame:
    return chunks.flush_chunks(t.conversations.select("conv_id", "turn"), "conv_id", "turn")


CHUNKS = (
    "RECURSIVE r AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g(user_id, event_id, n, began, turns, chunk) AS ("
    "SELECT user_id, event_id, n, ts, 1, CAST(0 AS BIGINT) FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN g.turns >= 5 OR r.ts - g.began >= INTERVAL 24 HOUR THEN r.ts ELSE g.began END, "
    "CASE WHEN g.turns >= 5 OR r.ts - g.began >= INTERVAL 24 HOUR THEN 1 ELSE g.turns + 1 END, g.chunk + CASE WHEN g.turns >= 5 OR r.ts - g.began >= INTERVAL 24 HOUR THEN 1 ELSE 0 END "
    "FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1)"
)


@query("st10_flush_by_age", f"WITH {CHUNKS} SELECT user_id AS conv_id, event_id AS turn, chunk FROM g")
def st10_age(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "ts")
    return chunks.flush_chunks(rows, "conv_id", "turn", "ts", 5, 86400).select("conv_id", "turn", "chunk")


@query(
    "st10_flush_stream",
    f"WITH {CHUNKS} SELECT user_id, chunk, arg_min(event_id, n) AS first_turn, arg_max(event_id, n) AS last_turn, CAST(count(*) AS INTEGER) AS turns FROM g GROUP BY user_id, chunk "
    "HAVING count(*) = 5 OR min(began) + INTERVAL 24 HOUR < (SELECT max(ts) FROM events)",
)
def st10_stream(t: Tables) -> DataFrame:
    flushed = chunks.flush_stream(_stream(t), "user_id", "event_id", "ts", 5, 86400)
    return t.spark.read.parquet(sinks.run_to_table(flushed, "append", "flushed"))


@query("st9_extract_and_commit", "SELECT event_id, lower(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def st9(t: Tables) -> DataFrame:
    raw = tables.read_topic(t.spark, "parquet", {}, t.events.schema, t.path("events") + "*")
    picked = tables.decode_json(raw.select("event_id", F.lower("event_type").alias("kind"), "props"), "props", "k int")
    out = fresh_dir(t.spark, "extract")
    sinks.process_then_commit(picked, sinks.by_batch(out), fresh_dir(t.spark, "extract-state"), True).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query(
    "st11_live_interest",
    f"SELECT user_id, k, round(sum({WSQL} * pow(0.5, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1000000.0 / 604800.0)), 6) AS interest FROM {EV} e GROUP BY 1, 2",
)
def st11(t: Tables) -> DataFrame:
    out = fresh_dir(t.spark, "interest")
    sinks.live_interest(
        _stream(t), "user_id", "k", "event_type", "ts", WEIGHTS, 7 * 86400.0, _as_of(), out, fresh_dir(t.spark, "interest-state")
    ).awaitTermination()
    return t.spark.read.parquet(out).groupBy("user_id", "k").agg(r6(F.sum("interest")).alias("interest"))

