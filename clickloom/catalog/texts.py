"""Queries on search, entities, logs, monitoring, attribution and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.catalog.registry import EV, Tables, query, r6
from clickloom.operators import attribution, calibration, entities, monitoring, records, search
from clickloom.sources import keyed

TFIDF = (
    "(WITH q AS (SELECT CAST(ts AS DATE) AS day, user_id, CAST(k AS VARCHAR) AS query FROM " + EV + " e), "
    "d AS (SELECT a.query AS doc, b.query AS word FROM q a JOIN q b ON a.day = b.day AND a.user_id = b.user_id AND a.query <> b.query), "
    "tf AS (SELECT doc, word, count(*) AS n FROM d GROUP BY 1, 2), dc AS (SELECT doc, sum(n) AS total FROM tf GROUP BY 1), "
    "df AS (SELECT word, count(DISTINCT doc) AS f FROM d GROUP BY 1), nd AS (SELECT count(DISTINCT doc) AS n FROM d), "
    "s AS (SELECT tf.doc AS base_query, tf.word AS rec_query, tf.n / total AS normalized_tf, log10(nd.n / f) AS idf, tf.n / total * log10(nd.n / f) AS tf_idf FROM tf JOIN dc USING (doc) JOIN df USING (word), nd) "
    "SELECT *, row_number() OVER (PARTITION BY base_query ORDER BY round(tf_idf, 9) DESC, rec_query) AS rn FROM s)"
)


def tfidf(t: Tables) -> DataFrame:
    rows = t.ev.select(F.to_date("ts").alias("day"), "user_id", F.col("k").cast("string").alias("query"))
    return search.query_cooccurrence_tfidf(rows, ["day", "user_id"], "query", 0, 15)


@query(
    "tx1_query_cooccurrence_tfidf",
    f"SELECT base_query, rec_query, round(normalized_tf, 6) AS normalized_tf, round(idf, 6) AS idf, round(tf_idf, 6) AS tf_idf, rn FROM {TFIDF}",
)
def tx1(t: Tables) -> DataFrame:
    return tfidf(t).withColumns({c: r6(c) for c in ("normalized_tf", "idf", "tf_idf")})


@query("tx2_recommend_for", f"SELECT rec_query, rn FROM {TFIDF} WHERE base_query = '42' AND rn <= 20")
def tx2(t: Tables) -> DataFrame:
    return search.recommend_for(tfidf(t), "42", 20).select("rec_query", "rn")


@query(
    "tx3_diversify_suggestions",
    f"WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {TFIDF} WHERE rn <= 20), g(base, rn, kept) AS (SELECT DISTINCT base_query, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM s UNION ALL "
    "SELECT g.base, s.rn, CASE WHEN contains(g.base, rec_query) OR contains(rec_query, g.base) OR len(list_filter(kept, lambda x: contains(rec_query, x) OR contains(x, rec_query) OR levenshtein(rec_query, x) <= 1)) > 0 "
    "THEN kept ELSE list_append(kept, rec_query) END FROM g JOIN s ON g.base = s.base_query AND s.rn = g.rn + 1), f AS (SELECT base, arg_max(kept, rn) AS kept FROM g GROUP BY 1) "
    "SELECT base_query, rec_query, s.rn FROM s JOIN f ON s.base_query = f.base WHERE list_contains(f.kept, rec_query) AND tf_idf > 0.0001",
)
def tx3(t: Tables) -> DataFrame:
    out = search.diversify_suggestions(tfidf(t), "base_query", "rec_query", "rn", "tf_idf", n=20, min_score=0.0001)
    return out.select("base_query", "rec_query", "rn")


def popular_names(t: Tables) -> DataFrame:
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("p_name").alias("query")).agg(F.count(F.lit(1)).alias("freq"))


NAMES = "(SELECT p_name AS query, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
KEYS = (
    "(WITH q AS (SELECT DISTINCT p_name AS query, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), pa AS (SELECT query, a, b, left(a, i) AS pre FROM q, range(1, 20) r(i) WHERE i <= length(a)), "
    "pb AS (SELECT query, a, b, left(b, i) AS pre FROM q, range(1, 20) r(i) WHERE i <= length(b)) "
    "SELECT DISTINCT query, key FROM (SELECT query, query AS key FROM q UNION ALL SELECT query, a FROM q UNION ALL SELECT query, b FROM q UNION ALL SELECT query, a || b FROM q UNION ALL SELECT query, a || ' ' || b FROM q UNION ALL SELECT query, left(a, 1) || left(b, 1) FROM q "
    "UNION ALL SELECT query, pre FROM pa UNION ALL SELECT query, a || pre FROM pb UNION ALL SELECT query, left(a || b, 1) || pre FROM pb UNION ALL SELECT query, a || substr(a || b, 2, 1) FROM q))"
)


@query("tx5_suggestion_keys", f"SELECT query, key FROM {KEYS}")
def tx5(t: Tables) -> DataFrame:
    return search.suggestion_keys(t.part, "p_name")


@query(
    "tx6_prefix_suggest",
    f"WITH k AS (SELECT replace(lower(key), ' ', '') AS key, n.query AS word, n.freq FROM {KEYS} x JOIN {NAMES} n ON x.query = n.query), p AS (SELECT DISTINCT left(key, i) AS prefix, word, freq FROM k, range(1, 40) r(i) WHERE i <= length(key)), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rn FROM p) SELECT typed, word, freq, rn FROM (SELECT DISTINCT left(p_name, 3) AS typed FROM part) JOIN g ON replace(lower(typed), ' ', '') = prefix WHERE rn <= 10",
)
def tx6(t: Tables) -> DataFrame:
    keys = search.suggestion_keys(t.part, "p_name").join(popular_names(t), "query")
    index = search.prefix_index(keys, "key", "query", "freq")
    return search.suggest(index, t.part.select(F.substring("p_name", 1, 3).alias("typed")), "typed")


@query("tx7_intent_classifier")
def tx7(t: Tables) -> DataFrame:
    rows = t.spread(t.conversations.select("conv_id", "turn", "text", "role"), "conv_id", "turn")
    features = search.intent_features(rows, "text")
    scored = search.intent_fit(features, "text", "role").transform(features)
    return scored.groupBy("role", "prediction").agg(F.count(F.lit(1)).alias("cnt"))


# Calibration of a plain score, the length of a text, against the quality label; SQL pools by the largest of the smallest means.
_CODE = "least(999, CAST(floor(1000.0 / (1 + exp(-((n_chars - 1500) / 1000.0)))) AS INTEGER))"
_BINS = f"(SELECT {_CODE} AS code, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)"


def _quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ((F.col("n_chars") - 1500) / 1000).alias("score")).join(t.labels, "doc_id")


@query(
    "tx7_calibration",
    f"WITH b AS (SELECT *, sum(n) OVER (ORDER BY code) AS cn, sum(positives) OVER (ORDER BY code) AS cp FROM {_BINS}), "
    "m AS (SELECT j.code AS j, k.code AS k, (k.cp - j.cp + j.positives) / (k.cn - j.cn + j.n) AS mean FROM b AS j JOIN b AS k ON j.code <= k.code), "
    "low AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m) "
    "SELECT b.code, b.n, b.positives, round(max(low), 9) AS rate FROM b JOIN low ON low.k = b.code GROUP BY ALL",
)
def tx7_calibration(t: Tables) -> DataFrame:
    return calibration.calibration_table(_quality(t), "score", "quality").withColumn("rate", r6("rate", 9))


@query("tx7_calibrated_report")
def tx7_report(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "text", "role")
    return calibration.calibrated_intents(rows, ["conv_id", "turn"], "text", "role")[1]


# A gazetteer taken from the benchmark texts: their opening word pairs and every longer word.
GAZ = (
    "(SELECT DISTINCT 'phrase' AS type, list_extract(w, 1) || ' ' || list_extract(w, 2) AS surface FROM (SELECT regexp_split_to_array(text, '[ \\n]+') AS w FROM benchmark) "
    "UNION SELECT DISTINCT 'word', w FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{7,}'))"
)
EDGE = "[.,!?;:\"''()\\[\\]]+"
TOKENS = (
    f"(SELECT doc_id, list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '^{EDGE}', ''), '{EDGE}$', '')), lambda w: w <> '') AS tk FROM documents)"
)


def gazetteer(t: Tables) -> DataFrame:
    w = F.split("text", "[ \n]+")
    pairs = t.benchmark.select(F.lit("phrase").alias("type"), F.concat(w[0], F.lit(" "), w[1]).alias("surface"))
    single = t.benchmark.select(F.lit("word").alias("type"), F.explode(w).alias("surface")).where(F.col("surface").rlike("^[a-z]{7,}$"))
    both = pairs.unionByName(single).distinct()
    return both.withColumns({
        "id": F.substring(F.md5("surface"), 1, 8),
        "parent_name": F.when(F.col("type") == "phrase", F.substring_index("surface", " ", 1)),
        "parent_id": F.when(F.col("type") == "phrase", F.lit("0")),
    })


MATCHES = (
    f"(WITH g AS (SELECT type, surface, lower(array_to_string(list_filter(list_transform(regexp_split_to_array(surface, '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^{EDGE}', ''), '{EDGE}$', '')), lambda w: w <> ''), ' ')) AS gram FROM {GAZ}), "
    f"t AS (SELECT doc_id, unnest(tk) AS tok, generate_subscripts(tk, 1) - 1 AS p FROM {TOKENS}), w AS (SELECT doc_id, p, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM t) "
    "SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(p + len(string_split(gram, ' ')) AS INTEGER) AS stop, CASE WHEN lower(tok) = gram THEN tok ELSE tok || ' ' || nxt END AS txt, type, surface FROM w JOIN g ON lower(tok) = gram OR lower(tok || ' ' || nxt) = gram)"
)
# Longest first, then earliest; a match is kept when none of its tokens is taken.
RULED = (
    f"o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stop - start DESC, start) AS n FROM (SELECT doc_id, start, stop, unnest(min((type, surface, txt))) FROM {MATCHES} GROUP BY 1, 2, 3) q(doc_id, start, stop, type, surface, txt)), "
    "r(doc_id, n, taken, hit) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM o UNION ALL SELECT o.doc_id, o.n, CASE WHEN list_has_any(taken, range(start, stop)) THEN taken ELSE list_concat(taken, range(start, stop)) END, "
    "NOT list_has_any(taken, range(start, stop)) FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1), k AS (SELECT o.* FROM o JOIN r ON o.doc_id = r.doc_id AND o.n = r.n WHERE r.hit)"
)


@query("tx8_phrase_match", f"SELECT doc_id, start, stop AS \"end\", type, surface FROM {MATCHES}")
def tx8(t: Tables) -> DataFrame:
    out = entities.phrase_match(t.texts, "doc_id", "text", gazetteer(t))
    return out.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "surface")


@query("tx9_entity_ruler", f'WITH RECURSIVE {RULED} SELECT doc_id, start, stop AS "end", type, surface, txt AS text FROM k')
def tx9(t: Tables) -> DataFrame:
    out = entities.entity_ruler(t.texts, "doc_id", "text", gazetteer(t))
    return out.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "surface", "text")


@query(
    "tx10_expand_parents",
    f"WITH RECURSIVE {RULED} SELECT doc_id, start, txt AS entity, type, 0 AS parent FROM k UNION ALL SELECT doc_id, start, string_split(surface, ' ')[1], 'word', 1 FROM k WHERE type = 'phrase'",
)
def tx10(t: Tables) -> DataFrame:
    gaz = gazetteer(t)
    found = entities.entity_ruler(t.texts, "doc_id", "text", gaz).select("doc_id", "start", "text", "type", "surface")
    out = entities.expand_parents(found, gaz, {"phrase": "word"})
    return out.select("doc_id", F.col("start").cast("int").alias("start"), "entity", "type", "parent")


@query(
    "tx11_date_mentions",
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, 'daterange' AS type, strftime(d, '%Y-%m-%d') AS start, strftime(d + 7, '%Y-%m-%d') AS \"end\" FROM o "
    "UNION ALL SELECT o_orderkey, 'duration', (o_orderkey % 9 + 1) || 'D', NULL FROM o UNION ALL SELECT o_orderkey, 'date', strftime(d + 1, '%Y-%m-%d'), NULL FROM o UNION ALL SELECT o_orderkey, 'datetime', strftime(d, '%Y-%m-%d') || ' 08:30', NULL FROM o",
)
def tx11(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(
        F.lit("Open "), day, F.lit(" to "), F.date_format(F.date_add(F.to_date("o_orderdate"), 7), "yyyy-MM-dd"), F.lit(", takes "),
        (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" days, shown Tomorrow and at "), day, F.lit(" 08:30."),
    )
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("ref"), text.alias("text"))
    return entities.date_mentions(rows, "o_orderkey", "text", "ref").drop("mention")


@query(
    "tx12_correct_queries",
    f"WITH v AS {NAMES}, q AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN substr(p_name, 2) WHEN 1 THEN 'x' || p_name ELSE 'z' || substr(p_name, 2) END AS query FROM part) "
    "SELECT query, word, freq FROM (SELECT q.query, v.query AS word, v.freq, row_number() OVER (PARTITION BY q.query ORDER BY v.freq DESC, v.query) AS rn FROM q JOIN v ON levenshtein(q.query, v.query) <= 1 WHERE q.query NOT IN (SELECT query FROM v)) WHERE rn = 1",
)
def tx12(t: Tables) -> DataFrame:
    c = F.col("p_name")
    rest = F.expr("substring(p_name, 2)")
    wrong = F.when(F.col("p_size") % 3 == 0, rest).when(F.col("p_size") % 3 == 1, F.concat(F.lit("x"), c)).otherwise(F.concat(F.lit("z"), rest))
    return search.correct_queries(t.part.select(wrong.alias("query")), "query", popular_names(t), "query", "freq")


@query(
    "tx13_fallback_queries",
    "WITH r AS (SELECT c_custkey, c_mktsegment AS query, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) SELECT c_custkey, query, n, CASE WHEN n = 0 THEN 'ALL' ELSE query END AS run_query FROM r",
)
def tx13(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    asked = t.customer.select("c_custkey", F.col("c_mktsegment").alias("query")).join(n, "c_custkey", "left").fillna(0, ["n"])
    # Two terms for each query: the first in alphabetical order is run, and no row is doubled.
    table = t.customer.select("c_mktsegment", F.explode(F.array(F.lit("OTHER"), F.lit("ALL"))).alias("term")).distinct()
    return search.fallback_queries(asked, "query", "n", table)


def _text_rank_sql(iters: int) -> str:
    sql = (
        f"WITH tk AS (SELECT item_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '^{EDGE}', ''), '{EDGE}$', '')), lambda w: w <> '') AS tk FROM benchmark), "
        "t AS (SELECT item_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS p FROM tk), h AS (SELECT a.w AS x, b.w AS y FROM t a JOIN t b ON a.item_id = b.item_id AND b.p - a.p BETWEEN 1 AND 2 AND a.w <> b.w), "
        "e AS (SELECT src, dst, count(*) AS n FROM (SELECT x AS src, y AS dst FROM h UNION ALL SELECT y, x FROM h) GROUP BY 1, 2), p AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM e), "
        "r0 AS (SELECT DISTINCT src AS word, 1.0::DOUBLE AS weight FROM p)"
    )
    for i in range(iters):
        sql += f", r{i + 1} AS MATERIALIZED (SELECT dst AS word, 0.15 + 0.85 * sum(p * weight) AS weight FROM p JOIN r{i} ON word = src GROUP BY 1)"
    return sql + f" SELECT word, round(weight, 6) AS weight FROM r{iters}"


@query("tx14_text_rank", _text_rank_sql(5))
def tx14(t: Tables) -> DataFrame:
    toks = t.benchmark.select("item_id", F.posexplode(entities.tokens(F.lower("text"))).alias("pos", "word"))
    return search.text_rank(toks, "item_id", "pos", "word", iters=5).select("word", r6("weight").alias("weight"))


# ---- logs -------------------------------------------------------------------------------------------

HITS = "(SELECT event_id, ts, user_id, value, event_type, k FROM " + EV + " e)"


def service_lines(t: Tables) -> DataFrame:
    """Events written as access-log lines; error events give lines that do not fit."""
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    size = F.when(F.col("event_type") == "signup", "-").otherwise((F.col("value") * 100).cast("long").cast("string"))
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit(".7 - - ["), stamp, F.lit(' +0000] "GET /api/'), "event_type",
        F.lit("?k="), F.col("k").cast("string"), F.lit(' HTTP/1.1" 200 '), size, F.lit(" "), F.col("event_id").cast("string"),
    )
    return t.ev.select("event_id", F.when(F.col("event_type") == "error", F.lit("upstream reset")).otherwise(line).alias("line"))


@query(
    "mo1_parse_service_log",
    f"SELECT event_id, '10.0.' || (user_id % 250) || '.7' AS client_ip, date_trunc('second', ts) AS ts, '/api/' || event_type AS path, 200 AS status, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(trunc(value * 100) AS BIGINT) END AS bytes, CAST(event_id AS INTEGER) AS response_time, 0 AS rejected FROM {HITS} h WHERE event_type <> 'error' "
    f"UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, 1 FROM {HITS} h WHERE event_type = 'error'",
)
def mo1(t: Tables) -> DataFrame:
    good, bad = monitoring.parse_service_log(service_lines(t), "line")
    good = good.drop("method").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("rejected", F.lit(0))
    return good.unionByName(bad.select("event_id", F.lit(1).alias("rejected")), allowMissingColumns=True)


def proxy_lines(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(
        F.lit("10.1.0."), (F.col("user_id") % 250).cast("string"), F.lit("-["), stamp, F.lit(" -0700]-GET /api/a-b/"), "event_type",
        F.lit(" HTTP/2.0-200-"), F.format_string("%.3f", F.col("event_id") / 1000),
    )
    return t.ev.select("event_id", F.when(F.col("event_type") == "error", F.lit("a-b-c")).otherwise(line).alias("line"))


@query(
    "mo2_parse_proxy_log",
    f"SELECT event_id, '10.1.0.' || (user_id % 250) AS source, 'GET' AS method, '200' AS status, '/' || event_type AS path, CAST(event_id AS DOUBLE) AS ms, 0 AS rejected FROM {HITS} h WHERE event_type <> 'error' "
    f"UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, 1 FROM {HITS} h WHERE event_type = 'error'",
)
def mo2(t: Tables) -> DataFrame:
    good, bad = monitoring.parse_proxy_log(proxy_lines(t), "line")
    good = good.withColumn("ms", r6("ms", 3)).withColumn("rejected", F.lit(0))
    return good.unionByName(bad.select("event_id", F.lit(1).alias("rejected")), allowMissingColumns=True)


def requests(t: Tables) -> DataFrame:
    return t.events.select("ts", F.col("event_type").alias("path"), F.when(F.col("value") > 80, 500).otherwise(200).alias("status"), F.col("value").alias("ms"))


@query(
    "mo3_api_metrics",
    "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, event_type AS path, count(*) AS calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, count(*) FILTER (value > 80) AS errors, "
    "round(count(*) / sum(count(*)) OVER (PARTITION BY time_bucket(INTERVAL 15 MINUTE, ts)), 6) AS share FROM events GROUP BY 1, 2",
)
def mo3(t: Tables) -> DataFrame:
    out = monitoring.api_metrics(requests(t), "ts", "path", "status", "ms")
    return out.withColumns({c: r6(c) for c in ("mean_ms", "share")})


@query("mo3_status_mix", "SELECT event_type AS path, CASE WHEN value > 80 THEN 500 ELSE 200 END AS status, count(*) AS calls, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY 1, 2")
def mo3_mix(t: Tables) -> DataFrame:
    return monitoring.status_mix(requests(t), "path", "status").withColumn("share", r6("share"))


@query("mo3_latency_quantiles", "SELECT event_type AS path, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def mo3_latency(t: Tables) -> DataFrame:
    out = monitoring.latency_quantiles(requests(t), ["path"], "ms")
    return out.withColumns({c: r6(c) for c in ("p50", "p90", "p99")})


@query(
    "mo6_streak_alerts",
    "WITH i AS (SELECT *, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM i WHERE value > 60) "
    "SELECT event_id, user_id, streak FROM s WHERE streak % 2 = 0",
)
def mo6(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "value")
    out = monitoring.streak_alerts(rows, ["user_id"], "ts", "value", 60, 2, ["event_id"])
    return out.select("event_id", "user_id", "streak")


@query(
    "mo7_top_consumer",
    "SELECT user_id, day, k, value FROM (SELECT user_id, CAST(ts AS DATE) AS day, k, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, k) AS rn FROM " + EV + " e) WHERE rn = 1",
)
def mo7(t: Tables) -> DataFrame:
    return monitoring.top_consumer(t.ev.withColumn("day", F.to_date("ts")), "user_id", "day", "k", "value")


@query("mo8_request_rate", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS bucket, count(*) AS requests, round(count(*) / 60.0, 6) AS qps FROM events GROUP BY 1")
def mo8(t: Tables) -> DataFrame:
    return monitoring.request_rate(t.events, "ts", "1 minute").withColumn("qps", r6("qps"))


# ---- attribution ------------------------------------------------------------------------------------

GAINS = "(SELECT l_orderkey AS g, l_partkey AS p, max(l_discount) AS x FROM lineitem GROUP BY 1, 2)"
SUBSETS = (
    f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM {GAINS}), m AS (SELECT g, n, unnest(range(0, CAST(1 << n AS BIGINT))) AS s FROM (SELECT DISTINCT g, n FROM a)), "
    "v AS (SELECT m.g, m.n, m.s, exp(sum(ln(1 + x))) AS prod, count(x) AS size FROM m LEFT JOIN a ON m.g = a.g AND (m.s >> a.i) & 1 = 1 GROUP BY 1, 2, 3), "
    "c AS (SELECT a.g, a.p, a.x, sum(a.x * coalesce(v.prod, 1) * gamma(v.size + 1) * gamma(a.n - v.size) / gamma(a.n + 1)) AS sh FROM a JOIN v ON a.g = v.g AND (v.s >> a.i) & 1 = 0 GROUP BY 1, 2, 3) "
)


# A tiny shift before rounding keeps exact half-way values on one side in both engines.
def gains(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("p")).agg(F.max("l_discount").alias("x"))


@query("at1_shapley", SUBSETS + "SELECT g, p, x, round(sh + 1e-13, 9) AS shapley, CASE WHEN sum(sh) OVER (PARTITION BY g) = 0 THEN NULL ELSE round(sh / sum(sh) OVER (PARTITION BY g) + 1e-12, 6) END AS share FROM c")
def at1(t: Tables) -> DataFrame:
    out = attribution.shapley(gains(t), ["g"], "p", "x")
    return out.select("g", "p", "x", r6(F.col("shapley") + 1e-13, 9).alias("shapley"), r6(F.col("share") + 1e-12).alias("share"))


@query(
    "at2_reward_split",
    SUBSETS + "SELECT g, p, CASE WHEN sum(sh) OVER (PARTITION BY g) = 0 THEN NULL ELSE round(sh / sum(sh) OVER (PARTITION BY g) * 0.75 * 0.8 + 1e-12, 6) END AS reward FROM c",
)
def at2(t: Tables) -> DataFrame:
    shares = attribution.shapley(gains(t), ["g"], "p", "x")
    return attribution.reward_split(shares, "share", 0.25, 0.2).select("g", "p", r6(F.col("reward") + 1e-12).alias("reward"))


# ---- records ----------------------------------------------------------------------------------------

PIECES = "len(regexp_extract_all({0}, '(\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}])'))"


@query(
    "ld1_token_budget",
    "SELECT conv_id, CAST(sum(3 + " + PIECES.format("role") + " + " + PIECES.format("text") + ") + 3 AS BIGINT) AS tokens FROM conversations GROUP BY 1",
)
def ld1(t: Tables) -> DataFrame:
    return records.token_budget(t.conversations, "conv_id", ["role", "text"])


RECORD = T.StructType().add("kind", "string").add("user", "long").add("tags", T.ArrayType(T.StringType()))


@query(
    "ld2_validate_records",
    "SELECT event_id, event_type NOT IN ('error', 'signup', 'purchase') AS valid, CASE event_type WHEN 'error' THEN 'not json' WHEN 'signup' THEN 'missing tags' WHEN 'purchase' THEN 'domain tags' ELSE '' END AS reasons FROM events",
)
def ld2(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"))
    tags = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") == "purchase", ', "tags": ["a", "z"]').otherwise(', "tags": ["a"]')
    text = F.when(F.col("event_type") == "error", F.lit("sorry, no answer")).otherwise(F.concat(F.lit("```json\n"), body, tags, F.lit("}\n```")))
    out = records.validate_records(t.events.select("event_id", text.alias("answer")), "answer", RECORD, {"tags": ["a", "b"]})
    return out.select("event_id", "valid", F.array_join("reasons", ",").alias("reasons"))


@query(
    "ld3_top_tags",
    "WITH n AS (SELECT user_id, event_type, k, CAST(sum(value) AS DOUBLE) AS s FROM " + EV + " e GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(round(s, 2) AS DOUBLE) DESC, CAST(k AS VARCHAR)) AS rn FROM n) "
    "SELECT user_id, event_type, string_agg(k, ',' ORDER BY rn) AS tags FROM r WHERE rn <= 5 GROUP BY 1, 2",
)
def ld3(t: Tables) -> DataFrame:
    sums = t.ev.groupBy("user_id", "event_type", "k").agg(F.round(F.sum("value"), 2).alias("score"))
    tag = F.struct(F.col("k").cast("string").alias("tag"), "score", F.lit("seen").alias("reason"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.collect_list(tag)), F.lit("\n```"))
    answers = sums.groupBy("user_id", "event_type").agg(fenced.alias("answer"))
    out = records.top_tags(answers, "answer", 5)
    return out.select("user_id", "event_type", F.array_join(F.transform("top", lambda x: x["tag"]), ",").alias("tags"))


@query(
    "ld4_text_image",
    "SELECT l_orderkey, count(*) AS n_boxes, round(sum(l_quantity * l_linenumber) / 20000.0, 6) AS area_share, count(*) > 5 OR sum(l_quantity * l_linenumber) / 20000.0 > 0.05 AS is_text FROM lineitem GROUP BY 1",
)
def ld4(t: Tables) -> DataFrame:
    w, h = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    zero = F.lit(0.0)
    box = F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h))
    boxes = t.lineitem.select("l_orderkey", box.alias("box"), F.lit(100.0).alias("h"), F.lit(200.0).alias("w"))
    return records.text_image(boxes, "l_orderkey", "box", "h", "w").withColumn("area_share", r6("area_share"))


VERSIONED = (
    "WITH b AS (SELECT c_custkey, c_acctbal, c_custkey % 3 AS version FROM customer), ch AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, o_orderkey % 3 AS version, o_orderkey AS seq FROM orders), "
    "f AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY c_custkey, version ORDER BY seq) = 1), w AS (SELECT f.* FROM f JOIN b ON f.c_custkey = b.c_custkey AND f.version = b.version) "
)


def _versioned(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = t.customer.select("c_custkey", "c_acctbal", (F.col("c_custkey") % 3).alias("version"))
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), (F.col("o_orderkey") % 3).alias("version"), F.col("o_orderkey").alias("seq"))
    return keyed.versioned_apply(base, changes, "c_custkey", "version", "seq")


@query("ld5_versioned_apply", VERSIONED + "SELECT b.c_custkey, coalesce(w.c_acctbal, b.c_acctbal) AS c_acctbal, b.version + CASE WHEN w.seq IS NULL THEN 0 ELSE 1 END AS version FROM b LEFT JOIN w ON b.c_custkey = w.c_custkey")
def ld5(t: Tables) -> DataFrame:
    return _versioned(t)[0]


@query("ld5_versioned_conflicts", VERSIONED + "SELECT ch.c_custkey, ch.seq FROM ch WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.c_custkey = ch.c_custkey AND w.seq = ch.seq)")
def ld5_conflicts(t: Tables) -> DataFrame:
    return _versioned(t)[1].select("c_custkey", "seq")

