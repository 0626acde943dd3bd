"""Queries on sources, sinks, filters, joins, aggregates, windows, sorts and scalar functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.catalog.registry import EV, IMP, WEIGHTS, WSQL, Tables, query, r6
from clickloom.functions import numeric, text
from clickloom.operators import features, monitoring, relational, search, summaries
from clickloom.plans.ranks import top_n
from clickloom.plans.skew import with_group, within_group_pairs
from clickloom.plans.stage import written
from clickloom.session import fresh_dir
from clickloom.sources import keyed, sinks, tables
from clickloom.streaming import sinks as stream_sinks
from clickloom.streaming import windows

@query(
    "io1_scan_events",
    "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-29' "
    "AND o_orderpriority LIKE '%-%W' AND o_orderstatus NOT IN ('P') AND o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderpriority <> ''",
)
def io1(t: Tables) -> DataFrame:
    days = [datetime(1997, 1, 1) + timedelta(days=d) for d in range(180)]
    out = tables.scan_events(
        t.orders, "o_orderdate", days, ("o_orderpriority", "%-%W"), ("o_orderstatus", ["P"]), ["o_custkey", "o_orderpriority"]
    )
    return out.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("io2_read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def io2(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "csv")
    t.orders.drop("o_orderdate").write.option("header", True).csv(path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return tables.read_csv(t.spark, path, schema)


@query("io2_read_csv_inferred", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def io2_inferred(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "csv-inferred")
    t.orders.drop("o_orderdate").write.option("header", True).csv(path)
    raw = tables.read_csv(t.spark, path)
    assert dict(raw.dtypes)["o_totalprice"] == "double" and dict(raw.dtypes)["o_orderkey"] in ("int", "bigint"), raw.dtypes
    return raw.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query(
    "io3_read_delimited",
    "SELECT user_id, k AS item, value AS rating, CAST(0 AS BIGINT) AS malformed FROM " + EV + " e WHERE event_type <> 'error' "
    "UNION ALL SELECT NULL, NULL, NULL, count(*) FROM events WHERE event_type = 'error'",
)
def io3(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "tsv")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("broken line "), F.col("event_id"))).otherwise(
        F.concat_ws("\t", F.col("user_id").cast("string"), F.col("k").cast("string"), F.col("value").cast("string"))
    )
    t.ev.select(line).write.text(path)
    schema = T.StructType().add("user_id", "long").add("item", "long").add("rating", "double")
    good, bad = tables.read_delimited(t.spark, path, schema)
    count = bad.agg(F.count(F.lit(1)).alias("malformed"))
    return good.withColumn("malformed", F.lit(0).cast("long")).unionByName(count, allowMissingColumns=True)


@query("io4_read_labelled_text", "SELECT p_name AS text, p_type AS label, count(*) AS cnt FROM part GROUP BY ALL")
def io4(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "labelled")
    t.part.select("p_type", "p_name").write.partitionBy("p_type").text(path)
    kinds = [x[0] for x in t.part.select("p_type").distinct().collect()]
    out = tables.read_labelled_text(t.spark, {k: f"{path}/p_type={k}" for k in kinds})
    return out.groupBy("text", "label").agg(F.count(F.lit(1)).alias("cnt"))


@query("io5_read_topic", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def io5(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {"maxFilesPerTrigger": "4"}, t.events.schema, t.path("events") + "*")
    rows = stream.where(F.col("event_type") != "error").select("event_id", "user_id", "event_type")
    return t.spark.read.parquet(stream_sinks.run_to_table(rows, "append", "topic"))


@query("io6_decode_json", "SELECT event_id, lower(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def io6(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.lower("event_type").alias("kind"), "props")
    return tables.decode_json(rows, "props", "k int")


@query("io7_export", "SELECT o_orderpriority, count(*) AS cnt, (SELECT count(*) FROM orders) AS exported FROM orders GROUP BY 1")
def io7(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "export")
    n = sinks.export(t.orders, path)
    return t.spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("cnt")).withColumn("exported", F.lit(n).cast("long"))


INDICATOR = (
    "SELECT event_type, count(*) AS cnt, count(DISTINCT user_id) AS users FROM {events} "
    "WHERE to_date(ts) = to_date(:biz_date) GROUP BY event_type"
)


@query(
    "io8_daily_indicators",
    "SELECT event_type, count(*) AS cnt, count(DISTINCT user_id) AS users, CAST(ts AS DATE) AS biz_date FROM events "
    "WHERE CAST(ts AS DATE) IN (DATE '2024-01-09', DATE '2024-01-10') GROUP BY event_type, CAST(ts AS DATE)",
)
def io8(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "indicators")
    for day in ("2024-01-09", "2024-01-10"):
        sinks.append_table(tables.daily_indicators(t.spark, INDICATOR, day, {"events": t.events}), path)
    return t.spark.read.parquet(path)


@query("io9_cells_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io9(t: Tables) -> DataFrame:
    family = {"c_name": "basic", "c_nationkey": "basic", "c_acctbal": "account", "c_mktsegment": "account"}
    cells = keyed.rows_to_cells(t.customer, "c_custkey", family)
    schema = {"basic:c_name": "string", "basic:c_nationkey": "int", "account:c_acctbal": "double", "account:c_mktsegment": "string"}
    return keyed.cells_to_rows(cells, "c_custkey", "family", "qualifier", "value", schema)


@query("io10_overwrite_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def io10(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "overwrite")
    t.customer.write.parquet(path)
    t.customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "io11_overwrite_partition",
    "SELECT user_id, event_type, '2024-01-08_06' AS biz_date FROM events WHERE event_type = 'click' UNION ALL "
    "SELECT user_id, event_type, '2024-01-09_06' FROM events WHERE event_type = 'purchase'",
)
def io11(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "partitions")
    rows = t.events.select("user_id", "event_type")
    first, second = (sinks.partition_hour(datetime(2024, 1, d, 6)) for d in (9, 10))
    sinks.overwrite_partition(rows.where("event_type = 'click'"), path, "biz_date", first)
    sinks.overwrite_partition(rows.where("event_type = 'view'"), path, "biz_date", second)
    sinks.overwrite_partition(rows.where("event_type = 'purchase'"), path, "biz_date", second)
    return t.spark.read.option("inferSchema", False).parquet(path).withColumn("biz_date", F.col("biz_date").cast("string"))


@query("io12_bulk_load", "SELECT l_orderkey, l_partkey, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem")
def io12(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "bulk")
    sinks.bulk_load(t.lineitem, path, ["l_orderkey", "l_partkey", "l_quantity"], 10_000, casts={"l_quantity": "int"})
    return t.spark.read.parquet(path)


@query("io13_replace_table", "SELECT p_partkey AS item_id, p_name AS title FROM part")
def io13(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "replace")
    sinks.replace_table(t.part, path, {"p_partkey": "item_id", "p_name": "title"})
    return t.spark.read.parquet(path)


@query(
    "io14_upsert",
    "WITH u AS (SELECT o_custkey + 100 AS c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS c_acctbal FROM orders GROUP BY 1) "
    "SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, c.c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal "
    "FROM customer c FULL JOIN u ON c.c_custkey = u.c_custkey",
)
def io14(t: Tables) -> DataFrame:
    updates = t.orders.select(
        (F.col("o_custkey") + 100).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )
    return keyed.upsert(t.customer.select("c_custkey", "c_name", "c_acctbal"), updates, ["c_custkey"], "at")


@query("io15_publish", "SELECT n_nationkey, n_name FROM nation")
def io15(t: Tables) -> DataFrame:
    folder, want = fresh_dir(t.spark, "publish"), t.nation.count()
    for _ in range(2):
        sinks.publish(
            t.spark, "nation_live", lambda p: t.nation.select("n_nationkey", "n_name").write.mode("overwrite").parquet(p),
            lambda df: df.count() == want, folder,
        )
    return t.spark.table("nation_live")


@query("io16_complete_sink", "SELECT event_type AS word, count(*) AS cnt FROM events GROUP BY 1")
def io16(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {}, t.events.schema, t.path("events") + "*")
    counts = windows.running_counts(stream.select(F.col("event_type").alias("word")), "word")
    return t.spark.read.parquet(stream_sinks.run_to_table(counts, "complete", "counts"))


@query("io17_process_then_commit", "SELECT event_id, event_type FROM events")
def io17(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {}, t.events.schema, t.path("events") + "*").select("event_id", "event_type")
    out, state = fresh_dir(t.spark, "commit"), fresh_dir(t.spark, "commit-state")
    stream_sinks.process_then_commit(stream, stream_sinks.by_batch(out), state, True).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query(
    "io18_keyed_store",
    "SELECT user_id, event_type, avg_value FROM (SELECT user_id, event_type, round(avg(value), 6) AS avg_value, max(ts) AS last FROM events "
    "GROUP BY ALL) WHERE last + INTERVAL 7 DAY > TIMESTAMP '2024-01-31 00:00:00'",
)
def io18(t: Tables) -> DataFrame:
    stream = tables.read_topic(t.spark, "parquet", {}, t.events.schema, t.path("events") + "*")
    store = stream_sinks.KeyedStore(t.spark, fresh_dir(t.spark, "store"), ["user_id", "event_type"])

    def step(df: DataFrame, batch: int) -> None:
        cells = df.groupBy("user_id", "event_type").agg(F.avg("value").alias("avg_value"), F.max("ts").alias("last"))
        store.write(cells, batch, F.col("last") + F.expr("interval 7 days"))

    stream_sinks.process_then_commit(stream, step, fresh_dir(t.spark, "store-state"), True).awaitTermination()
    live = keyed.drop_expired(store.read(), "expires_at", F.lit("2024-01-31").cast("timestamp"))
    return live.select("user_id", "event_type", r6("avg_value").alias("avg_value"))


@query("io19_multi_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def io19(t: Tables) -> DataFrame:
    keys = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.multi_get(t.orders, "o_custkey", keys).select("o_orderkey", "o_totalprice")


@query("io20_evolve", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(NULL AS VARCHAR) AS s_phone, s_name, s_acctbal FROM supplier")
def io20(t: Tables) -> DataFrame:
    schema = T.StructType().add("s_suppkey", "long").add("s_nationkey", "long").add("s_phone", "string")
    return keyed.evolve(t.supplier, schema)


@query("io21_ensure_columns", "SELECT doc_id, quality, toxic, CAST(NULL AS VARCHAR) AS score, 0 AS state FROM labels")
def io21(t: Tables) -> DataFrame:
    return keyed.ensure_columns(t.labels, {"score": F.lit(None).cast("string"), "state": 0, "quality": 1})


@query("pf1_projection", "SELECT event_id, ts, user_id, event_type, value FROM events")
def pf1(t: Tables) -> DataFrame:
    return t.events.drop("props")


@query("pf2_array_length", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE len(string_split(text, chr(10))) > 1")
def pf2(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.where(F.size(lines) > 1).select("doc_id", F.size(lines).cast("long").alias("n_lines"))


@query(
    "pf3_log_filter",
    "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00' "
    "AND value BETWEEN 10 AND 60 AND event_type IN ('click', 'purchase') AND user_id <> 8",
)
def pf3(t: Tables) -> DataFrame:
    c = F.col
    return t.events.where(
        (c("ts") >= F.lit("2024-01-05").cast("timestamp")) & (c("ts") < F.lit("2024-01-25").cast("timestamp"))
        & c("value").between(10, 60) & c("event_type").isin("click", "purchase") & (c("user_id") != 8)
    ).select("event_id", "value")


@query("pf4_byte_length", "SELECT p_partkey, p_name FROM part WHERE strlen(p_name) > 7 AND strlen(p_name) <= 10")
def pf4(t: Tables) -> DataFrame:
    return relational.byte_length_between(t.part.select("p_partkey", "p_name"), "p_name", 7, 10)


@query(
    "pf5_threshold_filter",
    "SELECT user_id, k, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, k) AS rn FROM "
    f"(SELECT user_id, k, CAST(sum({WSQL}) AS BIGINT) AS score FROM {EV} e GROUP BY 1, 2)) WHERE score > 2 AND rn <= 10 AND k NOT IN (13, 66)",
)
def pf5(t: Tables) -> DataFrame:
    ranked = top_n(relational.behavior_score(t.ev, ["user_id", "k"], "event_type", WEIGHTS), ["user_id"], ["-score", "k"], 20)
    return relational.threshold_filter(ranked, "score", 2, "rn", 10, [13, 66], "k")


@query(
    "pf6_having_all",
    "SELECT k FROM (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS k, event_type FROM " + EV + " e) "
    "WHERE event_type IN ('click', 'view') GROUP BY k HAVING count(DISTINCT event_type) = 2",
)
def pf6(t: Tables) -> DataFrame:
    rows = t.ev.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("k"), "event_type")
    return relational.having_all(rows, "k", "event_type", ["click", "view"])


@query("pf7_default_label", "SELECT vec_id, label FROM embeddings WHERE label <> 4")
def pf7(t: Tables) -> DataFrame:
    return t.embeddings.where("label != 4").select("vec_id", "label")


@query("pf8_positive_score", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def pf8(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("pf9_fill_nulls", "SELECT d.doc_id, coalesce(quality, -1) AS quality, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pf9(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").fillna(-1, ["quality"])


ROUTES = {"contact": "(mail|@)", "link": "(http|www)", "number": "[0-9]{3,}"}


@query(
    "pf10_route",
    "WITH m AS (SELECT doc_id, regexp_matches(text, '(mail|@)') AS a, regexp_matches(text, '(http|www)') AS b, "
    "regexp_matches(text, '[0-9]{3,}') AS c FROM documents) SELECT doc_id, 'contact' AS route FROM m WHERE a UNION ALL "
    "SELECT doc_id, 'link' FROM m WHERE b UNION ALL SELECT doc_id, 'number' FROM m WHERE c UNION ALL "
    "SELECT doc_id, 'general' FROM m WHERE NOT a AND NOT b AND NOT c",
)
def pf10(t: Tables) -> DataFrame:
    return relational.route(t.documents.select("doc_id", "text"), "text", ROUTES).select("doc_id", "route")


@query(
    "j1_session_self_join",
    "WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id, k, count(*) AS c FROM " + EV + " e GROUP BY 1, 2, 3) SELECT a.day, a.user_id, "
    "a.k AS a, b.k AS b, a.c AS c_a, b.c AS c_b FROM s a JOIN s b ON a.day = b.day AND a.user_id = b.user_id AND a.k < b.k",
)
def j1(t: Tables) -> DataFrame:
    rows = t.ev.groupBy(F.to_date("ts").alias("day"), "user_id", "k").agg(F.count(F.lit(1)).alias("c"))
    return within_group_pairs(rows, ["day", "user_id"], "k", ["c"])


@query(
    "j2_aggregate_join",
    "SELECT o_orderkey, o_custkey, round(o_totalprice / s, 9) AS share, n FROM orders JOIN (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n "
    "FROM orders GROUP BY 1) USING (o_custkey)",
)
def j2(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    out = with_group(o, ["o_custkey"], s=F.sum("o_totalprice"), n=F.count(F.lit(1)))
    return out.select("o_orderkey", "o_custkey", r6(F.col("o_totalprice") / F.col("s"), 9).alias("share"), "n")


@query(
    "j3_total_share",
    "SELECT event_type, count(*) AS cnt, (SELECT count(*) FROM events) AS total, round(count(*) / (SELECT count(*) FROM events), 9) AS share "
    "FROM events GROUP BY 1",
)
def j3(t: Tables) -> DataFrame:
    total = t.events.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")).withColumn("total", total)
    return out.withColumn("share", r6(F.col("cnt") / F.col("total"), 9))


@query("j4_left_count", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j4(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n_orders"])


@query(
    "j6_join_labels",
    "SELECT i.request, i.item, i.pos, coalesce(a.label, 0) AS label FROM " + IMP + " i LEFT JOIN (SELECT l_orderkey AS request, l_partkey AS item, "
    "max(CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END) AS label FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a ON i.request = a.request AND i.item = a.item",
)
def j6(t: Tables) -> DataFrame:
    acts = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("item"), F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("label")
    )
    return relational.join_labels(t.imp.select("request", "item", "pos"), acts, ["request", "item"])


@query(
    "j7_asof_join",
    "SELECT e.event_id, e.user_id, e.ts, f.ts AS feature_ts, f.value AS last_value FROM events e ASOF LEFT JOIN "
    "(SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') f ON e.user_id = f.user_id AND e.ts > f.ts",
)
def j7(t: Tables) -> DataFrame:
    samples = t.events.select("event_id", "user_id", "ts")
    feats = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("feature_ts"), F.col("value").alias("last_value"))
    return relational.asof_join(samples, feats, ["user_id"], "ts", "feature_ts")


@query(
    "j8_enrich",
    "SELECT p_type, s_nationkey, count(*) AS cnt, round(sum(l_quantity), 2) AS qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey "
    "LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
)
def j8(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    full = relational.enrich(li, (t.part.select("p_partkey", "p_type"), "p_partkey"), (t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey"))
    return full.groupBy("p_type", "s_nationkey").agg(F.count(F.lit(1)).alias("cnt"), r6(F.sum("l_quantity"), 2).alias("qty"))


@query(
    "j9_exclude_served",
    "SELECT DISTINCT user_id, k FROM " + EV + " e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM " + EV + " p WHERE p.event_type = 'purchase' "
    "AND p.user_id = e.user_id AND p.k = e.k)",
)
def j9(t: Tables) -> DataFrame:
    cands = t.ev.where("event_type = 'view'").select("user_id", "k").distinct()
    return relational.exclude(cands, t.ev.where("event_type = 'purchase'"), ["user_id", "k"])


@query(
    "j10_compute_missing",
    "WITH c AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT d.doc_id, sha256(d.text) AS hash, "
    "CAST(length(d.text) AS BIGINT) AS result, c.hash IS NOT NULL AS cached FROM documents d LEFT JOIN c ON sha256(d.text) = c.hash",
)
def j10(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    rated = t.documents.join(t.labels, "doc_id")
    stored = F.when(F.col("quality") == 1, F.lit("2024-01-20")).otherwise(F.lit("2023-12-01")).cast("timestamp")
    cache = rated.groupBy(F.sha2("text", 256).alias("hash")).agg(
        F.max(F.length("text")).cast("long").alias("result"), F.max(stored).alias("stored_at")
    )
    work = lambda todo: todo.select("hash", F.length("text").cast("long").alias("result"))
    return relational.compute_missing(t.documents.select("doc_id", "text"), "text", cache, work, now).select("doc_id", "hash", "result", "cached")


@query(
    "j11_fuse_profiles",
    "SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer "
    "FULL JOIN supplier ON c_custkey = s_suppkey + 50",
)
def j11(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(
        (F.col("s_suppkey") + 50).alias("j"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    b = b.select(F.col("j").alias("key"), "name", "balance")
    return relational.fuse_profiles(a, b, "key", {"name": "a", "balance": "b"})


@query("ag1_count_having", "SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def ag1(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 3")


@query("ag2_distinct_having", "SELECT k, count(*) AS cnt FROM " + EV + " e GROUP BY k HAVING count(DISTINCT user_id) > 10")
def ag2(t: Tables) -> DataFrame:
    out = t.ev.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("user_id").alias("users"))
    return out.where("users > 10").drop("users")


@query("ag3_sum_of_counts", "SELECT user_id, CAST(sum(c) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def ag3(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.sum("c").alias("total"))


@query("ag4_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users, (SELECT count(DISTINCT user_id) FROM events) AS all_users FROM events GROUP BY 1")
def ag4(t: Tables) -> DataFrame:
    overall = t.events.agg(F.countDistinct("user_id").alias("n")).scalar()
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).withColumn("all_users", overall)


@query(
    "ag4_daily_sketches",
    "SELECT event_type, count(*) AS rows, min(value) AS lowest, max(value) AS highest, true AS members_close, true AS median_close, true AS p90_close "
    "FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1",
)
def ag4_sketches(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "daily")
    summaries.store_days(summaries.summarize_days(t.events, "ts", ["event_type"], "user_id", "value"), path)
    est = summaries.over_days(t.spark, path, ["event_type"], "2024-01-03", "2024-01-20", {"median": 0.5, "p90": 0.9})
    # How far the estimates are from the rows they stand for: three standard errors at most.
    rows = t.events.where((F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")))
    both = rows.select("event_type", "user_id", "value").join(est, "event_type")
    below = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    exact = both.groupBy("event_type").agg(F.countDistinct("user_id").alias("n"), below("median").alias("m"), below("p90").alias("p"), F.first("members").alias("members"))
    slack = 1.0 / F.col("rows")
    exact = exact.join(est.select("event_type", "rows", "lowest", "highest"), "event_type")
    return exact.select(
        "event_type", "rows", "lowest", "highest",
        (F.abs(F.col("members") - F.col("n")) <= 3 * summaries.DISTINCT_ERROR * F.col("n") + 1).alias("members_close"),
        (F.abs(F.col("m") - 0.5) <= 3 * summaries.RANK_ERROR + slack).alias("median_close"),
        (F.abs(F.col("p") - 0.9) <= 3 * summaries.RANK_ERROR + slack).alias("p90_close"),
    )


@query(
    "ag5_collect_sorted",
    "SELECT user_id, CAST(floor((rn - 1) / 50) AS BIGINT) AS part, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT user_id, k, row_number() OVER "
    "(PARTITION BY user_id ORDER BY k) AS rn FROM (SELECT DISTINCT user_id, CAST(k AS VARCHAR) || ':' || event_type AS k FROM " + EV + " e)) GROUP BY 1, 2",
)
def ag5(t: Tables) -> DataFrame:
    rows = t.ev.select("user_id", F.concat_ws(":", F.col("k").cast("string"), "event_type").alias("k"))
    out = relational.collect_sorted(rows, ["user_id"], "k", per_row=50)
    return out.select("user_id", "part", F.array_join("items", ",").alias("items"))


@query(
    "ag6_list_of_counts",
    "SELECT user_id, string_agg(event_type || ':' || c, ',' ORDER BY event_type) AS types FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1",
)
def ag6(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    cells = F.sort_array(F.collect_list(F.struct("event_type", F.concat_ws(":", "event_type", F.col("c").cast("string")).alias("s"))))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(cells, lambda x: x["s"]), ",").alias("types"))


@query(
    "ag7_value_counts",
    "SELECT event_type, k, cnt, rn FROM (SELECT event_type, k, count(*) AS cnt, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, k) AS rn FROM "
    + EV + " e GROUP BY 1, 2) WHERE rn <= 10",
)
def ag7(t: Tables) -> DataFrame:
    return relational.value_counts(t.ev, "k", by="event_type", top=10)


@query("ag8_behavior_score", f"SELECT user_id, k, CAST(sum({WSQL}) AS BIGINT) AS score FROM {EV} e GROUP BY 1, 2")
def ag8(t: Tables) -> DataFrame:
    return relational.behavior_score(t.ev, ["user_id", "k"], "event_type", WEIGHTS)


@query("ag9_distinct_sets", "SELECT o_custkey, count(DISTINCT l_partkey) AS n_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ag9(t: Tables) -> DataFrame:
    sets = _baskets(t).distinct()
    return sets.groupBy(F.col("user").alias("o_custkey")).agg(F.count("item").alias("n_items"))


def _baskets(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("user"))
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    return li.join(o, "o_orderkey").select("user", "item")


@query("ag10_distinct_records", "SELECT DISTINCT user_id, event_type FROM events")
def ag10(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("u"), F.col("user_id").cast("string"), F.lit("e"), F.col("event_type")))
        .otherwise(F.create_map(F.lit("e"), F.col("event_type"), F.lit("u"), F.col("user_id").cast("string"))).alias("rec")
    )
    out = relational.distinct_records(rows)
    return out.select(F.col("rec")["u"].cast("long").alias("user_id"), F.col("rec")["e"].alias("event_type"))


@query("ag11_label_summary", "SELECT user_id, event_type, count(value) AS cnt, round(sum(value), 4) AS total, max(value) AS max_value FROM events GROUP BY 1, 2")
def ag11(t: Tables) -> DataFrame:
    return relational.label_summary(t.events, ["user_id", "event_type"], "value").withColumn("total", r6("total", 4))


@query(
    "ag12_histogram",
    "SELECT event_type, b.le, CAST(sum(CASE WHEN b.hi IS NULL OR value <= b.hi THEN 1 ELSE 0 END) AS BIGINT) AS cnt FROM events, "
    "(VALUES ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('90.0', 90.0), ('+Inf', NULL)) b(le, hi) WHERE value IS NOT NULL GROUP BY 1, 2",
)
def ag12(t: Tables) -> DataFrame:
    return relational.histogram(t.events, ["event_type"], "value", [5, 10, 50, 90])


@query("ag16_term_frequency", "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def ag16(t: Tables) -> DataFrame:
    return relational.term_frequency(t.documents, "text", r"[ \t\n\x0B\f\r]+")


@query(
    "w1_top_per_user",
    "SELECT user_id, event_type, cnt, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, event_type) AS rn FROM "
    "(SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2)) WHERE rn <= 3",
)
def w1(t: Tables) -> DataFrame:
    return top_n(t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("cnt")), ["user_id"], ["-cnt", "event_type"], 3)


@query(
    "w5_lag_diff",
    "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS diff FROM events",
)
def w5(t: Tables) -> DataFrame:
    out = relational.lag_diff(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "value", ["event_id"])
    return out.select("event_id", r6("diff").alias("diff"))


@query(
    "w7_history_before",
    "SELECT event_id, coalesce(array_to_string(list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS history FROM "
    + EV + " e",
)
def w7(t: Tables) -> DataFrame:
    rows = t.ev.select("event_id", "user_id", "ts", F.col("k").cast("string").alias("k"))
    out = relational.history_before(rows, "user_id", "ts", "k", 5, ["event_id"])
    return out.select("event_id", F.array_join("history", ",").alias("history"))


@query("sl1_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sl1(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("sl2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sl2(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("sl3_contiguous", "SELECT l_orderkey, count(*) AS lines, true AS contiguous FROM lineitem GROUP BY 1")
def sl3(t: Tables) -> DataFrame:
    rows = relational.contiguous(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", 8, ["l_partkey"])
    # Written as it stands: the place of a row is read from the files, one per partition.
    placed = written(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "contiguous")
    parts = placed.groupBy("l_orderkey", "part").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at") + 1).alias("span"))
    return parts.groupBy("l_orderkey").agg(
        F.sum("n").alias("lines"), ((F.max(F.col("span") - F.col("n")) == 0) & (F.max("part") - F.min("part") + 1 == F.count(F.lit(1)))).alias("contiguous")
    )


@query(
    "sl4_top_n_score",
    f"SELECT user_id, k, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, k) AS rn FROM "
    f"(SELECT user_id, k, CAST(sum({WSQL}) AS BIGINT) AS score FROM {EV} e GROUP BY 1, 2)) WHERE rn <= 3",
)
def sl4(t: Tables) -> DataFrame:
    return top_n(relational.behavior_score(t.ev, ["user_id", "k"], "event_type", WEIGHTS), ["user_id"], ["-score", "k"], 3)


_ROUTE_SQL = (
    "(SELECT user_id, k, CAST(sum(value) AS DOUBLE) AS s, '{0}' AS route, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(value), 4) DESC, k) AS rank "
    "FROM " + EV + " e WHERE event_type = '{0}' GROUP BY 1, 2)"
)


@query(
    "so1_merge_routes",
    "WITH c AS (SELECT * FROM " + _ROUTE_SQL.format("click") + " WHERE rank <= 10 UNION ALL SELECT * FROM " + _ROUTE_SQL.format("view")
    + " WHERE rank <= 10), b AS (SELECT user_id, k, min(rank) AS rank, arg_min(route, (rank, route)) AS route FROM c GROUP BY 1, 2) SELECT * FROM (SELECT user_id, k, rank, route, "
    "row_number() OVER (PARTITION BY user_id ORDER BY rank, route, k) AS pos FROM b) WHERE pos <= 10",
)
def so1(t: Tables) -> DataFrame:
    def recall(kind: str) -> DataFrame:
        return t.ev.where(F.col("event_type") == kind).groupBy("user_id", "k").agg(r6(F.sum("value"), 4).alias("score"))

    out = relational.merge_routes([("click", recall("click")), ("view", recall("view"))], "user_id", "k", "score", 10)
    return out.select("user_id", "k", "rank", "route", "pos")


@query("so2_concat_labelled", "SELECT n_name AS text, 0 AS label FROM nation UNION ALL SELECT p_name, 1 FROM part")
def so2(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_name").alias("text"), F.lit(0).alias("label"))
    return a.unionByName(t.part.select(F.col("p_name").alias("text"), F.lit(1).alias("label")))


@query("f1_split_explode", "SELECT p_partkey, unnest(string_split(replace(p_name, ' ', '|'), '|')) AS word FROM part")
def f1(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split(F.translate("p_name", " ", "|"), r"[\|]")).alias("word"))


@query("f2_concat", "SELECT concat_ws(':', o_orderkey, o_custkey, o_orderstatus) AS packed FROM orders")
def f2(t: Tables) -> DataFrame:
    return t.orders.select(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("packed"))


@query("f3_lower_trim_replace", "SELECT s_suppkey, replace(trim(lower(' ' || s_name || ' ')), '#', '-') AS name FROM supplier")
def f3(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.replace(F.trim(F.lower(F.concat(F.lit(" "), "s_name", F.lit(" ")))), F.lit("#"), F.lit("-")).alias("name"))


@query(
    "f4_normalize_query",
    "SELECT doc_id, sha256(lower(translate(text, '，。！？、；：“”‘’（）《》【】{}—…￥·~！@#￥%&*+|:\"<>?`[]\\;'',./ ', ''))) AS h FROM documents",
)
def f4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.normalize_query(F.col("text")), 256).alias("h"))


@query("f5_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_brand) AS d FROM part")
def f5(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_brand").cast("long").alias("d"))


@query("f6_containment", "SELECT e.event_id, contains(props, CAST(user_id AS VARCHAR)) AS a, contains(event_type, 'i') AS b FROM events e")
def f6(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.contains("props", F.col("user_id").cast("string")).alias("a"), F.contains("event_type", F.lit("i")).alias("b"))


@query("f7_paren_text", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS inner_text FROM part")
def f7(t: Tables) -> DataFrame:
    wrapped = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" (a) （"), "p_brand", F.lit("）"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", wrapped.alias("w")).select("p_partkey", text.paren_text(F.col("w")).alias("inner_text"))


@query("f8_log_divide", "SELECT o_orderkey, round(log10(o_totalprice), 6) AS lg, o_totalprice / (o_custkey + 1) AS q FROM orders")
def f8(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", r6(F.log10("o_totalprice")).alias("lg"), (F.col("o_totalprice") / (F.col("o_custkey") + 1)).alias("q"))


@query(
    "f9_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 1 AS yesterday, strftime(o_orderdate, '%Y-%m-%d_%H') AS part, CAST(o_orderdate AS DATE) + 30 AS due FROM orders",
)
def f9(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_sub(d, 1).alias("yesterday"), F.date_format("o_orderdate", "yyyy-MM-dd_HH").alias("part"), F.date_add(d, 30).alias("due"))


@query("f10_epoch_seconds", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def f10(t: Tables) -> DataFrame:
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.timestamp_seconds(secs).cast("timestamp_ntz").alias("at"))


@query("f11_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def f11(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("f12_base64", "SELECT doc_id, md5(base64(encode(text))) AS b, text = decode(from_base64(base64(encode(text)))) AS same FROM documents")
def f12(t: Tables) -> DataFrame:
    b = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    return t.documents.select("doc_id", F.md5(b).alias("b"), (F.decode(F.unbase64(b), "UTF-8") == F.col("text")).alias("same"))


@query("f13_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p FROM customer")
def f13(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", r6(numeric.sigmoid(F.col("c_acctbal") / 1000)).alias("p"))


@query("f14_percent", "SELECT l_orderkey, l_partkey, printf('%.1f%%', l_discount * 100) AS d FROM lineitem")
def f14(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", numeric.pct(F.col("l_discount"), 1).alias("d"))


@query("f15_last_segment", "SELECT page_id, '/' || string_split(url, '/')[-1] AS seg FROM pages")
def f15(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.last_segment(F.col("url")).alias("seg"))


@query("f16_fenced_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f16(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    parsed = text.parse_fenced_json(fenced, "struct<k:int>")
    return t.events.select("event_id", parsed["k"].alias("k"))


@query("f17_clean_nan", "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'quality:  banana' ELSE 'quality: ' || quality || ' banana' END AS shown FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def f17(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    shown = F.concat(F.lit("quality: "), F.coalesce(F.col("quality").cast("string"), F.lit("nan")), F.lit(" banana"))
    return rows.select("doc_id", text.clean_nan(shown).alias("shown"))


@query("f18_polygon_area", "SELECT p_partkey, round(p_size * (p_size + 2) / 2.0, 6) AS area FROM part")
def f18(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    pts = F.array(*[F.array(x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (F.lit(0.0), s + 2))])
    return t.part.select("p_partkey", r6(numeric.polygon_area(pts)).alias("area"))


@query(
    "f19_min_max",
    "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)",
)
def f19(t: Tables) -> DataFrame:
    out = features.min_max(t.events.select("event_id", "user_id", "value"), "value", ["user_id"])
    return out.select("event_id", r6("scaled").alias("scaled"))


@query(
    "mo5_table_check",
    "SELECT 'events' AS table_name, '2024-01-10' AS day, count(*) AS cnt, CASE WHEN count(*) > 300 THEN 'ok' ELSE 'low' END AS status FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' "
    "UNION ALL SELECT 'orders', '2024-01-10', count(*), CASE WHEN count(*) > 300 THEN 'ok' ELSE 'low' END FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '2024-01-10' "
    "UNION ALL SELECT 'broken', '2024-01-10', NULL, 'error: UNRESOLVED_COLUMN.WITH_SUGGESTION'",
)
def mo5(t: Tables) -> DataFrame:
    sources = {"events": t.events, "orders": t.orders, "broken": t.part}
    return monitoring.table_check(t.spark, sources, "2024-01-10", 300, {"events": "ts", "orders": "o_orderdate"})


@query("tx15_word_count", "SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def tx15(t: Tables) -> DataFrame:
    return relational.term_frequency(t.part, "p_name", " ")


@query(
    "tx4_frequent_queries",
    "SELECT k AS query, count(*) AS freq FROM " + EV + " e WHERE event_type IN ('click', 'view') AND value < 80 GROUP BY k HAVING count(DISTINCT user_id) > 10",
)
def tx4(t: Tables) -> DataFrame:
    rows = t.ev.withColumnRenamed("k", "query")
    return search.frequent_queries(rows, "query", "user_id", F.col("event_type").isin("click", "view"), F.col("value") < 80)
