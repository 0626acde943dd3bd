"""Boundaries, ties, nulls, empty inputs and malformed rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators import evaluation, features, monitoring, recommend, relational, search, sequences, training, vectors
from clickloom.plans.ranks import exact_quantiles, top_n
from clickloom.plans.skew import with_group
from clickloom.session import fresh_dir
from clickloom.sources import keyed, sinks, tables
from clickloom.streaming import sinks as stream_sinks
from clickloom.streaming import windows
from clickloom.streaming.chunks import flush_chunks, flush_stream

T0 = datetime(2024, 1, 1)


def minutes(m: float) -> datetime:
    return T0 + timedelta(minutes=m)


def test_session_gap_of_exactly_thirty_minutes_stays(frame):
    rows = [("u", minutes(0), 1), ("u", minutes(30), 2), ("u", minutes(60) + timedelta(seconds=1), 3), (None, minutes(1), 4), ("v", None, 5)]
    out = sequences.sessionize(frame(rows, "u string, ts timestamp, i int"), "u", "ts")
    assert {r.i: r.session for r in out.collect()} == {1: 1, 2: 1, 3: 2}


def test_session_sequences_drop_duplicates_and_go_on_in_parts(frame):
    rows = [("u", 1, minutes(1), "a"), ("u", 1, minutes(1), "a"), ("u", 1, minutes(0), "b"), ("u", 1, minutes(2), "a")]
    df = frame(rows, "u string, s int, ts timestamp, i string")
    assert sequences.session_sequences(df, "u", "s", "ts", "i").first()["items"] == ["b", "a", "a"]
    parts = sequences.session_sequences(df, "u", "s", "ts", "i", per_row=2).orderBy("part").collect()
    assert [(r.part, r["items"]) for r in parts] == [(0, ["b", "a"]), (1, ["a"])]


def test_empty_inputs(spark, frame):
    ev = frame([], "u string, ts timestamp, i string, w double")
    assert sequences.sessionize(ev, "u", "ts").count() == 0
    assert recommend.swing(ev, "u", "i").count() == 0
    assert recommend.cooccurrence(ev, "u", "i").count() == 0
    assert relational.having_all(ev, "u", "i", []).count() == 0
    assert relational.having_all(ev, "u", "i", ["a"]).count() == 0
    assert exact_quantiles(ev, ["u"], "w", [0.5], ["m"]).count() == 0
    assert search.query_cooccurrence_tfidf(ev, ["u"], "i", 0, 99).count() == 0


def test_asof_is_strictly_before(frame):
    samples = frame([("u", minutes(10), 1), ("u", minutes(5), 2), ("v", minutes(5), 3)], "u string, ts timestamp, id int")
    feats = frame([("u", minutes(5), 1.0), ("u", minutes(10), 2.0)], "u string, fts timestamp, x double")
    got = {r.id: r.x for r in relational.asof_join(samples, feats, ["u"], "ts", "fts").collect()}
    assert got == {1: 1.0, 2: None, 3: None}
    same = {r.id: r.x for r in relational.asof_join(samples, feats, ["u"], "ts", "fts", strict=False).collect()}
    assert same == {1: 2.0, 2: 1.0, 3: None}


def test_conflicts_at_exactly_a_day(frame):
    day = 24 * 60
    rows = [
        ("a", minutes(0), 0, 1), ("a", minutes(day), 1, 2),  # exactly 24 h before a positive: dropped
        ("b", minutes(0), 0, 3), ("b", minutes(day + 1), 1, 4),  # a minute more: kept
        ("c", minutes(0), 0, 5), ("c", minutes(day), 0, 6), ("c", minutes(2 * day), 0, 7),  # only the latest
        ("d", minutes(0), 0, 8), ("d", minutes(day + 1), 0, 9),  # far apart: both
    ]
    df = frame([("u", *r) for r in rows], "u string, i string, ts timestamp, label int, id int")
    got = training.resolve_conflicts(df, "u", "i", "ts", "label", tie=["id"])
    assert {r.id for r in got.collect()} == {2, 3, 4, 7, 8, 9}


def test_streak_restarts_after_an_alert(frame):
    rows = [("h", i, 91.0) for i in range(600)] + [("h", 600, 90.0), ("h", 601, 91.0)] + [("g", i, 91.0) for i in range(299)]
    out = monitoring.streak_alerts(frame(rows, "host string, t int, v double"), ["host"], "t", "v")
    assert sorted((r.host, r.t) for r in out.collect()) == [("h", 299), ("h", 599)]


def test_bytes_and_thresholds(frame):
    df = frame([("abc",), ("abcd",), ("a" * 15,), ("a" * 16,), ("感冒",), (None,)], "q string")
    assert relational.byte_length_between(df, "q", 3, 15).count() == 3
    ranked = frame([("a", 0.01, 1), ("b", 0.02, 10), ("c", 0.02, 11), ("d", 0.5, 2)], "w string, s double, r int")
    kept = relational.threshold_filter(ranked, "s", 0.01, "r", 10, ["d"], "w")
    assert [r.w for r in kept.collect()] == ["b"]


def test_favorites_need_three(frame):
    df = frame([("u", "a")] * 3 + [("u", "b")] * 2 + [("u", "c")] * 3, "u string, t string")
    assert recommend.favorite_types(df, "u", "t").first().types == "a:3,c:3"


def test_top_n_breaks_ties_by_id(frame):
    df = frame([("u", "b", 1), ("u", "a", 1), ("u", "c", 2)], "u string, i string, s int")
    assert [r.i for r in top_n(df, ["u"], ["-s", "i"], 2).orderBy("rn").collect()] == ["c", "a"]


def test_malformed_lines_and_json(spark, frame):
    log = frame([("10.0.0.1-[t]-GET /a-b/c HTTP/2.0-200-0.25",), ("broken",), ("",)], "line string")
    good, bad = monitoring.parse_proxy_log(log, "line")
    row = good.first()
    assert (row.source, row.method, row.status, row.path, row.ms) == ("10.0.0.1", "GET", "200", "/c", 250.0)
    assert bad.count() == 2
    js = frame([(1, '{"k": 5}'), (2, "{"), (3, None)], "id int, v string")
    assert {r.id: r.k for r in tables.decode_json(js, "v", "k int").collect()} == {1: 5, 2: None, 3: None}
    path = fresh_dir(spark, "tsv")
    frame([("u\ti\t4.5",), ("u\ti",), ("u\ti\tx",)], "line string").write.text(path)
    ok, broken = tables.read_delimited(spark, path, T.StructType().add("u", "string").add("i", "string").add("r", "double"))
    assert [tuple(r) for r in ok.collect()] == [("u", "i", 4.5)] and broken.count() == 2


def test_table_check_threshold_is_strict(spark, frame):
    df = frame([("2024-01-02",)] * 5 + [("2024-01-01",)], "biz_date string")
    out = monitoring.table_check(spark, {"five": df, "gone": "/no/such/table"}, "2024-01-02", 5)
    got = {r.table_name: (r.cnt, r.status) for r in out.collect()}
    assert got["five"] == (5, "low") and got["gone"][0] is None and got["gone"][1].startswith("error")
    assert monitoring.table_check(spark, {"five": df}, "2024-01-02", 4).first().status == "ok"
    dt = frame([("2024-01-02",)], "dt string")
    assert monitoring.table_check(spark, {"x_feature": dt}, "2024-01-02", 0).first().status == "ok"


def test_upsert_keeps_fields_without_a_new_value(frame):
    base = frame([(1, "a", 1), (2, "b", 2)], "id int, n string, x int")
    updates = frame([(2, None, 20, 1), (2, "z", None, 2), (3, "c", 30, 1)], "id int, n string, x int, at int")
    got = {r.id: (r.n, r.x) for r in keyed.upsert(base, updates, ["id"], "at").collect()}
    assert got == {1: ("a", 1), 2: ("z", 2), 3: ("c", 30)}


def test_versions(frame):
    base = frame([(1, "a", 5), (2, "b", 7)], "id int, v string, version int")
    changes = frame([(1, "x", 5, 2), (1, "y", 5, 1), (2, "z", 6, 1)], "id int, v string, version int, seq int")
    new, conflicts = keyed.versioned_apply(base, changes, "id", "version", "seq")
    assert {r.id: (r.v, r.version) for r in new.collect()} == {1: ("y", 6), 2: ("b", 7)}
    assert {(r.id, r.seq) for r in conflicts.collect()} == {(1, 2), (2, 1)}


def test_publish_keeps_the_live_copy_when_the_check_fails(spark, frame):
    folder = fresh_dir(spark, "pub")
    write = lambda rows: lambda p: frame(rows, "x int").write.mode("overwrite").parquet(p)
    first = sinks.publish(spark, "pub_view", write([(1,)]), lambda d: True, folder)
    with pytest.raises(RuntimeError):
        sinks.publish(spark, "pub_view", write([(2,)]), lambda d: False, folder)
    assert [r.x for r in spark.table("pub_view").collect()] == [1]
    second = sinks.publish(spark, "pub_view", write([(3,)]), lambda d: True, folder)
    assert first != second and [r.x for r in spark.table("pub_view").collect()] == [3]


def test_keyed_store_expires_and_repeats(spark, frame):
    store = stream_sinks.KeyedStore(spark, fresh_dir(spark, "kv"), ["k"])
    store.write(frame([("a", 1), ("b", 1)], "k string, v int"), 0, F.lit(minutes(10)))
    store.write(frame([("a", 2)], "k string, v int"), 1, F.lit(minutes(20)))
    store.write(frame([("a", 99)], "k string, v int"), 1, F.lit(minutes(20)))
    live = keyed.drop_expired(store.read(), "expires_at", F.lit(minutes(10)))
    assert [(r.k, r.v) for r in live.collect()] == [("a", 2)]


def test_chunks_flush_by_turns_and_by_age(frame):
    rows = [("c", i, minutes(i)) for i in range(7)] + [("c", 7, minutes(65)), ("c", 8, minutes(200))]
    out = flush_chunks(frame(rows, "c string, t int, ts timestamp"), "c", "t", "ts")
    assert [r.chunk for r in out.orderBy("t").collect()] == [0] * 5 + [1] * 2 + [2, 3]
    # Turn 7 comes exactly an hour after turn 5 opened its chunk.
    rows[7] = ("c", 7, minutes(64) + timedelta(seconds=59))
    out = flush_chunks(frame(rows, "c string, t int, ts timestamp"), "c", "t", "ts")
    assert [r.chunk for r in out.orderBy("t").collect()] == [0] * 5 + [1] * 3 + [2]


def test_stream_flush_agrees_with_batch(spark, frame):
    rows = [("c", i, minutes(i)) for i in range(7)] + [("c", 7, minutes(64)), ("c", 8, minutes(200)), ("d", 9, minutes(0)), ("z", 99, minutes(9999))]
    df = frame(rows, "c string, t int, ts timestamp")
    batch = flush_chunks(df, "c", "t", "ts").groupBy("c", "chunk").agg(F.count("t").alias("n"), F.min("t").alias("a")).where("c != 'z'")
    folder = fresh_dir(spark, "turns")
    df.coalesce(1).write.parquet(folder)
    stream = tables.read_topic(spark, "parquet", {}, df.schema, folder)
    out = spark.read.parquet(stream_sinks.run_to_table(flush_stream(stream, "c", "t", "ts"), "append", "flush"))
    assert {(r.c, r.chunk, r.turns, r.first_turn) for r in out.collect()} == {(r.c, r.chunk, r.n, r.a) for r in batch.collect()}


def test_stream_equals_batch_for_closed_windows(spark, frame):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") % 11).cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 97).alias("ts"))
    folder = fresh_dir(spark, "means")
    df.coalesce(1).write.parquet(folder)
    stream = tables.read_topic(spark, "parquet", {}, df.schema, folder)
    got = spark.read.parquet(stream_sinks.run_to_table(windows.tumbling_mean(stream, "ts", "k", "v"), "append", "means-out"))
    top = df.agg(F.max("ts")).first()[0]
    want = windows.tumbling_mean(df, "ts", "k", "v").where(F.col("window_end") <= F.lit(top))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similar_items_by_factors_takes_any_ids(spark):
    rows = [(f"u{u}", f"i{i}", 1.0) for u in range(12) for i in range(8) if (u + i) % 2 == 0]
    out = recommend.als_similar(spark.createDataFrame(rows, "u string, i string, r double"), "u", "i", "r", 2, rank=4)
    got = {r.base_id: r.rec_id for r in out.where("rn = 1").collect()}
    assert len(got) == 8 and all((int(a[1]) + int(b[1])) % 2 == 0 for a, b in got.items())


def test_cold_item_ties_go_to_the_smaller_id(frame):
    held = frame([(i, "a", p) for i, p in ((1, 10.0), (2, 10.0), (3, 10.0), (4, 12.0), (5, 8.0), (6, 8.0))], "id long, g string, p double")
    vec = held.select("id", F.array(F.col("id").cast("double")).alias("vector"))
    new = frame([(100, "a", 11.0), (101, "a", 9.0), (102, "b", 1.0), (103, "a", 10.0)], "id long, g string, p double")
    got = {r.id: r.vector[0] for r in recommend.cold_item_vector(new, held, vec, ["g"], "id", "p").collect()}
    assert got == {100: pytest.approx(2.0), 101: pytest.approx(2.0), 103: pytest.approx(2.0)}


@pytest.mark.parametrize("parts", ["2", "8"])
def test_results_do_not_depend_on_shuffle_partitions(spark, parts):
    df = spark.range(400).select((F.col("id") % 9).alias("u"), (F.col("id") * 7 % 23).alias("i"), F.timestamp_seconds(F.col("id") * 1000 % 77_777).alias("ts"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sim = sorted((r.base_id, r.rec_id, round(r.similarity, 9)) for r in recommend.swing(df, "u", "i").collect())
        ses = sorted((r.id, r.session) for r in sequences.sessionize(df, "u", "ts", tie=["id"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = _RESULTS.setdefault("swing", (sim, ses))
    assert seen == (sim, ses)


_RESULTS: dict = {}


def test_late_rows_are_dropped_in_a_stream(spark, frame):
    folder = fresh_dir(spark, "late")
    schema = "k string, v double, secs long"
    for secs in (0, 3600, 3700, 60, 7200, 7300):
        frame([("a", 1.0, secs)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = tables.read_topic(spark, "parquet", {"maxFilesPerTrigger": "1", "latestFirst": "false"}, frame([], schema).schema, folder)
    means = windows.tumbling_mean(stream.withColumn("ts", F.timestamp_seconds("secs")), "ts", "k", "v")
    out = spark.read.parquet(stream_sinks.run_to_table(means, "append", "late")).orderBy("window_start").collect()
    # The row at minute 1 came when the watermark had passed its window.
    assert [(r.window_start, r.cnt) for r in out] == [(datetime(1970, 1, 1), 1), (datetime(1970, 1, 1, 1), 2)]


def test_weights_and_unknown_actions(frame):
    df = frame([("u", "pv"), ("u", "huh"), ("v", "huh")], "u string, a string")
    got = {r.u: r.score for r in relational.behavior_score(df, ["u"], "a", {"pv": 1}).collect()}
    assert got == {"u": 1, "v": 0}


def test_routes_default(frame):
    df = frame([("call 123",), ("hello",)], "t string")
    out = relational.route(df, "t", {"num": r"\d", "call": "call"})
    assert sorted((r.t, r.route) for r in out.collect()) == [("call 123", "call"), ("call 123", "num"), ("hello", "general")]


def test_diversify_follows_the_order(frame):
    rows = [
        ("flu", "flu shot", 1, 0.9),  # contains the base
        ("flu", "cough", 2, 0.8),
        ("flu", "coughs", 3, 0.7),  # contains a kept word
        ("flu", "fever", 4, 0.6),
        ("flu", "fevar", 5, 0.5),  # one edit from a kept word
        ("flu", "syrup (cold)", 6, 0.4),  # keeps the word in parentheses, so the full text is not listed
        ("flu", "pill", 7, 0.01),  # not above the score
        ("flu", "tea", 11, 0.3),  # rank too low
    ]
    out = search.diversify_suggestions(frame(rows, "b string, r string, n int, s double"), "b", "r", "n", "s")
    assert [r.r for r in out.orderBy("n").collect()] == ["cough", "fever"]


def test_suggestion_keys_with_syllables(frame):
    df = frame([("北京 同仁",), ("，。",), ("ab",)], "q string")
    syl = frame([("北京", ["bei", "jing"]), ("同仁", ["tong", "ren"])], "token string, syllables array<string>")
    got = {}
    for r in search.suggestion_keys(df, "q", syl).collect():
        got.setdefault(r["query"], set()).add(r["key"])
    assert set(got) == {"北京 同仁", "ab"}
    assert {"北京", "同仁", "beijingtongren", "bei jing tong ren", "bjtr", "b", "be", "bei", "beij", "beijing", "北j", "北jing", "bei京"} <= got["北京 同仁"]
    assert got["ab"] == {"ab", "a"}


def test_prefix_lookup(frame):
    keys = frame([("Red Ring", "red ring", 5), ("red rope", "red rope", 9), ("blue", "blue", 1)], "key string, word string, freq int")
    index = search.prefix_index(keys, "key", "word", "freq", 10)
    asked = frame([("RE",), ("",), ("red ri",), ("x",), (" ,",)], "p string")
    got = sorted((r.typed, r.word, r.rn) for r in search.suggest(index, asked, "p").collect())
    assert got == [("RE", "red ring", 2), ("RE", "red rope", 1), ("red ri", "red ring", 1)]


def test_correction_prefers_the_frequent_word(frame):
    vocab = frame([("cold", 5), ("bold", 9), ("fever", 1)], "w string, f int")
    got = {r["query"]: r.word for r in search.correct_queries(frame([("told",), ("fevr",), ("cold",), ("xyz",)], "q string"), "q", vocab, "w", "f").collect()}
    assert got == {"told": "bold", "fevr": "fever"}


def test_auc_with_ties_and_report_with_missing_class(frame):
    df = frame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert evaluation.auc_logloss(df, "y", "p").first().auc == pytest.approx(0.875)
    rep = evaluation.classification_report(frame([("a", "a"), ("a", "b")], "y string, z string"), "y", "z")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in rep.collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 0)}


def test_sampling_does_not_depend_on_partitions(spark, frame):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("u"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    for pick in (
        lambda d: training.cap_per_user(d, "u", 10, 1, ["id"]),
        lambda d: training.sample_ratio(d, "label", 1, 1, 1, ["id"]),
        lambda d: training.hash_split(d, ["id"], {"a": 0.5, "b": 0.5}, 1, "u").where("part = 'a'"),
        lambda d: recommend.weighted_shuffle(d, ["u"], "id", ["id"], 1, 5),
    ):
        one = {r.id for r in pick(df.repartition(2)).collect()}
        two = {r.id for r in pick(df.repartition(9, "label")).collect()}
        assert one == two


def test_exploration_and_thompson(frame):
    recs = frame([("u", f"r{i}", i) for i in range(1, 5)], "u string, i string, rn int")
    seen = frame([("u", "r1", 1), ("u", "x", 0), ("u", "y", 50), ("v", "x", 1)], "u string, i string, exposures long")
    out = recommend.exploration_slot(recs, seen, "u", "i", 2, 3).orderBy("rn").collect()
    assert [r.rn for r in out] == [1, 2, 3, 4, 5] and out[1].explored == 1 and out[1].i in ("x", "y")
    post = recommend.beta_posterior(frame([("u", "a", 1)] * 200 + [("u", "b", 0)] * 200, "u string, i string, hit int"), ["u", "i"], "hit")
    first = recommend.thompson_rank(post, "u", "i", 1, 5).collect()
    assert [r.i for r in first] == ["a"]


def test_rolling_window_excludes_the_row_and_includes_the_edge(frame):
    rows = [(1, "a", minutes(0)), (2, "a", minutes(1)), (3, "a", minutes(1)), (4, "a", minutes(2))]
    got = features.rolling_stats(frame(rows, "id int, i string, ts timestamp"), "i", "ts", {"c": 60}, ["id"])
    assert {r.id: r.c for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_evolve_and_distinct(spark, frame):
    df = frame([(1, "a")], "id int, x string")
    out = keyed.evolve(df, T.StructType().add("new", "double").add("id", "long"))
    assert out.columns == ["new", "id", "x"] and out.first().id == 1
    maps = spark.range(2).select(F.when(F.col("id") == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("m"))
    assert relational.distinct_records(maps).count() == 1


def test_fm_model_agrees_with_its_expression(spark):
    df = spark.range(200).select((F.col("id") % 5 / 5).alias("a"), (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 2).alias("y"))
    model = recommend.fm_fit(df, ["a", "b"], "y", factors=4, iters=3)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = model.transform(recommend.fm_apply(df, ["a", "b"], model).withColumn("features", array_to_vector(F.array("a", "b"))))
    gap = both.select(F.max(F.abs(F.col("prob") - vector_to_array("probability")[1]))).first()[0]
    assert gap < 1e-9


def test_rows_without_a_group_stay(frame):
    df = frame([(1, "a", 1.0), (2, None, 3.0), (3, None, 5.0), (4, "a", 2.0)], "id int, g string, v double")
    parts = training.hash_split(df, ["id"], {"a": 0.5, "b": 0.5}, 1, "g").collect()
    assert sorted(r.id for r in parts) == [1, 2, 3, 4] and len({r.part for r in parts if r.g is None}) == 2
    assert {r.id: r.encoded for r in features.target_mean(df, "g", "v").collect()} == {1: 1.5, 2: 4.0, 3: 4.0, 4: 1.5}
    assert {r.id: r.scaled for r in features.min_max(df, "v", ["g"]).collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}


def test_hot_null_group_is_spread_and_kept(spark, frame):
    df = frame([(i, None if i % 3 else "a") for i in range(90)], "id int, g string")
    spark.conf.set("spark.clickloom.hotRows", "7")
    try:
        got = {r.id: r.n for r in with_group(df, ["g"], n=F.count(F.lit(1))).collect()}
    finally:
        spark.conf.unset("spark.clickloom.hotRows")
    assert got == {i: 60 if i % 3 else 30 for i in range(90)}


def test_one_synonym_per_query(frame):
    df = frame([("a", 5), ("a", 0), ("b", 0), (None, 0)], "q string, n int")
    table = frame([("a", "z"), ("a", "y"), ("c", "x")], "q string, term string")
    got = search.fallback_queries(df, "q", "n", table).collect()
    assert sorted((r.q or "", r.n, r.run_query or "") for r in got) == [("", 0, ""), ("a", 0, "y"), ("a", 5, "a"), ("b", 0, "b")]


def test_labels_follow_whole_path_segments(spark, tmp_path):
    for name, line in (("ask.txt", "one"), ("ask.txt2", "two"), ("more/ask.txt", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(line)
    out = tables.read_labelled_text(spark, {"ask": f"{tmp_path}/ask.txt", "other": f"file:{tmp_path}/ask.txt2", "more": f"{tmp_path}/more/"})
    assert {(r.text, r.label) for r in out.collect()} == {("one", "ask"), ("two", "other"), ("three", "more")}


def test_newest_cache_entry_counts_once(frame):
    rows = frame([("x",)], "c string")
    key = rows.select(F.sha2("c", 256).alias("hash"))
    cache = key.crossJoin(frame([("old", minutes(1)), ("new", minutes(2))], "result string, stored_at timestamp"))
    work = lambda todo: todo.select("hash", F.lit("made").alias("result"))
    run = lambda now: [r.result for r in relational.compute_missing(rows, "c", cache, work, F.lit(now), "1 hour").collect()]
    assert run(minutes(3)) == ["new"] and run(minutes(61.5)) == ["new"] and run(minutes(62)) == ["made"]


def test_copies_are_at_distance_zero(spark, frame):
    vecs = [[1000.0 + i * 1e-3, 999.0, 1e-4 * i] for i in range(5)]
    df = frame([(i, v) for i, v in enumerate(vecs)] + [(9, vecs[3])], "id long, vec array<double>")
    got = vectors.knn(df.where("id = 3"), df, k=2).collect()
    assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["id"])] == [(3, 0.0), (9, 0.0)]


def test_export_counts_what_it_writes(spark, tmp_path):
    assert sinks.export(spark.range(7).repartition(3), f"{tmp_path}/out") == 7
    assert sinks.export(spark.range(0), f"{tmp_path}/none") == 0
