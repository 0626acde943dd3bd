"""Values known from elsewhere: worked examples with printed results."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.catalog.ranking import FM_FACTORS, FM_INTERCEPT, FM_LINEAR
from clickloom.functions import numeric, text
from clickloom.operators import attribution, entities, recommend, records, relational, training
from clickloom.session import fresh_dir
from clickloom.sources import tables
from clickloom.streaming import sinks, windows

# A short click stream (user, item, category, action, epoch seconds).
CLICKS = """\
1004378,1715,149192,pv,1511658000
1004378,2244074,149192,pv,1511658060
1004378,3611281,149192,pv,1511658120
1004378,1715,149192,pv,1511658180
1004378,2244074,149192,pv,1511658240
1004378,3611281,149192,pv,1511658300
1004379,1715,149192,pv,1511658360
1004378,1256540,149192,pv,1511658420
1004378,2244074,149192,pv,1511658680
1004379,1715,149192,pv,1511658690
1004378,1715,149192,pv,1511658990
1004379,2244074,149192,pv,1511659090"""
ACTIONS = {"pv": 1, "fav": 2, "cart": 3, "buy": 4}
CLICK_SCHEMA = T.StructType().add("user", "string").add("item", "string").add("cat", "long").add("action", "string").add("secs", "long")
END = datetime(2017, 11, 26, 1, 20)
TOP = {("1004378", "2244074"): 3, ("1004378", "1715"): 3, ("1004378", "3611281"): 2, ("1004379", "1715"): 2, ("1004379", "2244074"): 1}


def clicks(spark):
    rows = [line.split(",") for line in CLICKS.split("\n")]
    return spark.createDataFrame([(u, i, int(c), a, int(s)) for u, i, c, a, s in rows], CLICK_SCHEMA)


def test_click_stream_batch(spark):
    scored = windows.sliding_score(clicks(spark).withColumn("ts", F.timestamp_seconds("secs")), "ts", ["user", "item"], "action", ACTIONS)
    assert scored.count() == 1735
    assert scored.select("window_end").distinct().count() == 291
    assert scored.select("window_end", "user").distinct().count() == 581
    top = windows.window_top_n(scored, ["user"], "item", "score").where(F.col("window_end") == F.lit(END)).collect()
    assert {(r.user, r.item): r.score for r in top} == TOP


def test_click_stream_streamed(spark):
    # One row far in the future closes every window of the real ones.
    folder = fresh_dir(spark, "clicks")
    late = spark.createDataFrame([("x", "x", 0, "pv", 1511658000 + 10 * 86400)], CLICK_SCHEMA)
    clicks(spark).coalesce(1).write.csv(folder)
    late.coalesce(1).write.mode("append").csv(folder)
    stream = windows.with_event_time(tables.read_topic(spark, "csv", {}, CLICK_SCHEMA, folder), "secs")
    scored = windows.sliding_score(stream.drop("secs"), "ts", ["user", "item"], "action", ACTIONS, delay=None).drop("w")
    out = fresh_dir(spark, "clicks-top")
    sinks.start_window_top_n(scored, ["user"], "item", "score", 3, out, fresh_dir(spark, "clicks-state")).awaitTermination()
    rows = spark.read.parquet(out).where(F.col("user") != "x")
    assert rows.select("window_end", "user").distinct().count() == 581
    top = rows.where(F.col("window_end") == F.lit(END)).collect()
    assert {(r.user, str(r.item)): r.score for r in top} == TOP


def test_factorisation_machine(spark):
    row = spark.range(1).select(*[F.lit(x).alias(f"x{i}") for i, x in enumerate((4.3, 3.0, 1.1, 0.1))])
    raw = recommend.fm_score([F.col(f"x{i}") for i in range(4)], FM_INTERCEPT, FM_LINEAR, FM_FACTORS)
    got = row.select(raw.alias("raw"), numeric.sigmoid(raw).alias("prob")).first()
    assert got.raw == pytest.approx(-0.6887103107760986, abs=1e-7)
    assert got.prob == pytest.approx(0.3343200324203072, abs=1e-7)


def test_shapley_example(spark):
    rows = spark.createDataFrame([("t", f"algo_{i}", x) for i, x in enumerate((0.01, 0.06, 0.01, 0.01), 1)], "team string, player string, gain double")
    out = attribution.shapley(rows, ["team"], "player", "gain")
    got = {r.player: r for r in out.collect()}
    assert got["algo_1"].shapley == pytest.approx(0.0104043483, abs=1e-9)
    assert got["algo_2"].shapley == pytest.approx(0.0609060150, abs=1e-9)
    assert got["algo_2"].share == pytest.approx(0.6612, abs=1e-4)
    assert sum(r.shapley for r in got.values()) == pytest.approx(0.09211906, abs=1e-12)
    reward = {r.player: r.reward for r in attribution.reward_split(out, "share", 0.25, 0.2).collect()}
    assert reward["algo_1"] == pytest.approx(0.0678, abs=1e-4) and reward["algo_2"] == pytest.approx(0.3967, abs=1e-4)
    assert attribution.lead_share(out, ["team"], "share", 0.25, 0.2).first().lead == pytest.approx(0.4)


def test_phrases(spark):
    terms = spark.createDataFrame([("brand", x, str(i)) for i, x in enumerate(("Great Wall Hover", "GAC Trumpchi", "Baic motor"))], "type string, surface string, id string")
    docs = spark.createDataFrame([(1, "I want to rent a Great wall Hover or GAC Trumpchi")], "doc long, text string")
    found = entities.phrase_match(docs, "doc", "text", terms).orderBy("start").collect()
    assert [r.text for r in found] == ["Great wall Hover", "GAC Trumpchi"]
    assert [(r.start, r.end) for r in found] == [(5, 8), (9, 11)]
    # The same when the surfaces are longer than the n-grams.
    cut = entities.phrase_match(docs, "doc", "text", terms, max_tokens=1).orderBy("start").collect()
    assert [tuple(r) for r in cut] == [tuple(r) for r in found]


GAZETTEER = [
    ("car_brand", "Great Wall Hover", "1", None, None), ("car_brand", "GAC Trumpchi", "2", None, None), ("car_brand", "Baic motor", "3", None, None),
    ("car_brand", "Mercedes Benz", "4", None, None), ("car_brand", "Benz", "4", None, None),
    ("car_model", "Audi A4", "1", "Audi", "1"), ("car_model", "Audi A6", "2", "Audi", "1"), ("car_model", "BMW M3", "3", "BMW", "2"), ("car_model", "BMW M4", "4", "BMW", "2"),
    ("city", "Los Angeles", "1", "United States", "11"), ("city", "L.A", "1", "United States", "11"), ("city", "New York", "2", "United States", "11"),
]
US = ("United States", "region", "11")
SENTENCES = {
    "rent car in Los Angeles": [("Los Angeles", "city", "1"), US],
    "rent a Mercedes Benz in Los Angeles": [("Mercedes Benz", "car_brand", "4"), ("Los Angeles", "city", "1"), US],
    "rent Benz in Los Angeles": [("Benz", "car_brand", "4"), ("Los Angeles", "city", "1"), US],
    "rent bmw m3 in New York": [("bmw m3", "car_model", "3"), ("BMW", "car_brand", "2"), ("New York", "city", "2"), US],
    "tickets to the great wall": [],
    "L.A is a big city.": [("L.A", "city", "1"), US],
}


def test_entities_and_parents(spark):
    gaz = spark.createDataFrame(GAZETTEER, "type string, surface string, id string, parent_name string, parent_id string")
    docs = spark.createDataFrame([(s, s) for s in SENTENCES], "doc string, text string")
    ents = entities.entity_ruler(docs, "doc", "text", gaz)
    rows = entities.expand_parents(ents, gaz).orderBy("doc", "start", "parent").collect()
    got = {s: [(r.entity, r.type, r.id_value) for r in rows if r.doc == s] for s in SENTENCES}
    assert got == SENTENCES


def test_split_and_explode(spark):
    movies = spark.createDataFrame([(1, "Toy Story", "Animation|Children|Comedy"), (2, "Heat", "Crime")], "id int, name string, genre string")
    got = movies.select("id", F.explode(F.split("genre", r"[\|]")).alias("g")).orderBy("id", "g").collect()
    assert [tuple(r) for r in got] == [(1, "Animation"), (1, "Children"), (1, "Comedy"), (2, "Crime")]


def test_group_sizes(spark):
    sizes = {"q1": 6, "q2": 18, "q3": 18, "q4": 13, "q5": 28, "q6": 17}
    rows = spark.createDataFrame([(q,) for q, n in sizes.items() for _ in range(n)], "query string")
    got = training.query_group_sizes(rows, "query", 3).collect()
    assert {r["query"]: r["size"] for r in got} == sizes
    # The partition is the one Spark would choose, and groups are numbered in sorted order in each.
    real = rows.repartition(3, "query").select("query", F.spark_partition_id().alias("part")).distinct().collect()
    assert {(r["query"], r["part"]) for r in got} == {(r["query"], r["part"]) for r in real}
    for part in {r["part"] for r in got}:
        mine = sorted((r["seq"], r["query"]) for r in got if r["part"] == part)
        assert [q for _, q in mine] == sorted(q for _, q in mine)


def test_label_summary(spark):
    rows = spark.createDataFrame([("a", "GET", 200, "/x", 3.0), ("a", "GET", 200, "/x", 5.0), ("b", "GET", 500, "/y", 1.0)], "source string, method string, status int, path string, cost double")
    got = relational.label_summary(rows, ["source", "method", "status", "path"], "cost").orderBy("source").collect()
    assert [(r.cnt, r.total, r.max_value) for r in got] == [(2, 8.0, 5.0), (1, 1.0, 1.0)]


RECORD = T.StructType()
for name in ("season", "style", "items"):
    RECORD = RECORD.add(name, T.ArrayType(T.StringType()))
RECORD = T.StructType([T.StructField("year", T.ArrayType(T.IntegerType())), *RECORD.fields])


def test_structured_record(spark):
    good = '{"year": [2025], "season": ["秋"], "style": ["优雅知性"], "items": ["西装", "夹克", "衬衫"]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, good.replace("秋", "秋冬")), (4, '{"year": [2025]}'), (5, "no json"), (6, good.replace("[2025]", '"x"')), (7, None)]
    df = spark.createDataFrame(rows, "id int, answer string")
    out = {r.id: r for r in records.validate_records(df, "answer", RECORD, {"season": ["春", "夏", "秋", "冬"]}).collect()}
    assert out[1].valid and out[2].valid and out[2].record["items"] == ["西装", "夹克", "衬衫"]
    assert out[3].reasons == ["domain season"]
    assert out[4].reasons == ["missing season", "missing style", "missing items"]
    assert out[5].reasons == ["not json"] and out[7].reasons == ["not json"]
    assert out[6].reasons == ["type year"]


def test_tags_and_fences(spark):
    tags = '```json\n[{"tag":"a","score":0.1,"reason":"r"},{"tag":"c","score":0.9,"reason":"r"},{"tag":"b","score":0.9,"reason":"r"}]\n```'
    df = spark.createDataFrame([(tags,)], "answer string")
    assert [t.tag for t in records.top_tags(df, "answer", 2).first().top] == ["b", "c"]


def test_text_image(spark):
    unit = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    rows = [("few", unit, 100.0, 100.0)] + [("many", unit, 1000.0, 1000.0)] * 6 + [("large", [[0.0, 0.0], [60.0, 0.0], [0.0, 60.0]], 100.0, 100.0)]
    df = spark.createDataFrame(rows, "id string, box array<array<double>>, h double, w double")
    got = {r.id: (r.n_boxes, r.area_share, r.is_text) for r in records.text_image(df, "id", "box", "h", "w").collect()}
    assert got == {"few": (1, 0.01, False), "many": (6, 0.0006, True), "large": (1, 0.18, True)}


def test_query_text(spark):
    df = spark.createDataFrame([("DHAfdadf ,.。。",), ("感冒（药）",), ("（）",)], "q string")
    assert [r[0] for r in df.select(text.normalize_query(F.col("q"))).collect()] == ["dhafdadf", "感冒药", ""]
    assert [r[0] for r in df.select(F.octet_length(F.lit("感冒"))).take(1)] == [6]
    df = spark.createDataFrame([("a (b) (c)",), ("d（e）",), ("f",), ("g ()",)], "q string")
    assert [r[0] for r in df.select(text.paren_text(F.col("q"))).collect()] == ["c", "e", "f", "g ()"]
