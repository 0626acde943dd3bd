"""The registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import byte_bpe, hard_negatives, hash_ring, language_id, licenses, line_dedup, mixing, ngram_join, segment_search, suffix_dedup, treap_search, vp_tree, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    dictionaries = language_id.train(docs, learn=~held_out)
    found = language_id.classify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_vp_tree(spark: SparkSession, folder: str) -> DataFrame:
    return vp_tree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op4_line_dedup"] = f"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
keyed AS (SELECT doc_id, n, line, {_KEY} AS k FROM split),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT keyed.*, length(keyed.k) >= 10 AND first_doc < doc_id AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (gone IS NOT TRUE), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def vocabulary(path: str | None = None) -> byte_bpe.Vocabulary:
    import public_tokenizers

    return byte_bpe.load(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    words = vocabulary()
    ids = byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), words).drop("text")
    ids = ids.withColumns({"n_tokens": F.floor(F.octet_length("ids") / 4), "ids_sha256": sha256("ids")})
    return byte_bpe.decode(ids, words).select("doc_id", "n_tokens", "ids_sha256", sha256("decoded").alias("decoded_sha256"))


@query
def op6_segment_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", segment_search.integers(F.col("embedding")).alias("embedding"))
    return segment_search.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLES["op6_segment_search"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
        CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN best USING (h)"""


DIMS = ["source", "lang", "topic"]
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}
BUDGET = 0.5


def topic(text):
    """A coarse topic of a text: notices, tables, short notes, prose."""
    return (
        F.when(F.contains(text, F.lit("License")), "notice").when(F.contains(text, F.lit(" | ")), "table")
        .when(F.coalesce(F.char_length(text), F.lit(0)) < 600, "note").otherwise("prose")
    )


def mixed(docs: DataFrame, budget: float) -> DataFrame:
    docs = docs.withColumns({"topic": topic(F.col("text")), "tokens": mixing.word_count(F.col("text"))})
    cells = mixing.cell_tokens(docs, DIMS)
    # Not calibrated: the query's SQL cuts each probability at 1.
    return mixing.mix(docs, DIMS, {d: mixing.flattened(cells, d, p) for d, p in POWERS.items()}, budget, calibrated=False)


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixed(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"), BUDGET)
    return out.select("doc_id", *DIMS, "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


def _rake_sql() -> str:
    steps, last = [], "w0"
    for i in range(mixing.ROUNDS * len(DIMS)):
        d = DIMS[i % len(DIMS)]
        steps.append(f"w{i + 1} AS (SELECT * REPLACE (coalesce(w * t_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0) AS w) FROM {last})")
        last = f"w{i + 1}"
    targets = ", ".join(f"power(sum(cell) OVER (PARTITION BY {d}), {POWERS[d]}) AS t_{d}" for d in DIMS)
    return f"""
WITH d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, 'License') THEN 'notice' WHEN contains(text, ' | ') THEN 'table'
        WHEN coalesce(length(text), 0) < 600 THEN 'note' ELSE 'prose' END AS topic,
    CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')), 0) AS BIGINT) AS tokens FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS cell FROM d GROUP BY ALL),
w0 AS (SELECT *, cell AS w, {targets} FROM cells WHERE cell > 0),
{', '.join(steps)},
fit AS (SELECT source, lang, topic, w / sum(w) OVER () AS w, cell, sum(cell) OVER () AS total FROM {last}),
p AS (SELECT d.*, coalesce(w, 0) AS weight, CASE WHEN tokens > 0 THEN coalesce(least(1.0, {BUDGET} * total * w / cell), 0) ELSE 0 END AS p
    FROM d LEFT JOIN fit ON d.source IS NOT DISTINCT FROM fit.source AND d.lang IS NOT DISTINCT FROM fit.lang AND d.topic = fit.topic)
SELECT doc_id, source, lang, topic, tokens, round(weight, 9) AS weight, round(p, 9) AS probability,
    ((CAST('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) < p AS sampled
FROM p"""


ORACLES["op8_mixing"] = _rake_sql()


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang", "doc_id")]
    files = docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")
    return licenses.scan_tree(files).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "how", "source_path")


def _license_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', {d!r}::DOUBLE, {e!r}::DOUBLE)" for a, b, c, d, e in licenses.template_weights())
    unseen = licenses.math.log(1 + len(licenses.TEMPLATES)) + 1
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH known(template, license, term, tw, idf) AS (VALUES {rows}),
files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, source, lang, text FROM documents),
lines AS (SELECT DISTINCT path, unnest(string_split(text, chr(10))) AS line FROM files),
bags AS (SELECT path, line, unnest(list_filter(list_transform(regexp_split_to_array({lower}, '[^a-z0-9.]+'), lambda x: trim(x, '.')), lambda x: x <> '')) AS term FROM lines),
w AS (SELECT path, line, term, count(*) * coalesce(any_value(k.idf), {unseen!r}) AS w
    FROM bags LEFT JOIN (SELECT DISTINCT term, idf FROM known) k USING (term) GROUP BY path, line, term),
norm AS (SELECT path, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT path, line, template, license, sum(w * tw) AS dot FROM w JOIN known USING (term) GROUP BY ALL),
own AS (SELECT path, license, cosine FROM (SELECT path, license, round(dot / norm, 9) AS cosine FROM dot JOIN norm USING (path, line))
    WHERE cosine >= {licenses.MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
short AS (SELECT path, source, lang, license FROM own JOIN files USING (path) WHERE len(regexp_split_to_array(text, '\\s+')) <= {licenses.FILE_WORDS}),
near AS (SELECT source || '/' || lang AS dir, min(path) AS path, arg_min(license, path) AS license FROM short GROUP BY ALL)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, round(own.cosine, 6) AS cosine,
    CASE WHEN own.path IS NOT NULL THEN 'own' WHEN near.dir IS NOT NULL THEN 'inherited' END AS how, coalesce(own.path, near.path) AS source_path
FROM files f LEFT JOIN own ON own.path = f.path LEFT JOIN near ON near.dir = f.source || '/' || f.lang"""


ORACLES["op9_license_scan"] = _license_sql()


@query
def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


ORACLES["op10_ngram_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r USING (doc_id)"""


SHARDS = 40


@query
def op11_hash_ring(spark: SparkSession, folder: str) -> DataFrame:
    placed = hash_ring.place(table(spark, folder, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _ring_sql() -> str:
    cells, low = 1 << hash_ring.CELL_BITS, hash_ring.POINT_BITS - hash_ring.CELL_BITS
    point = lambda text: f"CAST('0x' || substr(md5({text}), 1, {hash_ring.POINT_BITS // 4}) AS BIGINT)"
    crc_step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    crc_table = "SELECT range AS b0, range AS c0 FROM range(256)"
    for i in range(8):
        crc_table = f"SELECT b0, {crc_step.format('c0')} AS c0 FROM ({crc_table}) AS r{i}"
    return f"""
WITH crc_table AS (SELECT list(c0 ORDER BY b0) AS t FROM ({crc_table})),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
bytes AS (SELECT text, list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM texts),
sums AS (SELECT text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc FROM bytes, crc_table),
doc AS (SELECT doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32 FROM documents AS d JOIN sums ON sums.text = coalesce(d.text, '')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS nth FROM doc),
keyed AS (SELECT *, {point(f"'key:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32 || ':' || (nth // {hash_ring.COPIES})")} AS point FROM numbered),
spots AS (SELECT {point(f"'node:' || (range % {SHARDS}) || ':' || (range // {SHARDS})")} >> {low} AS spot, min(range % {SHARDS}) AS shard FROM range({SHARDS * hash_ring.NODES}) GROUP BY ALL),
nodes AS (SELECT spot, shard, row_number() OVER (ORDER BY spot) - 1 AS node FROM spots),
homed AS (SELECT keyed.*, coalesce(n.node, 0) AS node, coalesce(n.shard, (SELECT shard FROM nodes WHERE node = 0)) AS home,
    (((point >> {low}) - (SELECT max(spot) FROM nodes) - 1) % {cells} + {cells}) % {cells} AS turned
    FROM keyed ASOF LEFT JOIN nodes AS n ON (point >> {low}) <= n.spot),
own AS (SELECT range AS shard, coalesce(c, 0) AS own, sum(coalesce(c, 0)) OVER () AS total FROM range({SHARDS}) LEFT JOIN (SELECT home, count(*) AS c FROM homed GROUP BY home) ON home = range),
bounds AS (SELECT shard, own, total // {SHARDS} + CAST(row_number() OVER (ORDER BY own DESC, shard) <= total % {SHARDS} AS INTEGER) AS bound FROM own),
ranked AS (SELECT h.*, bound, row_number() OVER (PARTITION BY home ORDER BY point & {(1 << low) - 1}, doc_id NULLS FIRST, size, text_crc32, nth) - 1 AS slot FROM homed AS h JOIN bounds ON shard = home),
walkers AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY turned, point, doc_id NULLS FIRST, size, text_crc32, slot) - 1 AS nth_here FROM ranked WHERE slot >= bound),
room AS (SELECT node, shard, least(own, bound) AS own, greatest(bound - own, 0) AS room, row_number() OVER (PARTITION BY shard ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM nodes JOIN bounds USING (shard)),
flow AS (SELECT node, shard, own, room // n + CAST(i < room % n AS INTEGER) AS free, coalesce(walk, 0) AS walk FROM room LEFT JOIN (SELECT node, count(*) AS walk FROM walkers GROUP BY node) USING (node)),
levels AS (SELECT *, sum(walk - free) OVER (ORDER BY node) AS level, count(*) OVER () AS n FROM flow),
turned AS (SELECT *, (node - (SELECT arg_min(node, struct_pack(a := level, b := -node)) FROM levels) - 1 + n) % n AS turn FROM levels),
places AS (SELECT node, shard, free, coalesce(sum(walk) OVER w, 0) AS first_walk, coalesce(sum(free) OVER w, 0) AS first_free, own + coalesce(sum(free) OVER s, 0) AS first_slot FROM turned
    WINDOW w AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY shard ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
moved AS (SELECT w.doc_id, w.size, w.text_crc32, t.shard, t.first_slot + p.first_walk + w.nth_here - t.first_free AS slot FROM walkers AS w JOIN places AS p ON p.node = w.node
    JOIN places AS t ON p.first_walk + w.nth_here >= t.first_free AND p.first_walk + w.nth_here < t.first_free + t.free)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM (
    SELECT doc_id, size, text_crc32, home AS shard, slot FROM ranked WHERE slot < bound UNION ALL SELECT * FROM moved)"""


ORACLES["op11_hash_ring"] = _ring_sql()


def noisy_labels(vectors: DataFrame) -> DataFrame:
    """Integer vectors, and the next label where the id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), segment_search.integers(F.col("embedding")).alias("embedding"))


@query
def op12_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = noisy_labels(table(spark, folder, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


ORACLES["op12_cover_tree"] = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(coalesce(list_inner_product(a.e, c.e), 0) AS BIGINT) AS score
    FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.e) = len(a.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


@query
def op13_k2_treap(spark: SparkSession, folder: str) -> DataFrame:
    return treap_search.rank(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"), 20)


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{treap_search.TERM}')"
ORACLES["op13_k2_treap"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2.0 * any_value(nn) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
items AS (SELECT item_id, text, t, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
    FROM items JOIN df USING (t) JOIN tf USING (t), total GROUP BY item_id, text, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""
