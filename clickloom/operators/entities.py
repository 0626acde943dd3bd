"""Dictionary entities and date mentions in texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.text import words

# Signs cut from both ends of a token, where it stands in its text. A line mark may come last in a token.
_SIGNS = r"[.,!?;:\"'()\[\]]+"
_EDGE = rf"(?<!\S){_SIGNS}|{_SIGNS}(?=[\u0085\u2028\u2029]?(?!\S))"

# Parent type of an entity type.
PARENT_TYPE = {"car_model": "car_brand", "city": "region"}


def tokens(text: Column) -> Column:
    """White-space tokens without punctuation at their ends."""
    return words(F.regexp_replace(text, _EDGE, ""))


def read_gazetteer(rows: DataFrame) -> DataFrame:
    """Add the lower-cased token key and its length to (type, surface, id, parent_name, parent_id)."""
    toks = tokens(F.col("surface"))
    return rows.withColumn("gram", F.lower(F.array_join(toks, " "))).withColumn("n_tokens", F.size(toks))


def phrase_match(df: DataFrame, id: str, text: str, gazetteer: DataFrame, max_tokens: int = 8) -> DataFrame:
    """Every place where a gazetteer surface occurs, token by token and whatever the case:
    (id, start, end, text, type, surface). ``end`` is exclusive, tokens count from 0.

    Tokens that begin no surface leave first. The others become word n-grams as long as the longest surface with their beginning
    (at most ``max_tokens``), which meet the gazetteer by equality; Spark broadcasts a gazetteer it measures as small. Longer
    surfaces are found by their first ``max_tokens`` tokens and then compared whole.
    """
    gaz = read_gazetteer(gazetteer.drop("gram", "n_tokens"))
    longest = gaz.agg(F.max("n_tokens")).first()[0] or 1
    max_tokens = min(max_tokens, longest)
    gaz = gaz.withColumn("_head", F.substring_index("gram", " ", max_tokens))
    toks = df.select(id, tokens(F.col(text)).alias("_t"))

    # Each place takes only its own few tokens along, never the whole text.
    places = toks.select(id, "_t", F.posexplode("_t").alias("start", "_w"))
    places = places.select(id, "start", F.lower("_w").alias("_first"), F.slice("_t", F.col("start") + 1, max_tokens).alias("_ws"))
    firsts = gaz.groupBy(F.substring_index("gram", " ", 1).alias("_first")).agg(F.max(F.least("n_tokens", F.lit(max_tokens))).alias("_most"))
    begun = places.join(firsts, "_first")
    grams = begun.select(id, "start", "_ws", F.explode(F.sequence(F.lit(1), F.least("_most", F.size("_ws")))).alias("n"))
    grams = grams.select(id, "start", "n", F.array_join(F.slice("_ws", 1, F.col("n")), " ").alias("text")).withColumn("_head", F.lower("text"))
    hit = grams.join(gaz, "_head")
    short = hit.where(F.col("n_tokens") <= max_tokens).select(
        id, "start", (F.col("start") + F.col("n_tokens")).alias("end"), "text", "type", "surface"
    )
    if longest <= max_tokens:
        return short
    # Surfaces longer than the n-grams: fetch the text again for the few places whose head matches.
    tall = hit.where((F.col("n_tokens") > max_tokens) & (F.col("n") == max_tokens)).select(
        id, "start", "n_tokens", "gram", "type", "surface"
    )
    whole = tall.join(toks, id).withColumn("_p", F.array_join(F.slice("_t", F.col("start") + 1, F.col("n_tokens")), " "))
    whole = whole.where(F.lower("_p") == F.col("gram")).select(
        id, "start", (F.col("start") + F.col("n_tokens")).alias("end"), F.col("_p").alias("text"), "type", "surface"
    )
    return short.unionByName(whole)


def entity_ruler(df: DataFrame, id: str, text: str, gazetteer: DataFrame, max_tokens: int = 4) -> DataFrame:
    """Matches that do not overlap: the longest wins, then the earliest.

    Matches of one text are first cut into runs that overlap one another; only the few matches of a run
    compete.
    """
    found = phrase_match(df, id, text, gazetteer, max_tokens)
    one = found.groupBy(id, "start", "end").agg(F.min(F.struct("type", "surface", "text")).alias("_m"))
    w = Window.partitionBy(id).orderBy("start", "end")
    prior = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = one.withColumn("_new", F.coalesce((F.col("start") >= prior).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct(
        (F.col("start") - F.col("end")).alias("neg_len"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("_m").alias("m")
    )
    lists = runs.groupBy(id, "_run").agg(F.sort_array(F.collect_list(entry)).alias("_l"))

    def take(kept: Column, m: Column) -> Column:
        clash = F.exists(kept, lambda k: (m["start"] < k["end"]) & (k["start"] < m["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, m))

    kept = F.aggregate("_l", F.slice("_l", 1, 0), take)
    flat = lists.select(id, F.explode(kept).alias("_e"))
    return flat.select(id, "_e.start", "_e.end", "_e.m.text", "_e.m.type", "_e.m.surface")


def expand_parents(ents: DataFrame, gazetteer: DataFrame, parent_type: Mapping[str, str] = PARENT_TYPE) -> DataFrame:
    """Each entity followed by its parent, where the gazetteer names one: (..., entity, type, id).

    The parent type follows from the entity type; other types have parents of type ``none``.
    """
    facts = gazetteer.select("type", "surface", "id", "parent_name", "parent_id").withColumnRenamed("id", "_id")
    joined = ents.join(facts, ["type", "surface"], "left")
    ptype = F.lit("none")
    for child, parent in parent_type.items():
        ptype = F.when(F.col("type") == child, parent).otherwise(ptype)
    own = F.struct(F.col("text").alias("entity"), F.col("type").alias("etype"), F.col("_id").alias("eid"), F.lit(0).alias("parent"))
    up = F.struct(F.col("parent_name").alias("entity"), ptype.alias("etype"), F.col("parent_id").alias("eid"), F.lit(1).alias("parent"))
    rows = F.explode(F.when(F.col("parent_name").isNotNull(), F.array(own, up)).otherwise(F.array(own)))
    rest = [c for c in ents.columns if c not in ("text", "type", "surface")]
    return joined.select(*rest, rows.alias("_r")).select(
        *rest, F.col("_r.entity").alias("entity"), F.col("_r.etype").alias("type"), F.col("_r.eid").alias("id_value"), F.col("_r.parent").alias("parent")
    )


# Relative terms and their day offsets, duration units and their letters.
RELATIVE_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1}
DURATION_UNITS = {"day": "D", "week": "W", "month": "M", "year": "Y", "hour": "H", "minute": "M"}


def date_mentions(df: DataFrame, id: str, text: str, ref_date: str, terms: Mapping[str, int] = RELATIVE_DAYS) -> DataFrame:
    """Dates, times, ranges and durations named in a text: (id, type, start, end, mention).

    Explicit forms are found by pattern, relative terms are counted from the row's reference date.
    A range takes its two dates, a date takes its time of day, so no part is reported twice.
    """
    d = r"\d{4}-\d{2}-\d{2}"
    units = "|".join(DURATION_UNITS)
    rel = "|".join(terms)
    pattern = rf"({d} to {d}|{d} \d{{2}}:\d{{2}}(?::\d{{2}})?|{d}|\b\d+ (?:{units})s?\b|\b(?:{rel})\b)"
    low = F.lower(F.col(text))
    m = F.col("mention")
    found = df.select(id, ref_date, F.explode(F.regexp_extract_all(low, F.lit(pattern), 1)).alias("mention"))
    number = F.regexp_extract(m, rf"^(\d+) (?:{units})", 1)
    unit = F.regexp_extract(m, rf"^\d+ ({units})", 1)
    letter = F.lit("")
    for name, sign in DURATION_UNITS.items():
        letter = F.when(unit == name, sign).otherwise(letter)
    day = F.lit(None).cast("int")
    for term, off in terms.items():
        day = F.when(m == term, off).otherwise(day)
    moved = F.date_format(F.date_add(F.to_date(ref_date), day), "yyyy-MM-dd")
    is_range, is_time = m.rlike(f"^{d} to {d}$"), m.rlike(rf"^{d} \d")
    is_date, is_span = m.rlike(f"^{d}$"), unit != ""
    kind = F.when(is_range, "daterange").when(is_time, "datetime").when(is_date, "date").when(is_span, "duration").otherwise("date")
    start = F.when(is_range, F.substring(m, 1, 10)).when(is_time | is_date, m).when(is_span, F.concat(number, letter)).otherwise(moved)
    end = F.when(is_range, F.substring(m, 15, 10))
    return found.select(id, kind.alias("type"), start.alias("start"), end.alias("end"), "mention")
