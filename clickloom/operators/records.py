"""Chat budgets, structured answers, tags and text boxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.numeric import polygon_area
from clickloom.functions.text import parse_fenced_json, pieces, strip_fence


def token_budget(
    df: DataFrame,
    conv: str,
    values: Sequence[str],
    name: str | None = None,
    tokens: Mapping[str, Column] | None = None,
    per_message: int = 3,
    per_name: int = 1,
    per_reply: int = 3,
) -> DataFrame:
    """Prompt tokens per conversation: the values of each message, a fixed cost per message, a cost per
    given name, and the start of the reply.

    ``tokens`` may give the token count of a value column; the default counts letter runs, digit runs
    and single signs.
    """
    def count(col: str) -> Column:
        if tokens and col in tokens:
            return tokens[col]
        return F.coalesce(F.size(pieces(F.col(col))), F.lit(0))

    cost = F.lit(per_message)
    for v in [*values, *([name] if name else [])]:
        cost = cost + F.when(F.col(v).isNull(), 0).otherwise(count(v))
    if name:
        cost = cost + F.when(F.col(name).isNotNull(), per_name).otherwise(0)
    return df.groupBy(conv).agg((F.sum(cost) + per_reply).cast("long").alias("tokens"))


def validate_records(df: DataFrame, json: str, schema: T.StructType, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Parsed record, whether it is valid, and why not.

    A record is rejected if it is no JSON, lacks a field, has a field of another type, or holds a value
    outside the field's domain.
    """
    text = strip_fence(F.col(json))
    # The raw text of each field tells a missing field from one whose type does not fit.
    out = df.withColumn("_text", text).withColumn("record", F.from_json("_text", schema, {"mode": "PERMISSIVE"}))
    present = F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>"))
    reasons = [F.when(F.json_object_keys("_text").isNull(), F.lit("not json"))]
    for f in schema.fields:
        has = F.array_contains(present, f.name)
        value = F.col(f"record.{f.name}")
        reasons.append(F.when(F.json_object_keys("_text").isNotNull() & ~has, F.lit(f"missing {f.name}")))
        reasons.append(F.when(has & value.isNull(), F.lit(f"type {f.name}")))
        if f.name in enums:
            allowed = F.array(*[F.lit(v) for v in enums[f.name]])
            if isinstance(f.dataType, T.ArrayType):
                bad = F.size(F.array_except(value, allowed)) > 0
            else:
                bad = ~value.isin(*enums[f.name])
            reasons.append(F.when(bad, F.lit(f"domain {f.name}")))
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    out = out.withColumn("reasons", why).withColumn("valid", F.size("reasons") == 0).drop("_text")
    return out


def top_tags(df: DataFrame, tags: str, n: int = 5) -> DataFrame:
    """The ``n`` best tags by score from fenced JSON ``[{tag, score, reason}]``, best first."""
    parsed = parse_fenced_json(F.col(tags), "array<struct<tag:string,score:double,reason:string>>")
    ranked = F.array_sort(
        parsed,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .when(a["tag"] < b["tag"], -1)
        .when(a["tag"] > b["tag"], 1)
        .otherwise(0),
    )
    return df.withColumn("top", F.slice(ranked, 1, n))


def text_image(
    df: DataFrame, id: str, box: str, h: str, w: str, min_boxes: int = 5, min_share: float = 0.05
) -> DataFrame:
    """Whether an image is mostly text: many text boxes, or boxes over a large part of it.

    One row per box (an array of [x, y] points); explode a nested list of boxes first.
    """
    share = F.sum(polygon_area(F.col(box))) / F.max(F.col(h) * F.col(w))
    out = df.groupBy(id).agg(F.count(box).alias("n_boxes"), share.alias("area_share"))
    return out.withColumn("is_text", (F.col("n_boxes") > min_boxes) | (F.col("area_share") > min_share))
