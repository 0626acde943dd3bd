"""Tokens are cut by one pass over the text, and only places where a surface can begin become n-grams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clickloom.operators import entities

SIGNS = r"[.,!?;:\"'()\[\]]+"


def plain(text):
    # A line mark may come last in a token, as "$" allows before the end.
    cut = [re.sub(rf"^{SIGNS}|{SIGNS}(?=[\u0085  ]?\Z)", "", w) for w in re.split(r"[ \t\n\x0b\f\r]+", text)]
    return [w for w in cut if w]


def test_tokens_are_those_of_one_pass_per_token(spark):
    texts = ["(one) 'two' don't e.g. ... [x]", "  ,a,b, \n\t--c-- d.\u0085 .e  f. g  ", "", "!?", "É. Σ! ΑΣ, 日本。", ". . x", "a\x0bb.\x0c.c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    out = rows.select("id", entities.tokens(F.col("text")).alias("t"))
    assert "lambdafunction(regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in out.orderBy("id").collect()] == [*map(plain, texts), None]


def test_places_without_a_beginning_make_no_grams(spark):
    gaz = spark.createDataFrame(
        [("p", "New York"), ("p", "new york city hall"), ("w", "York"), ("w", "york"), ("p", "ΑΣ β"), ("n", "..."), ("n", None)], "type string, surface string"
    )
    texts = ["I saw New York, 'new' YORK city HALL. new", "york", "ας Β αΣ β", None, "", "a b c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for most in (1, 2, 4, 8):
        out = entities.phrase_match(rows, "id", "text", gaz, most)
        got = sorted((r.id, r.start, r.end, r.text, r.surface) for r in out.collect())
        want = []
        for i, t in enumerate(texts):
            toks = plain(t or "")
            for surface in ("New York", "new york city hall", "York", "york", "ΑΣ β"):
                n = len(surface.split(" "))
                want += [(i, p, p + n, " ".join(toks[p : p + n]), surface) for p in range(len(toks) - n + 1) if " ".join(toks[p : p + n]).lower() == surface.lower()]
        assert got == sorted(want)
