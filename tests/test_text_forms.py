"""Compatibility composition against Python's, and rounding against exact decimals."""

import random
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from sparkwell.functions import text as tx
from sparkwell.functions import understand
from sparkwell.operators.embedding import lexical

TEXTS = [
    "Ｆｕｌｌ ｗｉｄｔｈ １２３", "ﬁnal oﬀice", "①②③ ½ ²", "éà ö", "ｶﾞｷﾞ ﾊﾟ", "한", "ﷺ", "Å Å Å", "plain ascii", "déjà vu, größe, señor", "", None, "a b", "…", "ᾳͅ", "x̧́", "Straße ſ K",
    "😀 👩‍👩‍👧", "日本語 かな カナ 한국어", "Кириллица й й", "ĳ ŀ ŉ ǆ",
]


def test_nfkc_equals_pythons(spark):
    r = random.Random(2)
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    texts = TEXTS + ["".join(chr(r.choice(points)) for _ in range(40)) for _ in range(500)] + ["".join(r.choice("aeio") + chr(r.choice([0x300, 0x301, 0x308, 0x323])) for _ in range(9)) for _ in range(50)]
    known = [t for t in texts if t is None or all(unicodedata.category(c) != "Cn" for c in t)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(known)], "i int, t string").select("i", tx.nfkc("t").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [t if t is None else unicodedata.normalize("NFKC", t) for t in known]


def test_stable_characters_are_stable():
    stable = re.compile(f"[{tx.STABLE}]")
    for c in map(chr, (x for x in range(0x10000) if not 0xD800 <= x <= 0xDFFF)):
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
    pairs = [a + b for a in "aeouAEOUкиé가" for b in map(chr, range(0x10000)) if not 0xD800 <= ord(b) <= 0xDFFF and stable.match(b)]
    assert all(unicodedata.is_normalized("NFKC", p) for p in pairs)


def test_words_of_other_forms(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ ﬁnal ｃａｃｈｅｓ",), ("full final caches",)], "t string")
    rows = df.select(tx.words("t").alias("w"), tx.stems("t").alias("s"), tx.unicode_stems("t").alias("u"), tx.trigrams("t").alias("g"), lexical(F.col("t")).alias("v"), understand.rewrite(F.concat(F.lit("the "), "t")).alias("q")).collect()
    assert rows[0] == rows[1] and list(rows[0].w) == ["full", "final", "caches"]


def exact(x, digits):
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(x) < 1e15 else x


def test_rounding_by_the_exact_value(spark):
    r = random.Random(4)
    values = [1.005, 8.345, 1.115, 0.125, 0.375, -0.125, 2.5, -2.5, 0.0, 1e-12, 0.285, 1.255, 10.235, 1.45, 8.575, 1e14 + 0.5, 123456789.125, 0.1 + 0.2, 1e20, -1e300]
    values += [r.randrange(10**6) / 10**r.randrange(1, 6) for _ in range(3000)] + [r.uniform(-1, 1) * 10 ** r.randrange(-5, 8) for _ in range(3000)] + [(2 * r.randrange(10**5) + 1) / 2**r.randrange(1, 12) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    rows = df.select("x", *[tx.to_fixed(F.col("x"), n).alias(f"d{n}") for n in (0, 2, 3, 9)]).collect()
    for row in rows[: len(values)]:
        for n in (0, 2, 3, 9):
            if abs(row.x) * 10**n < 2**52:
                assert row[f"d{n}"] == exact(row.x, n), (row.x, n)
            else:
                assert row[f"d{n}"] == row.x
    assert rows[-3].d2 is None and rows[-2].d2 != rows[-2].d2 and rows[-1].d2 == float("inf")
    found = {row.x: row.d2 for row in rows[:5]}
    assert found == {1.005: 1.0, 8.345: 8.35, 1.115: 1.11, 0.125: 0.13, 0.375: 0.38}


def test_whole_processed_queries(spark):
    rows = [("  What is RAG  ", None), ("compare agents", "procedural"), ("compare agents", "no such intent"), (" ", "factual"), (None, "factual"), ("Ｃｏｍｐａｒｅ agents", "unknown")]
    got = [r.p for r in spark.createDataFrame(rows, "q string, given string").select(understand.processed(F.col("q"), F.col("given")).alias("p")).collect()]
    plain = [r.p for r in spark.createDataFrame(rows[:3], "q string, given string").select(understand.processed(F.col("q")).alias("p")).collect()]
    assert got[0] == plain[0] and got[0].original == "What is RAG"
    assert (got[1].intent, got[1].confidence) == ("procedural", plain[1].confidence) and got[2] == plain[2] and plain[1].intent != "procedural"
    for empty in got[3:5]:
        assert (empty.original, empty.rewritten, list(empty.expanded), empty.intent, empty.confidence) == ("", None, [], "unknown", 0.0)
    assert got[5].intent == "unknown" and got[5].rewritten == "compare agents"


def test_forced_models_and_ngrams(spark):
    f = understand.routing_features(F.lit("why does this happen and what is the tradeoff between both of them"))
    one = spark.range(1).select(
        understand.route(f).alias("free"), understand.route(f, forced=F.lit("ollama")).alias("forced"), understand.route(f, cheap=F.lit(True), forced=F.lit("groq")).alias("first"),
        understand.route(f, cheap=F.lit(True), forced=F.lit("other")).alias("unknown"), tx.ngrams(F.lit("A b\tab a"), 2).alias("two"), tx.ngrams(F.lit("ab"), 3).alias("short"), tx.ngrams(F.lit(" \n")).alias("none"),
    ).first()
    assert (one.forced, one["first"], one["unknown"]) == ("ollama", "groq", "local-extractive") and one.free in ("groq", "ollama")
    assert (list(one.two), list(one.short), list(one.none)) == (["ab", "ba"], ["ab"], [])
