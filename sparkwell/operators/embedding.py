"""Hashed text vectors, checks of vectors, quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LEXICAL_WIDTH = 64
#: Words whose buckets a worker remembers.
REMEMBERED = 1 << 16


def _plural(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith("es"):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def lexical(text: Column, width: int = LEXICAL_WIDTH) -> Column:
    """Stem counts by hash bucket, scaled to length 1 (a text without words: zeros), rounded to 12 digits.

    A vectorised function with a memory of words, since a hash by expressions walks every letter of every word.
    """
    import re
    import unicodedata

    pattern = re.compile("[a-z0-9]+")
    plain = lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t)

    def embed(texts):
        bucket: dict[str, int] = {}
        for series in texts:
            out = []
            for one in series:
                counts = np.zeros(width)
                for word in pattern.findall(plain(one or "").lower()):
                    at = bucket.get(word)
                    if at is None:
                        h = 0
                        for c in _plural(word):
                            h = (h * 31 + ord(c)) & 0xFFFFFFFF
                        if len(bucket) >= REMEMBERED:
                            bucket.clear()
                        at = bucket[word] = h % width
                    counts[at] += 1
                length = np.sqrt((counts * counts).sum())
                out.append(np.round(counts / length, 12) if length else counts)
            yield pd.Series(out)

    embed.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<double>")(text)


def signed_hash(text: Column, width: int = 256) -> Column:
    """Array of (bucket, weight): stems and pairs of neighbours by FNV-1a, with a hashed sign; the first 12,000 characters count."""

    def feature(weight: float):
        sign = lambda f: F.when(tx.fnv1a(F.concat(F.lit("sign:"), f)) % 2 == 0, weight).otherwise(-weight)
        return lambda f: F.struct((tx.fnv1a(f) % width).alias("bucket"), sign(f).alias("weight"))

    def of(stems: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(stems) - 2), lambda i: F.concat_ws(" ", F.get(stems, i), F.get(stems, i + 1)))
        pairs = F.when(F.size(stems) > 1, pairs).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(stems, feature(1.0)), F.transform(pairs, feature(0.75)))

    return tx.let(tx.unicode_stems(F.substring(text, 1, 12_000)), of)


def quantised(vector: Column, levels: int) -> Column:
    """Struct (scale, codes): symmetric integers up to ``levels``, rounded half to even."""
    top = F.array_max(F.transform(vector, F.abs))
    scale = F.when(top > 0, top / levels).otherwise(F.lit(1.0))
    codes = F.transform(vector, lambda x: F.greatest(F.lit(-levels), F.least(F.lit(levels), F.bround(x / scale).cast("int"))))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def valid(vector: Column, width: int) -> Column:
    return (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def variance(vector: Column) -> Column:
    """Mean squared distance of the components from their mean, within 0..1, rounded to 4 digits."""
    n = F.size(vector)
    mean = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return tx.rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread)), 4)


def widest_dimensions(vectors: DataFrame, embedding: str = "embedding", most: int = 2) -> DataFrame:
    """(dim, variance, rank) of the dimensions with the largest population variance; ties go to the lower one.

    Map-side partial aggregation leaves a row for each dimension.
    """
    spread = vectors.select(F.posexplode(F.col(embedding)).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(tx.rounded(F.col("variance"), 9)), "dim")))
    return ranked.where(F.col("rank") <= most)


def embedding_map(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x, y): the two widest dimensions, each scaled to 8..92; a constant one is at 50."""
    dims = F.broadcast(widest_dimensions(vectors, embedding).select("dim", "rank"))
    axes = vectors.select(F.col(vec_id).alias("vec_id"), F.posexplode(F.col(embedding)).alias("dim", "v")).join(dims, "dim")
    at = axes.groupBy("vec_id").agg(*[F.max(F.when(F.col("rank") == r, F.col("v").cast("double"))).alias(n) for r, n in ((1, "x"), (2, "y"))])
    bounds = at.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in ("x", "y") for f in (F.min, F.max)])

    def scaled(n: str) -> Column:
        low, high = F.col(f"min_{n}"), F.col(f"max_{n}")
        return F.when(high > low, tx.rounded(8 + (F.col(n) - low) / (high - low) * 84, 2)).otherwise(F.lit(50.0)).alias(n)

    return at.join(F.broadcast(bounds), F.lit(True)).select("vec_id", scaled("x"), scaled("y"))
