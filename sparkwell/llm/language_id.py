"""Language identification as mixture inference over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table
from .tokens import texts_of

#: Hashed n-gram kinds; a model has so many numbers for each language.
BUCKETS = 1 << 16
#: Steps of expectation-maximisation at most; it mostly ends before, when no more can be gained.
STEPS = 100
UNKNOWN = "und"
#: With fewer n-grams than this, nothing is said of how well languages explain a text.
LEAST_GRAMS = 20
#: Labelled documents that a model is learned from, about.
TRAINING_ROWS = 200_000


def grams(text: str | None) -> np.ndarray:
    """Hashes below BUCKETS of the text's letter trigrams, words padded by a blank; digits and signs count as blanks.

    There is one for each letter, the letter in its middle.
    """
    if not text:
        return np.zeros(0, np.uint16)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "ignore"), np.uint32)
    if len(codes) < 1:
        return np.zeros(0, np.uint16)
    letters = _letters(codes)
    codes = np.where(letters, codes, 32)
    padded = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    triple = (padded[:-2] * np.uint32(2654435761)) ^ (padded[1:-1] * np.uint32(2246822519)) ^ (padded[2:] * np.uint32(3266489917))
    triple = (triple ^ (triple >> np.uint32(15))) * np.uint32(668265263)
    return (triple >> np.uint32(16)).astype(np.uint16)[letters]  # those with a letter in the middle


_ALPHA = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    known = np.minimum(codes, 0x2FFF)
    out = _ALPHA[known]
    high = np.flatnonzero(codes >= 0x3000)
    if len(high):
        out = out.copy()
        out[high] = [chr(c).isalpha() for c in codes[high]]
    return out


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [BUCKETS, languages]) from all rows with a text and a language.

    Every task adds up its own counts before they are summed by language and bucket, and the
    model's size depends on the languages alone. Texts count whole, repeated rows as often as they come; no such rows give a
    model without languages.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, name in zip(texts_of(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                found = np.bincount(grams(one), minlength=BUCKETS)
                if name in sums:
                    sums[name] += found
                else:
                    sums[name] = found
        for name, total in sums.items():
            used = np.flatnonzero(total)
            columns = [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    summed = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # BUCKETS rows for each language at most
    names = sorted(found["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, found["lang"]) if names else [], found["bucket"].to_numpy(int)] = found["n"]
    smooth = 0.05
    return names, np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)).T.copy()


def proportions(counts: np.ndarray, logs: np.ndarray, members: tuple[int, ...], start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(proportions of the languages ``members``, log-likelihood) by expectation-maximisation.

    ``counts`` are the document's distinct n-grams' counts, ``logs`` their log-probabilities by language.
    The log-likelihood is concave in the proportions, so the largest slope tells how much can be gained at most: steps
    end when that is below a hundredth.
    """
    if len(members) == 1:
        return np.ones(1), float(counts @ logs[:, members[0]])
    part = logs[:, members]
    top = part.max(axis=1)
    likely = np.exp(part - top[:, None])
    share = np.full(len(members), 1 / len(members)) if start is None else start
    total, base = counts.sum(), float(counts @ top)
    for _ in range(STEPS):
        mixed = likely @ share
        slope = likely.T @ (counts / mixed)
        if float(slope.max()) - total < 1e-2:
            break
        share = share * slope / total
    return share, base + float(counts @ np.log(likely @ share))


def worth(counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best proportion, gain in log-likelihood) of each language added alone to a mixture; ``more`` is its likelihood over the mixture's, less 1.

    Newton's steps on a concave curve for all languages at once, between bounds that close in on its top.
    """
    low, high = np.zeros(more.shape[1]), np.full(more.shape[1], 1 - 1e-9)
    a = np.where(counts @ more > 0, 0.1, 0.0)
    high[a == 0] = 0.0
    for _ in range(12 if a.any() else 0):
        d = more / (1 + a * more)
        slope, curve = counts @ d, counts @ (d * d)
        low, high = np.where(slope > 0, a, low), np.where(slope > 0, high, a)
        a = a + slope / np.maximum(curve, 1e-300)
        a = np.where((a >= low) & (a <= high), a, (low + high) / 2)
        if (np.abs(slope) * (high - low) < 1e-2).all():
            break
    return a, counts @ np.log1p(a * more)


def identify(found: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """(the document's proportion of every language, those outside the chosen set at 0; log-likelihood of the set).

    Sets grow greedily from the best single language. A set of k languages is worth its log-likelihood less half the log of the
    n-grams for each free proportion (k - 1) and each choice of a member; the language that adds most comes next,
    and only one that adds no more than that ends the growth.
    """
    languages = logs.shape[1]
    kinds, counts = np.unique(found, return_counts=True)
    counts = counts.astype(np.float64)
    part = logs[kinds].astype(np.float64)
    penalty = 0.5 * np.log(counts.sum()) + np.log(max(languages, 2))
    single = counts @ part
    chosen = (int(np.argmax(single)),)
    share, best = np.ones(1), float(single[chosen[0]])
    while len(chosen) < languages:
        top = part[:, chosen].max(axis=1)
        mixed = top + np.log(np.exp(part[:, chosen] - top[:, None]) @ share)
        others = [k for k in range(languages) if k not in chosen]
        a, gain = worth(counts, np.expm1(part[:, others] - mixed[:, None]))
        k = int(np.argmax(gain))
        if gain[k] <= penalty:
            break
        chosen = (*chosen, others[k])
        share, best = proportions(counts, part, chosen, np.append(share * (1 - a[k]), a[k]))
    out = np.zeros(languages)
    out[list(chosen)] = share
    return out, best


def judged(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """Struct (lang_pred, score, lang_shares, surplus) of a text, for ``predict`` and for filters."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((names, logs.astype(np.float32)))  # 256 kB for each language

    def judge(texts):
        names, logs = shared.value
        for series in texts:
            out = []
            for one in series:
                found = grams(one)
                if not len(found) or not names:
                    out.append((UNKNOWN, 0.0, {}, None))
                    continue
                share, likelihood = identify(found, logs)
                best = int(np.argmax(share))
                surplus = likelihood / len(found) + np.log(BUCKETS) if len(found) >= LEAST_GRAMS else None
                out.append((names[best], float(min(1.0, max(0.0, share[best]))), {names[k]: float(share[k]) for k in np.flatnonzero(share > 0)}, surplus))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "lang_shares", "surplus"])

    judge.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(judge, "lang_pred string, score double, lang_shares map<string,double>, surplus double")(F.col(text))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``lang_shares`` (map of the languages found) and ``surplus`` to every row.

    The language of the largest proportion wins (ties: the first by name); ``score`` is its proportion. ``surplus`` is by how much, in nats for each
    n-gram, the languages found explain the text better than evenly spread n-grams would (null below LEAST_GRAMS). Null texts, texts without letters and models without
    languages give ``und``, 0, an empty map and null. Columns of those names are replaced; repeated rows are judged alike; texts are
    judged whole, however long; no rows give none.
    """
    ship(docs.sparkSession)
    added = ("lang_pred", "score", "lang_shares", "surplus")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return docs.select(*kept, judged(docs, model, text).alias("__judged")).select(*kept, "__judged.*")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_rows(docs: DataFrame, *, most: int = TRAINING_ROWS) -> DataFrame:
    """(text, lang) of rows outside the held-out fold that have both, about ``most`` of them, drawn by a hash of their ids and texts.

    So the same rows are drawn however the table's files are split, and rows which share an id, or have none, are drawn by their texts. Where
    equal rows are so many that over twice as many would be drawn, they are drawn by their places too.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = max(known.count(), 1)
    if n <= most:
        return known.select("text", "lang")
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < most)
    rows = drawn.count()
    if rows > 2 * most:
        drawn = drawn.where(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(rows)) < most)
    return drawn.select("text", "lang")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predict`` for the whole texts of ``documents``, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out()
    model = train(labelled_rows(docs))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model).drop("text")
