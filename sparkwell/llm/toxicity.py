"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table
from .tokens import texts_of

THRESHOLD = 0.7
#: A word needs so many toxic documents, and this share of its documents must be toxic.
LEAST_DOCS, LEAST_SHARE = 3, 0.6
#: Labelled documents that the lexicon and its calibration are learned from, about.
TRAINING_ROWS = 30_000
#: Entries that a task counts before it hands their sums on.
HELD = 100_000
#: Lengths of the word beginnings that may be listed besides whole words.
STEMS = (4, 5, 6, 7)
#: Look-alikes of Latin letters in other scripts, folded to them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ґ": "r", "г": "r", "п": "n", "и": "u", "ѵ": "v", "ь": "b", "ѡ": "w", "ҽ": "e", "ғ": "f",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "յ": "j",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ŧ": "t", "þ": "p", "ð": "d",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a listed word means no harm; the hits they cover don't count. More are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "stupid me", "pond scum", "scum line", "worthless check", "sore loser board")
#: How the character names of ornamented Latin letters begin or go on before the letter.
ORNAMENTS = r"(?:LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL )?|(?:NEGATIVE |CROSSED NEGATIVE )?(?:CIRCLED|SQUARED|PARENTHESIZED) LATIN (?:SMALL |CAPITAL )?LETTER |REGIONAL INDICATOR SYMBOL LETTER |TAG LATIN (?:SMALL|CAPITAL) LETTER )([A-Z])(?: WITH .*)?"


def _table() -> dict[int, str | None]:
    """What every character is folded to that is not kept, by rule: its compatibility form without accents, or the letter in its name."""
    table: dict[int, str | None] = {}
    ornamented = re.compile(ORNAMENTS)
    for code in (*range(0x80, 0x3000), *range(0xA640, 0xABFF), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0xE0020, 0xE0080)):
        one = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", one) if not unicodedata.combining(c)).lower()
        plain = "".join(LOOKALIKES.get(c, c) for c in plain)
        named = ornamented.fullmatch(unicodedata.name(one, ""))
        if named and not plain.isascii() or plain == one.lower() and named:
            plain = named[1].lower()
        kind = unicodedata.category(one)
        if kind in ("Cf", "Mn", "Me"):  # joiners, soft hyphens, accents on their own
            table[code] = None
        elif not plain.isalnum() and kind[0] in "PSZ" and not any(c.isalnum() for c in plain):
            table[code] = " "
        elif plain != one:
            table[code] = plain
    return table | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES}


_TABLE = str.maketrans(_table())
_SUBSTITUTES = str.maketrans(SUBSTITUTES)
_SIGNS = frozenset(SUBSTITUTES)
#: Three or more single letters, each followed by the same sign: a word that is spelled out.
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([.\-_*·•]{1,2})(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
#: The last letters of such a word: a quick look at texts that have none.
_SPELLED_END = re.compile(r"[.\-_*·•][^\W\d_][.\-_*·•]{1,2}[^\W\d_](?![^\W_])")


def folded(text: str | None) -> list[str]:
    """The text's words: lower-case, look-alikes, ornamented and accented letters as plain ones, digits inside words as the letters they stand for, spelled-out words as one."""
    low = (text or "").lower()
    if _SPELLED_END.search(low):
        low = _SPELLED.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), low)
    words = low.translate(_TABLE).split()
    for i, w in enumerate(words):
        if not w.isalpha() and not _SIGNS.isdisjoint(w):
            bare = w.rstrip("0123456789@$") if w[0].isalpha() and w[-1] in "@$" else w
            if any(c.isalpha() for c in bare):
                words[i] = bare.translate(_SUBSTITUTES)
    return words


def entries(words: list[str]) -> set[str]:
    """What a document may be listed for: its words, the beginnings of its longer words (with a ``*``), and the empty word."""
    kinds = set(words)
    return {"", *kinds} | {f"{w[:k]}*" for w in kinds for k in STEMS if len(w) > k}


def learn_lexicon(labelled: DataFrame, *, text: str = "text", label: str = "toxic") -> dict[str, float]:
    """Weights of the words, and beginnings of words, whose documents are toxic far more often than others: log odds against all documents.

    Documents are counted, not occurrences. Each task sums its own words first. A word is listed if its log-likelihood
    ratio passes twice the log of the number of words tested, so that chance alone lists about none,
    however large the corpus. No labels, or labels of one kind only, give an empty lexicon.
    """
    count = _document_counts

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    counts = rows.mapInArrow(count, "word string, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # The empty word stands for every document. Cut, since what follows reads the counts three times.
    tested = cut(counts.where((F.col("bad") >= LEAST_DOCS) | (F.col("word") == "")))
    total = tested.where("word = ''").select(F.col("bad").alias("all_bad"), F.col("good").alias("all_good")).collect()
    if not total or not total[0].all_bad or not total[0].all_good:
        return {}
    bad, good = total[0]
    rate = bad / (bad + good)
    words = tested.where("word <> ''")
    number = max(words.count(), 2)
    n = F.col("bad") + F.col("good")
    share = F.col("bad") / n
    xlog = lambda k, p, q: F.when(k > 0, k * F.log(p / F.lit(q))).otherwise(F.lit(0.0))
    ratio = 2 * (xlog(F.col("bad"), share, rate) + xlog(F.col("good"), 1 - share, 1 - rate))
    weight = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - math.log((bad + 0.5) / (good + 0.5))
    listed = words.where((share >= F.greatest(F.lit(LEAST_SHARE), F.lit(min(0.95, 2 * rate)))) & (ratio >= 2 * math.log(number)))
    return {r.word: r.weight for r in listed.select("word", weight.alias("weight")).collect()}  # words of TRAINING_ROWS texts at most


def learn_exceptions(labelled: DataFrame, lexicon: dict[str, float], *, text: str = "text", label: str = "toxic", given=EXCEPTIONS) -> tuple[str, ...]:
    """The given phrases and those learned: a hit with the word before or after it, whose documents are far more harmless than the hit's are.

    Documents are counted. A phrase is listed if at least LEAST_DOCS of its documents are harmless, its toxic share is no larger than that of all
    documents, and its log-likelihood ratio against the toxic share of its hit passes twice the log of the number of phrases.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches):
        machine = automaton(shared.value, ())
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for one, is_bad in zip(texts_of(batch, "text"), batch.column("label").to_pylist(), strict=True):
                words = folded(one)
                found = {("", "")} | {(p, words[i]) for i in hit_words(words, machine) for p in ("", *(" ".join(words[a : a + 2]) for a in (i - 1, i) if a >= 0 and a + 1 < len(words)))}
                for key in found:
                    seen.setdefault(key, [0, 0])[1 - is_bad] += 1
            yield pa.RecordBatch.from_pydict(
                {"phrase": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "bad": pa.array([v[0] for v in seen.values()], pa.int64()), "good": pa.array([v[1] for v in seen.values()], pa.int64())}
            )

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    counts = cut(rows.mapInArrow(count, "phrase string, word string, bad bigint, good bigint").groupBy("phrase", "word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    everything = counts.where("phrase = '' and word = ''").first()
    if everything is None:
        return tuple(given)
    phrases = counts.where("phrase <> ''")
    number = max(phrases.count(), 2)
    of_word = counts.where("phrase = '' and word <> ''").select("word", ((F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)).alias("rate"))
    n, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    xlog = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(F.lit(0.0))
    ratio = 2 * (xlog(F.col("bad"), share, F.col("rate")) + xlog(F.col("good"), 1 - share, 1 - F.col("rate")))
    usual = everything.bad / max(1, everything.bad + everything.good)
    harmless = phrases.join(of_word, "word").where((F.col("good") >= LEAST_DOCS) & (n > 0) & (share <= usual) & (ratio >= 2 * math.log(number)))
    return tuple(dict.fromkeys((*given, *sorted(r.phrase for r in harmless.select("phrase").distinct().collect()))))


def _document_counts(batches):
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for one, label in zip(texts_of(batch, "text"), batch.column("label").to_pylist(), strict=True):
            for word in entries(folded(one)):
                seen.setdefault(word, [0, 0])[1 - label] += 1
        if len(seen) > HELD:
            yield _counted(seen)
            seen = {}
    yield _counted(seen)


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    sums = list(seen.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], ["word", "bad", "good"]
    )


def automaton(lexicon: dict[str, float], exceptions=EXCEPTIONS):
    """Aho-Corasick over whole words: entries and texts have a blank on both sides of each word."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, weight in lexicon.items():
        pattern = f" {word[:-1]}" if word.endswith("*") else f" {word} "
        machine.add_word(pattern, (len(pattern), weight))
    for phrase in exceptions:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    machine.make_automaton()
    return machine


def hit_words(words: list[str], machine) -> set[int]:
    """Numbers of the words that the lexicon hits."""
    if not words or not len(machine):
        return set()
    ends = np.cumsum([len(w) + 1 for w in words])  # where each word's blank is, counted from the one before the first
    return {int(np.searchsorted(ends, end - length + 2)) for end, (length, weight) in machine.iter(f" {' '.join(words)} ") if weight is not None}


def measure(text: str | None, machine) -> tuple[float, int, int]:
    """(sum of the weights hit, hits, words) of a text; hits inside an exception phrase don't count."""
    words = folded(text)
    if not words or not len(machine):
        return 0.0, 0, len(words)
    hits, spared = [], []
    for end, (length, weight) in machine.iter(f" {' '.join(words)} "):
        (hits if weight is not None else spared).append((end - length + 1, end, weight))
    if spared:
        # Of the phrases that begin no later than a hit, does the one that reaches farthest cover it?
        spared.sort(key=lambda p: p[0])
        starts, reach = [p[0] for p in spared], list(accumulate((p[1] for p in spared), max))
        covered = lambda h: (k := bisect_right(starts, h[0])) > 0 and reach[k - 1] >= h[1]
        hits = [h for h in hits if not covered(h)]
    best: dict[int, float] = {}
    for start, _, weight in hits:  # a word counts once, by its strongest entry
        best[start] = max(weight, best.get(start, weight))
    return sum(best.values()), len(best), len(words)


#: Hits weigh this much each at most in the evidence, and bins of it in the calibration.
BINS = 64


def evidence(weight: float, hits: int, words: int) -> float:
    """The hits' weight normalised by length: per square root of the words, so that longer texts need more of it."""
    return weight / math.sqrt(words + 20) if hits else 0.0


def calibrate(measured: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from evidence to the chance of label 1, over a histogram of all rows (evidence, label)."""
    bin_of = F.least(F.lit(BINS - 1), F.ceil(F.col("evidence") * 16).cast("int"))
    rows = measured.groupBy(bin_of.alias("bin"), "label").agg(F.count("*").alias("n"), F.avg("evidence").alias("x")).collect()
    if len({r.label for r in rows}) < 2:
        return 0.0, -30.0
    x = np.array([r.x for r in rows])
    y, n = np.array([float(r.label) for r in rows]), np.array([float(r.n) for r in rows])
    n = n / n.sum() * min(n.sum(), 1e6)
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (p - y)) + 1e-3 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _measure_udf(lexicon: dict[str, float], exceptions, spark: SparkSession):
    shared = ship(spark).sparkContext.broadcast((lexicon, tuple(exceptions)))  # words of TRAINING_ROWS texts at most

    def judge(texts):
        machine = automaton(*shared.value)
        for series in texts:
            yield pd.Series([evidence(*measure(one, machine)) for one in series], dtype="float64")

    judge.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(judge, "double")


class Model:
    """A lexicon with its calibration."""

    def __init__(self, lexicon: dict[str, float], slope: float, offset: float, exceptions=EXCEPTIONS):
        self.lexicon, self.slope, self.offset, self.exceptions = lexicon, slope, offset, exceptions


def train(labelled: DataFrame, *, text: str = "text", label: str = "toxic", exceptions=EXCEPTIONS) -> Model:
    """Learns the lexicon, its exceptions and the curve from all rows whose label is 0 or 1.

    Null texts are empty ones, repeated rows count as often as they come, texts count whole. No rows, or one label only, give a model
    that finds nothing.
    """
    ship(labelled.sparkSession)
    lexicon = learn_lexicon(labelled, text=text, label=label)
    if not lexicon:
        return Model({}, 0.0, -30.0, exceptions)
    exceptions = learn_exceptions(labelled, lexicon, text=text, label=label, given=exceptions)
    weigh = _measure_udf(lexicon, exceptions, labelled.sparkSession)
    rows = labelled.where(F.col(label).isin(0, 1)).select(weigh(F.col(text)).alias("evidence"), F.col(label).cast("int").alias("label"))
    return Model(lexicon, *calibrate(rows), exceptions)


def chance(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The chance of label 1 of a text, for ``score`` and for filters."""
    weigh = _measure_udf(model.lexicon, model.exceptions, docs.sparkSession)
    return 1 / (1 + F.exp(-(weigh(F.col(text)) * model.slope + model.offset)))


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row, in place of columns of those names.

    Null and empty texts have no evidence and get the score of texts without hits, as does everything under an empty model (about 0).
    Repeated rows get the same score; texts are read whole, however long; an empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*kept, chance(docs, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, *, most: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of rows outside the held-out fold, about ``most`` of them, drawn by a hash of their ids.

    The drawn ids are so few that they are broadcast, so no text is shuffled. Of a document's repeated labels the largest counts. Where
    documents repeat a drawn id so often that there are over twice as many rows, those are drawn once more, by their places.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(known.count(), 1)
    drawn = F.broadcast(cut(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)))
    mine = docs.where(~held_out())
    rows = mine.select("doc_id").join(drawn, "doc_id").count()
    if rows > 2 * most:
        mine = mine.where(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(rows)) < most)
    return mine.select("doc_id", "text").join(drawn, "doc_id").select("text", "toxic")


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of the whole texts of ``documents``, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
