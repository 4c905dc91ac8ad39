"""Host-level quality rules: documents' rule failures by host, shrunk by a beta prior, and verdicts for whole hosts."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table, written
from .tokens import texts_of

#: Words of the windows that count as repeated, and bytes of text that are looked at together (a longer text alone).
WINDOW, BATCH_BYTES = 8, 1 << 22
#: White space that parts words, and symbols that are counted.
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: A host goes if the shrunk share of its documents that fail any one rule is above this.
HOST_LIMIT = 0.5

FIGURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def rules() -> dict[str, Column]:
    """What makes a document fail, by name. The first two fail it by themselves, all count against its host."""
    c = F.col
    return {
        "short": c("n_words") < 20,
        "repeats": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
    }


BASE = ("short", "repeats")


def repeated_words(ids: np.ndarray, n_words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts laid end to end (words as numbers, ``n_words`` of each text): the words within windows that their text has twice or more.

    Windows are sorted by a hash with the text's number; those that share one are then compared word by word.
    """
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = np.zeros(len(n_words), np.int64)
    n = len(ids) - window + 1
    if n < 2:
        return out
    key = (doc[:n] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(window):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[j : n + j].astype(np.uint64)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    at = inside[np.argsort(key[inside], kind="stable")]
    same = key[at][1:] == key[at][:-1]
    at = at[np.append(same, False) | np.append(False, same)]
    if not len(at):
        return out
    words = np.column_stack([doc[at], *[ids[at + j] for j in range(window)]])
    first = np.append(True, key[at][1:] != key[at][:-1])
    if (words == words[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]).all():
        found = at
    else:  # different windows share a hash
        _, where, times = np.unique(words, axis=0, return_inverse=True, return_counts=True)
        found = at[times[where.ravel()] > 1]
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, found, 1)
    np.add.at(covered, found + window, -1)
    held = doc[np.cumsum(covered)[:-1] > 0]
    return np.bincount(held, minlength=len(n_words))


def figures_of(texts: list[str | None]) -> list[np.ndarray]:
    """The columns of FIGURES for whole texts."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    counts, ids = np.zeros((5, len(texts)), np.int64), []
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        words = raw.split()  # bytes part at ASCII white space alone
        lines = [x for x in raw.split(b"\n") if x.strip()]
        counts[:, i] = (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    repeats = repeated_words(np.concatenate(ids) if ids else np.zeros(0, np.int64), counts[0])
    return [*counts, repeats]


def figures(docs: DataFrame, *, text: str, **carried: Column) -> DataFrame:
    """``carried`` columns and the FIGURES of every row's text."""
    rows = docs.select(*[c.alias(name) for name, c in carried.items()], F.col(text).alias("text"))
    before_them, names = list(carried), [x.split()[0] for x in FIGURES.split(", ")]

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([len(x) * 2 for x in (t or "" for t in texts_of(batch, "text"))])
            begin = 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right")))
                part = batch.slice(begin, end - begin)
                found = figures_of(part.column("text").to_pylist())
                columns = [part.column(c) for c in before_them] + [pa.array(x, pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays(columns, [*before_them, *names])
                begin = end

    ship(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, {FIGURES}")


def host_verdicts(judged: DataFrame, names: list[str], limit: float = HOST_LIMIT) -> DataFrame:
    """(host, rate_<rule> ..., rejected) from documents with a host and a boolean for each rule.

    A rule's failures at a host are taken as binomial, with a rate that varies over hosts by a beta distribution. Its mean and spread come from
    all hosts by moments weighted by their documents; the host's rate is the mean of the posterior. So few documents say
    little against a host, and where hosts differ no more than chance has it, all have the common rate.
    """
    hosts = cut(judged.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(f"f_{r}") for r in names]))
    fits = []
    for r in names:
        f = F.col(f"f_{r}")
        fits += [F.sum(f).alias(f"all_{r}"), F.sum(f * f / F.col("n")).alias(f"square_{r}")]
    of = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), *fits).first()  # one row
    rates = {}
    for r in names:
        p, weight = prior(of["hosts"], of["n"], of["nn"], of[f"all_{r}"], of[f"square_{r}"])
        rates[r] = (F.col(f"f_{r}") * weight + (1 - weight) * p) / (F.col("n") * weight + (1 - weight))
    over = F.lit(False)
    for rate in rates.values():
        over = over | (rate > limit)
    return hosts.select("host", *[x.alias(f"rate_{r}") for r, x in rates.items()], over.alias("rejected"))


def prior(hosts: int, n: int | None, nn: int | None, failed: int | None, square: float | None) -> tuple[float, float]:
    """(mean, weight) of the beta prior: 1 / weight - 1 documents' worth; weight 0 leaves hosts no say of their own.

    ``n`` documents failed ``failed`` times at all ``hosts``; ``nn`` and ``square`` are sums over hosts of squared documents and of squared failures over documents.
    """
    if not n:
        return 0.0, 0.0
    p = failed / n
    chance = p * (1 - p)
    room = n - nn / n - (hosts - 1)
    if hosts < 2 or chance <= 0 or room <= 0:
        return p, 0.0
    weight = (square - n * p * p - chance * (hosts - 1)) / (chance * room)
    return p, min(max(weight, 0.0), 1.0)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, FIGURES, base_failed, kept, host, host_rejected) for every row.

    A document of fewer than 20 words, or with over 30 percent of its words in windows of eight that it repeats, fails. Those and the other rules count against
    its host; a document is kept if it does not fail and its host is not rejected. Texts are read once, whole; what goes on is
    a row of numbers for each, so a host that holds a third of all rows makes a skewed join of small rows, which Spark splits.
    Null texts have no words and fail. A null host is a host of its own, apart from the empty one. Repeated rows count as often as they come, null ids are
    carried along, other columns are ignored, an empty table gives no rows.
    """
    name = F.col(host).cast("string")
    named = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name))  # no null key, which no join finds
    rows = written(figures(docs, text=text, doc_id=F.col(doc_id).cast("bigint"), host=named), "figures")
    failing = rules()
    judged = rows.withColumns(failing)
    verdicts = cut(host_verdicts(judged, list(failing), limit).select("host", "rejected"))
    joined = judged.withColumn("base_failed", F.col(BASE[0]) | F.col(BASE[1])).join(verdicts, "host")
    names = [x.split()[0] for x in FIGURES.split(", ")]
    back = F.when(F.col("host") != "-", F.substring("host", 2, 1 << 30)).alias("host")
    return joined.select("doc_id", *names, "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), back, F.col("rejected").alias("host_rejected"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of all ``documents``, each source a host."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


_RULES = {
    "short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
_FITS = ", ".join(
    f"CASE WHEN hosts < 2 OR p_{r} * (1 - p_{r}) <= 0 OR room <= 0 THEN 0 ELSE"
    f" least(greatest((square_{r} - n * p_{r} * p_{r} - p_{r} * (1 - p_{r}) * (hosts - 1)) / (p_{r} * (1 - p_{r}) * room), 0), 1) END AS w_{r}"
    for r in _RULES
)
ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT r, i, words[i : i + 7] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM texts)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
figures AS (
  SELECT r, doc_id, host, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (r)),
judged AS (SELECT *, {", ".join(f"({x}) AS {r}" for r, x in _RULES.items())} FROM figures),
hosts AS (SELECT host, count(*) AS n, {", ".join(f"count_if({r}) AS f_{r}" for r in _RULES)} FROM judged GROUP BY host),
totals AS (
  SELECT count(*) AS hosts, sum(n) AS n, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room,
    {", ".join(f"sum(f_{r}) / sum(n) AS p_{r}, sum(f_{r} * f_{r} / n) AS square_{r}" for r in _RULES)} FROM hosts),
priors AS (SELECT {", ".join(f"p_{r}" for r in _RULES)}, {_FITS} FROM totals),
verdicts AS (
  SELECT host, {" OR ".join(f"(f_{r} * w_{r} + (1 - w_{r}) * p_{r}) / (n * w_{r} + (1 - w_{r})) > {HOST_LIMIT}" for r in _RULES)} AS rejected FROM hosts, priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed, NOT (short OR repeats) AND NOT rejected AS kept, rejected AS host_rejected
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""
