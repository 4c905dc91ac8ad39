"""What extensions must offer: embedding providers, vector stores, extractors, evaluators; and checks of providers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .embedding import lexical, valid
from .search import topk

#: Similarity below which vectors of two providers don't fit one index.
COMPATIBLE = 0.2


@dataclass(frozen=True)
class Provider:
    """An embedding provider: a name, the width of its vectors, and the column of vectors for a column of texts."""

    name: str
    width: int
    embed: Callable[[Column], Column]


class Providers:
    """Providers by name; names are unique, and an unknown one is an error."""

    def __init__(self, providers: Iterable[Provider] = ()):
        self._by_name: dict[str, Provider] = {}
        for one in providers:
            self.add(one)

    def add(self, provider: Provider) -> None:
        if provider.name in self._by_name:
            raise ValueError(f"provider {provider.name} is registered already")
        self._by_name[provider.name] = provider

    def get(self, name: str) -> Provider:
        if name not in self._by_name:
            raise KeyError(f"unknown provider {name}; there are {', '.join(self.names())}")
        return self._by_name[name]

    def names(self) -> list[str]:
        return sorted(self._by_name)


LEXICAL = Provider("api-lexical", 64, lexical)


def embedded(rows: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """Adds ``embedding``, the provider's vectors; a vector of another width or with a component that is no number is an error."""
    found = rows.withColumn("embedding", provider.embed(F.col(text)))
    wrong = F.raise_error(F.lit(f"provider {provider.name} gave a vector that is not {provider.width} finite numbers"))
    return found.withColumn("embedding", F.when(valid(F.col("embedding"), provider.width), F.col("embedding")).otherwise(wrong.cast("array<double>")))


def deterministic(rows: DataFrame, provider: Provider, text: str = "text") -> bool:
    """Whether the provider gives each text the same vector twice."""
    both = embedded(rows.select(text), provider, text).select(F.col("embedding").alias("a"), text)
    both = both.select("a", provider.embed(F.col(text)).alias("b"))
    return both.where(F.col("a") != F.col("b")).limit(1).count() == 0


def ordered(pairs: DataFrame, provider: Provider) -> bool:
    """Whether ``text`` lies nearer to ``similar`` than to ``unrelated`` in every row."""
    e = pairs.select(*[provider.embed(F.col(c)).alias(c) for c in ("text", "similar", "unrelated")])
    return e.where(tx.cosine(F.col("text"), F.col("similar")) <= tx.cosine(F.col("text"), F.col("unrelated"))).limit(1).count() == 0


def drift(rows: DataFrame, before: Provider, after: Provider, text: str = "text") -> DataFrame:
    """(texts, drift, reindex): the mean distance between two providers' vectors of the same texts; of different widths it is 1.

    From COMPATIBLE on, an index of the one must be made anew for the other.
    """
    if before.width != after.width:
        return rows.agg(F.count("*").alias("texts"), F.lit(1.0).alias("drift"), F.lit(True).alias("reindex"))
    e = rows.select(before.embed(F.col(text)).alias("a"), after.embed(F.col(text)).alias("b"))
    apart = F.coalesce(F.avg(1 - tx.cosine(F.col("a"), F.col("b"))), F.lit(0.0))
    return e.agg(F.count("*").alias("texts"), tx.rounded(apart, 6).alias("drift")).withColumn("reindex", F.col("drift") >= COMPATIBLE)


class Store(Protocol):
    """A vector store over frames."""

    def insert(self, chunks: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int = 5, wanted: dict | None = None) -> DataFrame: ...

    def clear(self) -> None: ...


class FrameStore:
    """Vectors (id, v, and any attributes) as a frame: later rows of an id replace earlier ones, and all rows of an insert are valid or none goes in.

    The first insert fixes the width of all vectors. Rows are kept as plans; what they are made of is computed when a search runs.
    """

    def __init__(self):
        self.rows: DataFrame | None = None
        self.width: int | None = None

    def insert(self, chunks: DataFrame) -> None:
        width = self.width
        if width is None:
            first = chunks.where("v is not null").select(F.size("v").alias("n")).first()
            if first is None:
                if chunks.limit(1).count():
                    raise ValueError("a vector is null")
                return
            width = first.n
        wrong = chunks.where(F.col("id").isNull() | ~F.coalesce(valid(F.col("v"), width), F.lit(False)))
        if wrong.limit(1).count():
            raise ValueError(f"a row has no id, or a vector that is not {width} finite numbers")
        latest = chunks.withColumn("__place", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c != "id"]), "__place").alias("r")).select("id", "r.*")
        self.width = width
        self.rows = latest if self.rows is None else self.rows.join(latest, "id", "left_anti").unionByName(latest, allowMissingColumns=True)

    def search(self, queries: DataFrame, k: int = 5, wanted: dict | None = None) -> DataFrame:
        """``topk`` of the queries (query_id, qv) among rows that have all the attributes wanted."""
        if int(k) != k or k < 1:
            raise ValueError("k must be a whole number above 0")
        if self.rows is None:
            raise ValueError("the store is empty")
        return topk(queries, self.rows.where(tx.agrees(self.rows, wanted or {})).select("id", "v"), k)

    def clear(self) -> None:
        self.rows = self.width = None


#: An entity extractor: chunks (chunk_id, text) to (chunk_id, label, type, confidence, pos).
Extractor = Callable[[DataFrame], DataFrame]
#: An evaluator: columns of question, answer and context to a score from 0 to 1.
Evaluator = Callable[[Column, Column, Column], Column]


def entities_of(chunks: DataFrame, extractors: Iterable[Extractor]) -> DataFrame:
    """What several extractors find, each label of a chunk once, with its highest confidence and first place."""
    out = None
    for extract in extractors:
        found = extract(chunks).select("chunk_id", "label", "type", "confidence", "pos")
        out = found if out is None else out.unionByName(found)
    best = F.max_by("type", F.struct("confidence", -F.col("pos"))).alias("type")
    return out.groupBy("chunk_id", "label").agg(best, F.max("confidence").alias("confidence"), F.min("pos").alias("pos"))


def evaluated(samples: DataFrame, evaluators: dict[str, Evaluator], least: float = 0.5) -> DataFrame:
    """Adds a column for each evaluator's score, ``average`` and ``passed``: whether all scores reach ``least``."""
    scores = {name: f(F.col("question"), F.col("answer"), F.col("context")) for name, f in evaluators.items()}
    out = samples.select("*", *[c.alias(name) for name, c in scores.items()])
    total, passed = F.lit(0.0), F.lit(True)
    for name in scores:
        total, passed = total + F.col(name), passed & (F.col(name) >= least)
    return out.withColumn("average", tx.rounded(total / max(1, len(scores)), 3)).withColumn("passed", passed)
