"""Exact top-k search, hybrid scoring, reranking, fusion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Rows of a block of vectors and of a block of queries; a task holds one of each. As many queries are broadcast at most.
ROWS, QUERIES = 8192, 4096
#: Scores that a task holds at once; of more queries than that allows it takes some after others.
CELLS = 1 << 20


def _scores(a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    """Cosines of all rows of ``a`` with all rows of ``b``, rounded half up; 0 where a length is 0."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    scores = a @ b.T / np.where(na > 0, na, 1)[:, None] / np.where(nb > 0, nb, 1)[None, :]
    return np.floor(scores * 10.0**digits + 0.5) / 10.0**digits


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, score) of each query's k best ids; ties go to the smaller id, and minus infinity is no score."""
    order = np.argsort(ids, kind="stable")
    keep = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]  # ids are in order, so ties are too
    rows = np.repeat(np.arange(len(scores)), keep.shape[1])
    at = order[keep.ravel()]
    found = scores[rows, at]
    return rows[found > -np.inf], ids[at][found > -np.inf], found[found > -np.inf]


def _nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, digits: int, mine: np.ndarray | None = None, theirs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_best`` gives for the rows of ``a`` among those of ``b``, of CELLS scores at a time; only where ``mine`` equals ``theirs``, if given."""
    found, step = [], max(1, CELLS // len(b))
    for at in range(0, len(a), step):
        scores = _scores(a[at : at + step], b, digits)
        if mine is not None:
            scores[mine[at : at + step, None] != theirs[None, :]] = -np.inf
        rows, near, values = _best(scores, ids, k)
        found.append((rows + at, near, values))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def topk(queries: DataFrame, vectors: DataFrame, k: int = 5, digits: int = 9, within: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, score, rank, and the columns to ``carry``): each query's k nearest of all vectors; ties go to the smaller id.

    ``queries`` is (query_id, qv), ``vectors`` (id, v), of doubles; with ``within``, a column of both, only vectors that agree with the query there count.
    Up to QUERIES queries are broadcast: every task streams its vectors past them and keeps the k best of each, so no vector is
    shuffled. More queries than that are dealt to blocks, as are the vectors, and each pair of blocks is one task's work of bounded size.
    ``carry`` names columns of the vectors that come along with those found, so that nobody has to look for them again; ids must then be different.
    """
    columns = ["query_id", "qv", *([within] if within else [])]
    few = queries.select(*columns).limit(QUERIES + 1).toPandas()
    if len(few) > QUERIES:
        return _topk_by_blocks(queries, vectors, k, digits, within, carry)
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    shared, carry = vectors.sparkSession.sparkContext.broadcast(few), list(carry)
    along = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in carry)

    def best(batches):
        few, told = shared.value, {}
        a = np.array(few["qv"].to_list(), np.float64)
        number, ids, scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for pdf in batches:
            if not len(pdf) or not len(a):
                continue
            sides = (few[within].to_numpy(), pdf[within].to_numpy()) if within else ()
            rows, found, values = _nearest(a, np.array(pdf["v"].to_list(), np.float64), pdf["id"].to_numpy(), k, digits, *sides)
            number, ids, scores = np.concatenate([number, rows]), np.concatenate([ids, found.astype(object)]), np.concatenate([scores, values])
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, number))
            number, ids, scores = number[order], ids[order], scores[order]
            place = np.arange(len(number)) - np.searchsorted(number, number)
            number, ids, scores = number[place < k], ids[place < k], scores[place < k]
            if carry:
                left = set(ids)
                told = {i: row for i, row in told.items() if i in left}
                here = pdf[pdf["id"].isin(left)]
                told.update(zip(here["id"], here[carry].itertuples(index=False, name=None), strict=True))
        out = pd.DataFrame({"query_id": few["query_id"].to_numpy()[number], "id": ids, "score": scores})
        yield out.assign(**{c: pd.Series([told[i][n] for i in ids], dtype=object) for n, c in enumerate(carry)})

    listed = vectors.select("id", "v", *([within] if within else []), *carry)
    return _ranked(listed.mapInPandas(best, f"query_id {query_type}, id {id_type}, score double{along}"), k)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _topk_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, digits: int, within: str | None, carry: Sequence[str] = ()) -> DataFrame:
    carry = list(carry)
    along = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in carry)
    parts, blocks = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "id", "score", *carry)})
        sides = (q[within].to_numpy(), v[within].to_numpy()) if within else ()
        rows, ids, values = _nearest(np.array(q["qv"].to_list(), np.float64), np.array(v["v"].to_list(), np.float64), v["id"].to_numpy(), k, digits, *sides)
        out = pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "id": ids, "score": values})
        return out.merge(v[["id", *carry]].drop_duplicates("id"), on="id", how="left") if carry else out

    return _ranked(left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(best, f"query_id {query_type}, id {id_type}, score double{along}"), k)


def hybrid(candidates: DataFrame, weight: float = 0.65) -> DataFrame:
    """Adds ``sparse`` and ``combined`` to candidates (question, text, score) and ranks them anew.

    The sparse half compares sets of character trigrams. Ties: the longer text, then the id.
    """
    sparse = tx.set_cosine(tx.trigrams("question"), tx.trigrams("text"))
    dense = F.when(F.col("score").between(0, 1), F.col("score")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2)))
    scored = candidates.withColumn("sparse", tx.rounded(sparse, 9)).withColumn("combined", tx.rounded(weight * dense + (1 - weight) * F.col("sparse"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined"), F.desc(F.length("text")), "id")
    return scored.withColumn("hybrid_rank", F.row_number().over(order))


def rerank(candidates: DataFrame) -> DataFrame:
    """Adds ``overlap`` and ``rerank_score`` (four parts score, one part shared stems) and ``after_rank``; ties keep their rank."""
    overlap = tx.set_cosine(F.array_distinct(tx.stems("question")), F.array_distinct(tx.stems("text")))
    scored = candidates.withColumn("overlap", tx.rounded(overlap, 9)).withColumn("rerank_score", tx.rounded(0.8 * F.col("score") + 0.2 * F.col("overlap"), 9))
    return scored.withColumn("after_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


#: Weights of the six signals that fusion adds.
WEIGHTS = {"semantic": 0.45, "proximity": 0.15, "edge": 0.10, "depth": 0.05, "hyde": 0.15, "raptor": 0.10}


def fuse(signals: list[DataFrame], k: int = 5) -> DataFrame:
    """(query_id, id, final, rank) from frames of (query_id, id and some of the signals' columns).

    One union and one grouping take the largest value of each signal, 0 where a signal is missing.
    """
    union = signals[0]
    for one in signals[1:]:
        union = union.unionByName(one, allowMissingColumns=True)
    present = [c for c in WEIGHTS if c in union.columns]
    best = union.groupBy("query_id", "id").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in present])
    final = sum((WEIGHTS[c] * F.col(c) for c in present), F.lit(0.0))
    scored = best.withColumn("final", tx.rounded(final, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "id"))).where(F.col("rank") <= k)
