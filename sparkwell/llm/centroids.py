"""Centroid clustering with adaptive bounds: several nearest centroids' lower bounds for each vector, one bound for the rest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import erase, table, written

#: Of the contract: centroids, rounds, components, scale, and what stands before an id where starts are drawn.
CLUSTERS, ROUNDS, WIDTH, SCALE, DRAW = 8, 10, 64, 1024, "3:"
#: Centroids besides its own that a vector keeps a lower bound of.
TRACKED = 3
#: Bounds are doubles; what they certify must hold by more than their errors.
SLACK = 1e-9
#: Components beyond this would have squared distances that no bigint holds.
MOST = 1 << 27

STATE = "vec_id bigint, x binary, cluster int, distance bigint, upper double, near binary, lower binary, scanned int"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Each component as the integer floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def fits(vector: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Whether a vector has ``width`` components, none null or non-finite, nor beyond MOST when scaled."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > MOST))
    return F.coalesce((F.size(vector) == width) & ~bad, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``, int64."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= 1 << 20 and x.shape[1] <= 1 << 10:
        # All sums stay below 2^53, so products of doubles are exact.
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray, tracked: int):
    """(cluster, distance, near, lower) by all distances; ``lower`` has one column more than ``near``, for all other centroids."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number first
    far = np.full((len(x), 1), np.inf)
    roots = np.concatenate([np.sqrt(np.take_along_axis(d, order, 1)), far], axis=1)
    own = order[:, 0]
    return own, d[np.arange(len(x)), own], order[:, 1 : tracked + 1], roots[:, 1 : tracked + 2]


def reassign(x, own, upper, near, lower, centroids, moved):
    """One round's assignment of vectors with bounds; ``moved`` are the centroids' moves.

    Returns the new (own, upper, near, lower, scanned): distances computed are 0 for vectors whose bounds alone certify
    the old centroid, 1 if the distance to that one was needed, 2 if those to the tracked ones were, 3 for full scans.
    """
    n, tracked = near.shape
    upper, lower = upper + moved[own], lower.copy()
    lower[:, :tracked] -= moved[near]
    lower[:, tracked] -= moved.max(initial=0.0)
    scanned = np.zeros(n, np.int32)
    sure = lambda u, l: u * (1 + SLACK) + SLACK < l

    # The old centroid's exact distance, where bounds do not do.
    todo = np.flatnonzero(~sure(upper, lower.min(axis=1)))
    if len(todo):
        upper[todo] = np.sqrt(((x[todo] - centroids[own[todo]]) ** 2).sum(1))
        scanned[todo] = 1
        todo = todo[~sure(upper[todo], lower[todo].min(axis=1))]
    # Tracked centroids decide, if one of them or the old one is certainly nearer than all others.
    if len(todo) and tracked:
        among = np.concatenate([own[todo, None], near[todo]], axis=1)
        d = ((x[todo, None, :] - centroids[among]) ** 2).sum(2)
        order = np.lexsort((among, d), axis=1)  # by distance, then by number
        among, d = np.take_along_axis(among, order, 1), np.take_along_axis(d, order, 1)
        roots = np.sqrt(d)
        good = sure(roots[:, 0], lower[todo, tracked])
        at = todo[good]
        own[at], upper[at], near[at], lower[at, :tracked] = among[good, 0], roots[good, 0], among[good, 1:], roots[good, 1:]
        scanned[at] = 2
        todo = todo[~good]
    if len(todo):
        own[todo], d, near[todo], lower[todo] = scan(x[todo], centroids, tracked)
        upper[todo] = np.sqrt(d)
        scanned[todo] = 3
    return own, upper, near, lower, scanned


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _rows(matrix: np.ndarray, kind) -> pa.Array:
    flat, size = matrix.astype(kind).tobytes(), matrix.shape[1] * np.dtype(kind).itemsize
    return pa.array([flat[i * size : (i + 1) * size] for i in range(len(matrix))], pa.binary())


def _state(vec_id, x, own, distance, upper, near, lower, scanned) -> pa.RecordBatch:
    columns = [vec_id, x, pa.array(own, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper, pa.float64()), _rows(near, "<i4"), _rows(lower, "<f8"), pa.array(scanned, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])


def first_round(vectors: DataFrame, centroids: np.ndarray, tracked: int) -> DataFrame:
    """STATE of (vec_id, x: array<bigint>), all distances computed."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if len(x):
                own, d, near, lower = scan(x, centroids, tracked)
                yield _state(batch.column("vec_id"), _rows(x, "<i4"), own, d, np.sqrt(d), near, lower, np.full(len(x), 3))

    return vectors.mapInArrow(run, STATE)


def next_round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, tracked: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), "<i4", centroids.shape[1]).astype(np.int64)
            own = batch.column("cluster").to_numpy().astype(np.int64)
            near = _matrix(batch.column("near"), "<i4", tracked).astype(np.int64) if tracked else np.zeros((len(x), 0), np.int64)
            lower = _matrix(batch.column("lower"), "<f8", tracked + 1)
            own, upper, near, lower, scanned = reassign(x, own, batch.column("upper").to_numpy(), near, lower, centroids, moved)
            distance = ((x - centroids[own]) ** 2).sum(1)
            yield _state(batch.column("vec_id"), batch.column("x"), own, distance, upper, near, lower, scanned)

    return state.mapInArrow(run, STATE)


def moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The clusters' componentwise floor(sum / count); centroids of empty clusters stay.

    Tasks sum their own vectors, then Spark sums by cluster and component: clusters times components are all that the driver gets.
    """
    k, width = centroids.shape

    def run(batches):
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("x"), "<i4", width), batch.column("cluster").to_numpy()
                order = np.argsort(own, kind="stable")
                found, at = np.unique(own[order], return_index=True)
                sums[found] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
                n += np.bincount(own, minlength=k)
        here = np.flatnonzero(n)
        columns = [np.repeat(here, width), np.tile(np.arange(width), len(here)), sums[here].ravel(), np.repeat(n[here], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "place", "s", "n"])

    parts = state.select("x", "cluster").mapInArrow(run, "cluster bigint, place bigint, s bigint, n bigint")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.place] = int(r.s) // r.n
    return out


def starts(vectors: DataFrame, k: int, draw: str) -> np.ndarray:
    """The k vectors whose ids come first by hash, in that order; equal ids by components."""
    hashed = F.sha2(F.concat(F.lit(draw), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(hashed, "x").limit(k).select("x").collect()], np.int64)


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, k: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, draw: str = DRAW, tracked: int = TRACKED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that ``fits``.

    Exact integer k-means. Each round reads the vectors with their bounds and writes them with the new ones; the table of the round before then goes, so two
    stand at a time and a lost executor costs its tasks of one round. Only centroids go through the driver. A vector keeps an upper
    bound of its own centroid's distance, lower bounds of the ``tracked`` nearest others', and one for all the rest; moves of centroids
    loosen them, and distances are computed only where they certify no strict order. Ties go to the smaller number.
    Vectors that are null, of another width, hold null or non-finite components, or components beyond 2^27 when scaled are left out. Null ids draw like
    empty ones and stay null; repeated rows are vectors of their own; with fewer vectors than centroids there are as many as vectors; an empty
    table gives no rows; other columns are ignored. Sums beyond a bigint are null.
    """
    spark = ship(rows.sparkSession)
    kept = rows.where(fits(F.col(vector), width, scale)).select(F.col(vec_id).cast("bigint").alias("vec_id"), scaled(F.col(vector), scale).alias("x"))
    centroids = starts(kept, k, draw)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    tracked = min(tracked, len(centroids) - 1)
    state = written(first_round(kept, centroids, tracked), "clusters")
    for _ in range(rounds):
        new = moved_to(state, centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64))
        before, centroids = state, new
        state = written(next_round(before, centroids, moved, tracked), "clusters")
        erase(before)
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    held = lambda s: int(s) if s < 1 << 63 else None
    told = [(c, held(s), held(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])


def op12_adaptive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster`` of all ``embeddings``."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
  SELECT r, c, list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} AS k) GROUP BY r)"""


def _moved(i: int) -> str:
    return f"""
m{i} AS MATERIALIZED (SELECT cluster AS c, list(q ORDER BY place) AS x FROM (
  SELECT cluster, place, ((sum(val) - ((sum(val) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q FROM a{i} JOIN e USING (r) GROUP BY cluster, place) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x) AS x FROM c{i} AS k LEFT JOIN m{i} AS m USING (c))"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
e AS MATERIALIZED (SELECT r, unnest(x) AS val, generate_subscripts(x, 1) AS place FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{DRAW}' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS})),
{",".join(_round(i) + "," + _moved(i) for i in range(ROUNDS))},{_round(ROUNDS)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (r) JOIN c{ROUNDS} AS k ON k.c = a.cluster
"""
