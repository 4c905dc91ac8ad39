"""Near-duplicate vectors: binary codes of randomly rotated vectors decide which pairs are computed exactly."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import connected_components, cut, label_pairs, table

THRESHOLD = 0.95
#: Standard errors that an estimate may be off before a pair goes unexamined; the chance of that is below 1e-8.
SURE = 6.0
#: What estimates in single precision may be off besides.
ROUNDING = 1e-4
#: Bytes of a tile's vectors, and its rows at least and at most.
TILE_BYTES, LEAST_ROWS, MOST_ROWS = 8 << 20, 256, 16384
#: Tiles that a width is dealt to if there are so many rows for each, so that their pairs keep a cluster busy.
TILES, SPREAD = 8, 1024
#: Different widths that are dealt by a broadcast table of tile counts; a table of more is joined by shuffle.
BROADCAST_WIDTHS = 10_000


@lru_cache(maxsize=2)
def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 0.5..1: exact, and no square over- or underflows."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    half = -power // 2  # in two steps, since the whole power may be no finite number
    return np.ldexp(np.ldexp(vectors, half[:, None]), (-power - half)[:, None])


def code(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs of the rotated vectors, correction factor of each).

    The factor is the inner product of a vector with its own code, taken as a unit vector.
    """
    rotated = units @ turn
    signs = np.where(rotated >= 0, 1.0, -1.0) / np.sqrt(units.shape[1])
    return np.packbits(rotated >= 0, axis=1), np.einsum("ij,ij->i", signs, rotated)


def estimate(bits: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded with rotated unit vectors, and their standard errors.

    With x the code, o the vector and s the sine between o and q, <x, q> / <x, o> is <o, q> + s tan(o, x) u, where u is one component
    of a random unit vector of width - 1 components: the expectation over the rotations is <o, q>, and it
    strays by about s sqrt((1 - <x, o>^2) / <x, o>^2 / (width - 1)). The errors given are those for s = 1.
    """
    width = rotated.shape[1]
    signs = np.unpackbits(bits, axis=1, count=width).astype(np.float32) * 2 - 1
    signs /= (factor * np.sqrt(width)).astype(np.float32)[:, None]
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(width - 1, 1))
    return signs @ rotated.astype(np.float32).T, error


def linked(x: np.ndarray, y: np.ndarray, bits: np.ndarray, factor: np.ndarray, turn: np.ndarray, threshold: float, rows: int = 512):
    """Index pairs of ``x`` and ``y`` (both ``scaled``) of cosine ``threshold`` or more, each computed exactly in double precision.

    The sine of a pair that links is at most that of the threshold, and so is its estimate's error times that.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    rotated = (y / ny[:, None]) @ turn
    sine = np.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else 1.0
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        guess, error = estimate(bits[part], factor[part], rotated)
        a, b = np.nonzero(guess >= (threshold - SURE * error * sine - ROUNDING).astype(np.float32)[:, None])
        for some in range(0, len(a), 1 << 16):
            i, j = a[some : some + (1 << 16)] + at, b[some : some + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
            near = cosine >= threshold
            yield i[near], j[near]


def tile_count(width, n, tile: int | None):
    """Columns of widths and counts to tiles: of ``tile`` rows, else of TILE_BYTES, but fewer rows where that leaves few tiles."""
    if tile:
        return F.ceil(n / tile)
    rows = F.least(F.lit(MOST_ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(TILE_BYTES) / (8 * width))))
    return F.greatest(F.ceil(n / rows), F.least(F.lit(TILES), F.ceil(n / SPREAD)))


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors are one class, compared once and counted by its size. The classes of each width are dealt by hash
    to tiles of about TILE_BYTES, and each pair of tiles is one group: codes
    screen its pairs, survivors are computed exactly, and what leaves it is a count for each class and a
    spanning forest of its links, never the pairs. All pairs of classes of a width are screened, so the work is quadratic in
    different vectors, at a few operations a pair, and each vector is copied once for every tile of its width.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0 and a
    component of their own. Any others link by cosine, however large or small their components are; those of different widths never do.
    A null vec_id is carried along. Repeated rows are vectors like any others, other columns are ignored. No vectors give no rows.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    good = rows.where(usable).withColumn("width", F.size("v"))
    classes = cut(good.groupBy("width", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    tiles = cut(classes.groupBy("width").agg(F.count("*").alias("n")).select("width", tile_count(F.col("width"), F.col("n"), tile).cast("int").alias("tiles")))
    if tiles.limit(BROADCAST_WIDTHS + 1).count() <= BROADCAST_WIDTHS:
        tiles = F.broadcast(tiles)

    def with_code(batches):
        for pdf in batches:
            v, at = list(pdf["v"]), pdf["width"].to_numpy()
            stored, bits, factor = [None] * len(v), [None] * len(v), np.zeros(len(v))
            for width in np.unique(at):
                some = np.flatnonzero(at == width)
                x = scaled(np.stack([np.asarray(v[k], np.float64) for k in some]))
                packed, factor[some] = code(x / np.linalg.norm(x, axis=1)[:, None], rotation(int(width)))
                for k, one, b in zip(some.tolist(), x, packed, strict=True):
                    stored[k], bits[k] = one.tobytes(), b.tobytes()
            yield pd.DataFrame({"class": pdf["class"], "n": pdf["n"], "width": pdf["width"], "tiles": pdf["tiles"], "v": stored, "bits": bits, "factor": factor})

    listed = classes.select("class", "n", "width", "v").join(tiles, "width").select("class", "n", "width", "tiles", "v")
    coded = listed.mapInPandas(with_code, "class bigint, n bigint, width int, tiles int, v binary, bits binary, factor double")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = coded.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")).select("*", F.explode(every).alias("other"))
    dealt = dealt.select("width", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "n", "v", "bits", "factor")

    def compare(key, pdf):
        width, i, j = (int(k) for k in key)
        mine, ids, n = pdf["mine"].to_numpy(), pdf["class"].to_numpy(), pdf["n"].to_numpy()
        ax, ay = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        if len(ax) and len(ay):
            whole = lambda at, column, kind: np.frombuffer(b"".join(pdf[column].iloc[at]), kind).reshape(len(at), -1)
            vx, vy = whole(ax, "v", np.float64), whole(ay, "v", np.float64)
            for a, b in linked(vx, vy, whole(ax, "bits", np.uint8), pdf["factor"].to_numpy()[ax], rotation(width), threshold):
                a, b = ax[a], ay[b]
                if i == j:
                    apart = a != b
                    a, b = a[apart], b[apart]
                np.add.at(links, a, n[b])
                if i != j:
                    np.add.at(links, b, n[a])
                if (label[a] != label[b]).any():
                    label = label_pairs(len(label), label[a], label[b])[label]
        some = np.flatnonzero(links)
        return pd.DataFrame({"class": ids[some], "links": links[some], "root": ids[label[some]]})

    found = cut(dealt.groupBy("width", "i", "j").applyInPandas(compare, "class bigint, links bigint, root bigint"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("root").alias("a"), F.col("class").alias("b")))
    named = classes.join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the last join deals both sides anew and can split a vector that very many rows share.
    named = cut(named.join(smallest, "root").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    joined = rows.withColumn("key", F.when(usable, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def op6_rotated_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_vectors`` of all rows of ``embeddings`` at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept FROM e
"""
