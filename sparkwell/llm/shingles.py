"""Near copies by word shingles: candidates from bands of minima, decided by exact overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import connected_components, cut, label_pairs, written
from .tokens import texts_of

#: Words in a shingle, and the share of two texts' different shingles that both must have.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of minima, and minima in a band: of texts that share 0.8 of their shingles 997 in 1000 agree in a band, of those that share 0.3 one in 70.
BANDS, ROWS = 20, 6
SEED = 42
#: Rows and shingles of a block. Two blocks of a bucket meet at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different 64-bit hashes of the text's shingles, ascending.

    A-Z are lower-cased, words end at ASCII white space. Fewer words than a shingle has are one shingle; no words have none.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([of(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    return np.unique(np.array([of(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], np.uint64))


def factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1), draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: of its minima over the shingles' hashes under as many mixings. No shingles have no keys."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    times, plus = factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # bounded memory for texts of any length
        np.minimum(least, (hashes[at : at + 2048, None] * times + plus).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in (least >> np.uint64(20)).reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def banded(rows: DataFrame) -> DataFrame:
    """(row, id, keys) of rows (row, id, text)."""

    def run(batches):
        for batch in batches:
            keys = [band_keys(shingle_hashes(t)) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(keys, pa.list_(pa.int64()))], ["row", "id", "keys"])

    ship(rows.sparkSession)
    return rows.select("row", "id", "text").mapInArrow(run, "row bigint, id bigint, keys array<bigint>")


def candidates(keyed: DataFrame) -> DataFrame:
    """(a, b), a < b: each row of a bucket with the bucket's first row, and with one drawn by hash.

    So work grows with the rows, whatever a bucket holds. Both are minima, made before anything is shuffled; a bucket that very many rows share makes a
    skewed join of numbers. ``rest`` gives the pairs that are still to be looked at.
    """
    rows = keyed.select("row", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("order"), F.explode("keys").alias("key"))
    drawn = F.struct(F.xxhash64("key", "row").alias("h"), "row")
    buckets = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("order").alias("first"), F.min(drawn).alias("drawn")).where("n > 1"))
    met = rows.join(buckets, "key").select("row", F.explode(F.array("first.row", "drawn.row")).alias("other")).where("row <> other")
    return met.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()


def mixed(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, row, root): the rows of buckets whose rows are not all in one group yet; ``groups`` are (node, root), rows that it lacks are groups of their own."""
    rooted = keyed.join(groups.withColumnRenamed("node", "row"), "row", "left")
    rows = rooted.select("row", F.coalesce("root", "row").alias("root"), F.explode("keys").alias("key")).select("key", "row", "root")
    keys = cut(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    return cut(rows.join(keys, "key"))


def rest(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket whose rows are not in one group yet; ``groups`` are as in ``mixed``.

    Pairs within a group can join nothing more, so a bucket of one group gives none, however large. What does not link with its bucket's others meets
    each of them, a row for each pair: this spells out what ``rest_links`` compares, for small tables.
    """
    left = mixed(keyed, groups)
    right = left.select("key", F.col("row").alias("b"), F.col("root").alias("other"))
    return left.join(right, "key").where("row < b and root <> other").select(F.col("row").alias("a"), "b").distinct()


def shingled(rows: DataFrame) -> DataFrame:
    """(row, hashes) of rows (row, text)."""

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t).view(np.int64) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hashes, pa.list_(pa.int64()))], ["row", "hashes"])

    ship(rows.sparkSession)
    return rows.select("row", "text").mapInArrow(run, "row bigint, hashes array<bigint>")


def verified(pairs: DataFrame, hashed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) that have at least ``similar`` of their shingles in common; ``hashed`` are (row, hashes)."""

    def run(batches):
        for batch in batches:
            found = []
            (m, at), (n, to) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
            for i in range(batch.num_rows):
                x, y = m[at[i] : at[i + 1]], n[to[i] : to[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(common >= similar * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    both = pairs.join(hashed.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(hashed.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def overlapping(hashes: np.ndarray, sizes: np.ndarray, roots: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of unlike roots, of sets that have at least ``similar`` of their hashes in common; ``hashes`` are the sets' one after another.

    What few sets have is counted pair by pair, what many have by products of bounded slices, so that neither is a list of all pairs for each hash.
    """
    count = len(sizes)
    order = np.argsort(hashes, kind="stable")
    owner, found = np.repeat(np.arange(count), sizes)[order], hashes[order]
    run = np.cumsum(np.concatenate([[0], found[1:] != found[:-1]]))
    held = np.bincount(run)[run]
    common, few = np.zeros((count, count), np.int32), count // 16
    some = (held > 1) & (held <= few)
    mine, of = owner[some], run[some]
    for lag in range(1, few):
        same = of[lag:] == of[:-lag]
        if not same.any():
            break
        np.add.at(common.reshape(-1), mine[:-lag][same] * count + mine[lag:][same], 1)
    many = (held > 1) & (held > few)
    mine, of = owner[many], np.unique(run[many], return_inverse=True)[1]  # ascending, as runs are
    for first in range(0, int(of[-1]) + 1 if len(of) else 0, 1024):
        lo, hi = np.searchsorted(of, [first, first + 1024])
        has = np.zeros((count, 1024), np.float32)
        has[mine[lo:hi], of[lo:hi] - first] = 1
        common += (has @ has.T).astype(np.int32)
    a, b = [], []
    for at in range(0, count, 256):
        shared = common[at : at + 256]
        near = shared >= similar * (sizes[at : at + 256, None] + sizes - shared) - 1e-9
        x, y = np.nonzero(np.triu(near & (roots[at : at + 256, None] != roots), at + 1))
        a.append(x + at)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def runs(batches, key: list[str]):
    """The rows that agree in the columns ``key``, as lists of slices of batches, which must be sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in key]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows], strict=True):
            if held and (lo or any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(key, columns, strict=True))):
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def rest_links(keyed: DataFrame, groups: DataFrame, hashed: DataFrame, similar: float = SIMILAR, *, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that join whatever the verified pairs of ``rest`` join, without a row for each pair.

    A bucket's rows meet in one tile, where all are compared exactly, and each tile gives a spanning forest of its links. Of a bucket too large for that,
    the rows of its largest group and all others are dealt to blocks, and each block of others has a tile with each other block. Rows of the largest
    group are not compared among themselves, so a few rows apart from a large group cost no more than the group has rows.
    """
    rows = mixed(keyed, groups)
    sized = cut(rows.join(hashed.select("row", F.size("hashes").cast("bigint").alias("size")), "row"))
    each = sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "root")).alias("most"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / block_rows), F.ceil(size / block_shingles)).cast("int")

    most, n, size = F.col("most"), F.col("n"), F.col("size")
    dealing = cut(whole.select("key", most["root"].alias("most"), blocks(most["n"], most["size"]).alias("theirs"), blocks(n - most["n"], size - most["size"]).alias("others")))
    theirs, others = F.col("theirs"), F.col("others")
    # The others' blocks come first; a tile is named by the lower and the higher of its blocks.
    block = F.when(F.col("root") == F.col("most"), others + F.pmod(F.xxhash64("row"), theirs)).otherwise(F.pmod(F.xxhash64("row"), others)).cast("int")
    placed = sized.join(dealing, "key").select("key", "row", "root", "others", block.alias("block"), F.explode(F.sequence(F.lit(0), others + theirs - 1)).alias("with"))
    met = placed.where("with <> block and least(with, block) < others")
    tiles = met.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "row", "root")
    tile = ["key", "low", "high"]

    def compare(batches):
        for parts in runs(batches, tile):
            row, root = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("row", "root"))
            if len(row) < 2 or (root == root[0]).all():
                continue
            hashes = np.concatenate([p.column("hashes").flatten().to_numpy() for p in parts])
            sizes = np.concatenate([p.column("hashes").value_lengths().to_numpy() for p in parts]).astype(np.int64)
            a, b = overlapping(hashes, sizes, root, similar)
            if len(a):
                lowest = label_pairs(len(row), a, b)
                ends = np.flatnonzero(lowest != np.arange(len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(row[lowest[ends]], pa.int64()), pa.array(row[ends], pa.int64())], ["a", "b"])

    spread = tiles.join(hashed, "row").select(*tile, "row", "root", "hashes").repartition(*tile).sortWithinPartitions(*tile)
    return spread.mapInArrow(compare, "a bigint, b bigint")


def near_copies(rows: DataFrame, *, row: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row): the rows that go so that one of each group of near copies stays, that of the smallest id (null ids last), then of the smallest number.

    Groups are joined by pairs whose exact shingle overlap is at least SIMILAR; pairs are looked at if their texts agree in a band: those with the bucket's
    first row and a drawn one, then all others whose rows these have not joined. So every row that goes is, through such pairs, a near copy of the one that stays. ``row`` must number
    the rows. Texts without words are no copies of anything; texts of fewer words than a shingle only of equal ones. Empty tables give none.
    """
    plain = rows.select(F.col(row).cast("bigint").alias("row"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    keyed = written(banded(plain), "bands")
    pairs = cut(candidates(keyed))
    # Every row that shares a bucket is in a pair. Written, so that its size is known when Spark chooses between a broadcast and a shuffle of the texts.
    met = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "met")
    hashed = written(shingled(plain.join(met, "row")), "shingles")
    links = cut(verified(pairs, hashed))
    first = cut(connected_components(links))
    others = cut(rest_links(keyed, first, hashed))
    groups = cut(connected_components(links.unionByName(others))) if others.limit(1).count() else first
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("row"))
    members = groups.join(keyed.select(F.col("row").alias("node"), "id"), "node")
    stays = members.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    return groups.select(F.col("node").alias("row")).join(stays, "row", "left_anti")
