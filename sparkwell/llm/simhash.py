"""SimHash near-duplicates: fingerprints, and links by tiled exact comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import connected_components, cut, label_pairs, table, written
from .tokens import texts_of

#: Words in a shingle, differing bits that still link, and the seed of the hash.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Rows of a tile. Groups of up to so many fingerprints are one tile; larger ones are dealt out to more.
TILE = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash, as a signed integer, of the text's word shingles.

    A-Z are lower-cased, words end at ASCII white space; repeated shingles count as often as they come.
    Fewer words than a shingle has are one shingle; no words give 0, and so does null.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        whole, of = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = (np.concatenate([[0], ends[:-1] + 1])).tolist()
        hashes = [of(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        some = np.array(hashes[at : at + (1 << 16)], ">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", **carried: str) -> DataFrame:
    """Fingerprints ``fp`` of every row, after the bigint columns that ``carried`` names: new names for columns of ``docs``."""

    def hash_texts(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(fps, pa.int64())], [*carried, "fp"])

    ship(docs.sparkSession)
    rows = docs.select(*[F.col(c).cast("bigint").alias(name) for name, c in carried.items()], F.col(text).alias("text"))
    return rows.mapInArrow(hash_texts, ", ".join(f"{c} bigint" for c in [*carried, "fp"]))


def near_pairs(x: np.ndarray, y: np.ndarray | None, radius: int, tile: int = 512):
    """Index pairs within ``radius`` bits, tile by tile: exclusive or, then bit counts.

    Fingerprints are sorted by population count, so that two tiles whose counts lie further apart than
    the radius are skipped. ``y`` None compares ``x`` with itself, each pair once.
    """
    cx = np.bitwise_count(x).astype(np.int16)
    ox = np.argsort(cx, kind="stable")
    if y is None:
        cy, oy = cx, ox
    else:
        cy = np.bitwise_count(y).astype(np.int16)
        oy = np.argsort(cy, kind="stable")
    other = x if y is None else y
    for i in range(0, len(ox), tile):
        rows = ox[i : i + tile]
        for j in range(i if y is None else 0, len(oy), tile):
            columns = oy[j : j + tile]
            if cy[columns[0]] - cx[rows[-1]] > radius:
                break
            if cx[rows[0]] - cy[columns[-1]] > radius:
                continue
            near = np.bitwise_count(x[rows, None] ^ other[None, columns]) <= radius
            if y is None and i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if len(a):
                yield rows[a], columns[b]


def links(fps: DataFrame, *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (``fp``, distinct) within ``radius`` bits.

    The 64 bits fall into ``radius + 1`` bands; fingerprints that near agree wholly in at least one. Those with the
    same band value form a group, and every pair of a group is compared exactly, in tiles. A group of up to ``tile``
    fingerprints is one tile; a larger one is dealt out by population count and hash to tiles of about
    that size, and each pair of tiles whose counts differ by no more than the radius becomes a task's work of its
    own. Each tile pair gives a spanning forest of its links, so what is written grows with the rows compared.
    """
    bands = radius + 1
    width = 64 // bands
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for b in range(bands)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.value")
    groups = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    large = cut(groups.where(F.col("n") > tile))
    # A band has no more large groups than rows / tile; they decide where their rows go.
    keyed = keyed.join(large, ["band", "value"], "left")
    count = F.bit_count("fp").cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * tile))).cast("int")
    salt = F.pmod(F.xxhash64("fp", F.lit(7)), parts.cast("bigint")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("c1"), F.lit(0).alias("s1"), F.lit(0).alias("c2"), F.lit(0).alias("s2"), F.lit(0).alias("side")))

    # A tile is (count, salt). Its rows go to every pair it belongs to: as the first side for counts c..c+radius, as the second
    # for c-radius..c; within one count the salts are ordered too.
    def pairs_of(c, s, n):
        salts = F.sequence(F.lit(0), n - 1)
        first = F.flatten(F.transform(F.sequence(c, c + radius), lambda d: F.transform(F.filter(salts, lambda t: (d > c) | (t >= s)), lambda t: F.struct(c.alias("c1"), s.alias("s1"), d.alias("c2"), t.alias("s2"), F.lit(0).alias("side")))))
        second = F.flatten(F.transform(F.sequence(c - radius, c), lambda d: F.transform(F.filter(salts, lambda t: (d < c) | (t < s)), lambda t: F.struct(d.alias("c1"), t.alias("s1"), c.alias("c2"), s.alias("s2"), F.lit(1).alias("side")))))
        return F.concat(first, second)

    dealt = keyed.select("band", "value", "fp", F.explode(F.when(F.col("n").isNull(), one).otherwise(pairs_of(count, salt, parts))).alias("p"))
    dealt = dealt.select("band", "value", "p.*", "fp")
    key = ["band", "value", "c1", "s1", "c2", "s2"]

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [table.column(k).to_numpy() for k in [*key, "side", "fp"]]
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)] if held else columns
            if not len(columns[0]):
                held = columns
                continue
            new = np.zeros(len(columns[0]), bool)
            new[0] = True
            for c in columns[:6]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            held = [c[starts[-1] :] for c in columns]  # the last tile pair may go on in the next batch
            if len(starts) > 1:
                yield _compared([c[: starts[-1]] for c in columns], starts, radius)
        if held and len(held[0]):
            yield _compared(held, np.array([0, len(held[7])]), radius)

    spread = dealt.repartition(*key).sortWithinPartitions(*key)
    return spread.mapInArrow(compare, "a bigint, b bigint")


def _compared(columns: list[np.ndarray], starts: np.ndarray, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links of some whole tile pairs; ``starts`` ends with the end of the last."""
    _, _, c1, s1, c2, s2, side, fps = columns
    itself = (c1 == c2) & (s1 == s2)
    a, b = [], []
    u = fps.view(np.uint64)
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    # Small tiles side by side: each row with the next one, the one after that, and so on.
    small = sizes <= 64
    for lag in range(1, int(sizes[small].max()) if small.any() else 0):
        here = np.flatnonzero((group[lag:] == group[:-lag]) & small[group[lag:]])
        if not len(here):
            break
        near = here[np.bitwise_count(u[here] ^ u[here + lag]) <= radius]
        near = near[itself[near] | (side[near] != side[near + lag])]
        a.append(near)
        b.append(near + lag)
    for g in np.flatnonzero(~small):
        lo, hi = starts[g], starts[g + 1]
        first = np.flatnonzero(side[lo:hi] == 0) + lo
        second = first if itself[lo] else np.flatnonzero(side[lo:hi] == 1) + lo
        if not len(first) or not len(second):
            continue
        for x, y in near_pairs(u[first], None if itself[lo] else u[second], radius):
            a.append(first[x])
            b.append(second[y])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    root = label_pairs(len(fps), a, b) if len(a) else np.arange(len(fps))
    low = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(low, root, fps)
    ends = np.flatnonzero(low[root] != fps)
    return pa.RecordBatch.from_arrays([pa.array(low[root][ends], pa.int64()), pa.array(fps[ends], pa.int64())], ["a", "b"])


def roots(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for every different ``fp``: the smallest fingerprint that links reach."""
    classes = cut(fps.select("fp").distinct())
    linked = connected_components(links(classes, radius=radius))
    return classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id that links reach.

    Equal fingerprints meet in one group first, so copies are never compared. Rows without words, null text among them, share
    fingerprint 0. A null id is carried along but never names a component, unless all its ids are null. Repeated rows come back as often
    as they are there, texts are hashed whole however long, other columns are ignored, and an empty table gives no rows.
    """
    hashed = written(fingerprints(docs, text=text, doc_id=doc_id), "simhash")
    named = cut(roots(hashed, radius=radius))
    least = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))  # a row for each fingerprint before anything is joined
    names = least.join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the last join deals out both sides anew and can split a fingerprint that very many rows share.
    named = cut(named.join(names, "root").select("fp", "component_id"))
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def followers(rows: DataFrame, *, row: str, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(row): the numbers of the rows that go so that one of each group of near-duplicates stays.

    That of the smallest id stays (null ids last), then of the smallest number. ``row`` must number the rows; ids may be null or repeat. Empty
    tables give none.
    """
    hashed = written(fingerprints(rows, text=text, row=row, id=doc_id), "simhash")
    least = cut(hashed.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("order"), F.count("*").alias("n")))
    named = cut(least.join(roots(hashed, radius=radius), "fp"))
    best = named.groupBy("root").agg(F.min("order").alias("best"), F.sum("n").alias("n")).where("n > 1")
    # Most rows are alone; only the groups' fingerprints meet the rows.
    grouped = cut(named.join(best, "root").select("fp", F.col("best.row").alias("stays")))
    return hashed.join(grouped, "fp").where("row <> stays").select("row")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``components`` of all ``documents``, fingerprints as 16 lower-case hex digits."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
