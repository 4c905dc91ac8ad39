"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens overlap."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table, written
from .tokens import byte_letters, texts_of

#: Bytes of text that are aligned at once (a longer text alone), and units of text that a worker remembers.
BATCH_BYTES, REMEMBERED = 1 << 21, 500_000
#: Pairs of ids in one row of a batch's list.
PAIRS_ROW = 4096

#: A document's row has its figures and its links, as places in the list of its batch's pairs; a list's row has pairs and how many documents of the batch hold them.
ALIGNED = (
    "batch bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " link_pairs binary, link_times binary, at bigint, pairs array<bigint>, docs array<bigint>"
)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class PairEncoder:
    """Ids of a text in a byte-level vocabulary (A) and in a piece vocabulary (B).

    Both cut before a blank or a line end that follows something else than white space, whatever stands around: A's rules begin a new word there,
    and no piece of B goes over a blank or holds a line end. Such units of text are encoded once and then looked up. Vocabularies for which that does not
    hold get whole texts. ``tests/llm`` compares both ways.
    """

    CUT = re.compile(r"(?<=\S)(?=[ \n])")

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_b = self.b.get_piece_size()
        back = {letter: byte for byte, letter in byte_letters().items()}
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.bytes_a[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        rules = json.loads(self.a.to_str())
        before = rules["pre_tokenizer"] or {}
        plain_a = not rules["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain_b = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.b.normalize("ﬁ Ａ  x ") == "▁ﬁ▁Ａ▁▁x▁"
        self.by_unit = bool(plain_a and plain_b)
        self.clear()

    def clear(self) -> None:
        # By what follows a blank, or by a unit that begins with a line end; and units of texts with runs of white space, as they are.
        self.pieces: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.ids = array("i"), array("i")
        self.starts = array("q", [0]), array("q", [0])
        self.sound = array("b")

    def learn(self, units: list[str]) -> None:
        """Encodes new units, which begin with a blank or a line end, one after another."""
        raw = [u.encode() for u in units]
        # Laid end to end, A cuts them as it does one by one, unless some end in white space.
        apart = [units] if any(u[-1].isspace() for u in units) or not self.by_unit else [["".join(units)]]
        found_a = [x.ids for part in apart for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
        # B puts a blank before what it gets, unless it gets nothing; before a line end that blank is a token of its own.
        found_b = self.b.encode([(u[1:] or "\n") if u[0] == " " else u for u in units], num_threads=1)
        found_b = [y[1:] if u[0] == "\n" else y[:1] if u == " " else y for u, y in zip(units, found_b, strict=True)]
        ends = np.cumsum([len(x) for x in raw])
        whole = b"".join(raw)
        sides = []
        for ids, spelled in ((found_a, self.bytes_a), (found_b, self.bytes_b)):
            flat = list(chain.from_iterable(ids))
            stops = np.cumsum(self.lengths_of(flat, spelled))
            starts = np.searchsorted(stops, ends, "right")  # tokens up to each unit's end
            sides.append((flat, starts, b"".join(map(spelled.__getitem__, flat)) == whole and np.isin(ends, stops).all()))
        if all(fits for _, _, fits in sides):
            for side, (flat, starts, _) in enumerate(sides):
                self.starts[side].extend((starts + len(self.ids[side])).tolist())
                self.ids[side].extend(flat)
            self.sound.extend([1] * len(units))
        elif len(units) > 1:  # some are not given back: find out which
            for part in (units[: len(units) // 2], units[len(units) // 2 :]):
                self.learn(part)
        else:
            for side in (0, 1):
                self.starts[side].append(len(self.ids[side]))
            self.sound.append(0)

    def lengths_of(self, ids: list[int], spelled: list[bytes]) -> np.ndarray:
        return (self.lengths_a if spelled is self.bytes_a else self.lengths_b)[np.array(ids, np.int64)]

    def _known(self, known: dict[str, int], keys: list[str], unit_of) -> None:
        """Learns those of the keys that are new, all at once."""
        if new := [k for k in dict.fromkeys(keys) if k not in known]:
            first = len(self.sound)
            self.learn([unit_of(k) for k in new])
            known.update(zip(new, range(first, first + len(new)), strict=True))

    def places(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text, places, in what is remembered, of the units of a blank and the text; None for null and empty texts."""
        parts, whole = {}, {}
        for i, text in enumerate(texts):
            if text:
                parts[i] = text.replace("\n", " \n").split(" ") if self.by_unit else [""]
        # A piece that is empty or ends in white space stands where units do not begin.
        odd = {p for p in set(chain.from_iterable(parts.values())) if not p or p[-1].isspace()}
        for i in [i for i, pieces in parts.items() if odd and not odd.isdisjoint(pieces)]:
            del parts[i]
            whole[i] = self.CUT.split(" " + texts[i]) if self.by_unit else [" " + texts[i]]
        self._known(self.pieces, list(chain.from_iterable(parts.values())), lambda p: p if p[0] == "\n" else " " + p)
        self._known(self.units, list(chain.from_iterable(whole.values())), str)
        out: list[np.ndarray | None] = [None] * len(texts)
        for known, some in ((self.pieces, parts), (self.units, whole)):
            for i, keys in some.items():
                out[i] = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        return out

    def tokens(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of units in order."""
        out = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            ids, starts = np.array(ids, np.int64), np.array(starts, np.int64)
            counts = starts[places + 1] - starts[places]
            shift = starts[places] - (np.cumsum(counts) - counts)
            out.append(ids[np.repeat(shift, counts) + np.arange(int(counts.sum()))])
        return out[0], out[1]


@lru_cache(maxsize=2)
def encoder(path_a: str, path_b: str) -> PairEncoder:
    """One encoder for each worker process."""
    return PairEncoder(path_a, path_b)


@lru_cache(maxsize=1)
def spelled(most: int) -> np.ndarray:
    """Each id up to ``most`` in decimal with a comma, a stroke or a semicolon, eight bytes each, zeros after that."""
    ids = [str(i).encode() for i in range(most + 1)]
    width = max(8, -8 * (-(len(ids[-1]) + 1) // 8))
    return np.array([[x + mark for x in ids] for mark in (b",", b"|", b";")], f"S{width}")


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2,b3;`` and where each group's text ends; ``group_*`` number each token's group in order."""
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    words = spelled(most)
    out = np.zeros(len(ids_a) + len(ids_b), words.dtype)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    # A token comes after all tokens of earlier groups, and one of B after those of A in its own.
    at_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    out[at_a] = words[last_a.astype(np.int64), ids_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    out[at_b] = words[2 * last_b.astype(np.int64), ids_b]
    sizes = np.searchsorted(10 ** np.arange(1, 19), np.arange(most + 1), "right") + 2
    lengths = np.zeros(len(out), np.int64)
    lengths[at_b] = sizes[ids_b]
    lengths[at_a] = sizes[ids_a]
    return out.tobytes().translate(None, b"\0"), np.cumsum(lengths)[at_b[last_b]]


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, doc_bytes: np.ndarray, most: int) -> dict:
    """Figures and links of documents laid end to end.

    ``len_*`` are the tokens' bytes and ``doc_bytes`` the documents', none of them 0; no id exceeds ``most``. One count of A's and one of B's ends by byte: where both have one, groups
    end; between two neighbouring ends of either lies one link. Prefix sums, read at the documents' ends, part the figures.
    """
    total = int(doc_bytes.sum())
    ends = np.cumsum(doc_bytes)
    of_a = np.bincount(np.cumsum(len_a), minlength=total + 1)
    of_b = np.bincount(np.cumsum(len_b), minlength=total + 1)
    places = np.flatnonzero(of_a + of_b)
    of_a, of_b = of_a[places], of_b[places]
    upto_a, upto_b, upto_g = np.cumsum(of_a), np.cumsum(of_b), np.cumsum(of_a & of_b)
    at = np.searchsorted(places, ends)  # the documents' last links

    def part(sums):
        return np.diff(sums[at], prepend=0)

    cuts = upto_g - (of_a & of_b)
    a, b = upto_a - of_a, upto_b - of_b
    text, group_ends = written_groups(ids_a, ids_b, cuts[of_a == 1], cuts[of_b == 1], most)
    n_groups = part(upto_g)
    stops = group_ends[np.cumsum(n_groups) - 1]
    begins = np.concatenate([[0], stops[:-1]])
    n_links = np.diff(at + 1, prepend=0)
    return {
        "n_a": part(upto_a), "n_b": part(upto_b), "n_groups": n_groups, "n_links": n_links,
        "groups_sha256": [hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(begins.tolist(), stops.tolist(), strict=True)],
        "a": ids_a[a], "b": ids_b[b], "doc": np.repeat(np.arange(len(ends)), n_links),
    }


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``ALIGNED``: one for each document, and each batch's different pairs of ids in lists."""
    paths = vocabularies or default_vocabularies()

    def run(batches):
        both, part, seq = encoder(*paths), TaskContext.get().partitionId(), 0
        names, texts, held = [], [], 0

        def flush():
            nonlocal seq
            if len(both.sound) > REMEMBERED:
                both.clear()
            places = both.places(texts)
            batch = (part << 32) + seq
            seq += 1
            sound = np.array(both.sound, bool)
            good = np.array([bool(p is not None and sound[p].all()) for p in places], bool)
            kept = [p for p, g in zip(places, good, strict=True) if g]
            zero = np.zeros(len(names), np.int64)
            columns = {k: zero.copy() for k in ("n_a", "n_b", "n_groups", "n_links")}
            sha, at_of, times_of = [""] * len(names), [b""] * len(names), [b""] * len(names)
            pairs, docs_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if kept:
                ids_a, ids_b = both.tokens(np.concatenate(kept))
                len_a, len_b = both.lengths_a[ids_a], both.lengths_b[ids_b]
                counts = np.array(both.starts[0], np.int64)
                n_tokens = np.array([int((counts[p + 1] - counts[p]).sum()) for p in kept])
                doc_bytes = np.add.reduceat(len_a, np.cumsum(n_tokens) - n_tokens)
                found = aligned(ids_a, ids_b, len_a, len_b, doc_bytes, max(len(both.bytes_a), len(both.bytes_b)) - 1)
                for k, column in columns.items():
                    column[good] = found[k]
                pairs, where = np.unique(found["a"] * len(both.bytes_b) + found["b"], return_inverse=True)
                held_by, times = np.unique(found["doc"] * len(pairs) + where, return_counts=True)
                doc, pair = held_by // len(pairs), held_by % len(pairs)
                docs_of = np.bincount(pair, minlength=len(pairs))
                stops = np.cumsum(np.bincount(doc, minlength=len(kept))).tolist()
                pair, times = pair.astype("<i4"), times.astype("<i4")
                begin = 0
                for i, g, end in zip(np.flatnonzero(good).tolist(), found["groups_sha256"], stops, strict=True):
                    sha[i], at_of[i], times_of[i] = g, pair[begin:end].tobytes(), times[begin:end].tobytes()
                    begin = end
            n = len(names)
            rows = {"batch": pa.array([batch] * n, pa.int64()), "doc_id": pa.array(names, pa.int64())}
            rows |= {k: pa.array(v, pa.int64()) for k, v in columns.items()}
            rows |= {"groups_sha256": pa.array(sha), "link_pairs": pa.array(at_of, pa.binary()), "link_times": pa.array(times_of, pa.binary())}
            rows |= {"at": pa.nulls(n, pa.int64()), "pairs": pa.nulls(n, pa.list_(pa.int64())), "docs": pa.nulls(n, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(rows)
            firsts = range(0, len(pairs), PAIRS_ROW)
            lists = {k: pa.nulls(len(firsts), v.type) for k, v in rows.items()} | {"batch": pa.array([batch] * len(firsts), pa.int64()), "at": pa.array(firsts, pa.int64())}
            lists |= {k: pa.array([v[x : x + PAIRS_ROW] for x in firsts], pa.list_(pa.int64())) for k, v in (("pairs", pairs), ("docs", docs_of))}
            yield pa.RecordBatch.from_pydict(lists)
            names.clear(), texts.clear()

        for batch in batches:
            for name, one in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                size = len(one.encode()) if one else 0
                if names and held + size > BATCH_BYTES:
                    yield from flush()
                    held = 0
                names.append(name)
                texts.append(one)
                held += size
        if names:
            yield from flush()

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(lists: DataFrame, size_b: int) -> DataFrame:
    """(pair, value): twice the number of documents that hold the pair linked, and one more if no pair of its A id is held by more."""
    counts = cut(lists.groupBy("pair").agg(F.sum("docs").alias("n")))
    a = F.expr(f"pair div {size_b}")
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("bigint")).alias("value"))


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def summed(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of one batch with the sums over their links; ``found`` has the values of the batch's pairs by their place."""
    value = np.zeros(found.num_rows, np.int64)
    value[found.column("pos").to_numpy()] = found.column("value").to_numpy()
    links, times = docs.column("link_pairs").to_pylist(), docs.column("link_times").to_pylist()
    sums = np.zeros((2, docs.num_rows), np.int64)
    for i, (x, y) in enumerate(zip(links, times, strict=True)):
        if x:
            got, n = value[np.frombuffer(x, "<i4")], np.frombuffer(y, "<i4").astype(np.int64)
            sums[:, i] = ((got & 1) * n).sum(), ((got >> 1) * n).sum()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = {c: docs.column(c) for c in names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(columns)


def alignments(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A blank and the text are encoded by A, the text by B, which adds the blank. Where tokens of both end, a group ends. A link is a pair of overlapping
    tokens; its count is the number of documents that hold its ids linked, over all documents. ``n_best`` are the links whose count is the
    highest of their A id's, ``count_sum`` the sum of the counts.

    Texts are aligned in batches of about BATCH_BYTES. Counts are looked up once for each batch and different pair, not for each document, so what is shuffled
    is a list for each batch; a pair that all documents hold makes one row for each batch, which a skewed join can split.
    Texts that are null, empty or not given back by either tokenizer (U+2581 in a text, for example) have no tokens: zeros and ''. Special tokens' strings
    are plain text. Texts are whole, however long; a very long one is a batch. Repeated rows count and come back as often as they are there, null ids stay
    null, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    path_b = (vocabularies or default_vocabularies())[1]
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = written(align(docs, doc_id=doc_id, text=text, vocabularies=vocabularies), "aligned")
    listed = rows.where("pairs is not null").select("batch", "at", F.posexplode(F.arrays_zip("pairs", "docs")).alias("i", "z"))
    listed = listed.select("batch", (F.col("at") + F.col("i")).alias("pos"), F.col("z.pairs").alias("pair"), F.col("z.docs").alias("docs"))
    counts = cut(pair_counts(listed, size_b))
    found = listed.join(counts, "pair").select(F.col("batch").alias("of_batch"), "pos", "value")
    ship(spark)
    mine = rows.where("pairs is null").select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_pairs", "link_times")
    return mine.groupBy("batch").cogroup(found.groupBy("of_batch")).applyInArrow(summed, RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alignments`` of all ``documents``."""
    return alignments(table(spark, sf_dir, "documents"))
