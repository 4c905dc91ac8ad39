"""Near copies against exact overlap of all pairs, and planted ones."""

import random
import re

import corpus_pipeline as cp
import numpy as np
from sparkwell.llm import shingles as module
from sparkwell.llm.common import connected_components
from sparkwell.llm.shingles import candidates, near_copies, rest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower().decode())  # bytes.lower: A-Z only
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def brute_near_copies(rows, similar=0.8):
    """Ids that go: all but the smallest of each group that pairs of that overlap join."""
    sets, at = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            common = len(s & sets[j])
            if common >= similar * (len(s) + len(sets[j]) - common) - 1e-9:
                a, b = at[i], at[j]
                at = {k: min(a, b) if v in (a, b) else v for k, v in at.items()}
    return {i for i, root in at.items() if i != root}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.row for r in near_copies(docs.selectExpr("doc_id AS row", "doc_id", "text"), row="row").collect()}
    assert got == brute_near_copies([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, 5, long), (1, 3, long + " end"), (2, None, long), (3, 7, None), (4, 7, ""), (5, 7, None), (6, 1, "two words"), (7, 0, "Two  words"), (8, 2, "two worlds"), (9, None, "é \xa0 x"), (10, None, "é \xa0 x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row bigint, doc_id int, text string, keys string").repartition(3)
    assert {r.row for r in near_copies(df, row="row").collect()} == {0, 2, 6, 10}  # the smallest id stays, null ids last
    assert near_copies(df.limit(0), row="row").count() == 0


def planted(r, words, rate):
    """The text with some words exchanged, left out or added."""
    out = []
    for w in words:
        x = r.random()
        if x > rate:
            out.append(w)
        elif x > rate / 3:
            out += [f"new{r.randrange(10**6)}"] * (1 if x > 2 * rate / 3 else 2)
    return " ".join(out)


def test_planted_copies_are_found_by_the_stage(spark):
    """300 groups of an original and copies, with word changes that leave five-word overlaps of 0.8 and more; 600 texts that share passages stay."""
    r = random.Random(7)
    vocabulary = [f"word{i}" for i in range(4000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [text(60) for _ in range(5)]
    rows, pairs, clean = [], [], []
    for _ in range(300):
        words, first = text(r.choice([80, 200, 600])), len(rows)
        rows.append((first, " ".join(words)))
        for _ in range(r.choice([1, 1, 4])):
            copy = planted(r, words, r.uniform(0.005, 0.03))
            a, b = shingles(rows[first][1]), shingles(copy)
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((first, len(rows)))
            rows.append((len(rows), copy))
    for _ in range(600):
        clean.append(len(rows))
        rows.append((len(rows), " ".join([*text(100), *r.choice(passages), *text(100)])))
    order = list(range(len(rows)))
    r.shuffle(order)  # originals do not come first
    docs = spark.createDataFrame([(order[i], t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(8)
    kept = {x.doc_id for x in cp.near_dedup(spark, docs, "").collect()}
    caught = sum(order[a] not in kept or order[b] not in kept for a, b in pairs)
    assert len(pairs) > 300 and caught >= 0.97 * len(pairs)
    assert all(order[i] in kept for i in clean)
    # Of each group at least one text stays.
    gone = set(order) - kept
    assert not gone - brute_near_copies([(order[i], t) for i, t in rows], 0.5)


def test_rows_that_their_buckets_first_ones_do_not_link(spark):
    """Every pair of a bucket is looked at unless its rows are in one group, and no pair of a group is looked at again."""
    keyed = spark.createDataFrame([(i, i, [7, 100 + i // 50]) for i in range(100)] + [(100, 100, [8]), (101, 101, [])], "row bigint, id bigint, keys array<bigint>")
    met = {(x.a, x.b) for x in candidates(keyed).collect()}
    groups = spark.createDataFrame([(i, 0) for i in range(40)] + [(i, 40) for i in range(40, 60)], "node bigint, root bigint")
    root = {i: 0 if i < 40 else 40 if i < 60 else i for i in range(100)}
    got = [(x.a, x.b) for x in rest(keyed, groups).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(100) for b in range(a + 1, 100) if root[a] != root[b]}
    assert (61, 62) in got and (61, 62) not in met
    assert not rest(keyed.where("row < 40"), groups).count()


def test_links_apart_from_the_first_rows_join(spark):
    """Chains of texts, each near the next and far from those beyond: none is left out because a bucket's first row is too far from it."""
    r = random.Random(11)
    rows = []
    for c in range(30):
        words = [f"c{c}w{i}" for i in range(400)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = words[18:] + [f"x{r.randrange(10**9)}" for _ in range(18)]
    order = list(range(len(rows)))
    r.shuffle(order)
    named = [(order[i], t) for i, t in rows]
    got = {x.row for x in near_copies(spark.createDataFrame(named, "doc_id bigint, text string").selectExpr("doc_id AS row", "doc_id", "text"), row="row").collect()}
    assert got == brute_near_copies(named)


def test_a_group_of_texts_that_nearly_link_makes_no_row_for_each_pair(spark, monkeypatch):
    """250 texts on one core, far enough apart that few link: rows grow with the texts' 20 buckets, not with the 31,125 pairs."""
    r = random.Random(5)
    core, rows = [f"core{i}" for i in range(300)], []
    for _ in range(250):
        rows.append((len(rows), planted(r, core, 0.023)))
    docs = spark.createDataFrame(rows, "row bigint, text string").selectExpr("row", "row AS doc_id", "text").repartition(4)
    made, real = [], type(docs).mapInArrow

    def counted(df, *args, **kwargs):
        made.append(df.count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    got = {x.row for x in near_copies(docs, row="row").collect()}
    assert got == brute_near_copies(rows) and 0 < len(got) < 200
    # A row is hashed twice, meets two others in each bucket at most, and is in one tile of each bucket; then links go to their components.
    assert sum(made) < 70 * len(rows)


def test_tiles_join_what_all_pairs_join(spark):
    """Links of tiles, in one block or many, against all pairs: chains that groups cut through, buckets with one large group, rows in two buckets, long sets."""
    r = random.Random(3)
    at, sets, keys = 0, [], []
    for i in range(300):
        at += r.choice([5, 5, 5, 60])  # 95 or 40 of 100 in common with the last
        sets.append(list(range(at, at + (100 if i % 90 else 900))))
        keys.append([7] if i < 150 else [7, 8] if i < 160 else [8] if i < 280 else [100 + i // 2])
    for i in range(280, 300):
        sets[i] = sets[i - i % 2]  # buckets of two equal rows
    keyed = spark.createDataFrame([(i, i, k) for i, k in enumerate(keys)], "row bigint, id bigint, keys array<bigint>")
    hashed = spark.createDataFrame(list(enumerate(sets)), "row bigint, hashes array<bigint>").repartition(3)
    groups = spark.createDataFrame([(i, 20) for i in range(20, 120)] + [(i, 130) for i in range(130, 140)], "node bigint, root bigint")
    joined = lambda links: {tuple(x) for x in connected_components(links).collect()}
    expected = joined(module.verified(rest(keyed, groups), hashed))
    assert len(expected) > 100
    for limits in ({}, {"block_rows": 8}, {"block_shingles": 1000}, {"block_rows": 1, "block_shingles": 1}):
        assert joined(module.rest_links(keyed, groups, hashed, **limits)) == expected, limits
    assert not module.rest_links(keyed.where("row between 20 and 119"), groups, hashed).count()


def test_overlaps_of_sets_by_counting(spark):
    """Hashes that one, few, many or all of the sets have, against intersections."""
    r = random.Random(9)
    for count, least in ((2, 0.8), (3, 0.5), (70, 0.6), (400, 0.7)):
        sets = []
        for i in range(count):
            mine = set(range(40)) | {10**6 + i} | {50 + i % 3, 60 + i % 20, 100 + i % 150} | {r.randrange(-(2**63), 2**63) for _ in range(r.choice([0, 5, 30]))}
            sets.append(sorted(mine - {r.randrange(40)}) if i % 50 else [*range(3000)])
        roots = np.array([r.randrange(count) for _ in sets])
        a, b = module.overlapping(np.array([x for s in sets for x in s]), np.array([len(s) for s in sets]), roots, least)
        near = lambda x, y: len(x & y) >= least * len(x | y) - 1e-9
        plain = [set(s) for s in sets]
        expected = {(i, j) for i in range(count) for j in range(i + 1, count) if roots[i] != roots[j] and near(plain[i], plain[j])}
        got = list(zip(a.tolist(), b.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == expected
