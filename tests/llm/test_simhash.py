import random
import re

import numpy as np
import xxhash

from sparkwell.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min(groups[find(i)]) for i in range(len(ids))]


def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \t", "One", "one two", "ÄPFEL Äpfel x y", "nbsp joins words here now"]
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([5, 80, 400]))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            out.append("  ".join(copy))
    return out + out[:12]


def test_fingerprint_and_components(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = {r.doc_id: r for r in simhash.components(docs).collect()}
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    assert [got[i].fp % 2**64 for i in range(len(rows))] == fps
    assert [got[i].component_id for i in range(len(rows))] == brute_components(range(len(rows)), fps)


def test_large_groups_are_dealt_to_tiles(spark):
    r = np.random.default_rng(5)
    base = int(r.integers(0, 2**47))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(0, 47, (400, 3))}
    fps |= {int(x) for x in r.integers(0, 2**47, 600)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), tile=40)
    got = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    want = brute_components(fps, fps)
    assert [got.get(f, f) for f in fps] == want


def test_links_grow_with_rows_not_pairs(spark):
    fps = [(1 << a) | (1 << b) for a in range(30) for b in range(a)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    assert edges.count() < 4 * len(fps)


def test_skips_tiles_by_count():
    x = np.array([0, 1, 3, 2**40 - 1], np.uint64)
    pairs = {tuple(sorted((int(a), int(b)))) for i, j in simhash.near_pairs(x, None, 2, tile=1) for a, b in zip(i, j)}
    assert pairs == {(0, 1), (0, 2), (1, 2)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.components(docs).count() == 0
