"""Host rules against plain Python and the second engine."""

import re
from collections import Counter

import duckdb
import numpy as np

from sparkwell.llm import quality_rules
from sparkwell.llm.quality_rules import judge, prior, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(covered)


def brute(rows, limit=0.5):
    judged = []
    for name, text, host in rows:
        w, c, s, n, d, r = f = brute_figures(text)
        fails = [w < 20, 100 * r > 30 * w, 10 * s > w, 10 * d > 3 * n, c < 3 * w or c > 10 * w]
        judged.append((name, host, f, fails))
    hosts = Counter(h for _, h, _, _ in judged)
    out = set()
    for k in range(5):
        failed = Counter(h for _, h, _, x in judged if x[k])
        total, n = sum(failed.values()), len(judged)
        p = total / n
        room, weight = n - sum(v * v for v in hosts.values()) / n - (len(hosts) - 1), 0.0
        if len(hosts) > 1 and 0 < p < 1 and room > 0:
            spread = sum(v * (failed[h] / v - p) ** 2 for h, v in hosts.items())
            weight = min(max((spread - p * (1 - p) * (len(hosts) - 1)) / (p * (1 - p) * room), 0), 1)
        for h, v in hosts.items():
            if weight == 0:
                rate = p
            else:
                before = 1 / weight - 1  # documents that the prior is worth
                rate = (failed[h] + before * p) / (v + before)
            if rate > limit:
                out.add(h)
    return sorted(((name, *f, x[0] or x[1], not (x[0] or x[1]) and h not in out, h, h in out) for name, h, f, x in judged), key=str)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def sentence(rng, n):
    return " ".join(f"word{rng.integers(500)}" for _ in range(n))


def test_hosts_fall_and_stay(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for h in range(30):
        for i in range(40):
            bad = rng.random() < (0.9 if h < 3 else 0.05)
            rows.append((len(rows), sentence(rng, 5 if bad else 60), f"host{h}"))
    rows += [(9000, sentence(rng, 50) + "\n" + sentence(rng, 50), "new"), (9001, "too short", "alone")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id int, text string, source string, lang string")
    got = judge(docs)
    assert as_rows(got) == brute(rows)
    rejected = {r.host for r in got.where("host_rejected").select("host").collect()}
    assert {"host0", "host1", "host2"} <= rejected and not any(f"host{h}" in rejected for h in range(3, 30)) and "new" not in rejected
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    mine = judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")
    assert as_rows(mine) == sorted(con.sql(quality_rules.ORACLE).fetchall(), key=str)


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine ten"
    texts = [None, "", " \n\t\x0b\x0c\r ", "a\xa0b c\x1cd e\x85f", f"{line}\n{line}\n{line}\n \n\n", f"{line} {line} {line}", "x " * 100, "#*$%&|<> " * 30, "é" * 50_000, "ab\r\nab\r\nab", "w " * 7, " ".join(map(str, range(30))) * 2]
    rows = [(i if i % 3 else None, t, (None, "", "=", "-", "h")[i % 5]) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id int, text string, source string, n_words int, host string").repartition(4)
    assert as_rows(judge(docs)) == brute(rows)
    assert judge(docs.limit(0)).count() == 0


def test_whole_documents_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "BATCH_BYTES", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert as_rows(judge(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])


def test_hash_collisions_do_no_harm(monkeypatch):
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 3, 400), np.array([150, 0, 7, 8, 235])
    want = [brute_figures(" ".join(map(str, part)))[5] for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert repeated_words(ids, sizes).tolist() == want
    wide = ids.astype(np.int64) * (1 << 62)  # numbers that wrap: most windows share a hash
    assert repeated_words(wide, sizes).tolist() == [brute_figures(" ".join(map(str, part)))[5] for part in np.split(wide, np.cumsum(sizes)[:-1])]


def test_prior():
    assert prior(0, None, None, None, None) == (0.0, 0.0)
    assert prior(1, 10, 100, 5, 2.5) == (0.5, 0.0)
    assert prior(2, 20, 200, 10, 10.0)[1] == 1.0  # one host fails always, the other never
    assert prior(2, 20, 200, 10, 5.0)[1] == 0.0  # no more spread than chance
