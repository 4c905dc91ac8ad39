"""Alignment against a version that encodes whole texts and compares all byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkwell.llm import alignment
from sparkwell.llm.alignment import alignments, default_vocabularies, encoder

TEXTS = [
    "The cat sat on the mat, twice: once in 2023.", "The cat sat on the mat, twice: once in 2023.", "", None, " ", "\n", "  leading and  double  blanks \n\n and ends\n",
    "naïve façade — “quotes” … €5,000.50\tTab\r\nCR <|endoftext|> </s> <s> <0x0A>", "with ▁ mark", "日本語のテキスト と 한국어 😀👩‍👩‍👧 é", "x" * 3000, "a b　 c\x0b d\x1c e \x00 f",
    "it's we'll THEY'RE I'd'\n's", "_.,  ²., __.\n\t\n tab\t end", "\nbegins with a line end", "ends in a blank ", "." * 50 + " " * 70 + "\n" * 9 + "end",
]


def brute(rows):
    both = encoder(*default_vocabularies())
    tokens, found = {}, {}
    holders: Counter = Counter()
    for n, (_, text) in enumerate(rows):
        if not text:
            continue
        a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        spelled = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
        if any(b"".join(x) != (" " + text).encode() for x in spelled):
            continue
        ranges = []
        for side in spelled:
            ends = np.cumsum([len(x) for x in side]).tolist()
            ranges.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(i, j) for i, x in zip(a, ranges[0], strict=True) for j, y in zip(b, ranges[1], strict=True) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({y for _, y in ranges[0]} & {y for _, y in ranges[1]})
        groups, before = [], 0
        for c in cuts:
            mine = [",".join(str(i) for i, (s, e) in zip(ids, r, strict=True) if before <= s and e <= c) for ids, r in zip((a, b), ranges, strict=True)]
            groups.append("|".join(mine))
            before = c
        tokens[n] = (len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest())
        found[n] = links
        holders.update(set(links))
    most: dict = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    out = []
    for n, (name, _) in enumerate(rows):
        if n not in tokens:
            out.append((name, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = found[n]
        n_a, n_b, cuts, sha = tokens[n]
        out.append((name, n_a, n_b, cuts, len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), sha))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("batch_bytes", [1 << 21, 200])
def test_odd_texts(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch_bytes)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (3, TEXTS[0])]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id int, text string, batch string, pairs int").repartition(3)
    assert as_rows(alignments(docs)) == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    assert as_rows(alignments(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_units_or_whole_texts():
    both = encoder(*default_vocabularies())
    assert both.by_unit
    texts = [t for t in TEXTS if t]
    by_unit = [[x.tolist() for x in both.tokens(p)] for p in both.places(texts)]
    both.by_unit = False
    both.clear()
    whole = [[x.tolist() for x in both.tokens(p)] for p in both.places(texts)]
    both.by_unit = True
    both.clear()
    sound = [i for i, t in enumerate(texts) if "▁" not in t]
    assert [by_unit[i] for i in sound] == [whole[i] for i in sound]


def test_long_text_and_empty_table(spark):
    long = "word, another Word 12 " * 50_000
    got = alignments(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got.n_a == len(encoder(*default_vocabularies()).a.encode(" " + long, add_special_tokens=False).ids) and got.n_best > 0
    assert alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0
