import random
import zlib

import numpy as np
import pytest

from sparkwell.llm import packing, simple8b, token_counts, token_output, tokens

ODD = [
    None, "", " ", "The cat's café, it'll don't\tΣΊΣΥΦΟΣ σς İstanbul ǅ 12,345.67!", "<|endoftext|> a<|startoftext|>b", "Áé  nbsp wide\x1cfs\x85nel",
    "漢字かな交じり文 한국어 العربية हिन्दी", "word. word, WORD.. ,word ...", "naïve—dash “quotes” ½ ² ➀ 😀👍🏽", "x" * 3000, "a\r\nb\x0bc\x0cd", "ﬁ ﬂ ß ẞ ﷺ",
]


def texts():
    r = random.Random(1)
    syllables = ["the", "ing", "ön", "é", "ción", "ER", "st", "'", ".", ",", "7", "-"]
    return ODD + ["".join(r.choice(syllables) + r.choice(["", "", " ", "\n"]) for _ in range(r.choice([3, 40, 900]))) for _ in range(60)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_same_ids_as_the_library(library):
    mine = tokens.WordEncoder(tokens.default_vocabulary())
    for t in texts():
        assert np.frombuffer(mine.encode(t), mine.kind).tolist() == library(t), t


def test_words_are_forgotten_in_turn(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    mine = tokens.WordEncoder(tokens.default_vocabulary())
    for t in texts():
        assert np.frombuffer(mine.encode(t), mine.kind).tolist() == library(t)


def test_simple8b():
    r = np.random.default_rng(1)
    for n in (0, 1, 59, 61, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 49408, 1 << 33, 1 << 63):
            values = r.integers(0, top, n, dtype=np.uint64)
            if top == 1 << 63:
                values[::3] = np.uint64(2**64 - 1) - values[::3] % np.uint64(9)
                values[1::3] %= np.uint64(100)
            words, first = simple8b.encode(values)
            assert (simple8b.decode(words, first, n) == values).all()
            assert len(first) == -(-n // simple8b.BLOCK)


def documents(spark):
    rows = [(7 * i - 3, t, "clash") for i, t in enumerate(texts())]
    return rows + rows[:3], spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, n_tokens string")


def test_files_round_trip(spark, library, monkeypatch, tmp_path):
    rows, docs = documents(spark)
    token_output.write_files(docs, str(tmp_path / "ids"))
    got = sorted(tuple(r) for r in token_output.read_documents(spark.read.parquet(str(tmp_path / "ids"))).collect())
    at, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library(t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_output.read_documents(token_output.encode_documents(docs.limit(0))).count() == 0


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, library, size):
    rows, docs = documents(spark)
    got = packing.pack(docs, size=size, digest=True).collect()
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for d, t in {(d, t) for d, t, _ in rows}:
        ids = [*library(t), 1]
        times = sum(1 for r in rows if r[0] == d)
        assert sum(p.length for p in pieces[d]) == len(ids) * times
        for p in pieces[d]:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sorted(i for p in pieces[d] for i in range(p.start, p.start + p.length)) == sorted([*range(len(ids))] * times)
    short = []
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        if at < size:
            short.append(at)
        assert at <= size
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    assert packing.pack(docs.limit(0)).count() == 0


def test_fullest_is_the_best_sum():
    from itertools import product

    r = random.Random(4)
    for _ in range(60):
        counts = {r.randrange(1, 15): r.randrange(1, 4) for _ in range(4)}
        longest = max(counts)
        room = r.randrange(longest, 40)
        kinds = list(counts)
        sums = [sum(n * k for n, k in zip(kinds, ks)) for ks in product(*[range(counts[n] + 1) for n in kinds]) if ks[kinds.index(longest)]]
        best = packing.fullest(counts, room)
        assert sum(n * k for n, k in best.items()) == max(x for x in sums if x <= room)
        assert all(k <= counts[n] for n, k in best.items())


def test_length_report(spark, library):
    rows, docs = documents(spark)
    lengths = [len(library(t)) for _, t, _ in rows]
    report = token_counts.length_report(token_counts.encoded_lengths(docs), band=8)
    got = {r.context_limit: r for r in report.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r.n_docs, r.docs_over, r.all_tokens) == (lengths.count(limit), sum(n > limit for n in lengths), sum(lengths))
        assert r.tokens_kept == sum(min(n, limit) for n in lengths) and r.tokens_cut == sum(lengths) - r.tokens_kept
    for limit in (0, 7, 100, 10**6):
        assert token_counts.truncated_total(report, limit).first()[0] == sum(min(n, limit) for n in lengths)
    assert token_counts.quantile(report, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.length_report(token_counts.encoded_lengths(docs.limit(0))).count() == 0
