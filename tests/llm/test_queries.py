"""The registered queries themselves, on small tables that hold odd rows, against brute-force versions."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from sparkwell.llm import chat, packing, simhash, token_output, tokens
from sparkwell.llm import url_filter as uf

from .test_decontaminate import problem
from .test_simhash import brute_components, brute_fingerprint
from .test_tokens import ODD, library  # noqa: F401


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(r.choice(words) for _ in range(20_000))
    texts = [*ODD, long, long + " end", *(" ".join(r.choice(words) for _ in range(r.choice([3, 30, 300]))) for _ in range(30))]
    out = [(3 * i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)]
    out += [out[5], out[5], (out[7][0], "another text of that id", "en", "s", 1, "clash"), (None, "no id at all", None, None, None, None), (None, long, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, folder, rows, library):  # noqa: F811
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.ids_crc32, x.start) for x in entry.queries()["op2_simple8b_tokens"](spark, folder).collect())
    want = sorted((-1 if d is None else d, len(ids := [*library(t), 2]), crc(ids)) for d, t, *_ in rows)
    assert [x[:3] for x in got] == want
    at = 0
    for d, n, _, start in sorted(got, key=lambda x: x[3]):
        assert start == at
        at += n
    order = [x[0] for x in sorted(got, key=lambda x: x[3])]
    assert order == sorted(order)


def test_op2_parts_the_rows_of_one_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else 4, f"text {i}") for i in range(2000)], "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows in one task
    try:
        shards = token_output.encode_documents(docs).select("shard", "n_ids").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({s.shard for s in shards}) >= 3


def test_op3(spark, folder, rows, library):  # noqa: F811
    lengths = [len(library(t)) for _, t, *_ in rows]
    got = {x.context_limit: x for x in entry.queries()["op3_length_histogram"](spark, folder).collect()}
    assert set(got) == set(lengths)
    for limit, x in got.items():
        assert (x.n_docs, x.docs_over, x.tokens_kept) == (lengths.count(limit), sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))


def test_op4(spark, folder, rows, library):  # noqa: F811
    got = entry.queries()["op4_minimum_slack_packing"](spark, folder).collect()
    placed = {}
    for p in got:
        placed.setdefault(p.sequence_id, []).append((p.offset, p.length))
    short = []
    for ps in placed.values():
        ends = [a + n for a, n in sorted(ps)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(ps)] and ends[-1] <= packing.SEQUENCE
        short += [ends[-1]] * (ends[-1] < packing.SEQUENCE)
    assert all(n & (n - 1) == 0 for n in short)
    want = []
    by_tokens = {}
    for d, t, *_ in rows:
        ids = [*library(t), 1]
        by_tokens.setdefault((d, len(ids)), []).append(ids)
        want += [(str(d), len(ids), i) for i in range(len(ids))]
    assert sorted((str(p.doc_id), p.doc_tokens, i) for p in got for i in range(p.start, p.start + p.length)) == sorted(want)
    assert all(p.ids_crc32 in {crc(ids[p.start : p.start + p.length]) for ids in by_tokens[p.doc_id, p.doc_tokens]} for p in got)


def test_op4_plans_join_alike(spark):
    remainders = spark.createDataFrame([(i, 5 if i % 3 else 7, i) for i in range(9000)], "row bigint, rest bigint, nth bigint")
    segments = [(5, 0, 4100, 0, 3, 0, 0, 1, 0), (5, 4100, 9000, 0, 5, 0, 9, 2, 0), (7, 10, 8200, 0, 7, 3, 4, 1, 0), (5, 0, 9000, 3, 2, 0, 1, 1, 3)]
    placed = spark.createDataFrame(segments, packing.SEGMENTS)
    both = [sorted(map(tuple, packing.joined_plan(remainders, placed, small).select("row", "rest", "nth", "lo", "skip", "first_sequence").collect())) for small in (True, False)]
    assert both[0] == both[1] and len(both[0]) > 9000


def test_op7(spark, tmp_path):
    pages = [(1, "http://a.net/es/1", ""), (2, "http://b.org/x", '<a href="http://a.net/">'), (3, "http://www.example.com/en/x", ""), (4, None, None), (4, None, None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in entry.queries()["op7_link_trust"](spark, str(tmp_path)).collect())
    assert got[:3] == [(1, "a.net", "/es/1", "net/es/", "block"), (2, "b.org", "/x", None, "block"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert got[3:] == [(4, "", "", None, "allow")] * 2 and len(uf.RULES) == 5


def test_op8(spark, tmp_path):
    items = [(i, problem(i, ["Anna", "Bob"], [3, 4, 5])) for i in range(3)]
    docs = [(10 * k + i, f"Before it. {problem(i, ['Zoe', 'Ivan'], [11, 12, 13])} After it." if k else "nothing of the kind " * 30) for k in range(2) for i in range(3)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in entry.queries()["op8_template_matches"](spark, str(tmp_path)).collect()}
    assert got == {(10 + i, i) for i in range(3)}


def test_op10(spark, folder, rows):
    got = entry.queries()["op10_simhash_components"](spark, folder).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    ids = [1 << 40 if d is None else d for d, *_ in rows]
    roots = brute_components(ids, fps)
    want = sorted((i, f"{f:016x}", r) for i, f, r in zip(ids, fps, roots, strict=True))
    assert sorted((1 << 40 if x.doc_id is None else x.doc_id, x.fingerprint, 1 << 40 if x.component_id is None else x.component_id) for x in got) == want


def test_docstrings_and_folders():
    assert all(f.__doc__ for f in (simhash.op10_simhash_components, token_output.op2_simple8b_tokens, chat.op5_chat_format, packing.op4_minimum_slack_packing, uf.op7_link_trust))
    assert tokens.REMEMBERED > 0
