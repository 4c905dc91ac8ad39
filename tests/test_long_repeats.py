"""No pattern may take a stack frame for each repeat: rows of 200,000 equal things in one text."""

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import safety, scoring, understand
from sparkwell.functions import text as tx
from sparkwell.operators.chunking import chunks, running, sections

N = 200_000
REPEATS = {
    "line ends": "\n" * N, "dos line ends": "\r\n" * N, "numbers": "1,2." * N, "names": "Anna Berg " * N, "initials": "J. " * N, "hyphens": "a-" * N, "blanks": " " * N,
    "at signs": "a@" * N, "dots": "." * N, "quotes": "'" * N, "brackets": "[inst]" * N, "urls": "a/b?" * N, "digits": "123-" * N, "letters": "x" * N, "wide": "ｘ" * N,
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeats") / "t")
    rows = [(i, name, f"start {body} end") for i, (name, body) in enumerate(REPEATS.items())]
    spark.createDataFrame(rows, "doc_id int, name string, text string").repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_sections_and_chunks(table):
    got = {r.doc_id: r.n for r in sections(table).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(got) == len(REPEATS) and got[0] == got[1] == 2 and got[2] == 1
    assert chunks(sections(table)).agg(F.max("end_offset")).first()[0] > N


def test_rules(table):
    text = F.col("text")
    columns = [
        tx.words("text"), tx.stems("text"), tx.unicode_stems("text"), tx.long_words("text"), tx.keywords("text"), tx.collapsed("text"), tx.trimmed("text"), tx.summary("text", 80), tx.snake(text),
        safety.without_pii(text), safety.without_embedded(text), *[safety.matched(text, p) for p in (*safety.BLOCKS.values(), safety.EMBEDDED)],
        text.rlike(scoring.DIRECT), text.rlike(scoring.EVASION), F.lower(text).rlike(scoring.NEGATION), understand.rewrite(text), understand.expand(text), understand.intent(text),
    ]
    assert table.select(*[F.hash(F.to_json(F.struct(c.alias("c")))) for c in columns]).distinct().count() > 1


def test_running_sums(spark):
    for n in (0, 1, 511, 512, 513, 5000):
        values = [(i * 7) % 13 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running(F.col("v")).alias("s")).first().s
        assert got == [sum(values[:i]) for i in range(n)] or n == 0 and got == []


def test_many_sections_are_placed(spark):
    text = "\n\n".join(f"part {i}" for i in range(20_000))
    rows = sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("text", "start_offset").collect()
    assert len(rows) == 20_000 and all(text[r.start_offset :].startswith(r.text) for r in rows[::997])


def test_mails_after_mails(spark):
    texts = ["a@b.com_x@c.org", "x.y@z.de, b@c.org", "..a@b.co", "@b.com a@", "a@b@c.com"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(safety.without_pii(F.col("t")).redacted.alias("r")).collect()
    import re

    assert [r.r for r in got] == [re.sub(safety.PII["email"], "[REDACTED_EMAIL]", t) for t in texts]
