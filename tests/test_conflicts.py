import random

import duckdb

from sparkwell.plans.registry import ORACLES, QUERIES


def test_conflicts_equal_sql_beside_letters_of_any_script(spark, tmp_path):
    """A letter that is not of a-z ends a word for negations as it does for keywords, and a capital I with a dot is an i."""
    r = random.Random(5)
    words = ["bridge", "river", "opens", "evening", "morning", "bridge", "river", "opens", "evening", "morning", "no", "not", "isn't", "cannot", "never", "bridge", "river", "opens", "NİGHT", "İSN'T", "Kelvin", "noítaga", "noñmiie", "éno", "x_no", "no_x", "no1", "don't日", "日none", "nó", "٠not", "NO"]
    rows = [(c, t, "".join(r.choice(words) + r.choice(["", " ", " ", " ", "é", ".", "́", "ß", "Я", "\n", "–"]) for _ in range(r.randint(4, 30)))) for c in range(300) for t in range(4)]
    rows += [(300, 0, "bridge river opens"), (300, 1, "bridge river opens noítaga"), (301, 0, "bridge river NİGHT"), (301, 1, "no bridge river night"), (302, 0, None), (302, 1, "not")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(x) for x in QUERIES["conflicts"](spark, str(tmp_path)).collect())
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = sorted(sql.execute(ORACLES["conflicts"]).fetchall())
    assert got == want and {300, 301} <= {x[0] for x in got} and len(got) > 20
