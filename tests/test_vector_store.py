"""A vector store on disk: what is replaced, refused, repeated, compacted and read meanwhile."""

import pytest

from sparkwell.operators.providers import FrameStore
from sparkwell.operators.vector_store import FolderStore

ROW = "id int, v array<double>, kind string"


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame(rows, schema)


def held(df):
    return {r.id: (list(r.v), r.kind) for r in df.collect()}


def test_deltas_and_compaction(spark, tmp_path):
    store, plain = FolderStore(spark, str(tmp_path / "s")), FrameStore()
    with pytest.raises(ValueError):
        store.rows()
    parts = [[(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], [(2, [1.0, 1.0], "c"), (3, [0.5, 0.1], "a")], [(1, [0.0, -1.0], "d"), (1, [0.0, -2.0], "e"), (4, [2.0, 0.0], None)]]
    for i, part in enumerate(parts):
        df = frame(spark, part).coalesce(1)
        assert store.insert(df, f"t{i}")
        plain.insert(df)
        assert not store.insert(df, f"t{i}")
    want = held(plain.rows)
    assert held(store.rows()) == want and want[1] == ([0.0, -2.0], "e")
    before = store.rows()
    store.compact()
    assert held(store.rows()) == want and store.manifest()["deltas"] == [] and not store.insert(frame(spark, parts[0]), "t0")
    store.insert(frame(spark, [(3, [9.0, 9.0], "z"), (5, [1.0, 2.0], "y")]))
    assert held(before) == want  # a frame that was opened before reads what was there
    assert held(store.rows()) == want | {3: ([9.0, 9.0], "z"), 5: ([1.0, 2.0], "y")}
    store.compact()
    store.vacuum()
    assert held(FolderStore(spark, str(tmp_path / "s")).rows()) == want | {3: ([9.0, 9.0], "z"), 5: ([1.0, 2.0], "y")}
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 1
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, qv array<double>")
    plain.insert(frame(spark, [(3, [9.0, 9.0], "z"), (5, [1.0, 2.0], "y")]))
    got, expected = ([tuple(r) for r in s.search(queries, 3).orderBy("rank").collect()] for s in (store, plain))
    assert got == expected and [r.id for r in store.search(queries, 5, {"kind": None}).collect()] == [4]
    store.clear()
    with pytest.raises(ValueError):
        store.search(queries)


def test_bad_rows_leave_nothing(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path / "s"))
    assert not store.insert(frame(spark, []))
    store.insert(frame(spark, [(1, [1.0, 2.0], "a")]))
    for bad in ([(2, [1.0], "a")], [(None, [1.0, 2.0], "a")], [(2, None, "a")], [(2, [1.0, float("nan")], "a")], [(2, [1.0, None], "a")], [(3, [1.0, 2.0], "a"), (4, [1.0, 2.0, 3.0], "a")]):
        with pytest.raises(ValueError):
            store.insert(frame(spark, bad))
    assert held(store.rows()) == {1: ([1.0, 2.0], "a")} and len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 1


def test_a_lost_insert_is_not_seen(spark, tmp_path, monkeypatch):
    store = FolderStore(spark, str(tmp_path / "s"))
    store.insert(frame(spark, [(1, [1.0], "a")]), "one")
    with monkeypatch.context() as m:
        m.setattr(FolderStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            store.insert(frame(spark, [(2, [2.0], "b")]), "two")
        with pytest.raises(RuntimeError):
            store.compact()
    assert held(store.rows()) == {1: ([1.0], "a")}
    assert store.insert(frame(spark, [(2, [2.0], "b")]), "two")
    store.vacuum()
    assert held(store.rows()) == {1: ([1.0], "a"), 2: ([2.0], "b")}
