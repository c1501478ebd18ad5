"""Stores against what a plain dictionary would hold."""

from ledgermill.operators import store

SCHEMA = "id string, importe long, clave string, snapshot_id string, vigente boolean"


def state(df):
    return {r.id: (r.importe, r.snapshot_id, r.vigente) for r in df.collect()}


def test_snapshots_replace_and_retire(spark, tmp_path):
    root = str(tmp_path / "store")
    put = lambda rows, name: store.switch(store.with_snapshot(store.current(spark, root, SCHEMA), spark.createDataFrame(rows, "id string, importe long, clave string"), name), root)
    assert state(store.current(spark, root, SCHEMA)) == {}
    put([("a", 1, "x"), ("b", 2, "y")], "s1")
    put([("b", 3, "y"), ("c", 4, "z")], "s2")
    want = {"a": (1, "s1", False), "b": (3, "s2", True), "c": (4, "s2", True)}
    assert state(store.current(spark, root, SCHEMA)) == want
    put([("b", 3, "y"), ("c", 4, "z")], "s2")  # once more
    assert state(store.current(spark, root, SCHEMA)) == want
    assert tuple(store.snapshot_problems(store.current(spark, root, SCHEMA), "s2", 2, "clave").first()) == (2, 2, 2, True)
    assert store.snapshot_problems(store.current(spark, root, SCHEMA), "s2", 3, "clave").first().ok is False
    put([], "s3")
    assert {v[2] for v in state(store.current(spark, root, SCHEMA)).values()} == {False}


def test_half_written_states_are_passed_over(spark, tmp_path):
    root = str(tmp_path / "store")
    whole = spark.createDataFrame([("a", 1, "x", "s1", True)], SCHEMA)
    assert store.switch(whole, root) == 1
    assert store.switch(whole.limit(0), root) == 2
    (tmp_path / "store" / "v=2" / "_SUCCESS").unlink()  # as if the job had been lost
    assert state(store.current(spark, root, SCHEMA)) == {"a": (1, "s1", True)}
    assert store.switch(whole, root) == 2 and store.versions(spark, root) == [1, 2]


def test_uploads(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2")], "file_id string, sha256 string")
    batch = spark.createDataFrame([("a", "1", 1), ("a", "9", 2), ("c", "3", 3), ("c", "3", 4), ("c", "4", 5), ("d", "5", 7), ("d", "6", 6)], "file_id string, sha256 string, seq long")
    classes = store.uploads(have, batch)
    assert {r.seq: r.clase for r in classes.collect()} == {1: "duplicado", 2: "conflicto", 3: "nuevo", 4: "duplicado", 5: "conflicto", 6: "nuevo", 7: "conflicto"}
    assert sorted(map(tuple, store.accepted(have, classes).collect())) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "6")]
    assert {r.clase for r in store.uploads(store.accepted(have, classes), classes.where("clase = 'nuevo'").drop("clase")).collect()} == {"duplicado"}
    assert store.uploads(have, batch.limit(0)).count() == 0
