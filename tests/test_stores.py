"""Stores of byte objects and tables: what is saved is what is opened, and only what is new is written."""

import os

import pytest


def test_byte_store_round_trip(spark, tmp_path):
    from palimpsest.catalog import Catalog, Conflict
    from palimpsest.objects import ByteStore

    path, files = str(tmp_path / "store"), tmp_path / "files"
    files.mkdir()
    payload = bytes(range(256)) * 300
    (files / "one.bin").write_bytes(payload)
    (files / "two.bin").write_bytes(payload[1000:] + b"tail")
    (files / "none.bin").write_bytes(b"")
    b = ByteStore(spark)
    assert b.create_files(str(files), 1024) == 2  # the scan passes over the empty file
    b.create("none.bin", b"")
    assert b.read("one.bin") == payload and b.read("two.bin", 5, 20) == payload[1005:1025] and b.read("none.bin") == b""
    for i in range(3):
        b.insert("one.bin", 100 * i, b"new" * i)
    b.save(path)
    parts = set(os.listdir(path))
    b.append("two.bin", b"more")
    b.save(path)
    assert parts < set(os.listdir(path)) and len(set(os.listdir(path)) - parts) <= 2
    c = ByteStore.open(spark, path)
    assert c.sizes == b.sizes and c.read("two.bin") == payload[1000:] + b"tailmore" and c.read("one.bin", version=0) == payload
    assert ByteStore.open(spark, path, 0).read("two.bin") == payload[1000:] + b"tail"
    assert c.range_history("one.bin", 0, 50) == b.range_history("one.bin", 0, 50)
    with pytest.raises(Conflict):
        Catalog(path).commit(0, {})
    with pytest.raises(ValueError):
        b.create_files(str(files))


def test_table_round_trip(spark, tmp_path):
    from palimpsest.catalog import StoreError
    from palimpsest.objects import ByteStore
    from palimpsest.table import Table

    path = str(tmp_path / "table")
    t = Table(spark.createDataFrame([(i, "ab"[i % 2], i * 1.5) for i in range(10)], "id int, c string, x double"))
    t.relabel_lazy("c", {"a": "z"})
    t.add_range("x", 2, 5, 1.0)
    t.save(path)
    bases = [f for f in os.listdir(path) if f.startswith("base-")]
    t.drop_class("c", "b")
    t.save(path)
    assert [f for f in os.listdir(path) if f.startswith("base-")] == bases
    t.map_column("x", lambda c: c * 2)
    t.compact()
    t.relabel_lazy("c", {"z": "q"})
    t.save(path)
    o = Table.open(spark, path)
    assert o.versions == t.versions and o.columns == t.columns
    for v in range(t.versions):
        assert sorted(o.rows(v).collect()) == sorted(t.rows(v).collect()), v
    assert o.touched_versions(0, "c") == t.touched_versions(0, "c")
    o.drop_class("c", "q")
    assert o.num_rows() == 0 and Table.open(spark, path, 0).num_rows() == 10
    with pytest.raises(StoreError):
        ByteStore.open(spark, path)


def test_lock_belongs_to_its_holder(tmp_path):
    from palimpsest.catalog import Catalog, Locked

    a, b = Catalog(str(tmp_path)), Catalog(str(tmp_path))
    a.lock()
    with pytest.raises(Locked):
        b.unlock()
    with pytest.raises(Locked):
        b.lock(2)
    b.unlock(force=True)
    b.lock()
    b.unlock()
    assert not a.lock_held()


def test_object_reports_and_frame_cuts(spark):
    from palimpsest.objects import ByteStore

    data = bytes((i * 7) % 251 for i in range(9000))
    b = ByteStore(spark)
    b.create("v", data, 512)
    b.insert("v", 4000, b"\xff" * 10)
    new = data[:4000] + b"\xff" * 10 + data[4000:]
    for lo, n in ((0, 9010), (3, 700), (3995, 8), (9009, 50)):
        part = new[lo : lo + n]
        assert b.aggregate("v", lo, n) == (min(part), max(part), sum(part))
    assert b.aggregate("v", 100, 50, 0) == (min(data[100:150]), max(data[100:150]), sum(data[100:150])) and b.aggregate("v", 99999, 5) is None
    counts = {r["version"]: r for r in b.extent_counts("v").collect()}
    assert counts[0]["fresh"] == counts[0]["extents"] and 0 < counts[1]["fresh"] <= 2
    frames = spark.createDataFrame([(i, i * 901, 901, i % 3 == 0) for i in range(10)], "idx int, start long, nbytes long, idr boolean")
    with pytest.raises(ValueError):
        b.cut_frames("v", frames, 3, 5)
    b.cut_frames("v", frames, 3, 6)
    assert b.read("v") == new[: 3 * 901] + new[6 * 901 :]
    b.create("w", new[:9010])
    b.cut_frames("w", frames, 9, 10)
    assert b.read("w") == new[: 9 * 901]


def test_training_rounds_round_trip(spark):
    from palimpsest.functions import tokens as K

    texts = ["the cat sat on the mat", "the cat sat on the hat " * 3, "", None, "x" * 200 + " é cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sizes, counts = [], []
    for rounds in (0, 1, 3):
        known = K.train(df, "t", 5, 2, rounds)
        ids = K.tokenize(df, "t", known)
        sizes.append(known.count())
        counts.append(sum(len(r["tokens"]) for r in ids.collect()))
        back = {r["i"]: bytes(r["text"]).decode() for r in K.detokenize(ids, "i", "tokens", known).collect()}
        assert back == {i: t or "" for i, t in enumerate(texts)}
    assert sizes[0] < sizes[1] < sizes[2] <= sizes[0] + 15 and counts[0] > counts[1] > counts[2]
    assert K.ruled_out(known, "the dog sat") and not K.ruled_out(known, "he cat sa") and not K.ruled_out(known, "zzz")


def test_dedup_report(spark):
    from palimpsest.operators.similarity import dedup_report

    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(0, text), (1, text), (2, text + " more"), (3, "something else entirely here")], "i bigint, t string")
    assert tuple(dedup_report(df, "i", "t", 0.8).first()) == (4, 1, 2)
