from pyspark.sql import functions as F

from palimpsest.cli import Session
from palimpsest.dataset import Dataset
from palimpsest.functions import tokens
from palimpsest.operators import sketch
from palimpsest.sources import readers


def test_commands(spark, tmp_path):
    s = Session(spark, Dataset.from_records(spark, ["aaaaaaaaaaaa", "bbbbbbbb bad", "aaaaaaaaaaaa", "mail a@b.c", "x"]))
    lines = ["# comment", "", "count", "dedup", "drop-contains bad", "filter-length 2 0", "scan-pii", "rollback 0", "count", "diff 0 1", f"save {tmp_path}/s", f"open {tmp_path}/s", f"verify {tmp_path}/s", "nonsense", "quit"]
    said = [s.run(x) for x in lines]
    assert said[2:6] == ["5", "removed 1", "removed 1", "removed 1"] and said[6].startswith("flagged 1")
    assert said[8] == "5" and "'removed': 1" in said[9] and said[11] == "5 records" and said[12] == "sound" and "unknown" in said[13] and said[14] is None


def test_tokens_round_trip(spark):
    rows = [(1, "the cat sat on the mat"), (2, ""), (3, "ünï cödé\n\tthe cat"), (4, "z" * 70)]
    df = spark.createDataFrame(rows, "id int, text string")
    d = tokens.train(df, "text", merges=20, min_count=2)
    t = tokens.tokenize(df, "text", d)
    back = {r["id"]: bytes(r["text"]).decode() for r in tokens.detokenize(t, "id", "tokens", d).collect()}
    assert back == dict(rows)
    assert all(x >= tokens.ESCAPE for x in t.where("id = 4").first()["tokens"])
    more = tokens.learn(spark.createDataFrame([("new words",)], "text string"), "text", d)
    assert {tuple(r) for r in d.collect()} <= {tuple(r) for r in more.collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# mesh\nv 1 2 3\nvn 9 9 9\nv -1.5 0 2e1\n")
    assert [tuple(r) for r in readers.obj_mesh(spark, str(tmp_path / "m.obj")).orderBy("idx").collect()] == [(0, 1.0, 2.0, 3.0), (1, -1.5, 0.0, 20.0)]
    (tmp_path / "v.tsv").write_text("1\t6869\n7\tff00\n")
    assert [(r["id"], bytes(r["text"])) for r in readers.vocabulary(spark, str(tmp_path / "v.tsv")).orderBy("id").collect()] == [(1, b"hi"), (7, b"\xff\0")]
    nal = lambda k: b"\0\0\1" + bytes([k]) + b"xx"
    (tmp_path / "a.264").write_bytes(nal(7) + nal(8) + nal(5) + nal(1) + nal(6) + nal(1))
    got = [(r["idx"], r["size"], r["idr"]) for r in readers.access_units(spark, str(tmp_path / "a.264")).orderBy("idx").collect()]
    assert got == [(0, 18, True), (1, 6, False), (2, 12, False)]


def test_sketch_text(spark):
    regs = sketch.registers(spark.range(500), "id")
    again = sketch.loads(sketch.dumps(regs))
    assert {tuple(r) for r in regs.collect()} == {tuple(r) for r in again.select("reg", F.col("rank")).collect()}
