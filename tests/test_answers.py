"""Cuts, sketches, record contents, diffs and versions against plain implementations."""

import json

import numpy as np
import pytest


def plain_cuts(data, average):
    from palimpsest.operators.chunking import GEAR

    gear = [int(x) for x in GEAR]
    least, most, mask = average // 4, average * 4, (1 << (average - 1).bit_length()) - 1
    out, pos = [], 0
    while pos < len(data):
        end = len(data)
        if len(data) - pos > least:
            end = min(pos + most, len(data))
            h = 0
            for i in range(pos + least, end):
                h = (2 * h + gear[data[i]]) % 2**64
                if h & mask == 0:
                    end = i + 1
                    break
        out.append(end)
        pos = end
    return out


@pytest.mark.parametrize("average", [64, 100, 256, 4096])
def test_cut_positions(average):
    from palimpsest.operators.chunking import cuts

    r = np.random.default_rng(average)
    for data in (r.bytes(60_000), bytes(r.integers(97, 100, 20_000, dtype=np.uint8)), b"a" * 9000, b"", b"x", r.bytes(average // 4), r.bytes(average // 4 + 1)):
        assert cuts(data, average) == plain_cuts(data, average)


def test_sketch_of_numbers_with_nulls(spark):
    from palimpsest.operators import sketch

    full = spark.createDataFrame([(i,) for i in range(5000)], "v bigint")
    some = full.unionByName(spark.createDataFrame([(None,)], "v bigint"))
    a, b = sketch.registers(full, "v"), sketch.registers(some, "v")
    assert len(set(map(tuple, a.collect())) ^ set(map(tuple, b.collect()))) <= 2
    union = sketch.estimate(sketch.merge(a, b)).first()[0]
    assert abs(union - 5001) < 650 and union == sketch.estimate(b).first()[0]
    by = some.selectExpr("v % 3 as g", "v")
    again = sketch.loads(sketch.dumps(sketch.registers(by, "v", "g"), "g"), "g")
    assert sorted(map(repr, again.collect())) == sorted(repr(r) for r in sketch.registers(by, "v", "g").select("g", "reg", "rank").collect())
    kinds = [None, b"a", "a", True, 1, 1.0, -1]
    assert len({sketch.slot(x) for x in kinds}) >= len(kinds) - 1 and sketch.slot("a") == sketch.slot(b"a")


def test_contents_follow_json(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions.text import content

    values = ["plain", "true", "[1, 2]", "12", "", None, True, 1.5, 12, [3, {"b": 1, "a": "é"}], {"b": 1, "a": 2}, {"a": 2, "b": 1}]
    lines = [json.dumps({"text": v}) for v in values] + ["not json", "{broken", '{"other": 1}', "[1]"]
    want = [v if isinstance(v, str) else json.dumps(v, sort_keys=True) if v is not None else x for v, x in zip(values, lines)] + lines[len(values) :]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, s string")
    assert [r[1] for r in df.select("i", content(F.col("s").cast("binary"))).orderBy("i").collect()] == want


def test_diff_knows_compactions(spark):
    from palimpsest.table import Table

    t = Table(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(8)], "id int, c string"))
    t.drop_class("c", "a")
    before = t.versions - 1
    t.compact()
    after = t.versions - 1
    t.relabel_lazy("c", {"b": "z"})
    with pytest.raises(ValueError):
        t.diff(before, -1)
    assert t.diff(before, -1, "id")[1].count() == 4
    assert t.diff(after, -1)[1].count() == 4
    t.relabel("c", {"z": "y"})
    assert t.diff(after, -1)[1].count() == 4
    r = t.column_report("c").first()
    assert (r["n"], r["nulls"], r["estimate"]) == (4, 0, 1)


def test_record_access_and_versions(spark):
    from palimpsest.dataset import Dataset

    d = Dataset.from_records(spark, [{"text": "a"}, {"text": "b"}, {"text": "a"}, "plain", {"text": "b"}, {"text": "c"}])
    assert len(d) == 6 and d[0].json() == {"text": "a"} and d[-1].index == 5 and [r.index for r in d[1:5:2]] == [1, 3]
    assert [r.index for r in d[::-2]] == [5, 3, 1] and [r.text for r in d][3] == "plain" and d[9:] == []
    with pytest.raises(ValueError):
        d[3].json()
    with pytest.raises(IndexError):
        d[6]
    d.dedup()
    d.rollback(0)
    d.filter_length_or_all(13, 0)
    d.rollback(1)
    frame = sorted(map(tuple, d.versions_frame().collect()))
    plain = []
    for v in range(d.versions):
        rows = d.at(v).collect()
        plain.append((v, len(rows), sum(len(r["raw"]) + 1 for r in rows)))
    assert frame == plain
    changed = {(r["ord"], r["version"]) for r in d.touched().collect()}
    for v in range(1, d.versions):
        one, two = ({(r["ord"], bytes(r["raw"])) for r in d.at(x).collect()} for x in (v - 1, v))
        assert {o for o, x in changed if x == v} == {o for o, _ in one ^ two}


def test_repetitive_records(spark):
    from palimpsest.functions.text import quality

    texts = ["abcd" * 30, "abcde" * 30, "a" * 9, "a" * 10, "", "ab\n\tab\n\tab", "ab" * 40 + "cde", "é" * 6, "abc" * 40 + "d" * 3]
    q = quality(spark.createDataFrame([(t,) for t in texts], "s string"), "s").first()
    want = sum(len(t.encode()) >= 10 and len(set(t.encode())) < 5 for t in texts)
    assert q["repetitive"] == want and q["empty"] == 1 and q["short"] == 1
