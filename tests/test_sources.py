"""Sources and sinks: framings, malformed JSON, round trips."""

import gzip
import struct

import pytest

from weirflow.sources import files


def test_json_lines(spark):
    rows = ['{"user_id":"u","item":"i","more":1}', '{"user_id":"u","item"', '{"user_id":"u"}', '{"user_id":7,"item":"j"}', '{"user_id":"a","user_id":"b","item":"k"}', "", "[]"]
    df = spark.createDataFrame([(x,) for x in rows], "value string")
    assert [(r.user_id, r.item) for r in files.json_lines(df, "user_id string, item string").collect()] == [("u", "i"), ("7", "j"), ("b", "k")]
    assert files.json_lines(df, "user_id string, item string", ["user_id"]).count() == 4


def test_framed_records(spark, tmp_path):
    records = [b"one", b"", b"three" * 1000, b"\x00\n"]
    (tmp_path / "p.bin").write_bytes(b"".join(struct.pack("<I", len(r)) + r for r in records) + struct.pack("<I", 9) + b"cut")
    got = sorted(files.prefixed_records(spark, str(tmp_path / "p.bin")).collect(), key=lambda r: r.place)
    assert [bytes(r.record) for r in got] == records and got[0].tag.endswith("p.bin")
    (tmp_path / "f.bin").write_bytes(b"aabbccd")
    assert sorted(bytes(r.record) for r in files.fixed_records(spark, str(tmp_path / "f.bin"), 2).collect()) == [b"aa", b"bb", b"cc"]
    (tmp_path / "e.bin").write_bytes(b"")
    assert files.fixed_records(spark, str(tmp_path / "e.bin"), 2).count() == files.prefixed_records(spark, str(tmp_path / "e.bin")).count() == 0
    with pytest.raises(ValueError):
        files.fixed_records(spark, str(tmp_path / "e.bin"), 0)


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;y;;z")
    df = files.text_lines(spark, str(tmp_path / "a.txt"), ";")
    assert [r.value for r in df.collect()] == ["x", "y", "", "z"]
    files.write_lines(df, str(tmp_path / "out"), "value", compression="gzip")
    assert (tmp_path / "out" / "_SUCCESS").exists()
    part = next((tmp_path / "out").glob("part-*.gz"))
    assert gzip.decompress(part.read_bytes()) == b"x\ny\n\nz\n"
    files.write_lines(df, str(tmp_path / "semi"), "value", ";")
    assert files.text_lines(spark, str(tmp_path / "semi"), ";").count() == 4


@pytest.mark.parametrize("kind", ["parquet", "orc", "json"])
def test_tables(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    files.write_table(df, str(tmp_path / kind), kind, ["b"])
    assert {(r.a, r.b) for r in files.table(spark, str(tmp_path / kind), kind).collect()} == {(1, "x"), (2, "y")}


def test_lines_bear_the_tag_of_their_file(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text('{"a": "' + name + '"}\nbroken\n')
    from weirflow.sources.files import json_lines, text_lines

    rows = json_lines(text_lines(spark, str(tmp_path), tagged=True), "a string").collect()
    assert sorted((r.a, r.tag.rsplit("/", 1)[1]) for r in rows) == [("one", "one.json"), ("two", "two.json")]


def test_a_callback_for_each_group(spark):
    import pyarrow as pa

    from weirflow.operators.relational import group_transform

    def longest(key, rows):
        return pa.table({"k": [key[0]], "all": ["".join(rows.column("x").to_pylist())]})

    df = spark.createDataFrame([(1, "b"), (2, "z"), (1, "c"), (1, "a")], "k long, x string")
    found = group_transform(df, ["k"], ["x-"], longest, "k long, all string").collect()
    assert sorted((r.k, r["all"]) for r in found) == [(1, "cba"), (2, "z")]
