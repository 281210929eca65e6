"""Scalar functions against their rules, written in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from storyframe.functions import labels as L
from storyframe.functions import links as K
from storyframe.functions import text as T
from storyframe.functions import timecode as TC


def column(spark, kind, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", expression.alias("r"))
    return [r["r"] for r in sorted(rows.collect())]


def clock(seconds):
    if seconds is None:
        return "00:00:00.000"
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(minutes, 60)
    return f"{int(hours):02d}:{int(minutes):02d}:{rest:06.3f}"


def test_final_time_examples(spark):
    values = [None, 59.9996, 3725.678, 360000.0, 1.0005, 0.0005, -1.0]
    assert column(spark, "double", values, TC.final_time(F.col("v"))) == [
        "00:00:00.000", "00:00:60.000", "01:02:05.678", "100:00:00.000", "00:00:01.000", "00:00:00.001",
        "-1:59:59.000"]


def test_final_time_rounds_like_divmod_and_format(spark):
    rng = random.Random(5)
    values = [i / 2000 for i in range(40000)]
    values += [rng.random() * 10 ** rng.randint(-4, 6) for _ in range(40000)]
    values += [round(rng.random() * 10000, 4) for _ in range(40000)]
    assert column(spark, "double", values, TC.final_time(F.col("v"))) == [clock(v) for v in values]


@pytest.mark.parametrize("code, seconds", [
    ("0:01:02.50", 62.5), ("01:02.5", 62.5), ("7", 7.0), ("1:2:3:4", 0.0), (None, 0.0), ("x", None),
    (" 1 :02:3", 3723.0), ("1_0:00", 600.0), ("a:1:2", None), ("1:2:3.5d", None), (".5", 0.5), ("", None)])
def test_ass_seconds(spark, code, seconds):
    assert column(spark, "string", [code], TC.ass_seconds(F.col("v"))) == [seconds]


def test_iso_utc(spark):
    stamps = spark.sql("SELECT timestamp '2024-01-01 00:00:00.5+00:00' AS a, timestamp '2024-01-01 00:00:00+02:00' AS b")
    row = stamps.select(TC.iso_utc(F.col("a")), TC.iso_utc(F.col("b"))).first()
    assert tuple(row) == ("2024-01-01T00:00:00.500000+00:00", "2023-12-31T22:00:00+00:00")


def test_flat_value(spark):
    values = ['{"choices":["a/b/c"]}', '{"text":["x"],"number":1}', '{"number":2.0}', '{"number":2}', '{"text":"abc"}',
              '{"labels":["a/Scene"]}', '{"text":["say \\"hi\\"/é"]}', "{}"]
    flat = L.flat_value(F.col("v"), L.parsed_value(F.col("v")))
    got = column(spark, "string", values, flat)
    assert [r and (r["value"], r["is_number"]) for r in got] == [
        ("b/c", False), ("x", False), ("2.0", True), ("2", True), ("a", False), None, ("é", False), None]
    assert column(spark, "string", values, L.described(flat)) == ["b/c", "x", "2.0", "2", "a", "N/A", "é", "N/A"]
    assert column(spark, "string", values[:4], L.flat_json(flat)) == ['"b/c"', '"x"', "2.0", "2"]


def test_described_zero_is_missing(spark):
    flat = L.flat_value(F.col("v"), L.parsed_value(F.col("v")))
    values = ['{"number":0}', '{"text":[""]}', '{"text":["0"]}']
    assert column(spark, "string", values, L.described(flat)) == ["N/A", "N/A", "0"]


def test_json_text(spark):
    values = ['a "b" \\ [c]', "[]", "", "line\nbreak", "漢字", None]
    got = column(spark, "string", values, T.json_text(F.col("v")))
    assert [json.loads(t) for t in got] == values


def test_names_and_numbers(spark):
    names = ["ep01", "s01e02", "trailer"]
    assert column(spark, "string", names, T.stem_number(F.col("v"))) == [1, 102, 0]
    uploads = ["deep7 ep8", "EP3", "ep001", None]
    assert column(spark, "string", uploads, T.chapter_number(F.col("v"))) == [7, None, 1, None]
    assert column(spark, "bigint", [1, 100], T.pad2(F.col("v"))) == ["01", "100"]
    files = ["a.b.mov", "noext", ".hidden", "x.SRT"]
    assert column(spark, "string", files, T.file_stem(F.col("v"))) == ["a.b", "noext", ".hidden", "x"]
    assert column(spark, "string", files, T.file_ext(F.col("v"))) == [".mov", "", "", ".SRT"]


def test_strip_removes_unicode_blanks(spark):
    values = ["　 a b \t", "\x1c\x1fx\x1d"]
    assert column(spark, "string", values, T.strip(F.col("v"))) == [v.strip() for v in values]


def test_links(spark):
    cdn = K.LinkConfig(storage="s3", cdn_domain="cdn.example")
    row = spark.range(1).select(
        K.video_url(F.lit("a"), cdn), K.subtitle_url(F.lit("a"), F.lit("n.srt"), cdn),
        K.subtitle_url(F.lit("a"), F.lit(None).cast("string")), K.project_url(F.lit(0)),
        K.editor_url(F.lit("a"), F.lit(""), F.lit("s"))).first()
    assert tuple(row) == ("https://cdn.example/processed_videos/a.mp4",
                          "https://cdn.example/source_subtitles/a/n.srt", None, None, None)
