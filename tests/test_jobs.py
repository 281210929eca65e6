"""Ingestion and status jobs, in batch and as streams over several micro-batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from storyframe.plans import catalogue, ingest, status
from storyframe.sources import listing as U
from storyframe.sources import sinks
from storyframe.streaming import ingest as stream_ingest
from storyframe.streaming import status as stream_status
from workload import inputs

LOG = "asset_id bigint, ts bigint, seq bigint, status string, source_video string"
EXISTING = "media_id string, sequence_number bigint, asset_id string, title string"


def saves(count):
    rng = random.Random(8)
    return [(rng.choice([1, 1, 2, 3]), i // 3, i, rng.choice("abc"), rng.choice(["", "x", "y"])) for i in range(count)]


def listed(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_change_stamps(spark, sizes):
    log = spark.createDataFrame(
        [(1, 10, 1, "a", "x"), (1, 20, 2, "b", "x"), (1, 30, 3, "b", "y"), (2, 5, 4, "a", None)], LOG)
    stamps = status.change_stamps(log, ["status", "source_video"])
    assert listed(stamps, "asset_id", "status", "status_changed_at", "source_video_changed_at") == [
        (1, "b", 20, 30), (2, "a", None, None)]


def test_triggers_need_a_new_video(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, "a", "x"), (1, 2, 2, "a", ""), (1, 3, 3, "a", "y"), (1, 4, 4, "a", "y"), (2, 1, 5, "a", None),
         (2, 2, 6, "a", "z")], LOG)
    assert listed(status.triggers(log), "asset_id", "seq") == [(1, 3), (2, 6)]


BEAT = [(None, 10**12, 0, None, None)]
FOLLOWED = ["status", "source_video"]


def followed(spark, waves, tmp_path, lateness, beat=True):
    """The folder of a stream over `waves` of saves, a micro-batch each, and then a heartbeat."""
    for wave in [*waves, *([BEAT] if beat else [])]:
        spark.createDataFrame(wave, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    folder = str(tmp_path / "state")
    stream_status.track(stream_status.filled(log), folder, FOLLOWED, lateness).awaitTermination()
    return folder


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_the_batch_for_saves_within_the_lateness(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(a, ts * 10_000_000, i, s, v) for a, ts, i, s, v in saves(150)]
    # each save is up to a minute late
    order = sorted(rows, key=lambda r: r[1] + rng.random() * 60_000_000)
    cuts = sorted(rng.sample(range(1, 150), 3))
    waves = [order[i:j] for i, j in zip([0, *cuts], [*cuts, 150])]
    folder = followed(spark, waves, tmp_path, "1 minute")
    log = stream_status.filled(spark.createDataFrame(rows, LOG))
    assert stream_status.late(spark, folder).count() == 0
    columns = ["asset_id", "ts", "seq", "status", "previous_status"]
    assert listed(stream_status.changes(spark, folder, "status"), *columns) == listed(status.changes(log), *columns)
    assert listed(stream_status.triggers(spark, folder), "seq") == listed(status.triggers(log), "seq")
    stamps = ["asset_id", *FOLLOWED, *(f"{c}_changed_at" for c in FOLLOWED)]
    assert listed(stream_status.latest(spark, folder, FOLLOWED), *stamps) == listed(
        status.change_stamps(log, FOLLOWED), *stamps)
    # a second run on the same folder finds nothing new
    again = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    stream_status.track(stream_status.filled(again), folder, FOLLOWED, "1 minute").awaitTermination()
    assert listed(stream_status.changes(spark, folder, "status"), *columns) == listed(status.changes(log), *columns)


def test_a_wave_is_one_micro_batch_however_many_parts_its_log_has(spark, tmp_path):
    log = spark.range(6000).repartition(20).selectExpr(
        "id % 2 AS asset_id", "1000 * id AS ts", "id AS seq", "cast(id div 7 % 3 AS string) AS status", "'x' AS source_video")
    lateness, files = inputs.arrived_log(log, str(tmp_path / "log"))
    waves = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "log"))
    query = stream_status.track(waves, str(tmp_path / "state"), FOLLOWED, lateness)
    query.awaitTermination()
    # the waves, the heartbeat, and what waits for the watermark of the heartbeat
    assert query.lastProgress["batchId"] + 1 <= inputs.WAVES + 3
    columns = ["asset_id", "ts", "seq", "status", "previous_status"]
    assert listed(stream_status.changes(spark, str(tmp_path / "state"), "status"), *columns) == listed(
        status.changes(log), *columns)


def test_saves_wait_and_late_ones_are_listed(spark, tmp_path):
    second = 1_000_000
    folder = followed(spark, [[(1, 10 * second, 1, "a", ""), (1, 20 * second, 2, "b", "")], [(2, 40 * second, 3, "z", "")],
                              [(2, 41 * second, 7, "z", "")], [(1, 15 * second, 4, "c", ""), (1, 36 * second, 5, "d", "")]], tmp_path, "5 seconds", beat=False)
    # the save of 36 s waits, since another one of 36 s may still come; that of 15 s came after 20 s was settled
    assert listed(stream_status.changes(spark, folder, "status"), "seq") == [(2,)]
    assert listed(stream_status.late(spark, folder), "seq", "status") == [(4, "c")]
    followed(spark, [[(1, 30 * second, 6, "e", "")], BEAT], tmp_path, "5 seconds", beat=False)
    assert listed(stream_status.changes(spark, folder, "status"), "seq") == [(2,), (5,), (6,)]
    assert listed(stream_status.late(spark, folder), "seq") == [(4,)]


def test_ingest_plan(spark, sizes):
    files = spark.createDataFrame(
        [("m", n) for n in ("ep01.mp4", "ep01.srt", "a1.mov", "ep2.MP4", "ep3.mov", "ep3.txt", "note.mp4", "s01e02.mp4",
                            "ep5.mov", "ep5_b.mp4", "ep5.srt", "ep7.mp4")],
        "media_id string, name string")
    existing = spark.createDataFrame([("m", 3, "id3", "Third"), ("m", 9, "id9", "Ninth")], EXISTING)
    plan = ingest.plan(files, existing)
    rows = {r["sequence_number"]: r for r in plan.collect()}
    assert set(rows) == {0, 1, 3, 5, 7, 102}
    # Two videos share an episode: the title is from the mp4, the links from the mov, which has no subtitles.
    assert (rows[1]["title"], rows[1]["n_videos"], rows[1]["source_subtitle_url"]) == ("ep01", 2, None)
    assert rows[5]["title"] == "ep5_b" and rows[5]["source_subtitle_url"].endswith("/ep5.srt")
    assert (rows[3]["asset_id"], rows[3]["title"], rows[3]["created"]) == ("id3", "Third", False)
    assert rows[7]["created"] and len(rows[7]["asset_id"]) == 36
    merged = ingest.merged_assets(existing, plan)
    assert sorted(r["sequence_number"] for r in merged.collect()) == [0, 1, 3, 5, 7, 9, 102]
    assert ingest.duplicate_assets(existing.union(existing)).count() == 2


def test_files_are_ingested_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "uploads" / "work +%201"
    folder.mkdir(parents=True)

    def arrive(*names):
        for name in names:
            (folder / name).parent.mkdir(exist_ok=True)
            (folder / name).write_bytes(b"x")
        files = stream_ingest.file_stream(spark, str(tmp_path / "uploads"))
        existing = spark.createDataFrame([], EXISTING)
        stream_ingest.ingest_stream(files, existing, str(tmp_path / "state")).awaitTermination()
        return {r["sequence_number"]: r for r in stream_ingest.planned_assets(
            spark, existing, str(tmp_path / "state")).collect()}

    first = arrive("ep1.mp4", "ep1.srt", "skip.txt", "sub/ep9.mp4")
    assert set(first) == {1} and first[1]["media_id"] == "work +%201"
    second = arrive("ep2.mov", "z1.mov")
    assert set(second) == {1, 2}
    # The id and title stay; the links follow the later file, which has no subtitles.
    assert (second[1]["asset_id"], second[1]["title"]) == (first[1]["asset_id"], "ep1")
    assert second[1]["source_subtitle_url"] is None and not second[1]["created"]
    files = U.read_listing(spark, str(tmp_path / "uploads"))
    assert listed(files, "media_id", "name", "length") == [
        ("work +%201", n, 1) for n in ("ep1.mp4", "ep1.srt", "ep2.mov", "z1.mov")]
    # nothing new, nothing planned
    assert arrive() == second


def test_arriving_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    """No index of files in the driver, but the same works and names as one gives."""
    names = ["ep1.mp4", "EP2.MP4", "_h.mp4", ".x.mov", "_a=b.mov", "y.srt", "z.txt", "_metadata1.mp4", "w.mp4._COPYING_", "é %20.srt"]
    for work in ("a b", "_hidden", ".dot", "_k=1", "_metadata2", "ü%20", "none"):
        (tmp_path / "uploads" / work / "deeper").mkdir(parents=True)
        for name in names if work != "none" else []:
            (tmp_path / "uploads" / work / name).write_bytes(b"x")
            (tmp_path / "uploads" / work / "deeper" / name).write_bytes(b"x")
            (tmp_path / "uploads" / name).write_bytes(b"x")
    (tmp_path / "uploads" / "a b" / "broken.mp4").symlink_to(tmp_path / "nothing")
    path, out = str(tmp_path / "uploads"), str(tmp_path / "out")
    files = stream_ingest.file_stream(spark, path)
    plan = files._jdf.queryExecution().analyzed().toString()
    assert "binaryFile" not in plan and stream_ingest.Uploads.name() in plan
    for turn in (1, 2):
        files.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True) \
            .start(out).awaitTermination()
        found = sorted(map(tuple, spark.read.parquet(out).collect()))
        assert found == sorted(turn * [tuple(r) for r in U.read_listing(spark, path).select("media_id", "name").collect()])
    assert len(found) == 2 * 4 * 4


def test_the_files_of_a_work_take_few_steps_of_state():
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows) if isinstance(self.rows, list) else self.rows

        def update(self, row):
            calls.append("update")
            self.rows = row

        def appendList(self, rows):
            calls.append("append")
            self.rows = self.rows + rows

    names, turns = State(), State()
    turns.rows = None
    listing = stream_ingest.Listing()
    listing.init(type("Handle", (), {"getListState": lambda *_: names, "getValueState": lambda *_: turns})())
    first = list(listing.handleInputRows(("m",), iter([{"name": f"ep{i % 100}.mp4"} for i in range(200)]), None))
    second = list(listing.handleInputRows(("m",), iter([{"name": "ep7.mp4"}, {"name": "ep100.mp4"}]), None))
    assert len(first) == 100 and all(r.turn == 0 and r.fresh for r in first) and len(calls) <= 8
    assert len(second) == 101 and [(r.name, r.turn) for r in second if r.fresh] == [("ep100.mp4", 1)]
    assert list(listing.handleInputRows(("m",), iter([{"name": "ep7.mp4"}]), None)) == []


def test_folders_are_listed_with_their_files(spark, tmp_path):
    for name in ("a/ep1.mp4", "a/_ep2.mp4", "a/sub/ep3.mp4", "a/.hidden", "b +1/ep1.srt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "empty").mkdir()
    (tmp_path / "file").write_bytes(b"x")
    works = spark.createDataFrame([(i,) for i in ("a", "b +1", "empty", "file", "gone", None, "a")], "media_id string")
    folders = U.list_folders(works.where("media_id IS NOT NULL"), str(tmp_path))
    assert listed(folders.filter("name IS NULL"), "media_id", "found") == [
        ("a", True), ("b +1", True), ("empty", True), ("file", False), ("gone", False)]
    assert listed(folders.filter("name IS NOT NULL"), "media_id", "name", "length") == [
        ("a", ".hidden", 2), ("a", "_ep2.mp4", 2), ("a", "ep1.mp4", 2), ("b +1", "ep1.srt", 2)]
    planned = ingest.plan(folders.filter("name IS NOT NULL"), spark.createDataFrame([], EXISTING))
    states = {}
    for r in ingest.run_states(folders, planned).orderBy("step").collect():
        states.setdefault((r.media_id, r.sequence_number), []).append(r.status)
    assert states == {("a", None): ["ingesting", "completed"], ("b +1", None): ["ingesting", "completed"],
                      ("empty", None): ["ingesting", "completed"], ("file", None): ["ingesting", "failed"],
                      ("gone", None): ["ingesting", "failed"], ("a", 1): ["processing", "completed"],
                      ("a", 2): ["processing", "completed"]}


def test_manifest(spark, tmp_path):
    assets = spark.createDataFrame([(1, "m", 'a"b'), (2, "m", ""), (3, "m", None)],
                                   "asset_id int, media_id string, processed_video_url string")
    manifest = sinks.task_manifest(assets)
    assert [(r["asset_id"], json.loads(r["payload"])) for r in manifest.collect()] == [
        (1, {"data": {"video_url": 'a"b'}})]
    sinks.write_manifest(manifest, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 1


def test_search_needs_every_word_in_some_field(spark):
    rows = spark.createDataFrame([("Night Train", "One"), ("Day", "train"), ("Night", "Two")],
                                 "title string, media_title string")
    found = catalogue.searched(rows, " NIGHT tr", ["title", "media_title"])
    assert listed(found, "title") == [("Night Train",)]
    assert catalogue.searched(rows, "", ["title"]).count() == 3
    assert catalogue.faceted(rows, title="Day").count() == 1


def test_uploaded_subtitles(spark):
    assets = spark.createDataFrame([(1, "pending", None), (2, "pending", "old.ass"), (3, "pending", None)],
                                   "asset_id int, l1_status string, l1_output_file string")
    uploads = spark.createDataFrame([(1, "x"), (1, ""), (2, ""), (3, None)], "asset_id int, body string")
    assert listed(ingest.subtitle_upload(assets, uploads), "asset_id", "l1_status", F.coalesce(
        "l1_output_file", F.lit("-"))) == [
        (1, "completed", "l1_outputs/1_l1.ass"), (2, "pending", "old.ass"), (3, "pending", "-")]


def test_merged_assets_keep_what_a_plan_does_not_set(spark):
    existing = spark.createDataFrame([("m", 1, "a1", "Old", "completed", "l1.ass", 7, "pending")],
                                     "media_id string, sequence_number int, asset_id string, title string, "
                                     "l1_status string, l1_output_file string, annotation_task_id int, "
                                     "processing_status string")
    files = spark.createDataFrame([("m", "ep01.mp4"), ("m", "ep02.mp4")], "media_id string, name string")
    planned = ingest.plan(files, existing)
    merged = {r.sequence_number: r for r in ingest.merged_assets(existing, planned).collect()}
    assert (merged[1].title, merged[1].l1_status, merged[1].l1_output_file, merged[1].annotation_task_id) == (
        "Old", "completed", "l1.ass", 7)
    assert merged[1].processing_status == "completed" and merged[1].processed_video_url
    assert merged[2].l1_status is None and merged[2].title == "ep02"
