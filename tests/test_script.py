"""A small project read from its files, with every value worked out by hand."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyframe import schemas
from storyframe.functions.labels import FLAT
from storyframe.operators import regions as R
from storyframe.operators import timeline as N
from storyframe.plans import rejects, script
from storyframe.session import cut_lineage, measured
from storyframe.sources import annotations as A
from storyframe.sources import arrays, listing, sinks
from storyframe.sources import subtitles as S

FIRST = """[Script Info]
Dialogue: 0,0:00:05.50,0:00:06.00,D,Bo,0,0,0,,before section
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.00,0:00:02.00,D,Caption,0,0,0,,CITY
Dialogue: 0,0:00:09.99,0:00:10.50,D,Ann,0,0,0,,Hi, there\\Nbye
Comment: 0,0:00:04.00,0:00:05.00,D,Bo,0,0,0,,hidden
Dialogue: 0,0:00:10.00,0:00:11.00,D,Bo,0,0,0,,edge
Dialogue: 0,0:00:20.00,0:00:21.00,D,Bo,0,0,0,,outside
Dialogue: 0,0:00:03.00,short
[Fonts]
Dialogue: 0,0:00:05.00,0:00:06.00,D,Bo,0,0,0,,after section
[Events]
Dialogue: 0,0:00:05.20,0:00:06.00,D,Bo,0,0,0,,second section
"""
SECOND = """[EVENTS]\r
dialogue: 0,0:00:07.50,0:00:08.50,D, CAPTION,0,0,0,,not a caption: leading blank in the name\r
[events]\r
Dialogue: 0,0:00:08.00,0:00:09.00,D,Cy,0,0,0,,lost\r
"""


def result(region, name, start=None, end=None, **value):
    if start is not None:
        value.update(start=start, end=end)
    return {"id": region, "from_name": name, "value": value}


def label(region, text, start, end):
    return result(region, "region_type", start, end, labels=[text])


def insert(region, chapter, scene, inner):
    return [result(region, "scene_timeline_marker_type", choices=["插入过去/INSERT_PAST"]),
            result(region, "insert_past_chapter", number=chapter), result(region, "insert_past_scene", number=scene),
            result(region, "insert_past_inner_index", number=inner)]


def export(branch=False):
    second = [label("r5", "场景/Scene", 0, 8), result("r5", "scene_location", 0, 8, text=["in/out"]), *insert("r5", 1, 1, 1),
              label("r6", "场景/Scene", 8, 8), result("r6", "scene_timeline_marker_type", choices=["预叙/FORWARD"])]
    first = [
        label("r2", "场景/Scene", 10, 20), *insert("r2", 1, 1, 2),
        result("r1", "scene_location", 0, 10, text=["first try"]),
        label("r1", "场景/Scene", 0, 10), result("r1", "scene_location", 0, 10, text=["巷子/Alley"]),
        result("r1", "scene_mood_and_atmosphere"), result("", "scene_location", text=["x"]), result("r1", "", text=["x"]),
        label("r3", "高光/Highlight", 5, 12), result("r3", "highlight_type", 5, 12, choices=["动作片段/Action Clip"]),
        result("r3", "highlight_id", number=4),
        label("r4", "叙事线索/NARRATIVE_CUE", 3, 4),
        result("r4", "object_name", 3, 4, text=["ring"]),
        result("r4", "key_information_summary", 3, 4, text=["k1", ""]),
    ]
    if branch:
        first += [result("r2", "narrative_branch_type", choices=["分支/BRANCH"]), result("r2", "branch_id", number=1)]
    third = [label("r7", "场景/Scene", 0, 100)]
    return [
        {"inner_id": 2, "file_upload": "x-ep02.mp4", "annotations": [{"result": second}, {"result": third}]},
        {"inner_id": 1, "file_upload": "x-ep1.mp4", "annotations": [{"result": first}]},
        {"inner_id": 3, "file_upload": "trailer.mp4", "annotations": [{"result": third}]},
        {"inner_id": 4, "file_upload": "x-ep3.mp4"},
    ]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for project in ("demo", "twin +1%20"):
        (root / "subs" / project).mkdir(parents=True)
        (root / "subs" / project / "01.ass").write_bytes(FIRST.encode())
        (root / "subs" / project / "02.ass").write_bytes(SECOND.encode())
    (root / "exports").mkdir()
    (root / "exports" / "demo.json").write_text(json.dumps(export(), ensure_ascii=False, indent=1))
    (root / "exports" / "twin +1%20.json").write_text("\n " + json.dumps(export(branch=True)))
    (root / "exports" / "single.json").write_text(json.dumps(export()[0]))
    (root / "lines").mkdir()
    (root / "lines" / "demo.jsonl").write_text("".join(json.dumps(t) + "\n" for t in export()))
    return root


def built(spark, folder, **options):
    tasks = A.read_exports(spark, str(folder / "exports"))
    lines = S.read_lines(spark, str(folder / "subs"))
    return script.build(tasks, lines, "2024-06-01 12:00:00", **options)


def joined(fragments, max_bytes):
    """Documents by project; fragments are within the bound and numbered from 0."""
    texts = {}
    for r in sorted(fragments.collect(), key=lambda r: (r["project_id"], r["position"])):
        assert 0 < len(r["text"].encode()) <= max_bytes
        own = texts.setdefault(r["project_id"], [])
        assert r["position"] == len(own)
        own.append(r["text"])
    return {project: json.loads("".join(own)) for project, own in texts.items()}


def documents(spark, folder, max_bytes=500, **options):
    return joined(script.documents(built(spark, folder, **options), max_bytes), max_bytes)


@pytest.fixture(scope="module")
def parts(spark, folder):
    return cut_lineage(script.parts(built(spark, folder)))


def test_document(spark, folder, sizes):
    both = documents(spark, folder)
    got = both["demo"]
    assert got["project_metadata"] == {
        "project_name": "demo", "total_chapters": 2, "total_scenes": 4, "version": "1.8",
        "generation_date": "2024-06-01T12:00:00+00:00"}
    assert got["chapters"] == {
        "1": {"id": 1, "name": "Chapter_1", "textual": "Chapter 1", "source_file": "01.ass", "scene_ids": [1, 2]},
        "2": {"id": 2, "name": "Chapter_2", "textual": "Chapter 2", "source_file": "02.ass", "scene_ids": [3, 4]}}
    highlight = {"id": 4, "type": "Action Clip", "description": None, "mood": None,
                 "start_time": "00:00:05.000", "end_time": "00:00:12.000"}
    cues = [{"type": t, "value": v, "start_time": "00:00:03.000", "end_time": "00:00:04.000"}
            for t, v in (("Key_Information", "k1"), ("Object", "ring"))]
    assert got["scenes"]["1"] == {
        "id": 1, "name": "Scene_1", "textual": "Scene 1", "chapter_id": 1,
        "dialogues": [{"content": "Hi, there\nbye", "speaker": "Ann", "start_time": "00:00:09.990",
                       "end_time": "00:00:10.500"}],
        "captions": [{"content": "CITY", "start_time": "00:00:01.000", "end_time": "00:00:02.000"}],
        "highlights": [highlight], "narrative_cues": cues, "inferred_location": "Alley",
        "character_dynamics": "N/A", "mood_and_atmosphere": "N/A", "scene_content_type": "N/A",
        "branch": {"id": 0, "type": "linear", "intersection_with": []},
        "start_time": "00:00:00.000", "end_time": "00:00:10.000"}
    second, third, fourth = (got["scenes"][i] for i in "234")
    assert [d["content"] for d in second["dialogues"]] == ["edge"] and second["highlights"] == []
    assert second["timeline_marker"] == {
        "type": "INSERT_PAST", "insert_chapter_id": 1, "insert_scene_id": 1, "inner_index": 2}
    assert [(d["speaker"], d["content"]) for d in third["dialogues"]] == [
        (" CAPTION", "not a caption: leading blank in the name")]
    assert third["highlights"] == [highlight] and third["narrative_cues"] == cues
    assert third["inferred_location"] == "out" and second["inferred_location"] == "N/A"
    assert fourth["dialogues"] == [] and fourth["timeline_marker"] == {"type": "FORWARD"}
    assert got["narrative_timeline"] == {"type": "linear", "sequence": {
        "1": {"narrative_index": 1}, "2": {"narrative_index": 2}, "3": {"narrative_index": 3}}}
    assert list(got["narrative_timeline"]["sequence"]) == ["1", "2", "3"]


    assert both["twin +1%20"]["narrative_timeline"] == {
        "type": "multi_branch", "intersections": [], "branches": {
            "BRANCH_0": {"sequence": {"1": {"narrative_index": 1}, "3": {"narrative_index": 2}}},
            "BRANCH_1": {"sequence": {"2": {"narrative_index": 1}}}}}


def test_same_chapter_keeps_marks_in_their_episode(spark, folder):
    got = documents(spark, folder, same_chapter=True)["demo"]["scenes"]
    assert len(got["1"]["highlights"]) == 1 and got["3"]["highlights"] == [] and got["3"]["narrative_cues"] == []


def test_an_export_that_is_no_array_has_no_tasks(spark, folder):
    tasks = A.read_exports(spark, str(folder / "exports"))
    assert {r[0] for r in tasks.select("project_id").distinct().collect()} == {"demo", "twin +1%20"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.recursive(st.none() | st.integers(0, 9) | st.text('a"\\\\[]{},é\n', max_size=6),
                             lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('"]\\\\', max_size=3), x, max_size=3),
                             max_leaves=6), max_size=6), st.integers(1, 9), st.sampled_from([None, 2]))
def test_arrays_are_cut_as_a_parser_would(values, size, indent):
    """Every element is owned by one block, whatever the blocks; blocks are entered as their summaries say."""
    data = (" " + json.dumps(values, indent=indent, ensure_ascii=False) + "\n").encode()
    stream = pa.BufferReader(data)
    state, depth, found = arrays.OUTSIDE, 0, []
    for start in range(0, len(data), size):
        raw = np.frombuffer(data[start:start + size], np.uint8)
        places, texts = arrays._owned(stream, start, size, state, depth)
        found += zip(places, texts)
        exits = [arrays.summary(raw, s) for s in range(3)]
        state, depth = exits[state][0], depth + exits[state][1]
    assert [json.loads(t) for _, t in found] == values and state == arrays.OUTSIDE and depth == 0
    assert [p for p, _ in found] == sorted(p for p, _ in found)


def test_exports_in_blocks_of_any_size(spark, folder, tmp_path):
    def tasks(path, **options):
        rows = A.read_exports(spark, str(path), **options).orderBy("project_id", "task_pos").drop("task_pos")
        return [str(r) for r in rows.collect()]

    assert tasks(folder / "exports", block_bytes=16) == tasks(folder / "exports") != []
    for name, text in (("empty", ""), ("blank", " \n" * 30), ("none", "[ ]"), ("number", " 12 "), ("open", '[{"file_upload":"ep1"},{"a'),
                       ("object", '{"x":[{"file_upload":"ep1"}]}'), ("late", " " * 40 + '[{"file_upload":"ep2"}]')):
        (tmp_path / f"{name}.json").write_text(text)
    for size in (7, 1 << 20):
        found = A.read_exports(spark, str(tmp_path), size).orderBy("project_id", "task_pos").collect()
        assert [(r.project_id, r.file_upload, r.corrupt) for r in found] == [
            ("late", "ep2", None), ("open", "ep1", None), ("open", None, '{"a')]


def test_files_of_one_task_and_of_several_have_the_same_elements(spark, tmp_path, monkeypatch):
    texts = ["", " \n" * 9, "[ ]", ' [1, "é]\\\\", {"a": [",", "\\""]},\n [] , 7 ]\n', '{"x":[1, 2]}', '[{"a":1},{"b', "[" + '"x",' * 40 + "1]"]
    for i, text in enumerate(texts):
        (tmp_path / f"d{i % 2}" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 2}" / "deep" / f"{i}.json").write_text(text)
    for size in (3, 10):
        found = []
        for task_bytes in (arrays.TASK_BYTES, size):
            monkeypatch.setattr(arrays, "TASK_BYTES", task_bytes)
            found.append(sorted(map(tuple, arrays.elements(spark, str(tmp_path), block_bytes=size).collect())))
            monkeypatch.undo()
        assert found[0] == found[1] and len(found[0]) == 5 + 2 + 41
        assert [b for p, _, b in found[0] if p.endswith("/3.json")] == ["1", '"é]\\\\"', '{"a": [",", "\\""]}', "[]", "7"]


def test_exports_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The files that Spark's reader would list, without one list of them in the driver."""
    for folder in ("", "a b", "_hidden", ".dot", "a b/deep/é"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name in ("1.json", "_2.json", ".3.json", "4.jsonl", "k=5.json", "_k=6.json"):
            (tmp_path / folder / name).write_text("[1]")
    wanted = sorted(map(tuple, spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.json").load(str(tmp_path)).select("path", "length").collect()))
    monkeypatch.setattr(listing, "ROWS", 2)
    found = listing.files_below(spark, str(tmp_path), "*.json")
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) == 9
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("the driver lists files")))
    assert arrays.elements(spark, str(tmp_path)).count() == 9
    with pytest.raises(FileNotFoundError):
        listing.files_below(spark, str(tmp_path / "none"), "*")
    for name, pattern, like in (("a.mp4", "*.{mp4,mov}", True), ("a.MP4", "*.{mp4,mov}", False), ("a.srt", "*.{mp4,mov}", False),
                                ("ab", "[^b]?", True), ("bb", "[^b]?", False)):
        assert listing.named_like(name, pattern) == like


def test_blocks_are_dealt_by_file_from_one_listing(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"inner_id": j} for j in range(i % 5)]))
    found = arrays.elements(spark, str(tmp_path), block_bytes=20)
    assert found.count() == sum(i % 5 for i in range(300))
    plan = found._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "GroupsInArrow" not in plan and "RoundRobin" not in plan


def test_regions_that_are_not_hot_are_shuffled_once(spark, folder):
    results = A.results(A.read_exports(spark, str(folder / "exports")))
    found = [R.pivot_regions(results, at_most) for at_most in (None, 100)]
    plan = found[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "RepartitionByExpression [project_id" not in (
        found[0]._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect())) != []


def test_task_lines_give_the_same_regions(spark, folder):
    def regions(tasks):
        rows = R.pivot_regions(A.results(tasks)).drop("first_pos", "task_pos").filter("project_id = 'demo'")
        return sorted(map(str, rows.collect()))

    assert regions(A.read_task_lines(spark, str(folder / "lines"))) == regions(
        A.read_exports(spark, str(folder / "exports")))


def test_parts_split_large_scenes(spark, folder):
    pieces = cut_lineage(script.parts(built(spark, folder), size=1))
    bodies = {(r["item"], r["part"]): json.loads(r["body"]) for r in pieces.filter(
        "section = 'scene' AND project_id = 'demo'").collect()}
    assert set(bodies) == {("1", 0), ("1", 1), ("2", 0), ("3", 0), ("3", 1), ("4", 0)}
    assert [c["value"] for c in bodies["1", 0]["narrative_cues"] + bodies["1", 1]["narrative_cues"]] == ["k1", "ring"]
    assert "name" not in bodies["1", 1]
    assert bodies["1", 0]["highlights"] and not bodies["1", 1]["highlights"]


def test_fragments_of_any_size_are_one_document(spark, folder, sizes):
    made = built(spark, folder)
    whole = joined(script.documents(made, 1 << 20), 1 << 20)
    assert set(whole) == {"demo", "twin +1%20"} and joined(script.documents(made, 11), 11) == whole
    with pytest.raises(ValueError):
        script.documents(made, 7)


def test_pieces_of_documents_are_made_once(spark, folder):
    plan = script.documents(built(spark, folder), 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_documents_of_large_scenes_and_chapters(spark):
    """A scene with 1,001 children of a kind, a chapter of 1,001 scenes, and texts of up to four bytes a character."""
    scenes = spark.range(1, 1002).selectExpr(
        "'p' AS project_id", "cast(1 AS bigint) AS chapter_id", "id AS scene_id", "id * 10.0D AS start_seconds",
        "id * 10.0D + 5 AS end_seconds")
    scenes = cut_lineage(scenes.withColumns({a: F.lit(None).cast(FLAT) for a in schemas.FLAT_ATTRIBUTES}).select(
        "project_id", "chapter_id", "scene_id", "start_seconds", "end_seconds", *R.scene_columns()))
    text = F.concat(F.lit("aé€😀"), F.col("id").cast("string"))
    events = spark.range(1001).select(
        F.lit("p").alias("project_id"), F.lit(1).cast("long").alias("chapter_id"), F.lit("dialogue").alias("kind"),
        F.col("id").alias("line_no"), F.lit(10.5).alias("start_seconds"), F.lit(11.0).alias("end_seconds"),
        F.lit("Bo").alias("speaker"), text.alias("content"))
    marks = events.select("project_id", "chapter_id", "start_seconds", "end_seconds", F.col("line_no").alias("inner_id"),
                          F.col("line_no").alias("task_pos"), F.col("line_no").alias("first_pos")).limit(0)
    highlights = marks.withColumns({c: F.lit(None).cast(FLAT) for c in ("id", "type", "description", "mood")})
    cues = marks.withColumns({"cue_no": F.lit(0), "type": F.lit("x"), "value": F.lit("x")})
    got = joined(script.documents(script.assemble(scenes, events, highlights, cues, "2024-06-01 12:00:00"), 999), 999)["p"]
    assert got["chapters"]["1"]["scene_ids"] == list(range(1, 1002)) and len(got["scenes"]) == 1001
    assert [d["content"] for d in got["scenes"]["1"]["dialogues"]] == [f"aé€😀{i}" for i in range(1001)]
    assert got["narrative_timeline"]["sequence"]["1001"] == {"narrative_index": 1001}


def test_written_documents_are_read_back(spark, folder, tmp_path):
    fragments = cut_lineage(script.documents(built(spark, folder), 200))
    sinks.write_documents(fragments, str(tmp_path / "d"), folders=4)
    back = sinks.read_documents(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fragments.collect()))
    one = sinks.read_documents(spark, str(tmp_path / "d"), "demo", folders=4)
    assert joined(one, 200) == {"demo": joined(fragments, 200)["demo"]}
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().toString()


def test_written_parts_are_json_lines(spark, parts, tmp_path):
    sinks.write_script_parts(parts, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    lines = [x for x in lines if x["project_id"] == "demo"]
    assert {x["section"] for x in lines} == {"project_metadata", "chapter", "scene", "branch", "timeline"}
    assert sorted(x["item"] for x in lines if x["section"] == "scene") == ["1", "2", "3", "4"]


def test_subtitles_of_oddly_padded_names_are_not_read(spark):
    tasks = spark.createDataFrame([("p", "ep001.mp4"), ("p", "ep2.mp4"), ("p", "ep100.mp4"), ("p", "x.mp4")],
                                  "project_id string, file_upload string")
    assert sorted(r["chapter_id"] for r in A.subtitle_chapters(tasks).collect()) == [2, 100]


def test_large_files_are_read_in_blocks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    texts = [f"line {i:05d}" for i in range(20000)]
    body = "".join(f"Dialogue: 0,0:00:01.00,0:00:02.00,D,Bo,0,0,0,,{t}\n" for t in texts)
    (tmp_path / "p" / "01.ass").write_text("[Events]\n" + body + "[Fonts]\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = S.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        events = S.parse_events(lines).select("line_no", "content").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["content"] for r in sorted(events, key=lambda r: r["line_no"])] == texts


def test_rejects(spark):
    tasks = spark.createDataFrame(
        [("p", 0, '{"inner_id":1,"file_upload":"ep1","annotations":[]}'), ("p", 1, '{"annotations":[{"result":[]}]}'),
         ("p", 2, "not json"), ("p", 3, json.dumps({"file_upload": "ep1", "annotations": [{"result": [
             {"id": "a", "from_name": "highlight_type", "value": {"choices": []}},
             {"id": "a", "from_name": "region_type", "value": {"labels": []}},
             {"id": "a", "from_name": "object_name", "value": {"text": []}},
             {"id": "a", "from_name": "scene_location", "value": "text"}]}]}))],
        "project_id string, task_pos bigint, body string")
    parsed = A.parse_tasks(tasks, F.col("body"))
    assert sorted((r["item"], r["reason"]) for r in rejects.task_rejects(parsed).collect()) == [
        ("0", "no_annotations"), ("1", "no_file_upload"), ("2", "unreadable_task")]
    found = rejects.result_rejects(A.results(parsed))
    assert sorted((r["item"], r["reason"]) for r in found.collect()) == [
        ("3/0", "empty_choices"), ("3/1", "empty_labels"), ("3/3", "not_an_object")]
    with pytest.raises(ValueError):
        rejects.fail_fast(found)
    rejects.fail_fast(found.filter("false"))


def test_bad_times_and_incomplete_inserts_are_rejected(spark):
    events = S.timed_events(spark.createDataFrame(
        [("p", "01.ass", 1, "x", "1"), ("p", "01.ass", 2, "1", "1:y"), ("p", "01.ass", 3, "1", "2")],
        "project_id string, chapter_file string, line_no int, start_time_raw string, end_time_raw string"))
    assert sorted(r["reason"] for r in rejects.event_rejects(events).collect()) == ["bad_end_time", "bad_start_time"]
    scenes = spark.createDataFrame(
        [("p", "0", 1, None, None, None, None, None), ("p", "0", 2, "INSERT_PAST", 1.0, 1.0, None, "1"),
         ("p", "0", 3, None, None, None, None, None), ("q", "0", 1, None, None, None, None, None),
         ("q", "0", 2, "INSERT_PAST", 1.0, None, 1.0, None), ("q", "0", 3, "INSERT_PAST", 1.0, 1.0, 1.0, "1")],
        "project_id string, branch_key string, scene_id bigint, marker string, chapter_rank double, "
        "scene_rank double, inner_rank double, target string")
    # An empty rank is no harm while nothing has to be compared with it.
    assert [(r["project_id"], r["item"]) for r in rejects.insert_rejects(scenes).collect()] == [("q", "2")]
    listed = sorted((r["project_id"], r["narrative_index"], r["scene_id"]) for r in N.narrative_order(scenes).collect())
    assert listed == [("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("q", 1, 1), ("q", 2, 3)]


def test_blueprint_measures_groups_once(spark, monkeypatch):
    """Episodes per work and lines per file are counted once, and results of a region are shuffled once."""
    from storyframe.operators import children, intervals, skew
    from storyframe.plans import blueprint

    measured, plans = [], []
    counted, pivot = skew.largest_group, R.pivot_regions

    def count(df, keys):
        measured.append(tuple(keys))
        return counted(df, keys)

    def pivoted(*args):
        found = pivot(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    for module in (skew, children, intervals, script, blueprint, A, S):
        if hasattr(module, "largest_group"):
            monkeypatch.setattr(module, "largest_group", count)
    monkeypatch.setattr(R, "pivot_regions", pivoted)
    body = json.dumps({"inner_id": 1, "file_upload": "x-ep01.mp4", "annotations": [{"result": [
        {"id": "r", "from_name": "region_type", "value": {"start": 0, "end": 9, "labels": ["Scene"]}}]}]})
    # columns that the job does not need may be of any type
    assets = spark.createDataFrame([("w", 1, 1, "1.ass"), ("w", 2, 2, "2.ass"), (None, 3, 1, None)],
                                   "media_id string, asset_id long, sequence_number long, l1_output_file string") \
        .withColumn("other", F.lit(None))
    bodies = spark.createDataFrame([(1, body), (2, None), (3, body)], "asset_id long, body string")
    lines = spark.createDataFrame([
        ("1.ass", 0, "[Events]"), ("1.ass", 1, "Dialogue: 0,0:00:01.00,0:00:02.00,D,Ann,0,0,0,,hi")],
        "path string, line_no long, line string").withColumn("other", F.lit(None))
    made = blueprint.blueprint(assets, bodies, lines, "2024-06-01 12:00:00")
    assert measured.count(("media_id",)) == 1 and ("project_id", "chapter_file") not in measured
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert [(r["project_id"], r["scene_id"], r["ordinal"]) for r in made.script.children.collect()] == [("w", 1, 1)]
    assert {(r["project_id"], r["scene_id"]) for r in made.script.scenes.collect()} == {("w", 1), (None, 1)}
    assert [r["asset_id"] for r in made.skipped.collect()] == [2]


def test_most_results(spark):
    tasks = spark.createDataFrame([("p", 1, [{"result": [{"id": str(i)} for i in range(3)]}]), ("p", 1, None), ("p", 2, []),
                                   ("q", 1, [{"result": None}])],
                                  "project_id string, task_pos long, annotations array<struct<result:array<struct<id:string>>>>")
    assert A.most_results(tasks) == (4, 5) and A.most_results(tasks.limit(0)) == (0, 0)


def test_tables_that_compress_well_are_not_broadcast(spark):
    """A table of a few kilobytes in files, whose rows need megabytes, is joined by a shuffle; one of few rows is broadcast."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "300k")
    try:
        wide = spark.range(30_000).selectExpr("1L AS k", "id % 2 AS half", "'a text that is the same' AS text")
        large, small = measured(wide, "large"), measured(wide.limit(3), "small")
        other = spark.range(3).selectExpr("id AS k").repartition(2)
        for table, kind in ((large, "SortMergeJoin"), (small, "BroadcastHashJoin")):
            for side in (table, table.filter("half = 1").groupBy("k", "text").count()):
                plan = spark.range(500_000).selectExpr("id AS k").join(side, "k")._jdf.queryExecution().executedPlan().toString()
                assert kind in plan and plan.count("HashJoin") == (kind == "BroadcastHashJoin")
        assert large.join(other.hint("broadcast"), "k").count() == 30_000
        assert large.filter("half = 1").join(other, "k").count() == 15_000
        assert measured(wide.limit(0), "none").join(other, "k").count() == 0
    finally:
        spark.conf.set(limit, before)
