"""Structured scripts of all projects in one job.

A script is kept as parts, each a JSON text of its own: one per project for its metadata, one or more per chapter and
scene, and rows for the timeline. The nested document of a project is given in fragments of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.functions import labels as L
from storyframe.functions import text as T
from storyframe.functions.timecode import final_time
from storyframe.operators import children as C
from storyframe.operators import regions as R
from storyframe.operators import rollup
from storyframe.operators import timeline as N
from storyframe.operators.skew import join_hot, largest_group, running_total, with_previous
from storyframe.session import measured, scratch_path
from storyframe.sources import annotations as A
from storyframe.sources import subtitles as S

# Bytes of a fragment of a document, at most.
FRAGMENT_BYTES = 1 << 20
# Child lists of a scene, in the order of the document.
CHILD_LISTS = {
    "dialogue": "dialogues",
    "caption": "captions",
    "highlight": "highlights",
    "narrative_cue": "narrative_cues",
}


@dataclass(frozen=True)
class Script:
    scenes: DataFrame
    """One row per scene."""
    children: DataFrame
    """`project_id, scene_id, kind, ordinal, body`: every child of every scene."""
    chapters: DataFrame
    """Chapters with their scene ids, in parts."""
    totals: DataFrame
    """Project metadata."""
    branches: DataFrame
    """`project_id, branch_key, branch, first_scene, is_linear`."""
    timeline: DataFrame
    """`project_id, branch, scene_id, narrative_index`."""
    intersections: DataFrame
    """`project_id, scene_id, branches`."""


def build(tasks: DataFrame, lines: DataFrame, generated_at: datetime | str | None = None,
          same_chapter: bool = False, lines_at_most: int | None = None) -> Script:
    """Scripts from annotation tasks and subtitle lines.

    Highlights and cues meet the scenes of every chapter of their project by local time, unless `same_chapter`.
    Regions, scenes and subtitle events are written once, since several branches of the job read them, each some columns.
    `lines_at_most` bounds the lines of a file.
    """
    # A chapter has one file, hence no more events than the file has lines.
    top = largest_group(lines, S.FILE_KEY) if lines_at_most is None else lines_at_most
    # A region has no more results than its task, a project no more scenes than results.
    of_region, of_project = A.most_results(tasks)
    regions = measured(R.pivot_regions(A.results(tasks), of_region), "regions")
    events = S.with_file_chapter(S.timed_events(S.parse_events(lines, top)))
    spoken = join_hot(events, A.subtitle_chapters(tasks), ["project_id", "chapter_id"], "left_semi",
                      left_at_most=top)
    return assemble(measured(R.scenes(regions, of_project), "scenes"), measured(spoken, "spoken"), R.highlights(regions),
                    R.cues(regions), generated_at, same_chapter)


def assemble(scenes: DataFrame, events: DataFrame, highlights: DataFrame, cues: DataFrame,
             generated_at: datetime | str | None = None, same_chapter: bool = False) -> Script:
    """Scripts from scenes and their children."""
    # No chapter and no branch has more scenes than its project.
    top = largest_group(scenes, ["project_id"])
    spoken = C.attach(scenes, subtitle_children(events), ["line_no"], same_chapter=True)
    marked = C.attach(scenes, mark_children(highlights, cues), [*R.REGION_ORDER, "cue_no"], same_chapter=same_chapter)
    shape = ["project_id", "scene_id", "kind", "ordinal", "body"]
    ordering = N.timeline_input(scenes)
    return Script(
        scenes=scenes,
        children=spoken.select(shape).unionByName(marked.select(shape)),
        chapters=rollup.chapters(scenes, at_most=top),
        totals=rollup.project_totals(scenes, generated_at),
        branches=branches(ordering, top),
        timeline=timeline(ordering, top),
        intersections=N.intersections(ordering).select("project_id", "scene_id", branches_json().alias("branches")),
    )


def branches(ordering: DataFrame, at_most: int | None = None) -> DataFrame:
    """`project_id, branch_key, branch, first_scene, is_linear`: one row per branch, also for one that lists nothing.

    Every scene of a linear project is in the main branch, so one ordering per branch serves both kinds.
    """
    return join_hot(N.branch_names(ordering), N.linear_projects(ordering), ["project_id"],
                    left_at_most=at_most, right_at_most=1)


def timeline(ordering: DataFrame, at_most: int | None = None) -> DataFrame:
    """`project_id, branch, scene_id, narrative_index`."""
    top = largest_group(ordering, N.LIST_KEY) if at_most is None else at_most
    placed = join_hot(N.narrative_order(ordering, at_most=top), N.branch_names(ordering), N.LIST_KEY,
                      left_at_most=top, right_at_most=1)
    return placed.select("project_id", "branch", "scene_id", "narrative_index")


def subtitle_children(events: DataFrame) -> DataFrame:
    speaker = F.concat(F.lit(',"speaker":'), _text("speaker"))
    body = F.concat(
        F.lit('{"content":'), _text("content"), F.when(F.col("kind") == "caption", "").otherwise(speaker),
        F.lit(","), _pairs(_times()), F.lit("}"))
    return events.select("project_id", "chapter_id", "kind", "line_no", "start_seconds", body.alias("body"))


def mark_children(highlights: DataFrame, cues: DataFrame) -> DataFrame:
    high = _object([(c, L.flat_json(F.col(c))) for c in ("id", "type", "description", "mood")] + _times())
    cue = _object([(c, T.json_text(F.col(c))) for c in ("type", "value")] + _times())
    shape = ["project_id", "chapter_id", "kind", *R.REGION_ORDER, "cue_no", "body"]
    rows = highlights.withColumns({"kind": F.lit("highlight"), "cue_no": F.lit(0), "body": high}).select(shape)
    return rows.unionByName(cues.withColumns({"kind": F.lit("narrative_cue"), "body": cue}).select(shape))


def scene_body(lists: list[tuple[str, Column]]) -> Column:
    """JSON of a scene with its child lists."""
    return F.concat(scene_head(), F.lit(","), _pairs(lists), F.lit(","), scene_tail())


def scene_head() -> Column:
    """JSON of a scene up to its lists."""
    return F.concat(F.lit("{"), _pairs([
        ("id", F.col("scene_id").cast("string")), ("name", _text("name")), ("textual", _text("textual")),
        ("chapter_id", F.col("chapter_id").cast("string"))]))


def scene_tail() -> Column:
    """JSON of a scene behind its lists."""
    told = ["inferred_location", "character_dynamics", "mood_and_atmosphere", "scene_content_type"]
    others = F.transform("branch.intersection_with", lambda x: F.coalesce(L.flat_json(x), F.lit("null")))
    branch = _object([("id", _flat("branch.id")), ("type", _text("branch.type")),
                      ("intersection_with", _array(others))])
    kind = F.col("timeline_marker.type")
    inner = ("inner_index", _flat("timeline_marker.inner_index"))
    target = [(c, _flat(f"timeline_marker.{c}")) for c in ("insert_chapter_id", "insert_scene_id")]
    more = ("extended_information", _flat("timeline_marker.extended_information"))
    typed = ("type", _text("timeline_marker.type"))
    marker = (
        F.when(kind == "INSERT_PAST", _object([typed, *target, inner]))
        .when(kind.isin("PAST", "FUTURE"), _object([typed, inner, more]))
        .otherwise(_object([typed]))
    )
    recalled = _object([("type", _text("information_marker.type"))])
    nothing = F.lit("")
    return F.concat(
        _pairs([*[(c, _text(c)) for c in told], ("branch", branch)]),
        F.when(kind.isNotNull(), F.concat(F.lit(',"timeline_marker":'), marker)).otherwise(nothing),
        F.when(F.col("information_marker").isNotNull(), F.concat(F.lit(',"information_marker":'), recalled))
        .otherwise(nothing),
        F.lit(","), _pairs(_times()), F.lit("}"))


def scene_parts(script: Script, size: int = C.PART_ROWS) -> DataFrame:
    """`project_id, scene_id, part, body`: scenes with their children, at most `size` of a kind per part.

    Part 0 describes the scene and opens its lists; later parts only go on with the lists.
    """
    pieces = C.listed(script.children, ["project_id", "scene_id", "kind"], "ordinal", "body", "items", size)
    lists = pieces.groupBy("project_id", "scene_id", "part").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("items"))).alias(c) for k, c in CHILD_LISTS.items()])
    empty = F.array().cast("array<string>")
    listed = [(c, _array(F.coalesce(F.col(c), empty))) for c in CHILD_LISTS.values()]
    # Each scene meets part 0 of its lists; later parts and scenes without children stay alone.
    first = script.scenes.withColumns({"part": F.lit(0).cast("long"), "told": F.lit(True)})
    joined = first.join(lists, ["project_id", "scene_id", "part"], "full")
    later = _object([("id", F.col("scene_id").cast("string")), *listed])
    return joined.select("project_id", "scene_id", "part",
                         F.when(F.col("told"), scene_body(listed)).otherwise(later).alias("body"))


def parts(script: Script, size: int = C.PART_ROWS) -> DataFrame:
    """The whole of every script: `project_id, section, item, part, body`.

    Timeline rows have the branch as item and the narrative index as part; branches have their first scene as part.
    """

    def rows(df: DataFrame, section: str, item: Column, part: Column, body: Column) -> DataFrame:
        return df.select(F.col("project_id").cast("string").alias("project_id"), F.lit(section).alias("section"),
                         item.cast("string").alias("item"), part.cast("long").alias("part"), body.alias("body"))

    zero, scene = F.lit(0), F.col("scene_id")
    entry = _object([("scene_id", scene.cast("string")), ("narrative_index", F.col("narrative_index").cast("string"))])
    kind = F.when(F.col("is_linear"), F.lit("linear")).otherwise(F.lit("multi_branch"))
    met = _object([("scene_id", scene.cast("string")), ("branches", F.col("branches"))])
    return (
        rows(script.totals, "project_metadata", F.lit(""), zero, metadata_body())
        .unionByName(rows(script.chapters, "chapter", F.col("chapter_id"), F.col("part"), chapter_body()))
        .unionByName(rows(scene_parts(script, size), "scene", scene, F.col("part"), F.col("body")))
        .unionByName(rows(script.branches, "branch", F.col("branch"), F.col("first_scene"),
                          _object([("type", T.json_text(kind))])))
        .unionByName(rows(script.timeline, "timeline", F.col("branch"), F.col("narrative_index"), entry))
        .unionByName(rows(script.intersections, "intersection", scene, zero, met))
    )


def document_pieces(script: Script) -> DataFrame:
    """Every document as short texts: `project_id, section, k1, k2, k3, opens, text`, ordered by section, k1, k2 and k3.

    Pieces that `opens` marks follow a comma unless they are the first of their section.
    """

    def rows(df: DataFrame, section: int | Column, text: Column, k1: Column | None = None, k2: int | Column = 0,
             k3: Column | None = None, opens: bool | Column = False) -> DataFrame:
        def column(value) -> Column:
            return value if isinstance(value, Column) else F.lit(value)

        return df.select(
            F.col("project_id").cast("string").alias("project_id"), column(section).cast("int").alias("section"),
            column(0 if k1 is None else k1).cast("long").alias("k1"), column(k2).cast("int").alias("k2"),
            column(0 if k3 is None else k3).cast("long").alias("k3"), column(opens).alias("opens"), text.alias("text"))

    chapter, first_part = F.col("chapter_id"), F.col("part") == 0
    ids = F.array_join(F.transform("scene_ids", lambda x: x.cast("string")), ",")
    begun = F.concat(_key(chapter), chapter_head(), ids)
    chapters = [
        rows(script.chapters, 1, F.when(first_part, begun).otherwise(F.concat(F.lit(","), ids)), chapter,
             k3=F.col("part"), opens=first_part),
        rows(script.chapters.filter(first_part), 1, F.lit("]}"), chapter, 1)]

    # A scene is told in five texts with its four lists between them.
    starts = [F.lit(f'{"]," if i else ","}"{name}":[') for i, name in enumerate(CHILD_LISTS.values())]
    texts = [F.concat(_key(F.col("scene_id")), scene_head(), starts[0]), *starts[1:],
             F.concat(F.lit("],"), scene_tail())]
    told = script.scenes.select("project_id", "scene_id", F.posexplode(F.array(*texts)).alias("place", "text"))
    place = F.create_map(*[F.lit(x) for i, kind in enumerate(CHILD_LISTS) for x in (kind, 2 * i + 1)])
    scenes = [
        rows(told, 3, F.col("text"), F.col("scene_id"), 2 * F.col("place"), opens=F.col("place") == 0),
        rows(script.children, 3, F.concat(_comma(F.col("ordinal") > 1), F.col("body")), F.col("scene_id"),
             place[F.col("kind")], F.col("ordinal"))]

    linear, branch = F.col("is_linear"), F.col("first_scene")
    named = script.branches.select("project_id", "branch", "first_scene", "is_linear")
    placed = join_hot(script.timeline, named, ["project_id", "branch"], right_at_most=1)
    number = F.col("narrative_index")
    entry = F.concat(_comma(number > 1), _key(F.col("scene_id")), F.lit('{"narrative_index":'), number.cast("string"),
                     F.lit("}"))
    several = named.filter(~linear)
    opened = F.concat(T.json_text(F.col("branch")), F.lit(':{"sequence":{'))
    branches = [rows(placed, 5, entry, branch, 1, number), rows(several, 5, opened, branch, opens=True),
                rows(several, 5, F.lit("}}"), branch, 2)]

    kinds = named.groupBy("project_id").agg(F.bool_and("is_linear").alias("is_linear"))
    meetings = join_hot(script.intersections, kinds.filter(~linear), ["project_id"], "left_semi")
    met = _object([("scene_id", F.col("scene_id").cast("string")), ("branches", F.col("branches"))])
    frame = {
        2: F.lit('},"scenes":{'),
        4: F.when(linear, '},"narrative_timeline":{"type":"linear","sequence":{')
        .otherwise('},"narrative_timeline":{"type":"multi_branch","branches":{'),
        6: F.when(linear, "}}}").otherwise('},"intersections":['),
        8: F.when(linear, "").otherwise("]}}")}
    between = kinds.select("project_id", F.inline(F.array(
        *[F.struct(F.lit(k).alias("section"), text.alias("text")) for k, text in frame.items()])))
    head = F.concat(F.lit('{"project_metadata":'), metadata_body(), F.lit(',"chapters":{'))
    return reduce(DataFrame.unionByName, [
        rows(script.totals, 0, head), *chapters, *scenes, *branches,
        rows(meetings, 7, met, F.col("scene_id"), opens=True), rows(between, F.col("section"), F.col("text"))])


def documents(script: Script, max_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """`project_id, position, text`: the nested script of every project in fragments of at most `max_bytes` bytes.

    The texts of a project, one after the other by position from 0, are its document. Each piece is placed by the bytes
    before it, which are summed over slices where a project is large, and cut where a fragment ends, between two
    characters; so no project, chapter, scene or text has to fit in a row. `max_bytes` must be 8 or more.
    """
    if max_bytes < 8:
        raise ValueError("a fragment needs eight bytes or more")
    group, order = ["project_id"], ["section", "k1", "k2", "k3"]
    # The pieces are written once, since they are also counted.
    spark, path = script.scenes.sparkSession, scratch_path(script.scenes.sparkSession, "pieces")
    document_pieces(script).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    top = largest_group(pieces, group)
    linked = with_previous(pieces, group, order, {"before": "section"}, at_most=top)
    follows = F.col("opens") & F.coalesce(F.col("before") == F.col("section"), F.lit(False))
    texts = linked.withColumn("text", F.concat(_comma(follows), F.col("text"))).filter("text <> ''").select(
        *group, *order, "text", F.octet_length("text").alias("size"))
    located = running_total(texts, group, order, "size", "at", at_most=top)
    # A character belongs to the fragment in which it begins, so up to three bytes of it lie beyond.
    step = max_bytes - 3
    ends = F.col("at") + F.col("size")
    spread = located.select(*group, "text", "size", "at", F.explode(F.sequence(
        F.floor(F.col("at") / step), F.floor((ends - 1) / step))).alias("position"))
    data = F.encode("text", "UTF-8")

    def cut(offset: Column) -> Column:
        """`offset` into the piece, moved on to where a character begins."""
        def inside(k: int) -> Column:
            return F.substring(data, offset.cast("int") + 1 + k, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))

        moved = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
        return F.when(offset <= 0, 0).when(offset >= F.col("size"), F.col("size")).otherwise(offset + moved)

    begin = F.col("position") * step - F.col("at")
    whole = (begin <= 0) & (begin + step >= F.col("size"))
    start, end = cut(begin), cut(begin + step)
    part = F.decode(F.substring(data, start.cast("int") + 1, (end - start).cast("int")), "UTF-8")
    parts = spread.select(*group, "position", "at", F.when(whole, F.col("text")).otherwise(part).alias("text"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "text")))
    return parts.groupBy(*group, "position").agg(
        F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"))


def metadata_body() -> Column:
    return _object([
        ("project_name", _text("project_name")),
        ("total_chapters", F.col("total_chapters").cast("string")),
        ("total_scenes", F.col("total_scenes").cast("string")),
        ("version", _text("version")), ("generation_date", _text("generation_date"))])


def chapter_body() -> Column:
    ids = F.transform("scene_ids", lambda x: x.cast("string"))
    return F.concat(chapter_head(), F.array_join(ids, ","), F.lit("]}"))


def chapter_head() -> Column:
    """JSON of a chapter up to its first scene id."""
    told = [("id", F.col("chapter_id").cast("string")), *[(c, _text(c)) for c in ("name", "textual", "source_file")]]
    return F.concat(F.lit("{"), _pairs(told), F.lit(',"scene_ids":['))


def branches_json() -> Column:
    """The branch of an intersection scene followed by those it meets, as a JSON list."""
    ids = F.concat(F.array("branch_id"), F.col("intersection_with"))
    return _array(F.transform(ids, lambda x: F.coalesce(L.flat_json(x), F.lit("null"))))


def _times() -> list[tuple[str, Column]]:
    return [("start_time", T.json_text(final_time(F.col("start_seconds")))),
            ("end_time", T.json_text(final_time(F.col("end_seconds"))))]


def _text(column: str) -> Column:
    return T.json_text(F.col(column))


def _flat(column: str) -> Column:
    return F.coalesce(L.flat_json(F.col(column)), F.lit("null"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _key(id_: Column) -> Column:
    return F.concat(F.lit('"'), id_.cast("string"), F.lit('":'))


def _comma(when: Column) -> Column:
    return F.when(when, ",").otherwise("")


def _pairs(fields: list[tuple[str, Column]]) -> Column:
    pieces = []
    for i, (name, value) in enumerate(fields):
        pieces += [F.lit(f'{"," if i else ""}"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*pieces)


def _object(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("{"), _pairs(fields), F.lit("}"))
