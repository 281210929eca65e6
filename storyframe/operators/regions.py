"""From annotation results to regions, scenes, highlights and narrative cues.

Results are rows `project_id, task_pos, inner_id, file_upload, result_pos, region_id, from_name, value_json`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe import schemas as S
from storyframe.functions import labels as L
from storyframe.functions import text as T
from storyframe.functions.timecode import label_seconds
from storyframe.operators.skew import numbered
from storyframe.session import hot_rows

REGION_KEY = ["project_id", "task_pos", "region_id"]
# Order in which the regions of a project are visited.
REGION_ORDER = ["inner_id", "task_pos", "start_seconds", "first_pos"]
_EMPTY_JSON = r'^\s*(\{\s*\}|\[\s*\]|""|null|false|-?0+(\.0*)?)?\s*$'


def valid_results(results: DataFrame) -> DataFrame:
    """Results with a region, an attribute name and a non-empty value."""
    return results.filter(
        (F.coalesce("region_id", F.lit("")) != "")
        & (F.coalesce("from_name", F.lit("")) != "")
        & F.col("value_json").isNotNull()
        & ~F.col("value_json").rlike(_EMPTY_JSON)
    )


def with_chapter(results: DataFrame) -> DataFrame:
    """Keep tasks whose upload names an episode and add its number."""
    numbered_tasks = results.withColumn("chapter_id", T.chapter_number(F.col("file_upload")))
    return numbered_tasks.filter("chapter_id IS NOT NULL").withColumn("inner_id", F.coalesce("inner_id", F.lit(0)))


def flattened(results: DataFrame) -> DataFrame:
    """Add `flat`, the flattened value, and `parsed`, the fields of the value."""
    parsed = valid_results(results).withColumn("parsed", L.parsed_value(F.col("value_json")))
    return parsed.withColumn("flat", L.flat_value(F.col("value_json"), F.col("parsed")))


def pivot_regions(results: DataFrame, at_most: int | None = None) -> DataFrame:
    """One row per region, the last value of each attribute winning.

    Results are first brought down to the last one per region and attribute. The vocabulary is fixed and other
    names share one entry, so a region then has a bounded number of rows, however many results it had. If `at_most`, a bound
    on the results of a region, tells that none is hot, results are shuffled by region once, before both steps.
    """
    pos, parsed = F.col("result_pos"), F.col("parsed")
    name = F.col("from_name")
    known = name.isin("region_type", *S.FLAT_ATTRIBUTES, *S.TEXT_ATTRIBUTES)
    timed = parsed["start"].isNotNull() & parsed["end"].isNotNull()
    rows = flattened(with_chapter(results)).select(
        *REGION_KEY, "inner_id", "chapter_id", "result_pos",
        F.when(known, name).otherwise("").alias("name"),
        F.when(timed, F.struct(parsed["start"].alias("start"), parsed["end"].alias("end"))).alias("span"),
        # of a value, what its attribute is read for
        F.struct(F.when(name.isin(S.FLAT_ATTRIBUTES), F.col("flat")).alias("flat"),
                 F.when(name == "region_type", parsed["labels"]).alias("labels"),
                 F.when(name.isin(S.TEXT_ATTRIBUTES), parsed["text"]).alias("texts")).alias("value"),
    )
    if at_most is not None and at_most <= hot_rows(results.sparkSession):
        rows = rows.repartition(*REGION_KEY)
    rows = rows.withColumn("times", F.when(F.col("span").isNotNull(), F.struct(
        pos.alias("pos"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))))
    task = [F.min("inner_id").alias("inner_id"), F.min("chapter_id").alias("chapter_id")]
    last = rows.groupBy(*REGION_KEY, "name").agg(
        *task, F.min("result_pos").alias("first_pos"), F.max("times").alias("times"),
        F.max_by("value", "result_pos").alias("value"))
    regions = last.groupBy(*REGION_KEY).agg(
        *task, F.min("first_pos").alias("first_pos"), F.max("times").alias("times"),
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))

    def value(name: str) -> Column:
        return F.try_element_at("values", F.lit(name))

    start, end = F.col("times.start").try_cast("double"), F.col("times.end").try_cast("double")
    return regions.select(
        *REGION_KEY, "inner_id", "chapter_id", "first_pos", start.alias("start_time"), end.alias("end_time"),
        label_seconds(start).alias("start_seconds"), label_seconds(end).alias("end_seconds"),
        L.region_label(value("region_type")["labels"]).alias("region_type"),
        *[value(a)["flat"].alias(a) for a in S.FLAT_ATTRIBUTES],
        *[value(a)["texts"].alias(a) for a in S.TEXT_ATTRIBUTES],
    )


def routed(regions: DataFrame, region_type: str) -> DataFrame:
    return regions.filter(F.col("region_type") == region_type)


def scenes(regions: DataFrame, at_most: int | None = None) -> DataFrame:
    """Scenes of every project, numbered across its chapters in region order.

    `at_most` bounds the scenes of a project; the number of its annotation results will do.
    """
    ranked = numbered(routed(regions, S.SCENE), ["project_id"], REGION_ORDER, "scene_id", at_most)
    return ranked.select(
        "project_id", "scene_id", "chapter_id", "region_id", "start_seconds", "end_seconds", *scene_columns()
    )


def scene_columns() -> list[Column]:
    """Descriptive columns and marker structs of a scene, from its number and attributes."""
    number = F.col("scene_id")
    return [
        T.numbered_name("Scene", number).alias("name"),
        T.numbered_name("Scene", number, " ").alias("textual"),
        L.described(F.col("scene_location")).alias("inferred_location"),
        L.described(F.col("scene_character_dynamics")).alias("character_dynamics"),
        L.described(F.col("scene_mood_and_atmosphere")).alias("mood_and_atmosphere"),
        L.described(F.col("scene_content_type")).alias("scene_content_type"),
        branch_struct().alias("branch"),
        timeline_marker().alias("timeline_marker"),
        information_marker().alias("information_marker"),
    ]


def branch_struct() -> Column:
    kind = F.col("narrative_branch_type.value")
    none = F.array().cast(f"array<{L.FLAT}>")

    def branch(id_: Column, type_: str, others: Column) -> Column:
        return F.struct(id_.alias("id"), F.lit(type_).alias("type"), others.alias("intersection_with"))

    main = F.struct(F.lit("0").alias("value"), F.lit(True).alias("is_number"))
    return (
        F.when(kind == "BRANCH", branch(F.col("branch_id"), "multi_branch", none))
        .when(kind == "INTERSECTION",
              branch(F.col("branch_intersection_x"), "multi_branch", F.array("branch_intersection_y")))
        .otherwise(branch(main, "linear", none))
    )


def timeline_marker() -> Column:
    """Null unless the marker type is a known one; fields a type does not use are null."""
    kind = _marker_type()
    nothing = F.lit(None).cast(L.FLAT)
    insert = kind == "INSERT_PAST"
    inner = (
        F.when(insert, F.col("insert_past_inner_index"))
        .when(kind == "PAST", F.col("past_inner_index"))
        .when(kind == "FUTURE", F.col("future_inner_index"))
    )
    more = F.when(kind == "PAST", F.col("past_description")).when(kind == "FUTURE", F.col("future_description"))
    return F.when(kind.isin(S.TIMELINE_MARKERS), F.struct(
        kind.alias("type"),
        F.when(insert, F.col("insert_past_chapter")).otherwise(nothing).alias("insert_chapter_id"),
        F.when(insert, F.col("insert_past_scene")).otherwise(nothing).alias("insert_scene_id"),
        inner.alias("inner_index"),
        more.alias("extended_information"),
    ))


def information_marker() -> Column:
    return F.when(_marker_type() == "REFERENCE", F.struct(F.lit("RECALL").alias("type")))


def _marker_type() -> Column:
    marker = F.col("scene_timeline_marker_type")
    return F.when(~marker["is_number"], marker["value"])


def highlights(regions: DataFrame) -> DataFrame:
    return routed(regions, S.HIGHLIGHT).select(
        "project_id", "chapter_id", "region_id", *_marks_order(), "start_seconds", "end_seconds",
        F.col("highlight_id").alias("id"), F.col("highlight_type").alias("type"),
        F.col("highlight_description").alias("description"), F.col("highlight_mood").alias("mood"),
    )


def cues(regions: DataFrame) -> DataFrame:
    """One row per non-empty text: all key information first, then the objects."""

    def entries(column: str, kind: str) -> Column:
        filled = F.filter(F.col(column), lambda x: F.coalesce(x, F.lit("")) != "")
        listed = F.transform(filled, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))
        return F.coalesce(listed, F.array().cast("array<struct<type:string,value:string>>"))

    both = F.concat(entries("key_information_summary", "Key_Information"), entries("object_name", "Object"))
    return routed(regions, S.CUE).select(
        "project_id", "chapter_id", "region_id", *_marks_order(), "start_seconds", "end_seconds",
        F.posexplode(both).alias("cue_no", "cue"),
    ).select("*", "cue.type", "cue.value").drop("cue")


def _marks_order() -> list[str]:
    return [c for c in REGION_ORDER if c != "start_seconds"]
