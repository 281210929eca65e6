"""The registered queries: one per operator group, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe import schemas
from storyframe.functions import labels as L
from storyframe.functions import text as T
from storyframe.functions.timecode import ass_seconds, final_time, label_seconds
from storyframe.operators import children as C
from storyframe.operators import regions as R
from storyframe.operators import rollup
from storyframe.operators import timeline as N
from storyframe.operators.intervals import interval_join
from storyframe.operators.skew import join_hot, largest_group
from storyframe.plans import blueprint, catalogue, ingest, rejects, script, search, status
from storyframe.session import cut_lineage, measured, scratch_path
from storyframe.sources import annotations as A
from storyframe.sources import listing as U
from storyframe.sources import sinks
from storyframe.sources import subtitles as S
from storyframe.sources import catalogue as tables
from storyframe.streaming import ingest as stream_ingest
from storyframe.streaming import status as stream_status
from workload import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
# Generation time of the scripts, fixed so that results can be compared.
GENERATED = "2024-06-01 12:00:00+00:00"
# Bytes of a fragment of a document.
FRAGMENT_BYTES = 2003
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


# Subtitles and time codes.


@query
def subtitle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.timed_events(S.parse_events(I.subtitle_lines(spark, sf_dir)))
    return events.withColumns({"start_time": final_time(F.col("start_seconds")),
                               "end_time": final_time(F.col("end_seconds"))}).drop("start_seconds", "end_seconds")


@query
def subtitle_section_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.with_file_chapter(S.parse_events(I.subtitle_lines(spark, sf_dir, fonts=True)))
    return events.select("project_id", "chapter_id", "line_no", "kind", "speaker", "content")


@query
def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written with one to four parts."""
    second = F.format_string("%02d.%02d", F.expr("s % 60"), F.expr("c % 100"))
    rows = I.table(spark, sf_dir, "events").selectExpr(
        "event_id", f"cast(floor({I.MICROS} / 10000) as bigint) AS c").withColumn("s", F.expr("c div 100"))
    text = (
        F.when(F.col("event_id") % 5 == 0, F.format_string("%d.%02d", "s", F.expr("c % 100")))
        .when(F.col("event_id") % 5 == 1, F.concat_ws(":", F.expr("cast(s div 60 as string)"), second))
        .when(F.col("event_id") % 5 == 2, F.concat_ws(
            ":", F.expr("cast(s div 3600 as string)"), F.format_string("%02d", F.expr("s div 60 % 60")), second))
        .when(F.col("event_id") % 5 == 3, F.concat_ws(":", F.lit("0"), F.lit("1"), F.lit("2"), second))
    )
    seconds = ass_seconds(text)
    return rows.select("event_id", text.alias("code"), F.round(seconds * 100).cast("bigint").alias("centis"),
                       seconds.alias("seconds"))


@query
def timecode_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN value * 1000.0005D "
                   "WHEN 3 THEN event_id / 2000 WHEN 4 THEN 59.9996D + 60 * (event_id % 100) "
                   "WHEN 5 THEN value / 7 ELSE value * 61.7D END")
    return I.table(spark, sf_dir, "events").select(
        "event_id", final_time(value).alias("time"), final_time(label_seconds(value)).alias("label_time"))


@query
def chapter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter, subtitle file and names for the upload name of every document."""
    name = F.expr("concat('deep', ' x-ep', CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '' END, "
                  "cast(doc_id % 120 AS string), CASE WHEN doc_id % 4 = 0 THEN ' ep9.mp4' ELSE '.mp4' END)")
    upload = F.when(F.col("doc_id") % 11 == 0, F.lit("EP3-trailer.mp4")).otherwise(name)
    rows = I.table(spark, sf_dir, "documents").select("doc_id", upload.alias("file_upload"))
    chapter = T.chapter_number(F.col("file_upload"))
    return rows.withColumn("chapter_id", chapter).filter("chapter_id IS NOT NULL").select(
        "doc_id", "chapter_id", T.subtitle_file(F.col("chapter_id")).alias("source_file"),
        T.numbered_name("Chapter", F.col("chapter_id")).alias("name"),
        T.stem_number(T.file_stem(F.col("file_upload"))).alias("digits"))


# Annotation results and regions.


@query
def label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.flattened(I.annotation_results(spark, sf_dir))
    return rows.select(
        "project_id", "region_id", "l_linenumber", "l_partkey", "l_suppkey", "from_name",
        F.col("flat.value").alias("value"), F.col("flat.is_number").alias("is_number"),
        L.described(F.col("flat")).alias("described"), L.flat_json(F.col("flat")).alias("literal"))


@query
def region_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = R.pivot_regions(I.annotation_results(spark, sf_dir))
    flats = [F.col(f"{a}.value").alias(a) for a in schemas.FLAT_ATTRIBUTES]
    texts = [_joined(F.col(a)).alias(a) for a in schemas.TEXT_ATTRIBUTES]
    return regions.select("project_id", "task_pos", "chapter_id", "inner_id", "region_id", "region_type",
                          "start_time", "end_time", *flats, *texts)


@query
def region_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = R.pivot_regions(I.annotation_results(spark, sf_dir))
    kinds = {"n_scenes": schemas.SCENE, "n_highlights": schemas.HIGHLIGHT, "n_cues": schemas.CUE}
    counts = [F.count_if(F.coalesce(F.col("region_type") == kind, F.lit(False))).alias(out)
              for out, kind in kinds.items()]
    return regions.groupBy("project_id").agg(*counts, F.count(F.lit(1)).alias("n_regions"))


def _region_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = I.annotation_results(spark, sf_dir)
    # No region has more results than its project, and no project more scenes.
    top = largest_group(results, ["project_id"])
    return R.scenes(R.pivot_regions(results, at_most=top), at_most=top)


@query
def scene_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _region_scenes(spark, sf_dir)
    return scenes.select("project_id", "scene_id", "chapter_id", "region_id", "name")


@query
def scene_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _region_scenes(spark, sf_dir)
    marker = F.col("timeline_marker")
    return scenes.select(
        "project_id", "scene_id", "name", "textual", "inferred_location", "character_dynamics", "mood_and_atmosphere",
        "scene_content_type", F.col("branch.id.value").alias("branch_id"), F.col("branch.type").alias("branch_type"),
        _joined(F.transform("branch.intersection_with", lambda x: F.coalesce(x["value"], F.lit("null"))))
        .alias("meets"),
        marker["type"].alias("marker"), marker["insert_chapter_id"]["value"].alias("insert_chapter_id"),
        marker["insert_scene_id"]["value"].alias("insert_scene_id"),
        marker["extended_information"]["value"].alias("extended_information"),
        F.col("information_marker.type").alias("information"))


@query
def highlight_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.highlights(R.pivot_regions(I.annotation_results(spark, sf_dir)))
    return found.select(
        "project_id", "chapter_id", "region_id", final_time(F.col("start_seconds")).alias("start_time"),
        *[F.col(f"{c}.value").alias(f"highlight_{c}") for c in ("id", "type", "description", "mood")])


@query
def cue_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.cues(R.pivot_regions(I.annotation_results(spark, sf_dir)))
    return found.select("project_id", "chapter_id", "region_id", "cue_no", "type", "value")


@query
def annotations_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation text per order, merged per customer; orders without one are skipped."""
    assets = I.assets(spark, sf_dir)
    bodies = I.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS asset_id",
        """CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('{"inner_id":', cast(o_orderkey AS string),
           ',"file_upload":"x-ep', cast(o_orderkey % 30 AS string), '.mp4","annotations":[{"result":[{"id":"r',
           cast(o_custkey AS string), '","from_name":"highlight_id","value":{"number":',
           cast(o_orderkey % 9 AS string), '}}]},{"result":[]}]}') END AS body""")
    tasks, _ = A.merged_tasks(assets, bodies)
    return A.results(tasks).select("project_id", "task_pos", "inner_id", "file_upload", "region_id", "value_json")


@query
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results from one JSON array per customer, read in blocks that are smaller than most tasks."""
    root = I.placed_files(I.exports(spark, sf_dir), scratch_path(spark, "exports"))
    return A.results(A.read_exports(spark, root, block_bytes=200)).select(
        "project_id", "inner_id", "file_upload", "region_id", "value_json")


@query
def annotation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose value list is empty, among those of all line items."""
    rows = I.annotation_results(spark, sf_dir)
    broken = F.expr("""CASE WHEN l_partkey % 9 = 1 THEN replace(value_json, '"choices":[', '"choices":[],"x":[')
                       WHEN l_partkey % 9 = 2 THEN replace(value_json, '"labels":[', '"labels":[],"x":[')
                       WHEN l_partkey % 9 = 3 THEN '"text"' ELSE value_json END""")
    found = rejects.result_rejects(rows.withColumn("value_json", broken).withColumn(
        "result_pos", F.col("l_linenumber")))
    return found.groupBy("project_id", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


# Interval joins.


def _scene_children(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    scenes = I.scenes(spark, sf_dir)
    events = I.spoken(spark, sf_dir).filter(F.col("kind") == kind)
    attached = C.attach(scenes, events, ["line_no"], same_chapter=True)
    rows = C.with_empty(scenes.select("project_id", "scene_id"), attached)
    placed = F.col("ordinal").isNotNull()
    return rows.select(
        "project_id", "scene_id", "ordinal", "speaker", "content",
        F.when(placed, final_time(F.col("start_seconds"))).alias("start_time"),
        F.when(placed, final_time(F.col("end_seconds"))).alias("end_time"))


@query
def scene_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_children(spark, sf_dir, "dialogue")


@query
def scene_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_children(spark, sf_dir, "caption").drop("speaker")


@query
def scene_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    highlights, _ = I.marked(spark, sf_dir)
    attached = C.attach(I.scenes(spark, sf_dir), highlights.withColumn("kind", F.lit("highlight")),
                        R.REGION_ORDER, same_chapter=False)
    return attached.select("project_id", "scene_id", "ordinal", F.col("id.value").alias("highlight_id"),
                           final_time(F.col("start_seconds")).alias("start_time"))


@query
def scene_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cues = I.marked(spark, sf_dir)
    attached = C.attach(I.scenes(spark, sf_dir), cues.withColumn("kind", F.lit("narrative_cue")),
                        [*R.REGION_ORDER, "cue_no"], same_chapter=False)
    return attached.select("project_id", "scene_id", "ordinal", "type", "value")


@query
def scene_highlights_in_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    highlights, _ = I.marked(spark, sf_dir)
    attached = C.attach(I.scenes(spark, sf_dir), highlights.withColumn("kind", F.lit("highlight")),
                        R.REGION_ORDER, same_chapter=True)
    return attached.select("project_id", "scene_id", "ordinal", F.col("id.value").alias("highlight_id"))


@query
def interval_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks per scene from the bare interval join."""
    scenes = I.scenes(spark, sf_dir).select("project_id", "scene_id", F.col("start_seconds").alias("scene_start"),
                                            F.col("end_seconds").alias("scene_end"))
    highlights, cues = I.marked(spark, sf_dir)
    points = highlights.select("project_id", "event_id", "start_seconds").unionByName(
        cues.select("project_id", "event_id", "start_seconds"))
    found = interval_join(scenes, points, ["project_id"], "scene_start", "scene_end", "start_seconds")
    return found.groupBy("project_id", "scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.sum("event_id").alias("event_sum"))


@query
def scene_child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered child lists of each scene in parts of fifty."""
    attached = C.attach(I.scenes(spark, sf_dir), I.spoken(spark, sf_dir), ["line_no"], same_chapter=True)
    ids = attached.withColumn("line", F.col("line_no").cast("string"))
    lists = C.listed(ids, ["project_id", "scene_id", "kind"], "ordinal", "line", "lines", size=50)
    return lists.select("project_id", "scene_id", "kind", "part", _joined(F.col("lines")).alias("lines"))


# Chapters, totals, timeline, script.


@query
def chapter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.chapters(I.scenes(spark, sf_dir, "true"))
    return found.withColumn("scene_ids", _joined(F.transform("scene_ids", lambda x: x.cast("string")), ","))


@query
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.project_totals(I.scenes(spark, sf_dir, "true"), GENERATED)


@query
def timeline_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.narrative_order(I.timeline_scenes(spark, sf_dir), ["project_id"])


@query
def timeline_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("branch_number").cast("string")
    scenes = I.timeline_scenes(spark, sf_dir).withColumns({"branch_key": number, "branch_name": number})
    placed = N.narrative_order(scenes)
    lists = script.branches(scenes).select("project_id", "branch_key", "branch", "is_linear")
    return join_hot(lists, placed, N.LIST_KEY, "left", left_at_most=1).select(
        "project_id", "branch", "is_linear", "scene_id", "narrative_index")


@query
def timeline_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of projects whose inserts lack ranks."""
    return N.narrative_order(cut_lineage(I.incomplete_scenes(spark, sf_dir)), ["project_id"])


@query
def timeline_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts that cannot be placed for want of a rank."""
    return rejects.insert_rejects(cut_lineage(I.incomplete_scenes(spark, sf_dir)), ["project_id"])


@query
def timeline_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(text: str) -> Column:
        return F.struct(F.lit(text).alias("value"), F.lit(True).alias("is_number"))

    met = F.when(F.col("meets"), F.array(number("1"))).otherwise(F.array().cast(f"array<{L.FLAT}>"))
    scenes = I.timeline_scenes(spark, sf_dir).withColumns({"branch_id": number("0"), "intersection_with": met})
    return N.intersections(scenes).select("project_id", "scene_id", script.branches_json().alias("branches"))


def _script(spark: SparkSession, sf_dir: str) -> script.Script:
    highlights, cues = I.marked(spark, sf_dir)
    return script.assemble(I.described_scenes(spark, sf_dir), I.spoken(spark, sf_dir), highlights, cues, GENERATED)


@query
def script_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every script as JSON text."""
    return script.parts(_script(spark, sf_dir))


@query
def script_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script as one nested document, in fragments small enough that each takes several."""
    return script.documents(_script(spark, sf_dir), FRAGMENT_BYTES)


@query
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of every script, read back from the files they were written to."""
    path = scratch_path(spark, "documents")
    sinks.write_documents(script_documents(spark, sf_dir), path)
    return sinks.read_documents(spark, path)


def _blueprint(spark: SparkSession, sf_dir: str) -> blueprint.Blueprint:
    needed = ["asset_id", "media_id", "sequence_number", "l1_output_file"]
    episodes = measured(I.assets(spark, sf_dir).select(needed), "episodes")
    return blueprint.blueprint(episodes, I.annotation_bodies(episodes), I.episode_lines(episodes), GENERATED)


@query
def blueprint_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes and dialogue of scripts built from the catalogue."""
    built = _blueprint(spark, sf_dir).script
    scenes = built.scenes.select("project_id", "scene_id", "chapter_id", "region_id")
    children = built.children.select("project_id", "scene_id", "ordinal", "body")
    return scenes.join(children, ["project_id", "scene_id"], "left")


@query
def blueprint_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = I.assets(spark, sf_dir)
    return blueprint.mismatches(S.renumbered(episodes), I.annotation_bodies(episodes))


# Catalogue and ingestion.


@query
def upload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.videos(I.files(spark, sf_dir)).select("media_id", "name", "stem", "ext", "ext_rank", "sequence_number")


@query
def video_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.video_counts(I.files(spark, sf_dir))


@query
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan(I.files(spark, sf_dir), I.existing_assets(spark, sf_dir))


@query
def assets_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes of the orders after an ingest run over the listing."""
    existing = cut_lineage(I.catalogue_episodes(spark, sf_dir))
    merged = ingest.merged_assets(existing, cut_lineage(ingest.plan(I.files(spark, sf_dir), existing)))
    return merged.select("media_id", "sequence_number", "asset_id", "title", "l1_status", "l2_l3_status",
                         "l1_output_file", "annotation_task_id", "processing_status", "processed_video_url",
                         "source_subtitle_url")


@query
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a work per customer after an ingest run, with a folder for each work of the listing."""
    works = I.table(spark, sf_dir, "customer").selectExpr("concat('src', cast(c_custkey AS string)) AS media_id")
    return ingest.media_status(works, I.files(spark, sf_dir))


@query
def subtitle_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = I.assets(spark, sf_dir).withColumn("sequence_number", F.expr("sequence_number * 3 - 2"))
    return S.renumbered(assets).select("media_id", "asset_id", "position", "chapter_file")


@query
def subtitle_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation uploads its text for the order of that number; short turns count as empty."""
    turns = I.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id + 1 AS asset_id", "CASE WHEN length(text) < 40 THEN '' ELSE text END AS body")
    return ingest.subtitle_upload(I.assets(spark, sf_dir), turns).select("asset_id", "l1_status", "l1_output_file")


@query
def task_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.task_manifest(I.assets(spark, sf_dir))


@query
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling tasks of all episodes, read back from the files they were written to."""
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(sinks.task_manifest(I.assets(spark, sf_dir)), path)
    return sinks.read_manifest(spark, path)


@query
def media_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.media_listing(I.media(spark, sf_dir)).select("media_id", "title", "position")


@query
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalogue.asset_listing(I.assets(spark, sf_dir), I.media(spark, sf_dir))
    return listed.select("asset_id", "media_id", "label", "position")


@query
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = catalogue.with_media(I.assets(spark, sf_dir), I.media(spark, sf_dir))
    found = catalogue.searched(catalogue.faceted(joined, l1_status="completed"), "EPISODE customer 9",
                               ["title", "media_title"])
    return found.select("asset_id", "media_id", "title", "media_title")


@query
def catalog_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the searches of all suppliers find among all episodes, through the index; those of equal words are made once."""
    rows = measured(catalogue.with_media(I.assets(spark, sf_dir), I.media(spark, sf_dir)).select(
        "asset_id", "title", "media_title"), "rows")
    fields = ["title", "media_title"]
    postings = measured(search.index(rows, "asset_id", fields), "postings")
    asked = I.searches(spark, sf_dir).select("query_id", search.normal(F.col("query")).alias("query"))
    made = asked.select(F.col("query").alias("query_id"), "query").distinct()
    found = search.search(made, rows, postings, "asset_id", fields)
    counted = found.groupBy(F.col("query_id").alias("query")).agg(
        F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("first_asset"), F.sum("asset_id").alias("asset_sum"))
    return asked.join(counted, "query").groupBy("query_id").agg(
        F.sum("n").alias("n"), F.min("first_asset").alias("first_asset"), F.sum("asset_sum").alias("asset_sum"))


@query
def catalogue_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes that the conversations name, from a table in buckets."""
    path = scratch_path(spark, "catalogue")
    tables.write_table(I.assets(spark, sf_dir), path, "asset_id", buckets=32)
    ids = I.table(spark, sf_dir, "conversations").selectExpr("3 * conv_id + 1 AS asset_id")
    return tables.by_ids(spark, path, ids, "asset_id", buckets=32).select("asset_id", "media_id", "title", "l1_status")


@query
def catalogue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes after uploads of subtitles and some new episodes were put into the table, twice."""
    path = scratch_path(spark, "catalogue")
    episodes = I.assets(spark, sf_dir).select("asset_id", "media_id", "title", "l1_status", "l1_output_file")
    tables.write_table(episodes, path, "asset_id", buckets=32)
    turns = I.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id + 1 AS asset_id", "CASE WHEN length(text) < 40 THEN '' ELSE text END AS body")
    before = tables.read_table(spark, path)
    done = ingest.subtitle_upload(before, turns).join(turns.filter("body <> ''").select("asset_id"), "asset_id", "left_semi")
    new = I.table(spark, sf_dir, "supplier").selectExpr(
        "-1 - s_suppkey AS asset_id", "s_suppkey AS media_id", "s_name AS title", "'pending' AS l1_status",
        "cast(NULL AS string) AS l1_output_file")
    changed = cut_lineage(done.unionByName(new))
    for _ in range(2):
        tables.upsert(spark, path, changed, "asset_id", buckets=32)
    return tables.read_table(spark, path)


@query
def asset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = catalogue.with_links(I.assets(spark, sf_dir), I.media(spark, sf_dir))
    return linked.select("asset_id", "editor_url", "task_url", "project_url")


@query
def workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.media_action(I.media(spark, sf_dir)).select("media_id", "ingestion_status", "action")


@query
def asset_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = catalogue.with_links(I.assets(spark, sf_dir), I.media(spark, sf_dir))
    return catalogue.asset_actions(linked).select("asset_id", "subtitle_action", "annotation_action")


@query
def invalid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works and episodes with valid states, empty ones, and invalid ones in one or several columns."""
    works = I.media(spark, sf_dir).withColumns({
        "media_type": F.expr("CASE media_id % 4 WHEN 0 THEN media_type WHEN 1 THEN 'movie' WHEN 2 THEN 'short_drama' END"),
        "ingestion_status": F.expr("CASE WHEN media_id % 6 = 0 THEN 'lost' ELSE ingestion_status END")})
    episodes = I.assets(spark, sf_dir).withColumns({
        "l1_status": F.expr("CASE asset_id % 5 WHEN 0 THEN 'Completed' WHEN 1 THEN NULL ELSE l1_status END"),
        "l2_l3_status": F.expr("CASE WHEN asset_id % 7 = 0 THEN '' ELSE l2_l3_status END")})
    found = [tables.invalid_values(rows).select(F.col(id_).alias("row_id"), _joined(F.col("invalid"), ",").alias("invalid"))
             for rows, id_ in ((works, "media_id"), (episodes, "asset_id"))]
    return found[0].unionByName(found[1])


# Status history and streams.


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.status_log(I.table(spark, sf_dir, "events"))


# The statuses of an episode.
STATUSES = ["processing_status", "l1_status", "l2_l3_status"]


def _tracked(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> str:
    """The folder of a stream that has followed `columns` of the log over several micro-batches, one per wave."""
    folder = scratch_path(spark, name)
    log = stream_status.filled(_log(spark, sf_dir))
    lateness, files = I.arrived_log(log, f"{folder}/log")
    waves = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")
    stream_status.track(waves, folder, columns, lateness).awaitTermination()
    return folder


@query
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.changes(_log(spark, sf_dir)).select("asset_id", "ts", "seq", "status", "previous_status")


@query
def status_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.change_stamps(_log(spark, sf_dir), ["status", "processing_status"])


@query
def trigger_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.triggers(_log(spark, sf_dir)).select("asset_id", "ts", "seq", "source_video")


@query
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three statuses of each episode and the times of their last changes, from saves that overtake each other."""
    return stream_status.latest(spark, _tracked(spark, sf_dir, "status", STATUSES), STATUSES)


@query
def trigger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_status.triggers(spark, _tracked(spark, sf_dir, "trigger", ["source_video"]))


@query
def listing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files of the works of all customers, from real folders."""
    root = I.upload_folders(spark, sf_dir, scratch_path(spark, "uploads"))
    works = I.table(spark, sf_dir, "customer").selectExpr("concat('src', cast(c_custkey AS string)) AS media_id")
    return U.list_folders(works, root)


@query
def ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of an ingest run over the same folders."""
    folders = cut_lineage(listing_files(spark, sf_dir))
    planned = ingest.plan(folders.filter("name IS NOT NULL"), I.existing_assets(spark, sf_dir))
    return ingest.run_states(folders, planned)


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from files that arrive in two waves: first all but the second videos, then these."""
    folder = scratch_path(spark, "ingest")
    listed = I.landed(I.files(spark, sf_dir).selectExpr("concat(media_id, '/', name) AS path", "'x' AS body"), "path")
    nested = listed.selectExpr("concat(regexp_extract(path, '^[^/]+', 0), '/sub/ep77.mp4') AS path", "'y' AS body").distinct()
    existing = I.existing_assets(spark, sf_dir)
    first = F.col("path").endswith(".mov")
    for wave in (listed.filter(~first).unionByName(nested), listed.filter(first)):
        I.placed_files(wave, f"{folder}/uploads")
        arriving = stream_ingest.file_stream(spark, f"{folder}/uploads")
        stream_ingest.ingest_stream(arriving, existing, f"{folder}/state").awaitTermination()
    return stream_ingest.planned_assets(spark, existing, f"{folder}/state")
