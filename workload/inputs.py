"""Library inputs derived from whole test tables; of `events`, some queries give each type a role of its own.

Projects are groups of ten users, customers or runs of orders, so their number grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.functions.labels import FLAT
from storyframe.operators.regions import scene_columns
from storyframe.operators.skew import largest_group, numbered, with_previous
from storyframe.session import cut_lineage
from storyframe.sources.listing import file_system, qualified


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(rows: DataFrame, *keys: str) -> DataFrame:
    """Write derived rows as an importer would, so that queries read plain columns and not the derivation.

    A table of few row groups is first spread over the cores.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows.rdd.getNumPartitions() < cores
    return cut_lineage(rows.repartition(cores, *keys) if few else rows)


# Microseconds since the start of 2024.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"
FIELDS = ["project_id", "chapter_id"]


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.selectExpr(
        "cast(floor(user_id / 10) as bigint) AS project_id", "user_id % 10 + 1 AS chapter_id", "event_id",
        f"{MICROS} AS us", f"{MICROS} / cast(1000000 as double) AS start_seconds", "user_id", "event_type", "value",
        "props")


def scenes(spark: SparkSession, sf_dir: str, when: str = "event_type = 'purchase'") -> DataFrame:
    """A scene per purchase, lasting until the next purchase of the user; the last of each user has no end."""
    bought = _marks(spark, sf_dir).filter(when).drop("event_type")
    top = largest_group(bought, ["project_id"])
    ended = with_previous(bought, ["user_id"], ["us", "event_id"], {"end_seconds": "start_seconds"}, descending=True,
                          at_most=top)
    filled = ended.withColumn("end_seconds", F.coalesce("end_seconds", F.lit(0.0)))
    return cut_lineage(numbered(filled, ["project_id"], ["chapter_id", "us", "event_id"], "scene_id", at_most=top))


def described_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with attributes, branches in every other project, and timeline markers."""

    def flat(text: str | None, is_number: bool = False) -> Column:
        if text is None:
            return F.lit(None).cast(FLAT)
        value = F.expr(text).cast("string")
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(is_number).alias("is_number")))

    attributes = {
        "scene_location": flat("CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END"),
        "scene_character_dynamics": flat("concat('u', user_id)"),
        "scene_content_type": flat(None),
        "scene_mood_and_atmosphere": flat("CASE WHEN value < 5 THEN '' ELSE 'Calm' END"),
        "narrative_branch_type": flat(
            "CASE WHEN project_id % 2 = 0 THEN 'NONE' WHEN event_id % 3 = 0 THEN 'BRANCH' "
            "WHEN event_id % 3 = 1 THEN 'INTERSECTION' END"),
        "branch_id": flat("event_id % 2", True),
        "branch_intersection_x": flat("event_id % 4", True),
        "branch_intersection_y": flat("1 + event_id % 5", True),
        "scene_timeline_marker_type": flat(
            "CASE event_id % 8 WHEN 0 THEN 'START' WHEN 1 THEN 'INSERT_PAST' WHEN 2 THEN 'INSERT_PAST' "
            "WHEN 3 THEN 'FORWARD' WHEN 4 THEN 'REFERENCE' WHEN 5 THEN 'PAST' WHEN 6 THEN 'FUTURE' END"),
        "insert_past_chapter": flat("1 + event_id % 3", True),
        "insert_past_scene": flat("1 + event_id % 60", True),
        "insert_past_inner_index": flat("1 + event_id % 2", True),
        "past_inner_index": flat("event_id % 9", True),
        "past_description": flat("concat('ago ', user_id)"),
        "future_inner_index": flat("event_id % 7", True),
        "future_description": flat(None),
    }
    rows = scenes(spark, sf_dir).withColumns(attributes)
    return cut_lineage(rows.select(*FIELDS, "scene_id", "start_seconds", "end_seconds", *scene_columns()))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as dialogue, clicks as captions."""
    kind = F.when(F.col("event_type") == "click", "caption").otherwise("dialogue")
    rows = _marks(spark, sf_dir).filter("event_type IN ('view', 'click')")
    return rows.select(
        *FIELDS, kind.alias("kind"), F.col("event_id").alias("line_no"), "start_seconds",
        (F.col("start_seconds") + F.col("value")).alias("end_seconds"),
        F.when(kind == "dialogue", F.col("event_type")).alias("speaker"), F.col("props").alias("content"))


def marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Errors as highlights, sign-ups as narrative cues."""
    rows = _marks(spark, sf_dir).select(
        *FIELDS, "event_type", "event_id", "value", "start_seconds", (F.col("start_seconds") + 2).alias("end_seconds"), "props",
        F.lit(0).cast("long").alias("inner_id"), F.col("user_id").alias("task_pos"),
        F.col("event_id").alias("first_pos"))

    def flat(text: str, is_number: bool = False) -> Column:
        return F.struct(F.expr(text).cast("string").alias("value"), F.lit(is_number).alias("is_number"))

    highlights = rows.filter("event_type = 'error'").withColumns({
        "id": flat("event_id", True), "type": flat("'Action Clip'"), "description": flat("props"),
        "mood": F.lit(None).cast(FLAT)})
    cues = rows.filter("event_type = 'signup'").withColumns({
        "cue_no": F.lit(0), "type": F.expr("CASE WHEN event_id % 4 = 1 THEN 'Object' ELSE 'Key_Information' END"),
        "value": F.concat(F.lit("v"), F.col("event_id").cast("string"))})
    return highlights, cues


def subtitle_lines(spark: SparkSession, sf_dir: str, fonts: bool = False) -> DataFrame:
    """A subtitle file per conversation and a dialogue line per turn.

    With `fonts` every third file closes its events after the second turn, and the next third repeats the header.
    """
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "10 * turn AS line_no",
        r"""concat('Dialogue: 0,0:00:', lpad(cast(turn * 5 AS string), 2, '0'), '.00,0:00:',
            lpad(cast(turn * 5 + 4 AS string), 2, '0'), '.50,Default,',
            CASE WHEN role = 'system' THEN 'Caption' ELSE role END, ',0,0,0,,',
            replace(text, chr(10), concat(chr(92), 'N'))) AS line""")
    files = turns.select("conv_id").distinct()
    extra = [(-30, "'[Script Info]'", "true"), (-20, "' [Events] '", "true"), (-10, "'Format: Layer'", "true")]
    if fonts:
        extra += [(15, "'[Fonts]'", "conv_id % 3 = 0"), (25, "'[events]'", "conv_id % 3 = 0"),
                  (15, "'[EVENTS]'", "conv_id % 3 = 1")]
    for number, line, when in extra:
        turns = turns.unionByName(files.filter(when).selectExpr(
            "conv_id", f"cast({number} AS bigint) AS line_no", f"{line} AS line"))
    return landed(turns.selectExpr(
        "cast(floor(conv_id / 10) as bigint) AS project_id",
        "concat(lpad(cast(conv_id % 10 + 1 AS string), 2, '0'), '.ass') AS chapter_file", "line_no", "line"),
        "project_id", "chapter_file", "line_no")


# Annotation results from line items: a region per order, eight orders per task, five tasks per project.
def _pick(column: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({column} % {len(values)} AS int) + 1)"


TEXT_NAME = _pick("l_partkey", "scene_location", "scene_character_dynamics", "highlight_description",
                  "key_information_summary", "object_name", "past_description")
NUMBER_NAME = _pick("l_partkey", "branch_id", "branch_intersection_x", "branch_intersection_y", "insert_past_chapter",
                    "insert_past_scene", "highlight_id")
CHOICE_NAME = _pick("l_partkey", "scene_content_type", "scene_mood_and_atmosphere", "narrative_branch_type",
                    "scene_timeline_marker_type", "highlight_type", "highlight_mood")
NAME = f"""CASE l_linenumber % 3 WHEN 0 THEN 'region_type' WHEN 2 THEN {CHOICE_NAME}
  ELSE CASE WHEN l_suppkey % 2 = 0 THEN {TEXT_NAME} ELSE {NUMBER_NAME} END END"""
LABEL = _pick("l_partkey", *["场景/Scene"] * 5, "高光/Highlight", "叙事线索/NARRATIVE_CUE", "Other")
BRANCH = _pick("l_suppkey", "无/NONE", "分支/BRANCH", "交叉/INTERSECTION")
MARKER = _pick("l_suppkey", "开始/START", "插入/INSERT_PAST", "预叙/FORWARD", "引用/REFERENCE", "过去/PAST", "Other")
CHOICE = f"""CASE l_partkey % 6 WHEN 2 THEN {BRANCH} WHEN 3 THEN {MARKER}
  ELSE concat('选/', l_returnflag, '/', l_linestatus) END"""
TEXTS = """concat('"text":["t', cast(l_partkey AS string), '/', l_linestatus, '","","b"]')"""
NUMBER = """concat('"number":', cast(l_suppkey % 5 AS string), CASE WHEN l_partkey % 7 = 0 THEN '.0' ELSE '' END)"""
VALUE = f"""CASE WHEN l_partkey % 50 = 0 THEN '{{}}'
  ELSE concat('{{"start":', cast(cast(l_quantity AS int) AS string), ',"end":',
    cast(cast(l_quantity AS int) + 5 AS string), ',',
    CASE l_linenumber % 3 WHEN 0 THEN concat('"labels":["', {LABEL}, '"]')
      WHEN 2 THEN concat('"choices":["', {CHOICE}, '"]')
      ELSE CASE WHEN l_suppkey % 2 = 0 THEN {TEXTS} ELSE {NUMBER} END END, '}}') END"""
RESULT_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def annotation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("task_pos", F.expr("cast(floor(l_orderkey / 8) as bigint) % 5"))
    rows = items.selectExpr(
        "cast(floor(l_orderkey / 40) as bigint) AS project_id", "task_pos",
        "CASE WHEN task_pos = 3 THEN NULL ELSE 5 - task_pos END AS inner_id",
        "CASE WHEN task_pos = 4 THEN 'trailer.mp4' "
        "ELSE concat('x-ep', lpad(cast(task_pos + 1 AS string), 2, '0'), '.mp4') END AS file_upload",
        f"struct({', '.join(RESULT_ORDER)}) AS result_pos", "cast(l_orderkey AS string) AS region_id",
        f"{NAME} AS from_name", f"{VALUE} AS value_json", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return landed(rows, "region_id", "l_linenumber")


def timeline_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene per order, a project per customer, with flashbacks, forward scenes and two branches."""
    rows = numbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "scene_id")
    return cut_lineage(rows.selectExpr(
        "o_custkey AS project_id", "scene_id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'INSERT_PAST' WHEN 1 THEN 'INSERT_PAST' WHEN 2 THEN 'FORWARD' "
        "WHEN 3 THEN 'NONE' END AS marker",
        "cast(1 + o_orderkey % 3 AS double) AS chapter_rank", "cast(1 + o_orderkey % 7 AS double) AS scene_rank",
        "cast(1 + o_orderkey % 2 AS double) AS inner_rank", "cast(1 + o_orderkey % 7 AS string) AS target",
        "CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS branch_number",
        "CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'multi_branch' ELSE 'linear' END "
        "AS branch_type",
        "o_orderpriority LIKE '2%' AS meets"))


def incomplete_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of the orders with empty ranks: all chapters of every sixth project, and some others of each kind."""
    empty = {"chapter_rank": "project_id % 6 = 0 OR project_id % 6 = 1 AND scene_id % 13 = 0",
             "scene_rank": "(scene_id + project_id) % 9 = 0", "target": "(scene_id + project_id) % 9 = 0",
             "inner_rank": "scene_id % 4 = 0"}
    return timeline_scenes(spark, sf_dir).withColumns(
        {c: F.expr(f"CASE WHEN NOT ({when}) THEN {c} END") for c, when in empty.items()})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload listing with a file per document: ten episodes of up to four files per work.

    One episode in three has two videos. The subtitles of every fifth work pair with no video.
    """
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('src', cast(doc_id div 40 AS string)) AS media_id",
        "concat('ep', lpad(cast(doc_id div 4 % 10 + 1 AS string), 2, '0'), CASE doc_id % 4 WHEN 0 THEN '.mp4' "
        "WHEN 1 THEN CASE WHEN doc_id div 40 % 5 = 3 THEN '_en.srt' ELSE '.srt' END "
        "WHEN 2 THEN CASE WHEN doc_id div 4 % 3 = 0 THEN '.mov' ELSE '.avi' END ELSE '.txt' END) AS name")


def placed_files(rows: DataFrame, root: str) -> str:
    """Write a file per row `path, body` below `root`, from the tasks; a path that ends in `/` makes a folder. Gives `root`."""
    base_uri = qualified(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(base_uri)
        made = None
        for batch in batches:
            for path, body in zip(*(batch.column(c).to_pylist() for c in ("path", "body")), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                if not path.endswith("/"):
                    with system.open_output_stream(f"{base}/{path}") as out:
                        out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select("path", "body").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


def upload_folders(spark: SparkSession, sf_dir: str, root: str) -> str:
    """The files of the listing in a folder per work, more to be left out or kept, and empty folders for some works."""
    listed = files(spark, sf_dir).selectExpr("concat(media_id, '/', name) AS path", "repeat('x', length(name)) AS body")
    works = files(spark, sf_dir).select("media_id").distinct()
    odd = works.selectExpr("explode(array(concat(media_id, '/sub/ep03.mp4'), concat(media_id, '/_ep01.mp4'))) AS path", "'y' AS body")
    empty = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").selectExpr(
        "concat('src', cast(c_custkey AS string), '/') AS path", "'' AS body")
    return placed_files(listed.unionByName(odd).unionByName(empty), root)


def existing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes already in the catalogue: one per supplier, four per work."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('src', cast(s_suppkey div 4 AS string)) AS media_id", "s_suppkey % 4 + 1 AS sequence_number",
        "concat('known-', s_name) AS asset_id", "s_name AS title")


def catalogue_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes of the orders, in the works that `files` names."""
    return assets(spark, sf_dir).withColumns({
        "media_id": F.concat(F.lit("src"), F.col("media_id").cast("string")),
        "asset_id": F.col("asset_id").cast("string"), "processing_status": F.lit("pending")})


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS media_id", "c_name AS title", "c_mktsegment AS media_type",
        "CASE c_nationkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'ingesting' WHEN 2 THEN 'completed' "
        "ELSE 'failed' END AS ingestion_status",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey + 1000 END AS annotation_project_id",
        "timestampadd(SECOND, cast(c_custkey * 7919 % 100000 AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00') "
        "AS created_at")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "sequence_number")
    return rows.selectExpr(
        "o_orderkey AS asset_id", "o_custkey AS media_id", "concat('Episode ', cast(o_orderkey AS string)) AS title",
        "sequence_number",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS l1_status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'completed' ELSE 'in_progress' END AS l2_l3_status",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('https://cdn.example/processed_videos/', "
        "cast(o_orderkey AS string), '.mp4') END AS processed_video_url",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('https://cdn.example/source_subtitles/', "
        "cast(o_orderkey AS string), '/s.srt') END AS source_subtitle_url",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey + 500 END AS annotation_task_id",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('l1_outputs/', cast(o_orderkey AS string), '.ass') "
        "END AS l1_output_file")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`query_id, query`: a search per supplier, of words of one to nine characters; some find nothing, two ask for nothing."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS query_id", """CASE s_suppkey % 6
        WHEN 0 THEN concat('Episode ', cast(s_suppkey AS string)) WHEN 1 THEN concat('MER#0000  ', cast(s_suppkey % 10 AS string))
        WHEN 2 THEN concat('sode ', cast(s_suppkey % 97 AS string), ' 0', cast(s_suppkey % 7 AS string))
        WHEN 3 THEN concat(cast(s_suppkey AS string), ' zz') WHEN 4 THEN CASE WHEN s_suppkey = 4 THEN ' ' ELSE 'e 11 R#' END
        ELSE CASE WHEN s_suppkey > 5 THEN concat('customer ode 1', cast(s_suppkey AS string)) END END AS query""")


def annotation_bodies(episodes: DataFrame) -> DataFrame:
    """One annotation text per episode with one scene; one in five has none, one in nine is off by a chapter."""
    return episodes.selectExpr("asset_id", """CASE WHEN asset_id % 5 = 0 THEN NULL ELSE concat(
        '{"inner_id":', cast(asset_id % 3 AS string), ',"file_upload":"x-ep',
        lpad(cast(sequence_number + CASE WHEN asset_id % 9 = 0 THEN 1 ELSE 0 END AS string), 2, '0'),
        '.mp4","annotations":[{"result":[{"id":"r', cast(asset_id AS string),
        '","from_name":"region_type","value":{"start":', cast(asset_id % 4 AS string), ',"end":',
        cast(asset_id % 4 + asset_id % 7 AS string), ',"labels":["场景/Scene"]}}]},{"result":[]}]}') END AS body""")


def episode_lines(episodes: DataFrame) -> DataFrame:
    """Subtitle files of the episodes: the header and two lines of dialogue each."""
    lines = """array('[Events]',
        concat('Dialogue: 0,0:00:0', cast(asset_id % 6 AS string), '.50,0:00:09.00,D,Ann,0,0,0,,one ', l1_output_file),
        concat('Dialogue: 0,0:00:0', cast(asset_id % 4 AS string), '.00,0:00:08.25,D,Bo,0,0,0,,two'))"""
    given = episodes.filter("l1_output_file IS NOT NULL")
    return given.selectExpr("l1_output_file AS path", f"posexplode({lines}) AS (line_no, line)")


# A name with quotes, backslashes, brackets and commas.
ODD_NAME = """concat('x-ep', cast(o_orderkey % 30 AS string), ' [}], "', repeat(chr(92), cast(o_orderkey % 4 AS int)), '".mp4')"""


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`path, body` of a JSON array of tasks per customer; every seventh file has an object as root, every fifth is indented."""
    task = F.expr("""concat('{"inner_id":', cast(o_orderkey AS string), ',"file_upload":', name,
      ',"annotations":[{"result":[{"id":"r', cast(o_custkey AS string), '","from_name":"highlight_id","value":{"number":',
      cast(o_orderkey % 9 AS string), ',"deep":[[1,{"a":"]"}]]}}]},{"result":[]}]}')""")
    orders = table(spark, sf_dir, "orders").withColumn("name", F.expr(f"ltrim('[', rtrim(']', to_json(array({ODD_NAME}))))"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", task.alias("task")))).alias("t"))
    between = F.when(F.col("o_custkey") % 5 == 0, ",\n    ").otherwise(",")
    body = F.array_join(F.transform("t", lambda x: x["task"]), "\x00")
    text = F.concat(F.lit(" ["), F.replace(body, F.lit("\x00"), between), F.lit("]\n"))
    return lists.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".json")).alias("path"),
                        F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit('{"tasks":'), text, F.lit("}"))).otherwise(text)
                        .alias("body"))


def status_log(events: DataFrame) -> DataFrame:
    """A save per event; errors save no source video."""
    return events.selectExpr(
        "user_id AS asset_id", f"{MICROS} AS ts", "event_id AS seq", "event_type AS status",
        "CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, '.mp4') END AS source_video",
        "CASE WHEN value > 10 THEN 'completed' ELSE 'processing' END AS processing_status",
        "CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS l1_status",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 4 THEN 'in_progress' ELSE 'pending' END AS l2_l3_status")


WAVES = 2


def arrived_log(log: DataFrame, path: str) -> tuple[str, int]:
    """Write a log as waves of files, and last a heartbeat; gives the lateness to allow for and the files of a wave.

    A save comes in the wave of its time or, one in three, in the next one, so saves of an episode overtake each other.
    """
    files = log.sparkSession.sparkContext.defaultParallelism
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    width = ((last or 0) - (first or 0)) // WAVES + 1
    wave = F.floor((F.col("ts") - F.lit(first)) / width) + F.when(F.pmod(F.xxhash64("seq"), F.lit(3)) == 0, 1).otherwise(0)
    for number in range(WAVES + 1):
        log.filter(wave == number).repartition(files).write.mode("append").parquet(path)
    beat = log.sparkSession.range(1).select(F.lit((last or 0) + 4 * width).alias("ts"))
    log.limit(0).unionByName(beat, allowMissingColumns=True).write.mode("append").parquet(path)
    return f"{3 * width // 1000 + 1} milliseconds", files
