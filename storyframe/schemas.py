"""Schemas of the inputs and the fixed vocabulary of the annotation template."""

# Annotation export: `value` stays raw JSON, so that numbers keep their spelling.
RESULT = "struct<id:string,from_name:string,value:string>"
TASK = f"inner_id bigint, file_upload string, annotations array<struct<result:array<{RESULT}>>>"

ANNOTATION_RESULTS = (
    "project_id string, task_pos bigint, inner_id bigint, file_upload string, result_pos bigint, "
    "region_id string, from_name string, value_json string"
)
SUBTITLE_LINES = "project_id string, chapter_file string, line_no bigint, line string"
LISTING = "media_id string, name string"

# Attributes whose flattened value is used.
FLAT_ATTRIBUTES = [
    "scene_location",
    "scene_character_dynamics",
    "scene_content_type",
    "scene_mood_and_atmosphere",
    "narrative_branch_type",
    "branch_id",
    "branch_intersection_x",
    "branch_intersection_y",
    "scene_timeline_marker_type",
    "insert_past_chapter",
    "insert_past_scene",
    "insert_past_inner_index",
    "past_inner_index",
    "past_description",
    "future_inner_index",
    "future_description",
    "highlight_id",
    "highlight_type",
    "highlight_description",
    "highlight_mood",
]
# Attributes of which every text is used.
TEXT_ATTRIBUTES = ["key_information_summary", "object_name"]

# Region types and timeline markers.
SCENE, HIGHLIGHT, CUE = "SCENE", "HIGHLIGHT", "NARRATIVE_CUE"
TIMELINE_MARKERS = ["START", "NONE", "RETURN_PRESENT", "INSERT_PAST", "FORWARD", "PAST", "FUTURE", "UNRELATED"]
SCRIPT_VERSION = "1.8"

# Allowed states of the catalogue.
CATALOGUE_VALUES = {
    "media_type": ["short_drama", "movie"],
    "ingestion_status": ["pending", "ingesting", "completed", "failed"],
    "processing_status": ["pending", "processing", "completed", "failed"],
    "l1_status": ["pending", "in_progress", "completed"],
    "l2_l3_status": ["pending", "in_progress", "completed"],
    "copyright_status": ["pending", "cleared", "owned", "restricted"],
    "language": ["zh-CN", "en-US"],
}
