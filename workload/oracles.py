"""Expected results as SQL over the test tables, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from storyframe.schemas import FLAT_ATTRIBUTES


def clock(x: str) -> str:
    """Seconds, not negative, as HH:MM:SS.mmm."""
    minutes = f"cast(round(({x} - {x} % 60) / 60) AS bigint)"
    text = f"printf('%02d:%02d:%06.3f', {minutes} // 60, {minutes} % 60, {x} % 60)"
    return f"(CASE WHEN {x} IS NULL THEN '00:00:00.000' ELSE {text} END)"


def quoted(x: str) -> str:
    return f"coalesce(cast(to_json({x}) AS varchar), 'null')"


MICROS = "(epoch_us(ts) - 1704067200000000)"
MARKS = f"""
marks AS (
  SELECT cast(floor(user_id / 10) AS bigint) AS project_id, user_id % 10 + 1 AS chapter_id, event_id, user_id, event_type,
    value, props, {MICROS} AS us, {MICROS} / cast(1000000 AS double) AS s
  FROM events)"""
SCENES = f"""{MARKS},
scenes AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY chapter_id, us, event_id) AS scene_id,
    s AS s0, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS s1
  FROM marks WHERE event_type = 'purchase')"""
EVERY_SCENE = SCENES.replace(" WHERE event_type = 'purchase'", "")
SPOKEN = """
spoken AS (
  SELECT project_id, chapter_id, CASE WHEN event_type = 'click' THEN 'caption' ELSE 'dialogue' END AS kind,
    event_id AS line_no, s AS at, s + value AS until, event_type AS speaker, props AS content
  FROM marks WHERE event_type IN ('view', 'click'))"""
HIGHLIGHTS = """
highlights AS (
  SELECT project_id, chapter_id, event_id, user_id, s AS at, props FROM marks WHERE event_type = 'error')"""
CUES = """
cues AS (
  SELECT project_id, chapter_id, event_id, user_id, s AS at, concat('v', event_id) AS value,
    CASE WHEN event_id % 4 = 1 THEN 'Object' ELSE 'Key_Information' END AS type
  FROM marks WHERE event_type = 'signup')"""


def placed(children: str, order: str, same_chapter: bool, columns: str) -> str:
    """Children on scenes by a plain range join, numbered per scene."""
    chapter = "AND c.chapter_id = x.chapter_id" if same_chapter else ""
    return f"""
SELECT x.project_id, x.scene_id, row_number() OVER (PARTITION BY x.project_id, x.scene_id ORDER BY {order}) AS ordinal,
  {columns}
FROM scenes x JOIN {children} c ON c.project_id = x.project_id {chapter} AND x.s0 <= c.at AND c.at < x.s1"""


def spoken_on_scenes(kind: str, columns: str, outer: str) -> str:
    inner = placed(f"(SELECT * FROM spoken WHERE kind = '{kind}')", "c.line_no", True, columns)
    return f"""WITH {SCENES}, {SPOKEN}, hits AS ({inner})
SELECT x.project_id, x.scene_id, h.ordinal, {outer}
FROM scenes x LEFT JOIN hits h ON h.project_id = x.project_id AND h.scene_id = x.scene_id"""


ITEMS = """
items AS (
  SELECT *, cast(floor(l_orderkey / 40) AS bigint) AS project_id, cast(floor(l_orderkey / 8) AS bigint) % 5 AS task_pos,
    cast(l_orderkey AS varchar) AS region_id, l_partkey % 50 <> 0 AS filled,
    CASE l_linenumber % 3 WHEN 0 THEN 'label' WHEN 2 THEN 'choice'
      ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'text' ELSE 'number' END END AS shape,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
  FROM lineitem),
eav AS (
  SELECT *,
    CASE shape
      WHEN 'label' THEN 'region_type'
      WHEN 'text' THEN (['scene_location', 'scene_character_dynamics', 'highlight_description',
        'key_information_summary', 'object_name', 'past_description'])[l_partkey % 6 + 1]
      WHEN 'number' THEN (['branch_id', 'branch_intersection_x', 'branch_intersection_y', 'insert_past_chapter',
        'insert_past_scene', 'highlight_id'])[l_partkey % 6 + 1]
      ELSE (['scene_content_type', 'scene_mood_and_atmosphere', 'narrative_branch_type',
        'scene_timeline_marker_type', 'highlight_type', 'highlight_mood'])[l_partkey % 6 + 1] END AS from_name,
    CASE shape
      WHEN 'text' THEN l_linestatus
      WHEN 'number' THEN concat(l_suppkey % 5, CASE WHEN l_partkey % 7 = 0 THEN '.0' ELSE '' END)
      WHEN 'choice' THEN CASE l_partkey % 6
        WHEN 2 THEN (['NONE', 'BRANCH', 'INTERSECTION'])[l_suppkey % 3 + 1]
        WHEN 3 THEN (['START', 'INSERT_PAST', 'FORWARD', 'REFERENCE', 'PAST', 'Other'])[l_suppkey % 6 + 1]
        ELSE concat(l_returnflag, '/', l_linestatus) END END AS flat,
    CASE WHEN shape = 'label' THEN
      (['SCENE', 'SCENE', 'SCENE', 'SCENE', 'SCENE', 'HIGHLIGHT', 'NARRATIVE_CUE', 'OTHER'])[l_partkey % 8 + 1] END
      AS label,
    CASE WHEN shape = 'text' THEN concat('t', l_partkey, '/', l_linestatus) END AS first_text
  FROM items WHERE filled)"""
REGIONS = f"""{ITEMS},
regions AS (
  SELECT project_id, task_pos, region_id, CASE WHEN task_pos = 3 THEN 0 ELSE 5 - task_pos END AS inner_id,
    task_pos + 1 AS chapter_id,
    cast(arg_max(cast(trunc(l_quantity) AS int), rn) AS double) AS start_time,
    arg_max(label, rn) FILTER (WHERE shape = 'label') AS region_type,
    {', '.join(f"arg_max(flat, rn) FILTER (WHERE from_name = '{a}') AS {a}" for a in FLAT_ATTRIBUTES)},
    arg_max(first_text, rn) FILTER (WHERE from_name = 'key_information_summary') AS key_text,
    arg_max(first_text, rn) FILTER (WHERE from_name = 'object_name') AS object_text,
    arg_min(l_shipdate, rn) AS f1, arg_min(l_linenumber, rn) AS f2, arg_min(l_partkey, rn) AS f3,
    arg_min(l_suppkey, rn) AS f4, arg_min(l_extendedprice, rn) AS f5, arg_min(l_quantity, rn) AS f6
  FROM eav WHERE task_pos <> 4 GROUP BY project_id, task_pos, region_id),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project_id
    ORDER BY inner_id, task_pos, start_time, f1, f2, f3, f4, f5, f6) AS scene_id
  FROM regions WHERE region_type = 'SCENE')"""


def or_na(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'N/A')"


CHAINED = """
inserts AS (
  SELECT *, cast(scene_id AS varchar) AS sid,
    row_number() OVER (PARTITION BY project_id, b ORDER BY c1, c2, c3, scene_id) AS turn
  FROM told WHERE marker = 'INSERT_PAST'),
walk AS (
  SELECT project_id, b, 0::bigint AS turn, coalesce(list(cast(scene_id AS varchar) ORDER BY scene_id)
    FILTER (WHERE coalesce(marker, '') NOT IN ('INSERT_PAST', 'FORWARD')), []) AS l
  FROM told GROUP BY project_id, b
  UNION ALL
  SELECT w.project_id, w.b, i.turn,
    CASE WHEN list_contains(w.l, i.target)
      THEN list_concat(list_concat(w.l[1:list_position(w.l, i.target)], [i.sid]),
                       w.l[list_position(w.l, i.target) + 1:len(w.l)])
      ELSE list_concat(w.l, [i.sid]) END
  FROM walk w JOIN inserts i ON i.project_id = w.project_id AND i.b = w.b AND i.turn = w.turn + 1),
final AS (SELECT project_id, b, arg_max(l, turn) AS l FROM walk GROUP BY project_id, b),
told_order AS (
  SELECT project_id, b, cast(unnest(l) AS bigint) AS scene_id, generate_subscripts(l, 1) AS narrative_index FROM final)"""
ORDERED = """
ordered AS (
  SELECT *, o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS scene_id,
    CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS branch,
    CASE WHEN o_orderkey % 5 < 2 THEN 'INSERT_PAST' WHEN o_orderkey % 5 = 2 THEN 'FORWARD'
      WHEN o_orderkey % 5 = 3 THEN 'NONE' END AS marker,
    1 + o_orderkey % 3 AS c1, 1 + o_orderkey % 7 AS c2, 1 + o_orderkey % 2 AS c3,
    cast(1 + o_orderkey % 7 AS varchar) AS target
  FROM orders)"""
INCOMPLETE = f"""{ORDERED},
gapped AS (
  SELECT project_id, scene_id, marker,
    CASE WHEN NOT (project_id % 6 = 0 OR project_id % 6 = 1 AND scene_id % 13 = 0) THEN c1 END AS c1,
    CASE WHEN (scene_id + project_id) % 9 <> 0 THEN c2 END AS c2, CASE WHEN scene_id % 4 <> 0 THEN c3 END AS c3,
    CASE WHEN (scene_id + project_id) % 9 <> 0 THEN target END AS target
  FROM ordered),
clash AS (
  SELECT DISTINCT a.project_id, a.scene_id
  FROM gapped a JOIN gapped o ON o.project_id = a.project_id AND o.marker = 'INSERT_PAST' AND a.marker = 'INSERT_PAST'
  WHERE a.c1 IS NULL AND o.c1 IS NOT NULL
    OR a.c1 IS NOT DISTINCT FROM o.c1 AND a.c2 IS NULL AND o.c2 IS NOT NULL
    OR a.c1 IS NOT DISTINCT FROM o.c1 AND a.c2 IS NOT DISTINCT FROM o.c2 AND a.c3 IS NULL AND o.c3 IS NOT NULL)"""

# Scripts: the described scenes and the text of each part.
DESCRIBED = f"""{SCENES},
described AS (
  SELECT *,
    CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE {or_na('props')} END AS place,
    CASE WHEN value < 5 THEN 'N/A' ELSE 'Calm' END AS mood,
    CASE WHEN project_id % 2 = 0 OR event_id % 3 = 2 THEN 'line' WHEN event_id % 3 = 0 THEN 'branch' ELSE 'meet' END
      AS place_in_tree,
    (['START', 'INSERT_PAST', 'INSERT_PAST', 'FORWARD', NULL, 'PAST', 'FUTURE', NULL])[event_id % 8 + 1] AS marker,
    event_id % 8 = 4 AS recalled,
    1 + event_id % 3 AS c1, 1 + event_id % 60 AS c2, 1 + event_id % 2 AS c3,
    cast(1 + event_id % 60 AS varchar) AS target
  FROM scenes),
told AS (
  SELECT *, CASE place_in_tree WHEN 'line' THEN 0 WHEN 'branch' THEN event_id % 2 ELSE event_id % 4 END AS b
  FROM described),
kinds AS (
  SELECT project_id, bool_and(place_in_tree = 'line') AS is_linear FROM told GROUP BY project_id)"""


def times(start: str, end: str) -> str:
    return f"""'"start_time":"', {clock(start)}, '","end_time":"', {clock(end)}, '"'"""


DIALOGUE = f"""concat('{{"content":', {quoted('c.content')}, ',"speaker":', {quoted('c.speaker')}, ',',
  {times('c.at', 'c.until')}, '}}') AS body"""
CAPTION = f"""concat('{{"content":', {quoted('c.content')}, ',', {times('c.at', 'c.until')}, '}}') AS body"""
HIGHLIGHT = f"""concat('{{"id":', c.event_id, ',"type":"Action Clip","description":',
  {quoted("substr(c.props, strpos(c.props, '/') + 1)")}, ',"mood":null,', {times('c.at', '(c.at + 2)')}, '}}') AS body"""
CUE = f"""concat('{{"type":', {quoted('c.type')}, ',"value":', {quoted('c.value')}, ',',
  {times('c.at', '(c.at + 2)')}, '}}') AS body"""


def child_list(name: str, children: str, order: str, same_chapter: bool, body: str) -> str:
    return f"""
{name} AS (
  SELECT project_id, scene_id, string_agg(body, ',' ORDER BY ordinal) AS bodies
  FROM ({placed(children, order, same_chapter, body)}) GROUP BY project_id, scene_id)"""


MARK_ORDER = "c.user_id, c.at, c.event_id"
SCRIPT = f"""{DESCRIBED}, {SPOKEN}, {HIGHLIGHTS}, {CUES}, {CHAINED},
{child_list('l1', "(SELECT * FROM spoken WHERE kind = 'dialogue')", 'c.line_no', True, DIALOGUE)},
{child_list('l2', "(SELECT * FROM spoken WHERE kind = 'caption')", 'c.line_no', True, CAPTION)},
{child_list('l3', 'highlights', MARK_ORDER, False, HIGHLIGHT)},
{child_list('l4', 'cues', MARK_ORDER, False, CUE)},
branches AS (
  SELECT t.project_id, b, concat('BRANCH_', b) AS item, min(scene_id) AS first_scene,
    CASE WHEN any_value(is_linear) THEN 'linear' ELSE 'multi_branch' END AS type
  FROM told t JOIN kinds k ON k.project_id = t.project_id GROUP BY t.project_id, b),
parts AS (
  SELECT project_id, 'project_metadata' AS section, '' AS item, 0::bigint AS part, 0::bigint AS id,
    concat('{{"project_name":"', project_id, '","total_chapters":', count(DISTINCT chapter_id), ',"total_scenes":',
      count(*), ',"version":"1.8","generation_date":"2024-06-01T12:00:00+00:00"}}') AS body
  FROM told GROUP BY project_id
  UNION ALL
  SELECT project_id, 'chapter', cast(chapter_id AS varchar), 0, chapter_id,
    concat('{{"id":', chapter_id, ',"name":"Chapter_', chapter_id, '","textual":"Chapter ', chapter_id,
      '","source_file":"', printf('%02d', chapter_id), '.ass","scene_ids":[',
      string_agg(cast(scene_id AS varchar), ',' ORDER BY scene_id), ']}}')
  FROM told GROUP BY project_id, chapter_id
  UNION ALL
  SELECT t.project_id, 'scene', cast(t.scene_id AS varchar), 0, t.scene_id,
    concat('{{"id":', t.scene_id, ',"name":"Scene_', t.scene_id, '","textual":"Scene ', t.scene_id,
      '","chapter_id":', chapter_id,
      ',"dialogues":[', l1.bodies, '],"captions":[', l2.bodies, '],"highlights":[', l3.bodies,
      '],"narrative_cues":[', l4.bodies, '],"inferred_location":',
      {quoted("substr(place, CASE WHEN place = 'N/A' THEN 1 ELSE strpos(place, '/') + 1 END)")},
      ',"character_dynamics":"u', user_id, '","mood_and_atmosphere":"', mood, '","scene_content_type":"N/A","branch":',
      CASE place_in_tree
        WHEN 'line' THEN '{{"id":0,"type":"linear","intersection_with":[]}}'
        WHEN 'branch' THEN concat('{{"id":', b, ',"type":"multi_branch","intersection_with":[]}}')
        ELSE concat('{{"id":', b, ',"type":"multi_branch","intersection_with":[', 1 + event_id % 5, ']}}') END,
      CASE marker
        WHEN 'START' THEN ',"timeline_marker":{{"type":"START"}}'
        WHEN 'FORWARD' THEN ',"timeline_marker":{{"type":"FORWARD"}}'
        WHEN 'INSERT_PAST' THEN concat(',"timeline_marker":{{"type":"INSERT_PAST","insert_chapter_id":', c1,
          ',"insert_scene_id":', c2, ',"inner_index":', c3, '}}')
        WHEN 'PAST' THEN concat(',"timeline_marker":{{"type":"PAST","inner_index":', event_id % 9,
          ',"extended_information":"ago ', user_id, '"}}')
        WHEN 'FUTURE' THEN concat(',"timeline_marker":{{"type":"FUTURE","inner_index":', event_id % 7,
          ',"extended_information":null}}')
        ELSE '' END,
      CASE WHEN recalled THEN ',"information_marker":{{"type":"RECALL"}}' ELSE '' END,
      ',', {times('s0', 's1')}, '}}')
  FROM told t
  LEFT JOIN l1 ON l1.project_id = t.project_id AND l1.scene_id = t.scene_id
  LEFT JOIN l2 ON l2.project_id = t.project_id AND l2.scene_id = t.scene_id
  LEFT JOIN l3 ON l3.project_id = t.project_id AND l3.scene_id = t.scene_id
  LEFT JOIN l4 ON l4.project_id = t.project_id AND l4.scene_id = t.scene_id
  UNION ALL
  SELECT project_id, 'branch', item, first_scene, 0, concat('{{"type":"', type, '"}}') FROM branches
  UNION ALL
  SELECT project_id, 'timeline', concat('BRANCH_', b), narrative_index, scene_id,
    concat('{{"scene_id":', scene_id, ',"narrative_index":', narrative_index, '}}')
  FROM told_order
  UNION ALL
  SELECT project_id, 'intersection', cast(scene_id AS varchar), 0, scene_id,
    concat('{{"scene_id":', scene_id, ',"branches":[', b, ',', 1 + event_id % 5, ']}}')
  FROM told WHERE place_in_tree = 'meet')"""

FILES = """
files AS (
  SELECT concat('src', doc_id // 40) AS media_id, (doc_id // 4) % 10 + 1 AS seq, (doc_id // 40) % 5 = 3 AS unpaired,
    CASE WHEN doc_id % 4 = 2 AND (doc_id // 4) % 3 <> 0 THEN 3 ELSE doc_id % 4 END AS kind
  FROM documents),
videos AS (
  SELECT media_id, seq, printf('ep%02d', seq) AS stem, CASE kind WHEN 0 THEN '.mp4' ELSE '.mov' END AS ext,
    CASE kind WHEN 0 THEN 0 ELSE 1 END AS ext_rank
  FROM files WHERE kind IN (0, 2)),
srts AS (SELECT media_id, seq FROM files WHERE kind = 1 AND NOT unpaired)"""
PLANNED = f"""{FILES},
plan AS (
  SELECT v.media_id, v.seq AS sequence_number, count(*) AS n_videos,
    any_value(k.id) IS NULL AS created, coalesce(any_value(k.title), min(v.stem)) AS title,
    any_value(sha256(concat(v.media_id, chr(1), v.seq))) AS h, any_value(k.id) AS known_id,
    bool_or(s.seq IS NOT NULL) AS has_srt
  FROM videos v
  LEFT JOIN srts s ON s.media_id = v.media_id AND s.seq = v.seq
  LEFT JOIN known k ON k.media_id = v.media_id AND k.seq = v.seq
  GROUP BY v.media_id, v.seq),
plan_ids AS (
  SELECT *, coalesce(known_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])) AS asset_id FROM plan),
planned AS (
  SELECT media_id, sequence_number, asset_id, title, created, n_videos, 'completed' AS processing_status,
    concat('http://localhost:9999/media/processed_videos/', asset_id, '.mp4') AS processed_video_url,
    CASE WHEN has_srt THEN concat('http://localhost:9999/media/source_subtitles/', asset_id, '/ep',
      printf('%02d', sequence_number), '.srt') END AS source_subtitle_url
  FROM plan_ids)"""
PLAN = f"""known AS (
  SELECT concat('src', s_suppkey // 4) AS media_id, s_suppkey % 4 + 1 AS seq, concat('known-', s_name) AS id,
    s_name AS title
  FROM supplier),
{PLANNED}
SELECT * FROM planned"""
ASSETS = """
media AS (
  SELECT c_custkey AS media_id, c_name AS media_title, c_custkey * 7919 % 100000 AS age,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 1000 END AS project
  FROM customer),
assets AS (
  SELECT o_orderkey AS asset_id, o_custkey AS media_id, concat('Episode ', o_orderkey) AS title,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS l1_status,
    o_orderkey % 3 = 0 AS annotated,
    CASE WHEN o_orderkey % 4 <> 0 THEN concat('https://cdn.example/processed_videos/', o_orderkey, '.mp4') END AS video,
    CASE WHEN o_orderkey % 6 <> 0 THEN concat('https://cdn.example/source_subtitles/', o_orderkey, '/s.srt') END AS srt,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + 500 END AS task,
    CASE WHEN o_orderkey % 7 <> 0 THEN concat('l1_outputs/', o_orderkey, '.ass') END AS l1_output_file
  FROM orders)"""
LOG = f"""
log AS (
  SELECT user_id AS asset_id, {MICROS} AS ts, event_id AS seq, event_type AS status,
    CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, '.mp4') END AS source_video,
    CASE WHEN value > 10 THEN 'completed' ELSE 'processing' END AS processing_status,
    (['pending', 'in_progress', 'completed'])[event_id % 3 + 1] AS l1_status,
    CASE WHEN event_id % 11 <> 0 THEN CASE WHEN value > 4 THEN 'in_progress' ELSE 'pending' END END AS l2_l3_status
  FROM events),
before AS (
  SELECT *, lag(status) OVER w AS previous_status, lag(source_video) OVER w AS previous_video,
    lag(processing_status) OVER w AS previous_processing, lag(l1_status) OVER w AS previous_l1,
    lag(l2_l3_status) OVER w AS previous_l2, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS back
  FROM log WINDOW w AS (PARTITION BY asset_id ORDER BY ts, seq))"""

ORACLES: dict[str, str] = {
    "subtitle_parse": f"""
SELECT cast(floor(conv_id / 10) AS bigint) AS project_id, printf('%02d.ass', conv_id % 10 + 1) AS chapter_file,
  10 * turn AS line_no, CASE WHEN role = 'system' THEN 'caption' ELSE 'dialogue' END AS kind,
  printf('0:00:%02d.00', turn * 5) AS start_time_raw, printf('0:00:%02d.50', turn * 5 + 4) AS end_time_raw,
  CASE WHEN role <> 'system' THEN role END AS speaker, text AS content,
  {clock('cast(turn * 5 AS double)')} AS start_time, {clock('(turn * 5 + cast(4.5 AS double))')} AS end_time
FROM conversations""",
    "subtitle_section_gate": """
SELECT cast(floor(conv_id / 10) AS bigint) AS project_id, conv_id % 10 + 1 AS chapter_id, 10 * turn AS line_no,
  CASE WHEN role = 'system' THEN 'caption' ELSE 'dialogue' END AS kind,
  CASE WHEN role <> 'system' THEN role END AS speaker, text AS content
FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn >= 2)""",
    "timecode_parse": f"""
WITH t AS (SELECT event_id, {MICROS} // 10000 AS c, {MICROS} // 1000000 AS s FROM events),
u AS (SELECT *, printf('%02d.%02d', s % 60, c % 100) AS tail FROM t)
SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN printf('%d.%02d', s, c % 100) WHEN 1 THEN concat(s // 60, ':', tail)
    WHEN 2 THEN printf('%d:%02d:%s', s // 3600, s // 60 % 60, tail) WHEN 3 THEN concat('0:1:2:', tail) END AS code,
  CASE WHEN event_id % 5 < 3 THEN c ELSE 0 END AS centis,
  CASE event_id % 5 WHEN 0 THEN cast(printf('%d.%02d', s, c % 100) AS double)
    WHEN 1 THEN (s - s % 60) + cast(tail AS double) WHEN 2 THEN (s - s % 60) + cast(tail AS double)
    ELSE cast(0 AS double) END AS seconds
FROM u""",
    "timecode_format": f"""
WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN value
  WHEN 2 THEN value * cast(1000.0005 AS double) WHEN 3 THEN event_id / 2000
  WHEN 4 THEN cast(59.9996 AS double) + 60 * (event_id % 100) WHEN 5 THEN value / 7
  ELSE value * cast(61.7 AS double) END AS v FROM events)
SELECT event_id, {clock('v')} AS time, {clock('v')} AS label_time FROM t""",
    "chapter_extract": """
SELECT doc_id, doc_id % 120 AS chapter_id, printf('%02d.ass', doc_id % 120) AS source_file,
  concat('Chapter_', doc_id % 120) AS name,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 120 * 10 + 9 ELSE doc_id % 120 END AS digits
FROM documents WHERE doc_id % 11 <> 0""",
    "label_value": f"""
WITH {ITEMS}
SELECT project_id, region_id, l_linenumber, l_partkey, l_suppkey, from_name, flat AS value,
  CASE WHEN shape <> 'label' THEN shape = 'number' END AS is_number,
  CASE WHEN shape = 'number' AND l_suppkey % 5 = 0 THEN 'N/A' ELSE {or_na('flat')} END AS described,
  CASE WHEN shape = 'number' THEN flat ELSE {quoted('flat')} END AS literal
FROM eav""",
    "region_pivot": f"""
WITH {REGIONS}
SELECT project_id, task_pos, chapter_id, inner_id, region_id, region_type, start_time, start_time + 5 AS end_time,
  {', '.join(FLAT_ATTRIBUTES)}, key_text || '||b' AS key_information_summary, object_text || '||b' AS object_name
FROM regions""",
    "region_route": f"""
WITH {REGIONS}
SELECT project_id, count(*) FILTER (WHERE region_type = 'SCENE') AS n_scenes,
  count(*) FILTER (WHERE region_type = 'HIGHLIGHT') AS n_highlights,
  count(*) FILTER (WHERE region_type = 'NARRATIVE_CUE') AS n_cues, count(*) AS n_regions
FROM regions GROUP BY project_id""",
    "scene_number": f"""
WITH {REGIONS}
SELECT project_id, scene_id, chapter_id, region_id, concat('Scene_', scene_id) AS name FROM numbered""",
    "scene_project": f"""
WITH {REGIONS}
SELECT project_id, scene_id, concat('Scene_', scene_id) AS name, concat('Scene ', scene_id) AS textual,
  {or_na('scene_location')} AS inferred_location, {or_na('scene_character_dynamics')} AS character_dynamics,
  {or_na('scene_mood_and_atmosphere')} AS mood_and_atmosphere, {or_na('scene_content_type')} AS scene_content_type,
  CASE narrative_branch_type WHEN 'BRANCH' THEN branch_id WHEN 'INTERSECTION' THEN branch_intersection_x
    ELSE '0' END AS branch_id,
  CASE WHEN narrative_branch_type IN ('BRANCH', 'INTERSECTION') THEN 'multi_branch' ELSE 'linear' END AS branch_type,
  CASE WHEN narrative_branch_type = 'INTERSECTION' THEN coalesce(branch_intersection_y, 'null') ELSE '' END AS meets,
  CASE WHEN scene_timeline_marker_type IN ('START', 'INSERT_PAST', 'FORWARD', 'PAST')
    THEN scene_timeline_marker_type END AS marker,
  CASE WHEN scene_timeline_marker_type = 'INSERT_PAST' THEN insert_past_chapter END AS insert_chapter_id,
  CASE WHEN scene_timeline_marker_type = 'INSERT_PAST' THEN insert_past_scene END AS insert_scene_id,
  CASE WHEN scene_timeline_marker_type = 'PAST' THEN past_description END AS extended_information,
  CASE WHEN scene_timeline_marker_type = 'REFERENCE' THEN 'RECALL' END AS information
FROM numbered""",
    "highlight_project": f"""
WITH {REGIONS}
SELECT project_id, chapter_id, region_id, {clock('start_time')} AS start_time, highlight_id, highlight_type,
  highlight_description, highlight_mood
FROM regions WHERE region_type = 'HIGHLIGHT'""",
    "cue_explode": f"""
WITH {REGIONS},
found AS (
  SELECT project_id, chapter_id, region_id, 1 AS o, 'Key_Information' AS type, key_text AS value FROM regions
    WHERE region_type = 'NARRATIVE_CUE' AND key_text IS NOT NULL
  UNION ALL SELECT project_id, chapter_id, region_id, 2, 'Key_Information', 'b' FROM regions
    WHERE region_type = 'NARRATIVE_CUE' AND key_text IS NOT NULL
  UNION ALL SELECT project_id, chapter_id, region_id, 3, 'Object', object_text FROM regions
    WHERE region_type = 'NARRATIVE_CUE' AND object_text IS NOT NULL
  UNION ALL SELECT project_id, chapter_id, region_id, 4, 'Object', 'b' FROM regions
    WHERE region_type = 'NARRATIVE_CUE' AND object_text IS NOT NULL)
SELECT project_id, chapter_id, region_id, row_number() OVER (PARTITION BY project_id, chapter_id, region_id ORDER BY o) - 1
  AS cue_no, type, value
FROM found""",
    "annotations_merge": """
SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS task_pos,
  o_orderkey AS inner_id, concat('x-ep', o_orderkey % 30, '.mp4') AS file_upload, concat('r', o_custkey) AS region_id,
  concat('{"number":', o_orderkey % 9, '}') AS value_json
FROM orders WHERE o_orderkey % 5 <> 0""",
    "annotation_rejects": f"""
WITH {ITEMS},
found AS (
  SELECT project_id, CASE WHEN l_partkey % 9 = 3 THEN 'not_an_object'
    WHEN l_partkey % 9 = 1 AND filled AND shape = 'choice' THEN 'empty_choices'
    WHEN l_partkey % 9 = 2 AND filled AND shape = 'label' THEN 'empty_labels' END AS reason
  FROM items)
SELECT cast(project_id AS varchar) AS project_id, 'result' AS source, reason, count(*) AS n
FROM found WHERE reason IS NOT NULL GROUP BY project_id, reason""",
    "scene_dialogues": spoken_on_scenes(
        "dialogue", f"c.speaker, c.content, {clock('c.at')} AS start_time, {clock('c.until')} AS end_time",
        "speaker, h.content, h.start_time, h.end_time"),
    "scene_captions": spoken_on_scenes(
        "caption", f"c.content, {clock('c.at')} AS start_time, {clock('c.until')} AS end_time",
        "h.content, h.start_time, h.end_time"),
    "scene_highlights": f"WITH {SCENES}, {HIGHLIGHTS}" + placed(
        "highlights", MARK_ORDER, False,
        f"cast(c.event_id AS varchar) AS highlight_id, {clock('c.at')} AS start_time"),
    "scene_cues": f"WITH {SCENES}, {CUES}" + placed("cues", MARK_ORDER, False, "c.type, c.value"),
    "scene_highlights_in_chapter": f"WITH {SCENES}, {HIGHLIGHTS}" + placed(
        "highlights", MARK_ORDER, True, "cast(c.event_id AS varchar) AS highlight_id"),
    "interval_bucketed": f"""
WITH {SCENES}
SELECT x.project_id, x.scene_id, count(*) AS n, min(m.event_id) AS first_event,
  cast(sum(m.event_id) AS bigint) AS event_sum
FROM scenes x JOIN marks m ON m.event_type IN ('error', 'signup') AND m.project_id = x.project_id AND x.s0 <= m.s AND m.s < x.s1
GROUP BY x.project_id, x.scene_id""",
    "scene_child_lists": f"""
WITH {SCENES}, {SPOKEN},
hits AS (
  SELECT x.project_id, x.scene_id, c.kind, c.line_no,
    row_number() OVER (PARTITION BY x.project_id, x.scene_id, c.kind ORDER BY c.line_no) - 1 AS i
  FROM scenes x JOIN spoken c ON c.project_id = x.project_id AND c.chapter_id = x.chapter_id
    AND x.s0 <= c.at AND c.at < x.s1)
SELECT project_id, scene_id, kind, i // 50 AS part, string_agg(cast(line_no AS varchar), '|' ORDER BY i) AS lines
FROM hits GROUP BY project_id, scene_id, kind, i // 50""",
    "chapter_rollup": f"""
WITH {EVERY_SCENE}
SELECT project_id, chapter_id, cast(0 AS bigint) AS part, concat('Chapter_', chapter_id) AS name,
  concat('Chapter ', chapter_id) AS textual, printf('%02d.ass', chapter_id) AS source_file,
  string_agg(cast(scene_id AS varchar), ',' ORDER BY scene_id) AS scene_ids
FROM scenes GROUP BY project_id, chapter_id""",
    "project_totals": f"""
WITH {EVERY_SCENE}
SELECT project_id, cast(project_id AS varchar) AS project_name, count(DISTINCT chapter_id) AS total_chapters,
  count(*) AS total_scenes, '1.8' AS version, '2024-06-01T12:00:00+00:00' AS generation_date
FROM scenes GROUP BY project_id""",
    "timeline_linear": f"""
WITH RECURSIVE {ORDERED}, told AS (SELECT *, 0 AS b FROM ordered), {CHAINED}
SELECT project_id, scene_id, narrative_index FROM told_order""",
    "timeline_incomplete": f"""
WITH RECURSIVE {INCOMPLETE}, told AS (SELECT *, 0 AS b FROM gapped g WHERE NOT EXISTS (
  SELECT 1 FROM clash c WHERE c.project_id = g.project_id AND c.scene_id = g.scene_id)), {CHAINED}
SELECT project_id, scene_id, narrative_index FROM told_order""",
    "timeline_rejects": f"""
WITH {INCOMPLETE}
SELECT cast(project_id AS varchar) AS project_id, 'scene' AS source, cast(scene_id AS varchar) AS item,
  'incomplete_insert' AS reason
FROM clash""",
    "timeline_branches": f"""
WITH RECURSIVE {ORDERED}, told AS (SELECT *, branch AS b FROM ordered), {CHAINED},
kinds AS (SELECT project_id, bool_and(o_orderpriority[1] NOT IN ('1', '2')) AS is_linear FROM told GROUP BY project_id)
SELECT f.project_id, concat('BRANCH_', f.b) AS branch, is_linear, scene_id, narrative_index
FROM final f JOIN kinds k ON k.project_id = f.project_id
LEFT JOIN told_order o ON o.project_id = f.project_id AND o.b = f.b""",
    "timeline_intersections": f"""
WITH {ORDERED}
SELECT project_id, scene_id, '[0,1]' AS branches FROM ordered WHERE o_orderpriority LIKE '2%'""",
    "script_build": f"""
WITH RECURSIVE {SCRIPT}
SELECT cast(project_id AS varchar) AS project_id, section, item, part, body FROM parts""",
    "script_documents": f"""
WITH RECURSIVE {SCRIPT},
maps AS (
  SELECT project_id, max(body) FILTER (WHERE section = 'project_metadata') AS metadata,
    string_agg(concat('"', item, '":', body), ',' ORDER BY id) FILTER (WHERE section = 'chapter') AS chapters,
    string_agg(concat('"', item, '":', body), ',' ORDER BY id) FILTER (WHERE section = 'scene') AS scenes,
    string_agg(body, ',' ORDER BY id) FILTER (WHERE section = 'intersection') AS meetings
  FROM parts GROUP BY project_id),
lists AS (
  SELECT project_id, item, string_agg(concat('"', id, '":{{"narrative_index":', part, '}}'), ',' ORDER BY part) AS entries
  FROM parts WHERE section = 'timeline' GROUP BY project_id, item),
trees AS (
  SELECT b.project_id, any_value(type) AS type, any_value(l.entries) AS only_list,
    string_agg(concat('"', b.item, '":{{"sequence":{{', l.entries, '}}}}'), ',' ORDER BY first_scene) AS branches
  FROM branches b LEFT JOIN lists l ON l.project_id = b.project_id AND l.item = b.item GROUP BY b.project_id),
whole AS (SELECT cast(m.project_id AS varchar) AS project_id,
  concat('{{"project_metadata":', metadata, ',"chapters":{{', chapters, '}},"scenes":{{', scenes,
    '}},"narrative_timeline":', CASE WHEN type = 'linear'
      THEN concat('{{"type":"linear","sequence":{{', only_list, '}}}}')
      ELSE concat('{{"type":"multi_branch","branches":{{', branches, '}},"intersections":[', meetings, ']}}') END,
    '}}') AS document
FROM maps m JOIN trees t ON t.project_id = m.project_id)
SELECT project_id, position, substr(document, 1 + 2000 * position, 2000) AS text
FROM (SELECT *, unnest(range((length(document) + 1999) // 2000)) AS position FROM whole)""",
    "blueprint_scenes": f"""
WITH {ASSETS},
tasks AS (
  SELECT media_id AS project_id, asset_id, seq + CASE WHEN asset_id % 9 = 0 THEN 1 ELSE 0 END AS chapter_id,
    cast(asset_id % 4 AS double) AS s0, cast(asset_id % 4 + asset_id % 7 AS double) AS s1,
    row_number() OVER (PARTITION BY media_id ORDER BY asset_id % 3, seq) AS scene_id
  FROM assets WHERE asset_id % 5 <> 0),
spoken AS (
  SELECT media_id AS project_id, seq AS chapter_id, 1 AS line, asset_id % 6 + cast(0.5 AS double) AS at,
    cast(9 AS double) AS until, 'Ann' AS speaker, concat('one ', l1_output_file) AS content
  FROM assets WHERE l1_output_file IS NOT NULL
  UNION ALL
  SELECT media_id, seq, 2, cast(asset_id % 4 AS double), cast(8.25 AS double), 'Bo', 'two'
  FROM assets WHERE l1_output_file IS NOT NULL),
hits AS (
  SELECT t.project_id, t.scene_id, row_number() OVER (PARTITION BY t.project_id, t.scene_id ORDER BY c.line) AS ordinal,
    {DIALOGUE}
  FROM tasks t JOIN spoken c ON c.project_id = t.project_id AND c.chapter_id = t.chapter_id
    AND t.s0 <= c.at AND c.at < t.s1
  WHERE EXISTS (SELECT 1 FROM tasks x WHERE x.project_id = t.project_id AND x.chapter_id = c.chapter_id))
SELECT t.project_id, t.scene_id, chapter_id, concat('r', asset_id) AS region_id, ordinal, body
FROM tasks t LEFT JOIN hits h ON h.project_id = t.project_id AND h.scene_id = t.scene_id""",
    "blueprint_mismatches": f"""
WITH {ASSETS}
SELECT asset_id, seq AS position, seq + 1 AS chapter_id FROM assets WHERE asset_id % 5 <> 0 AND asset_id % 9 = 0""",
    "video_counts": f"WITH {FILES} SELECT media_id, count(*) AS n_videos FROM videos GROUP BY media_id",
    "upload_listing": f"""
WITH {FILES}
SELECT media_id, concat(stem, ext) AS name, stem, ext, ext_rank, seq AS sequence_number FROM videos""",
    "ingest_plan": f"WITH {PLAN}",
    "ingest_stream": f"WITH {PLAN}",
    "assets_merged": f"""
WITH {ASSETS},
known AS (
  SELECT concat('src', media_id) AS media_id, seq, cast(asset_id AS varchar) AS id, title, l1_status, annotated,
    l1_output_file, task, video, srt
  FROM assets),
{PLANNED}
SELECT coalesce(k.media_id, p.media_id) AS media_id, coalesce(k.seq, p.sequence_number) AS sequence_number,
  coalesce(k.id, p.asset_id) AS asset_id, coalesce(k.title, p.title) AS title, l1_status,
  CASE WHEN annotated THEN 'completed' WHEN NOT annotated THEN 'in_progress' END AS l2_l3_status, l1_output_file,
  task AS annotation_task_id, coalesce(p.processing_status, 'pending') AS processing_status,
  CASE WHEN p.media_id IS NULL THEN video ELSE p.processed_video_url END AS processed_video_url,
  CASE WHEN p.media_id IS NULL THEN srt ELSE p.source_subtitle_url END AS source_subtitle_url
FROM known k FULL JOIN planned p ON p.media_id = k.media_id AND p.sequence_number = k.seq""",
    "ingest_status": """
SELECT concat('src', c_custkey) AS media_id,
  CASE WHEN c_custkey IN (SELECT doc_id // 40 FROM documents) THEN 'completed' ELSE 'failed' END AS ingestion_status
FROM customer""",
    "subtitle_renumber": f"""
WITH {ASSETS}
SELECT media_id, asset_id, seq AS position,
  CASE WHEN l1_output_file IS NOT NULL THEN printf('%02d.ass', seq) END AS chapter_file
FROM assets""",
    "subtitle_upload": f"""
WITH {ASSETS}, filled AS (SELECT DISTINCT conv_id + 1 AS asset_id FROM conversations WHERE length(text) >= 40)
SELECT a.asset_id, CASE WHEN f.asset_id IS NOT NULL THEN 'completed' ELSE l1_status END AS l1_status,
  CASE WHEN f.asset_id IS NOT NULL THEN concat('l1_outputs/', a.asset_id, '_l1.ass') ELSE l1_output_file END
    AS l1_output_file
FROM assets a LEFT JOIN filled f ON f.asset_id = a.asset_id""",
    "task_manifest": f"""
WITH {ASSETS}
SELECT asset_id, media_id, concat('{{"data":{{"video_url":"', video, '"}}}}') AS payload, 'in_progress' AS l2_l3_status
FROM assets WHERE video IS NOT NULL""",
    "media_list": f"""
WITH {ASSETS}
SELECT media_id, media_title AS title, row_number() OVER (ORDER BY age DESC, media_id) AS position FROM media""",
    "catalog_list": f"""
WITH {ASSETS}
SELECT asset_id, a.media_id, concat(media_title, ' - ', printf('%02d', seq), ' - ', title) AS label,
  row_number() OVER (ORDER BY age DESC, a.media_id, seq, asset_id) AS position
FROM assets a JOIN media m ON m.media_id = a.media_id""",
    "catalog_search": f"""
WITH {ASSETS}
SELECT asset_id, a.media_id, title, media_title FROM assets a JOIN media m ON m.media_id = a.media_id
WHERE l1_status = 'completed' AND (title ILIKE '%episode%' OR media_title ILIKE '%episode%')
  AND (title ILIKE '%customer%' OR media_title ILIKE '%customer%') AND (title LIKE '%9%' OR media_title LIKE '%9%')""",
    "asset_links": f"""
WITH {ASSETS}
SELECT asset_id,
  CASE WHEN video IS NOT NULL AND srt IS NOT NULL THEN
    concat('http://localhost:3000?videoUrl=', video, '&srtUrl=', srt, '&assetId=', asset_id) END AS editor_url,
  CASE WHEN project IS NOT NULL AND task IS NOT NULL THEN
    concat('http://localhost:8081/projects/', project, '/data?tab=', task, '&task=', task) END AS task_url,
  CASE WHEN project IS NOT NULL THEN concat('http://localhost:8081/projects/', project) END AS project_url
FROM assets a JOIN media m ON m.media_id = a.media_id""",
    "workflow_state": """
SELECT c_custkey AS media_id, (['pending', 'ingesting', 'completed', 'failed'])[c_nationkey % 4 + 1] AS ingestion_status,
  CASE WHEN c_nationkey % 4 = 0 THEN 'batch_upload' WHEN c_nationkey % 4 = 2 AND c_custkey % 3 <> 0 THEN 'open_project'
    WHEN c_nationkey % 4 = 2 THEN 'create_project' END AS action
FROM customer""",
    "asset_actions": f"""
WITH {ASSETS}
SELECT asset_id, CASE WHEN video IS NULL OR srt IS NULL THEN 'files_missing' WHEN l1_status = 'completed'
    THEN 'edit_again' ELSE 'open_editor' END AS subtitle_action,
  CASE WHEN project IS NULL THEN 'project_missing' WHEN task IS NULL THEN 'not_imported'
    WHEN annotated THEN 'view_completed' ELSE 'open_task' END AS annotation_action
FROM assets a JOIN media m ON m.media_id = a.media_id""",
    "invalid_states": """
SELECT c_custkey AS row_id, CASE WHEN c_custkey % 12 = 0 THEN 'media_type,ingestion_status'
  WHEN c_custkey % 4 = 0 THEN 'media_type' ELSE 'ingestion_status' END AS invalid
FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0
UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 35 = 0 THEN 'l1_status,l2_l3_status' WHEN o_orderkey % 5 = 0 THEN 'l1_status'
  ELSE 'l2_l3_status' END
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""",
    "status_changes": f"""
WITH {LOG}
SELECT asset_id, ts, seq, status, previous_status FROM before WHERE status <> previous_status""",
    "status_stamps": f"""
WITH {LOG}
SELECT asset_id, arg_max(status, (ts, seq)) AS status, arg_max(processing_status, (ts, seq)) AS processing_status,
  max(ts) FILTER (WHERE status <> previous_status) AS status_changed_at,
  max(ts) FILTER (WHERE processing_status <> previous_processing) AS processing_status_changed_at
FROM before GROUP BY asset_id""",
    "trigger_batch": f"""
WITH {LOG}
SELECT asset_id, ts, seq, source_video FROM before WHERE source_video <> previous_video AND source_video <> ''""",
}
ORACLES["document_files"] = ORACLES["script_documents"]
ORACLES["manifest_files"] = f"""
SELECT cast(asset_id AS varchar) AS asset_id, cast(media_id AS varchar) AS media_id, payload
FROM ({ORACLES["task_manifest"]})"""
ORACLES["status_stream"] = f"""
WITH {LOG}
SELECT asset_id, max(processing_status) FILTER (WHERE back = 1) AS processing_status,
  max(l1_status) FILTER (WHERE back = 1) AS l1_status, max(l2_l3_status) FILTER (WHERE back = 1) AS l2_l3_status,
  max(ts) FILTER (WHERE processing_status <> previous_processing) AS processing_status_changed_at,
  max(ts) FILTER (WHERE l1_status <> previous_l1) AS l1_status_changed_at,
  max(ts) FILTER (WHERE l2_l3_status <> previous_l2) AS l2_l3_status_changed_at
FROM before GROUP BY asset_id"""
ORACLES["ingest_stream"] = f"""
WITH {PLAN.replace("SELECT * FROM planned", "")}
SELECT * REPLACE (created AND NOT EXISTS (SELECT 1 FROM videos v WHERE v.media_id = p.media_id AND v.ext = '.mov') AS created)
FROM planned p"""
ORACLES["export_files"] = """
SELECT cast(o_custkey AS varchar) AS project_id, o_orderkey AS inner_id,
  concat('x-ep', o_orderkey % 30, ' [}], "', repeat(chr(92), cast(o_orderkey % 4 AS int)), '".mp4') AS file_upload,
  concat('r', o_custkey) AS region_id, concat('{"number":', o_orderkey % 9, ',"deep":[[1,{"a":"]"}]]}') AS value_json
FROM orders WHERE o_custkey % 7 <> 0"""
ORACLES["catalog_searches"] = f"""
WITH {ASSETS},
queries AS (
  SELECT s_suppkey AS query_id, coalesce(CASE s_suppkey % 6 WHEN 0 THEN concat('Episode ', s_suppkey)
    WHEN 1 THEN concat('MER#0000 ', s_suppkey % 10) WHEN 2 THEN concat('sode ', s_suppkey % 97, ' 0', s_suppkey % 7)
    WHEN 3 THEN concat(s_suppkey, ' zz') WHEN 4 THEN CASE WHEN s_suppkey = 4 THEN '' ELSE 'e 11 R#' END
    ELSE CASE WHEN s_suppkey > 5 THEN concat('customer ode 1', s_suppkey) END END, '') AS query
  FROM supplier),
texts AS (SELECT asset_id, lower(title) AS title, lower(media_title) AS work
  FROM assets a JOIN media m ON m.media_id = a.media_id)
SELECT query_id, count(*) AS n, min(asset_id) AS first_asset, cast(sum(asset_id) AS bigint) AS asset_sum
FROM queries JOIN texts ON len(list_filter(string_split(lower(query), ' '),
  lambda w: NOT (contains(title, w) OR contains(work, w)))) = 0
GROUP BY query_id"""
ORACLES["catalogue_by_id"] = f"""
WITH {ASSETS}
SELECT asset_id, media_id, title, l1_status FROM assets WHERE asset_id IN (SELECT 3 * conv_id + 1 FROM conversations)"""
ORACLES["catalogue_upsert"] = f"""
WITH {ASSETS}, filled AS (SELECT DISTINCT conv_id + 1 AS asset_id FROM conversations WHERE length(text) >= 40)
SELECT a.asset_id, media_id, title, CASE WHEN f.asset_id IS NOT NULL THEN 'completed' ELSE l1_status END AS l1_status,
  CASE WHEN f.asset_id IS NOT NULL THEN concat('l1_outputs/', a.asset_id, '_l1.ass') ELSE l1_output_file END
    AS l1_output_file
FROM assets a LEFT JOIN filled f ON f.asset_id = a.asset_id
UNION ALL SELECT -1 - s_suppkey, s_suppkey, s_name, 'pending', NULL FROM supplier"""
ORACLES["listing_files"] = """
WITH works AS (SELECT c_custkey, concat('src', c_custkey) AS media_id FROM customer),
names AS (
  SELECT doc_id // 40 AS work, concat('ep', printf('%02d', (doc_id // 4) % 10 + 1), CASE doc_id % 4 WHEN 0 THEN '.mp4'
    WHEN 1 THEN CASE WHEN (doc_id // 40) % 5 = 3 THEN '_en.srt' ELSE '.srt' END
    WHEN 2 THEN CASE WHEN (doc_id // 4) % 3 = 0 THEN '.mov' ELSE '.avi' END ELSE '.txt' END) AS name
  FROM documents)
SELECT media_id, c_custkey % 7 = 0 OR c_custkey IN (SELECT work FROM names) AS found, NULL AS name, NULL::BIGINT AS length
FROM works
UNION ALL
SELECT media_id, true, name, CASE WHEN name[1] = '_' THEN 1 ELSE length(name) END
FROM works JOIN (FROM names UNION SELECT work, '_ep01.mp4' FROM names) n ON work = c_custkey"""
ORACLES["ingest_states"] = f"""
WITH {PLAN.replace("SELECT * FROM planned", "")},
works AS (SELECT concat('src', c_custkey) AS media_id,
  c_custkey % 7 = 0 OR c_custkey IN (SELECT doc_id // 40 FROM documents) AS found FROM customer)
SELECT media_id, NULL::BIGINT AS sequence_number, 0 AS step, 'ingesting' AS status FROM works
UNION ALL SELECT media_id, NULL, 1, CASE WHEN found THEN 'completed' ELSE 'failed' END FROM works
UNION ALL SELECT media_id, unnest(sequence_numbers), 0, 'processing' FROM works JOIN (
  SELECT media_id, list(sequence_number) AS sequence_numbers FROM planned GROUP BY media_id) p USING (media_id)
UNION ALL SELECT media_id, unnest(sequence_numbers), 1, 'completed' FROM works JOIN (
  SELECT media_id, list(sequence_number) AS sequence_numbers FROM planned GROUP BY media_id) p USING (media_id)"""
ORACLES["trigger_stream"] = ORACLES["trigger_batch"]
