"""The derived tables as DuckDB views, written as common table expressions.

``with_views`` puts the ones a statement uses in front of it. Array functions of DuckDB are 1-based.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["frames"] = """
SELECT vec_id % 4 AS video_id,
       row_number() OVER (PARTITION BY vec_id % 4 ORDER BY label, vec_id) - 1 AS frame_idx,
       8 AS h, 8 AS w,
       list_transform(embedding, lambda e: CAST(greatest(least(floor(20 + label * 20 + CAST(e AS DOUBLE) * 16), 255), 0) AS INTEGER)) AS px
FROM embeddings
"""

VIEWS["pixels"] = """
SELECT video_id, frame_idx, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
       px[i + 1] AS b, px[(i + 1) % 64 + 1] AS g, px[(i + 9) % 64 + 1] AS r
FROM frames CROSS JOIN range(64) t(i)
"""

VIEWS["masks"] = """
SELECT video_id, frame_idx, h, w, CAST(k AS INTEGER) AS inst,
       list_transform(px, lambda v: CAST((v + 37 * k) % 11 = 0 AS INTEGER)) AS mask
FROM frames CROSS JOIN range(1, 5) t(k)
"""

VIEWS["scores"] = """
SELECT video_id, frame_idx,
       CASE WHEN p IS NULL THEN CAST(0 AS DOUBLE)
            ELSE list_sum(list_transform(range(1, 65), lambda i: abs(px[i] - p[i]))) / CAST(64 AS DOUBLE) END AS score
FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM frames)
"""

VIEWS["cuts"] = """
SELECT video_id, frame_idx, score, ratio, ratio >= 2.5 AND score >= 15 AS is_cut
FROM (SELECT video_id, frame_idx, score,
             CASE WHEN coalesce(s, 0) > 0 THEN score / (s / n) WHEN score >= 15 THEN CAST(255 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ratio
      FROM (SELECT video_id, frame_idx, score,
                   coalesce(sum(score) OVER a, 0) + coalesce(sum(score) OVER b, 0) AS s,
                   count(score) OVER a + count(score) OVER b AS n
            FROM scores
            WINDOW a AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
                   b AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)))
"""

VIEWS["scenes"] = """
SELECT video_id, scene_id, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame
FROM (SELECT video_id, frame_idx,
             CAST(1 + sum(CAST(is_cut AS INTEGER)) OVER (PARTITION BY video_id ORDER BY frame_idx) AS BIGINT) AS scene_id FROM cuts)
GROUP BY video_id, scene_id
"""

VIEWS["pieces"] = """
SELECT video_id, s AS start_frame, least(s + 5, end_frame) AS end_frame
FROM (SELECT video_id, end_frame, unnest(range(start_frame, end_frame, 5)) AS s FROM scenes)
"""

VIEWS["placed"] = """
SELECT p.video_id, p.start_frame, p.end_frame, coalesce(min(s.scene_id), 0) AS scene_id
FROM pieces p LEFT JOIN scenes s
  ON s.video_id = p.video_id AND p.start_frame >= s.start_frame AND p.end_frame <= s.end_frame
GROUP BY p.video_id, p.start_frame, p.end_frame
"""

VIEWS["members"] = """
SELECT video_id, scene_id, start_frame, end_frame, start_frame + (end_frame - start_frame) // 2 AS mid_frame,
       row_number() OVER (PARTITION BY video_id, scene_id ORDER BY start_frame) - 1 AS pos,
       count(*) OVER (PARTITION BY video_id, scene_id) AS n
FROM placed
"""

VIEWS["detections"] = """
SELECT l_orderkey % 4 AS video_id, l_orderkey // 4 AS frame_idx, l_partkey * 8 + l_linenumber AS det_no,
       CAST(l_partkey % 6 AS INTEGER) AS x1, CAST(s % 6 AS INTEGER) AS y1,
       CAST(l_partkey % 6 + 1 + l_linenumber % 3 AS INTEGER) AS x2,
       CAST(s % 6 + 1 + CAST(q AS INTEGER) % 3 AS INTEGER) AS y2,
       q / 50 AS conf, CAST(l_partkey % 3 AS INTEGER) AS cls
FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY ALL)
"""

VIEWS["manifest_local"] = """
SELECT o_orderkey AS line_no,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN ''
            WHEN o_orderkey % 23 = 0 THEN '/data/in/' || o_orderkey || '.mkv'
            WHEN o_orderkey % 2 = 0 THEN 'https://www.youtube.com/watch?v=' || o_custkey
            ELSE ' https://youtu.be/' || o_custkey END AS "YouTube URL",
       flag AS face_upscale,
       CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'No' END AS background_upscale,
       CASE WHEN o_orderkey % 7 = 0 THEN ' NaN ' WHEN o_orderkey % 11 = 0 THEN 'two'
            ELSE CAST(o_orderkey % 6 AS VARCHAR) END AS background_upscale_value,
       flag AS unet, '' AS clahe,
       CASE WHEN o_orderkey % 3 = 0 THEN 'y' ELSE 'n' END AS crop_video,
       '00:00:05' AS "start_time (00:00:00)",
       '00:01:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS "end_time (01:22:33)",
       CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'P' THEN 'Error' ELSE '' END AS Executed,
       '' AS "Start Time", '' AS "End Time",
       CASE WHEN o_orderkey % 5 = 0 THEN 'failed: out of memory, retry' ELSE '' END AS Remarks,
       'input_videos/' || o_orderkey || '.mp4' AS "Input Path"
FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'true' WHEN '2' THEN 'False' WHEN '3' THEN 'nan' WHEN '4' THEN 'maybe' END AS flag FROM orders)
"""

VIEWS["manifest_online"] = """
SELECT c_custkey AS line_no,
       CASE WHEN c_custkey % 2 = 0 THEN 'https://www.youtube.com/watch?v=' ELSE 'https://youtu.be/' END || c_custkey AS "YouTube URL",
       '' AS face_upscale, '' AS background_upscale, '' AS background_upscale_value,
       CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'nan' END AS unet,
       '' AS crop_video, '' AS "start_time (00:00:00)", '' AS "end_time (01:22:33)", '' AS Executed,
       '' AS "Start Time", '' AS "End Time", '' AS Remarks, c_mktsegment AS Owner
FROM customer
"""

VIEWS["outcomes"] = """
SELECT o_orderkey AS line_no, CASE WHEN good THEN 'Yes' ELSE 'Error' END AS new_status,
       '2025-01-01T00:00:00' AS new_start, CASE WHEN good THEN '2025-01-01T01:00:00' ELSE '' END AS new_end,
       CASE WHEN good THEN '' ELSE 'code ' || (o_orderkey % 9) END AS new_remarks
FROM (SELECT *, CAST(floor(o_totalprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) % 2 = 0 AS good FROM orders WHERE o_orderstatus <> 'F')
"""

VIEWS["jobs"] = """
SELECT o_orderkey AS job_id,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed'
            WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'running' END AS status,
       CAST(o_orderkey % 101 AS INTEGER) AS progress, o_custkey % 8 AS node_id,
       CASE WHEN o_orderkey % 2 = 1 THEN
         '{"jobType":"batch_csv","youtubeUrl":"' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'https://youtu.be/' || o_custkey END
         || '","youtube_url":"alt-' || o_orderkey || '","partIndex":' || (o_orderkey % 3) || ',"part_index":7'
         || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN ',"unetFlag":null,"unet_flag":true,"upscaleValue":1.5'
                 ELSE ',"unetFlag":true,"upscaleValue":3' END || '}'
       ELSE
         '{"mode":"single","type":"","youtube_url":"https://youtu.be/' || o_custkey || '","part_index":' || (o_orderkey % 3)
         || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"unet_flag":true,"upscale_value":4.0' END || '}'
       END AS body
FROM orders
"""

VIEWS["log"] = """
SELECT user_id AS job_id, event_id AS line_no,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS ts_us,
       CASE event_type
         WHEN 'click' THEN CASE i % 4 WHEN 0 THEN 'Progress: ' || k || '%' WHEN 1 THEN ' ' || k || '%|####  | 3/8'
              WHEN 2 THEN 'frame=  ' || (k * 11) || ' fps=25'
              ELSE 'size=1kB time=00:0' || (i % 3) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(i % 100 AS VARCHAR), 2, '0') || ' speed=1x' END
         WHEN 'view' THEN CASE i % 7 WHEN 0 THEN 'Task ' || k || ' / 100' WHEN 1 THEN 'task ' || k || '/8'
              WHEN 2 THEN '[INFO] Running restoration...' WHEN 3 THEN '[INFO] Starting scene detection for: x'
              WHEN 4 THEN 'ComfyUI server ready' WHEN 5 THEN 'Colorized final video at: tmp/' || i || '.mp4'
              ELSE 'Task ' || k || ' / 0' END
         WHEN 'signup' THEN CASE i % 2 WHEN 0 THEN '🎯 Video URL: https://youtu.be/' || i ELSE '📥 Resolved Path: input_videos/' || i || '.mp4' END
         WHEN 'purchase' THEN CASE i % 4 WHEN 0 THEN 'final video at: /workspace/out//' || i || '.mp4'
              WHEN 1 THEN 'Final Postprocessed video at: out/' || i || '.mp4' ELSE 'final video at: output_videos/x/../' || i || '.mp4 ' END
         ELSE CASE WHEN i % 5 = 0 THEN '' WHEN i % 2 = 0 THEN 'status: Error' ELSE 'remarks: code ' || k || ': retry' END
       END AS line
FROM (SELECT *, event_id AS i, CAST(props->>'$.k' AS INTEGER) AS k FROM events)
"""

VIEWS["gpu_lines"] = """
SELECT CAST(s_nationkey % 8 AS BIGINT) AS node_id, s_suppkey AS probe_no, part, line FROM (
  SELECT *, 0 AS part, concat_ws(', ', s_suppkey, s_name, s_suppkey % 30, (s_suppkey * 97) % 8000, CASE WHEN s_suppkey % 25 = 0 THEN '0' ELSE '8000' END, s_suppkey % 40 + 40) AS line FROM supplier
  UNION ALL SELECT *, 1, '   ' FROM supplier WHERE s_suppkey % 10 = 0
  UNION ALL SELECT *, 2, 'n/a, no device, -' FROM supplier WHERE s_suppkey % 10 = 1)
"""

VIEWS["gpus"] = """
SELECT node_id, probe_no, CAST(p[1] AS INTEGER) AS gpu_index, p[2] AS name, CAST(p[3] AS INTEGER) AS utilization,
       CAST(p[4] AS INTEGER) AS memory_used, CAST(p[5] AS INTEGER) AS memory_total, CAST(p[6] AS INTEGER) AS temperature
FROM (SELECT node_id, probe_no, list_transform(string_split(line, ','), lambda s: trim(s)) AS p FROM gpu_lines WHERE trim(line) <> '')
WHERE len(p) >= 6
"""

VIEWS["files"] = """
SELECT p_partkey AS file_id, name,
       CASE WHEN p_partkey % 29 = 0 THEN '/workspace2/' WHEN p_partkey % 13 = 0 THEN '../../etc/'
            WHEN p_partkey % 11 = 0 THEN 'input_videos/./x/../Scene_' || p_size || '//'
            WHEN p_partkey % 7 = 0 THEN '/workspace/input_videos/' ELSE 'input_videos/Scene_' || p_size || '/' END || name AS path,
       p_partkey * 31 % 1000 AS size, p_partkey % 3 = 0 AS is_done, p_size
FROM (SELECT *, 'Actor_' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' WHEN 2 THEN '.txt' ELSE '' END AS name FROM part)
"""

# The workspace root, with the five folder shapes of ``files`` resolved by hand.
VIEWS["resolved"] = """
SELECT file_id, name, path, size, is_done,
       CASE WHEN file_id % 29 = 0 THEN '/workspace2/' WHEN file_id % 13 = 0 THEN '/etc/'
            WHEN file_id % 11 = 0 THEN '/workspace/input_videos/Scene_' || p_size || '/'
            WHEN file_id % 7 = 0 THEN '/workspace/input_videos/' ELSE '/workspace/input_videos/Scene_' || p_size || '/' END || name AS full_path
FROM files
"""

VIEWS["videos"] = """
SELECT p_partkey AS video_id, CASE WHEN p_partkey % 5 = 0 THEN '0/0' WHEN p_partkey % 2 = 0 THEN '25/1' ELSE '30000/1001' END AS rate,
       CAST(p_size * 40 AS BIGINT) AS width, p_size * 30 - p_partkey % 7 + 7 AS height, p_partkey % 400 AS frame_count
FROM part
"""

VIEWS["video_rates"] = """
SELECT *, CASE rate WHEN '25/1' THEN CAST(25 AS DOUBLE) WHEN '30000/1001' THEN CAST(30000 AS DOUBLE) / 1001 END AS fps FROM videos
"""

VIEWS["template_nodes"] = """
SELECT p_partkey AS template_id, (k - p_partkey % 5 + 5) % 5 AS node_pos, n.node_id, n.class_type, n.inputs
FROM part CROSS JOIN (VALUES
  (0, '78', 'Load Image', [{'k': 'image', 'v': '"a.png"'}, {'k': 'upload', 'v': '"image"'}]),
  (1, '76', 'CLIPTextEncode', [{'k': 'text', 'v': '"old"'}, {'k': 'clip', 'v': '["38",0]'}]),
  (2, '3', 'KSampler', [{'k': 'seed', 'v': '1'}, {'k': 'steps', 'v': '4'}, {'k': 'cfg', 'v': '1.5'}]),
  (3, '35', 'FluxGuidance', [{'k': 'guidance', 'v': '2.5'}, {'k': 'cfg', 'v': '9.5'}]),
  (4, '77', 'TextEncode', [{'k': 'prompt', 'v': '"none"'}, {'k': 'width', 'v': '64'}])
) n(k, node_id, class_type, inputs)
"""

VIEWS["template_inputs"] = """
SELECT template_id, node_pos, node_id, class_type, u.k AS input, u.v AS value
FROM template_nodes, (SELECT unnest(inputs) AS u)
"""

VIEWS["requests"] = """
SELECT event_id AS prompt_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS req_us FROM events
"""

VIEWS["responses"] = """
SELECT event_id AS prompt_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') + CAST(k AS BIGINT) * 13000000 AS resp_us, part
FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)
CROSS JOIN (VALUES ('clothes'), ('arms'), ('neck'), ('faces')) p(part)
WHERE k % 10 <> 0 AND (part <> 'faces' OR k % 7 <> 0)
"""

VIEWS["vectors"] = """
SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 8) AS logits FROM embeddings
"""


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [name for name in VIEWS if name in words]


def with_views(sql: str) -> str:
    """Put the views a statement names, and those they name, in front of it."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in _used(text):
            if name != own and name not in needed:
                visit(VIEWS[name], name)
                needed.append(name)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    # A statement that brings its own WITH continues the list.
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    if own is None:
        return f"WITH {views}\n{sql}"
    return f"WITH {own.group(1) or ''}{views},\n{sql[own.end():]}"
