"""Manifest queries (ids A1-A3, B1-B7, B9, B10, B25, B32, C1, C2, D4, F4, G1-G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.catalog.registry import query
from filmloom.functions import text as T
from filmloom.operators import manifest as M
from filmloom.plans.storage import scratch_path
from filmloom.sources import derived as D
from filmloom.sources import manifest_csv as CSV

SHORT = [("YouTube URL", "url"), ("face_upscale", "face"), ("background_upscale_value", "scale"), ("Executed", "executed"), ("Remarks", "remarks")]
MISSING = ", ".join(f"'{w}'" for w in CSV.MISSING_TEXTS)


def short(df, *extra):
    return df.select(*extra, *[M.col(c).alias(a) for c, a in SHORT])


def written(spark, sf):
    path = scratch_path(spark, "manifest-csv")
    CSV.replace_manifest(M.as_text(D.manifest_local(spark, sf), ["line_no"]), path)
    return path


SHORT_SQL = ", ".join(f'"{c}" AS {a}' for c, a in SHORT)
NULLED_SQL = ", ".join(f'CASE WHEN "{c}" NOT IN ({MISSING}) THEN "{c}" END AS {a}' for c, a in SHORT)


@query("a1_manifest_scan", f"SELECT CAST(line_no AS VARCHAR) AS line_no, {NULLED_SQL} FROM manifest_local")
def a1(spark, sf):
    return short(CSV.read_manifest(spark, written(spark, sf), ["line_no", *D.MANIFEST_COLUMNS]), "line_no")


@query("a2_missing_source", f"SELECT line_no, {SHORT_SQL} FROM manifest_local")
def a2(spark, sf):
    absent = CSV.read_or_empty(spark, scratch_path(spark, "absent"), D.MANIFEST_COLUMNS)
    local = D.manifest_local(spark, sf)
    return short(local.unionByName(absent, allowMissingColumns=True), "line_no")


@query("a3_replace_manifest", """
SELECT CASE WHEN Executed <> '' THEN Executed END AS executed, CAST(count(*) + count(*) AS BIGINT) AS n FROM manifest_local GROUP BY 1
""")
def a3(spark, sf):
    path = written(spark, sf)
    twice = CSV.read_manifest(spark, path, ["line_no", *D.MANIFEST_COLUMNS])
    CSV.replace_manifest(twice.unionAll(twice), path)
    again = CSV.read_manifest(spark, path, ["line_no", *D.MANIFEST_COLUMNS])
    return again.groupBy(F.col("Executed").alias("executed")).agg(F.count(F.lit(1)).alias("n"))


@query("b1_required_columns", "SELECT line_no, \"YouTube URL\" AS url, '' AS clahe, Owner AS owner FROM manifest_online")
def b1(spark, sf):
    df = M.ensure_columns(D.manifest_online(spark, sf))
    return df.select("line_no", M.col("YouTube URL").alias("url"), "clahe", F.col("Owner").alias("owner"))


@query("b2_common_columns", """
SELECT line_no, "YouTube URL" AS url, unet, "Input Path" AS input_path, 14 AS n_columns FROM manifest_local
""")
def b2(spark, sf):
    local, online = D.manifest_local(spark, sf), D.manifest_online(spark, sf)
    names = M.common_columns(online, local)
    return local.select(*[M.col(c) for c in names]).select(
        "line_no", M.col("YouTube URL").alias("url"), "unet", M.col("Input Path").alias("input_path"), F.lit(len(names)).alias("n_columns")
    )


@query("b3_cast_to_text", "SELECT CAST(line_no AS VARCHAR) AS line_no, coalesce(face_upscale, 'nan') AS face FROM manifest_local")
def b3(spark, sf):
    df = M.as_text(D.manifest_local(spark, sf), ["line_no", "face_upscale"], null_text="nan")
    return df.select("line_no", F.col("face_upscale").alias("face"))


@query("b4_null_like_default", """
SELECT line_no, CASE WHEN u IS NULL OR lower(trim(u)) IN ('', 'nan', 'na') THEN 'none' ELSE trim(u) END AS url,
       CASE WHEN s IS NULL OR lower(trim(s)) IN ('', 'nan', 'na') THEN '2' ELSE trim(s) END AS scale
FROM (SELECT line_no, "YouTube URL" AS u, background_upscale_value AS s FROM manifest_local)
""")
def b4(spark, sf):
    return D.manifest_local(spark, sf).select(
        "line_no", T.null_like_default(M.col("YouTube URL"), "none").alias("url"),
        T.null_like_default(F.col("background_upscale_value"), "2").alias("scale"),
    )


@query("b5_checked_boolean", """
SELECT line_no, CASE face WHEN 'true' THEN true WHEN 'false' THEN false END AS face_upscale,
       CASE background_upscale WHEN '1' THEN true ELSE false END AS background_upscale,
       CASE unet WHEN 'true' THEN true WHEN 'false' THEN false END AS unet, false AS clahe, crop_video = 'y' AS crop_video,
       CASE WHEN face = 'maybe' THEN 'invalid boolean for face_upscale: maybe' END AS error
FROM (SELECT line_no, background_upscale, crop_video,
             CASE WHEN face_upscale IS NULL OR face_upscale = 'nan' THEN 'false' ELSE lower(face_upscale) END AS face,
             CASE WHEN unet IS NULL OR unet = 'nan' THEN 'true' ELSE lower(unet) END AS unet FROM manifest_local)
""")
def b5(spark, sf):
    return M.parse_flags(D.manifest_local(spark, sf)).select("line_no", *M.FLAG_DEFAULTS, "error")


@query("b6_lenient_flag", """
SELECT line_no, coalesce(lower(trim(face_upscale)) IN ('true', '1', 'yes', 'y'), false) AS face,
       coalesce(lower(trim(crop_video)) IN ('true', '1', 'yes', 'y'), false) AS crop FROM manifest_local
""")
def b6(spark, sf):
    return D.manifest_local(spark, sf).select(
        "line_no", T.lenient_flag(F.col("face_upscale")).alias("face"), T.lenient_flag(F.col("crop_video")).alias("crop")
    )


@query("b7_checked_number", """
SELECT line_no, CASE WHEN v BETWEEN 1 AND 4 THEN v END AS scale, v IS NULL OR v NOT BETWEEN 1 AND 4 AS is_error
FROM (SELECT line_no, CASE WHEN trim(background_upscale_value) SIMILAR TO '[0-9]+' THEN CAST(trim(background_upscale_value) AS DOUBLE) END AS v FROM manifest_local)
""")
def b7(spark, sf):
    scale = T.checked_scale(F.col("background_upscale_value"))
    return D.manifest_local(spark, sf).select("line_no", scale.alias("scale"), scale.isNull().alias("is_error"))


@query("b9_pending_rows", """
SELECT line_no, "YouTube URL" AS url, Executed AS executed FROM manifest_local
WHERE lower(trim(Executed)) <> 'yes' AND trim(coalesce("YouTube URL", '')) LIKE 'http%'
""")
def b9(spark, sf):
    return M.pending(D.manifest_local(spark, sf)).select("line_no", M.col("YouTube URL").alias("url"), F.col("Executed").alias("executed"))


@query("b10_input_kind", """
SELECT line_no, CASE WHEN "YouTube URL" LIKE '%youtube.com%' OR "YouTube URL" LIKE '%youtu.be%' THEN 'youtube' ELSE 'path' END AS kind FROM manifest_local
""")
def b10(spark, sf):
    return D.manifest_local(spark, sf).select("line_no", T.input_kind(M.col("YouTube URL")).alias("kind"))


@query("b25_notifications", """
SELECT o.line_no, CASE WHEN new_status = 'Yes' THEN '✅ Pipeline Completed' ELSE '❌ Pipeline Failed' END AS subject,
       'Video: ' || trim(coalesce("YouTube URL", '')) || chr(10) || 'Start: ' || new_start || chr(10) || 'End: ' || new_end || chr(10)
       || 'Status: ' || new_status || chr(10) || 'Remarks: ' || new_remarks AS body
FROM outcomes o JOIN manifest_local m ON m.line_no = o.line_no
""")
def b25(spark, sf):
    return M.notifications(D.outcomes(spark, sf).join(D.manifest_local(spark, sf), "line_no"))


@query("b32_update_at_key", """
SELECT line_no, CASE WHEN line_no = 27 THEN 'yes' ELSE clahe END AS clahe, CASE WHEN line_no = 27 THEN '00:02:51' ELSE "end_time (01:22:33)" END AS end_time
FROM manifest_local
""")
def b32(spark, sf):
    df = M.update_at(D.manifest_local(spark, sf), "line_no", 27, {"clahe": "yes", "end_time (01:22:33)": "00:02:51"})
    return df.select("line_no", "clahe", M.col("end_time (01:22:33)").alias("end_time"))


@query("c1_write_back", """
SELECT m.line_no, coalesce(new_status, Executed) AS executed, coalesce(new_start, "Start Time") AS started,
       CASE WHEN o.line_no IS NULL THEN "End Time" WHEN new_end = '' THEN 'N/A' ELSE new_end END AS ended,
       coalesce(new_remarks, Remarks) AS remarks
FROM manifest_local m LEFT JOIN outcomes o ON o.line_no = m.line_no
""")
def c1(spark, sf):
    df = M.write_back(D.manifest_local(spark, sf), D.outcomes(spark, sf))
    return df.select(
        "line_no", F.col("Executed").alias("executed"), M.col("Start Time").alias("started"), M.col("End Time").alias("ended"), F.col("Remarks").alias("remarks")
    )


@query("c2_keyed_reset", """
SELECT m.line_no, k.url IS NOT NULL AS was_reset, CASE WHEN k.url IS NULL THEN Executed END AS executed,
       CASE WHEN k.url IS NULL THEN "Input Path" END AS input_path
FROM manifest_local m LEFT JOIN (SELECT DISTINCT "YouTube URL" AS url FROM manifest_online WHERE Owner = 'BUILDING') k
  ON trim(m."YouTube URL") = k.url
""")
def c2(spark, sf):
    keys = D.manifest_online(spark, sf).filter("Owner = 'BUILDING'").select(M.col("YouTube URL"))
    df = M.reset_matching(D.manifest_local(spark, sf), keys)
    return df.select("line_no", "was_reset", F.col("Executed").alias("executed"), M.col("Input Path").alias("input_path"))


@query("d4_duplicate_keys", """
SELECT CAST(count(*) - count(DISTINCT "YouTube URL") - CAST(bool_or("YouTube URL" IS NULL) AS INTEGER) AS BIGINT) AS duplicates FROM manifest_local
""")
def d4(spark, sf):
    return M.duplicate_count(D.manifest_local(spark, sf))


@query("f4_preview", 'SELECT line_no, "YouTube URL" AS url FROM manifest_local ORDER BY line_no LIMIT 100')
def f4(spark, sf):
    return M.preview(D.manifest_local(spark, sf), "line_no").select("line_no", M.col("YouTube URL").alias("url"))


MERGED_SQL = """
SELECT line_no, url, unet, input_path, owner FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, line_no) AS rn FROM (
    SELECT 0 AS src, line_no, "YouTube URL" AS url, unet, "Input Path" AS input_path, CAST(NULL AS VARCHAR) AS owner FROM manifest_local
    UNION ALL SELECT 1, line_no, "YouTube URL", unet, {path}, Owner FROM manifest_online))
WHERE rn = 1
"""


@query("g1_union_keep_first", MERGED_SQL.format(path="NULL"))
def g1(spark, sf):
    df = M.keep_first(D.manifest_local(spark, sf), D.manifest_online(spark, sf), "YouTube URL", "line_no")
    return df.select("line_no", M.col("YouTube URL").alias("url"), "unet", M.col("Input Path").alias("input_path"), F.col("Owner").alias("owner"))


@query("g2_merge_sheets", f"SELECT line_no, url, unet, input_path, 15 AS n_columns FROM ({MERGED_SQL.format(path=chr(39) * 2)})")
def g2(spark, sf):
    df = M.merge_sheets(D.manifest_local(spark, sf), D.manifest_online(spark, sf))
    return df.select(
        "line_no", M.col("YouTube URL").alias("url"), "unet", M.col("Input Path").alias("input_path"), F.lit(len(df.columns)).alias("n_columns")
    )


@query("g3_empty_keep_schema", "SELECT count(*) AS n, 15 AS n_columns FROM manifest_local WHERE false")
def g3(spark, sf):
    empty = M.empty_like(D.manifest_local(spark, sf))
    return empty.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(empty.columns)))
