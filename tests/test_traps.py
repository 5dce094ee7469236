"""Hand-made rows for the cases where the obvious reading is wrong."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from filmloom.functions import color as C
from filmloom.functions import numbers as N
from filmloom.functions import paths as P
from filmloom.functions import progress as PR
from filmloom.functions import text as T
from filmloom.operators import batches as B
from filmloom.operators import detections as DT
from filmloom.operators import frames as FR
from filmloom.operators import logs as L
from filmloom.operators import manifest as M
from filmloom.operators import pixels as PX
from filmloom.operators import scenes as S
from filmloom.plans.storage import scratch_path
from filmloom.sources import logs as SL
from filmloom.sources import manifest_csv as CSV
from filmloom.sources import telemetry as G
from filmloom.sources import templates as TP


def column(spark, values, type_="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {type_}")


def apply(spark, values, expression, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def frame_table(spark, videos):
    """``{video: [plane, ...]}`` to frames of 2 x 2 pixels."""
    data = [(v, i, 2, 2, px) for v, planes in videos.items() for i, px in enumerate(planes)]
    return spark.createDataFrame(data, "video_id bigint, frame_idx bigint, h int, w int, px array<int>")


# text


def test_null_like_words(spark):
    got = apply(spark, [None, "", " ", "NaN", " na ", "nano", " x "], lambda c: T.null_like_default(c, "d"))
    assert got == ["d", "d", "d", "d", "d", "nano", "x"]


def test_checked_boolean_and_strict_mode(spark):
    assert apply(spark, ["T", "yes", "0", "N", "maybe"], T.checked_bool) == [True, True, False, False, None]
    with pytest.raises(PySparkException, match="invalid boolean for unet: maybe"):
        column(spark, ["maybe"]).select(T.strict_bool(F.col("v"), "unet")).collect()


def test_lenient_flag_takes_four_words_only(spark):
    assert apply(spark, [" TRUE ", "1", "y", "t", None], T.lenient_flag) == [True, True, True, False, False]


def test_number_range_is_closed_and_plain_decimal(spark):
    values = ["1", "4.0", "0.99", "4.01", "2d", "nan", "1e0", " 2 ", "", None]
    assert apply(spark, values, T.checked_scale) == [1.0, 4.0, None, None, None, None, 1.0, 2.0, None, None]


def test_archive_name(spark):
    df = spark.createDataFrame([("", "a.mp4"), (None, ""), ("__", "b"), ("x" * 90, "c")], "u string, n string")
    got = [r[0] for r in df.select(T.safe_archive_name(F.col("u"), F.col("n"))).collect()]
    assert got == ["a.mp4_a.mp4", "video_", "video_b", "x" * 80 + "_c"]


def test_latin_name(spark):
    name = "dir/Ｆilm ﬁ ä漢字٣_-.x" + "y" * 40
    (got,) = apply(spark, [name], lambda c: T.latin_file_name(c, "20250101000000"))
    normal = "Film fi ä漢字٣_-.x" + "y" * 40
    kept = "Filmfiä٣_-.x" + "y" * 40
    assert got == f"{kept[:32]}_20250101000000_{hashlib.sha1(normal.encode()).hexdigest()[:8]}"


# paths


def test_normal_path_is_posix(spark):
    values = ["a//b/./c/../d", "/../x", "../x", "", "//a", "///a", "a/..", "/", "./", "a/../../b"]
    import posixpath

    assert apply(spark, values, P.normal_path) == [posixpath.normpath(v) for v in values]


def test_sibling_folder_is_not_inside(spark):
    values = ["/workspace2/x", "/workspace/x", "/workspace", "/etc"]
    assert apply(spark, values, P.is_inside) == [False, True, True, False]
    assert apply(spark, values, lambda c: P.is_inside(c, boundary=False)) == [True, True, True, False]


def test_suffix_is_the_last_one(spark):
    got = apply(spark, ["a.MP4", "a.mp4.txt", "mp4", "a."], lambda c: P.has_suffix(c, P.VIDEO_SUFFIXES))
    assert got == [True, False, False, False]


def test_stem(spark):
    from pathlib import PurePosixPath

    values = ["x/a.b.mp4", ".bashrc", "noext", "a.", "d/.x.y"]
    assert apply(spark, values, P.stem) == [PurePosixPath(v).stem if v != "a." else "a." for v in values]


# progress and stages


def test_percent_cuts_instead_of_rounding(spark):
    values = ["Progress: 100%", "progress:7%", "Task 29 / 100", "Task 1/0", "Task 3/8", "none", "Progress: 5% Task 9/9"]
    want = [95, 7, int(29 / 100 * 100), None, 37, None, 5]
    assert apply(spark, values, PR.percent) == want


def test_dialects(spark):
    lines = ["1234%|x", " 45%|##", "a b%|", "frame=  500 fps=1", "frame=5", "x 250%"]
    assert apply(spark, lines, PR.first_percent) == [100, 45, None, None, None, 100]
    assert apply(spark, lines, PR.bar_percent) == [100, 45, None, None, None, None]
    assert apply(spark, lines, PR.bar_digits) == [1234, 45, None, None, None, None]
    assert apply(spark, lines, PR.frame_percent) == [None, None, None, 50, None, None]


def test_stage_order(spark):
    lines = ["Colorized final video at: x", "final video at: y", "Postprocessed", "comfyui", "ComfyUI colorized", "running restoration"]
    assert apply(spark, lines, PR.stage) == ["colorize", "finalize", "postprocess", None, "comfyui", None]


def test_session_rules(spark):
    lines = [
        "status: lost", "🎯 Video URL: a", "  ", "📥 Resolved Path: in/a: b.mp4", "final video at: o.mp4", "status: Error",
        "Video URL: x Video URL: b", "remarks: r1", "remarks: r2: more",
    ]
    log = spark.createDataFrame([(1, i, i, l) for i, l in enumerate(lines)], "job_id bigint, line_no bigint, ts_us bigint, line string")
    got = rows(L.session_results(L.sessions(log, block=2)))
    assert got == [(1, 1, "a", "Error", "in/a: b.mp4", "o.mp4", None, 4), (1, 2, "b", "running", None, None, "r2: more", 3)]


def test_closing_increment_completes_the_total(spark):
    lines = ["time=00:00:02.00 x", "time=00:00:01.00", "time=00:00:04.50", "done"]
    log = spark.createDataFrame([(1, i, i, l) for i, l in enumerate(lines)], "job_id bigint, line_no bigint, ts_us bigint, line string")
    got = rows(L.frame_increments(log, 10.0, 100), "line_no", "gained", "is_closing")
    assert got == [(0, 20, False), (1, 0, False), (2, 25, False), (2, 55, True)]


def test_log_files_keep_line_order(spark):
    path = scratch_path(spark, "log-files")
    spark.range(500).select(F.format_string("line %05d", "id")).coalesce(1).write.text(path)
    log = SL.read_log_files(spark, path)
    got = [(r.line_no, r.line) for r in log.orderBy("line_no").collect()]
    assert got == [(i + 1, f"line {i:05d}") for i in range(500)]


# telemetry


def test_gpu_lines_and_percent(spark):
    lines = ["0, A, 5, 1164, 8000, 40", "", "1, B, 5", "2, C, 9, 10, 0, 41", "0, D, x, 1, 2, 3, 9"]
    got = rows(G.parse_gpu_lines(spark.createDataFrame([(l,) for l in lines], "line string")).withColumn("p", G.memory_percent()), "name", "utilization", "p")
    assert got == [("A", 5, round(1164 / 8000 * 100, 1)), ("C", 9, 0.0), ("D", None, 50.0)]
    short = G.parse_gpu_lines(spark.createDataFrame([("A, 100, 50, 40, 7",)], "line string"), G.SHORT_FIELDS)
    assert rows(short) == [("A", 100, 50, 40, 7)]


def test_tenths_round_like_python(spark):
    values = [u / t * 100 for t in (8000, 8192, 15943) for u in range(0, t + 1, 7)]
    assert apply(spark, values, N.round_tenth, "double") == [round(v, 1) for v in values]


# manifest


def test_merge_keeps_first_and_counts_null_once(spark):
    local = spark.createDataFrame([(1, None, "p"), (2, "u", "q"), (3, None, "r")], "line_no bigint, `YouTube URL` string, `Input Path` string")
    online = spark.createDataFrame([(1, "u", "o"), (2, "w", "o")], "line_no bigint, `YouTube URL` string, Owner string")
    merged = M.merge_sheets(local, online)
    assert rows(merged, "`YouTube URL`", "`Input Path`") == [("u", "q"), ("w", ""), (None, "p")]
    assert "Owner" not in merged.columns
    assert M.duplicate_count(local).first()[0] == 1


def test_merge_into_missing_master(spark):
    online = M.ensure_columns(spark.createDataFrame([(1, "u")], "line_no bigint, `YouTube URL` string"))
    absent = CSV.read_or_empty(spark, scratch_path(spark, "none"), [*online.columns, "Input Path"])
    assert rows(M.merge_sheets(absent, online), "`YouTube URL`", "`Input Path`") == [("u", "")]


def test_csv_keeps_quotes_and_line_ends(spark):
    text = 'failed: "out, of\nmemory", code: 1'
    path = scratch_path(spark, "quoted")
    CSV.replace_manifest(spark.createDataFrame([("u", text, "N/A")], "a string, b string, c string"), path)
    assert rows(CSV.read_manifest(spark, path)) == [("u", text, None)]


def test_write_back_fills_missing_end(spark):
    base = spark.createDataFrame([(1, "", "", "", ""), (2, "Yes", "s", "e", "")], "line_no bigint, Executed string, `Start Time` string, `End Time` string, Remarks string")
    done = spark.createDataFrame([(1, "Error", "s", "", "why")], "line_no bigint, new_status string, new_start string, new_end string, new_remarks string")
    assert rows(M.write_back(base, done)) == [(1, "Error", "s", "N/A", "why"), (2, "Yes", "s", "e", "")]


def test_reset_strips_the_key(spark):
    base = spark.createDataFrame([(" u ", "Yes"), ("v", "Yes"), (None, "Yes")], "`YouTube URL` string, Executed string")
    got = M.reset_matching(base, spark.createDataFrame([("u",), ("u",)], "k string"), columns=["Executed"])
    assert rows(got) == [(" u ", None, True), ("v", "Yes", False), (None, "Yes", False)]


# templates


def test_first_node_in_document_order(spark):
    body = '{"9":{"inputs":{"prompt":"p"},"class_type":"X"},"1":{"inputs":{"text":"t","seed":1},"class_type":"LoadImage"}}'
    df = spark.createDataFrame([(1, body)], "template_id int, body string")
    patched = TP.patched(df, lambda n: TP.with_prompt(n, "new"), lambda n: TP.with_image(n, "i.png"))
    got = rows(TP.scan(patched), "node_id", "input", "value")
    assert got == [("1", "image", '"i.png"'), ("1", "seed", "1"), ("1", "text", '"t"'), ("9", "prompt", '"new"')]


def test_seed_is_an_exclusive_or():
    assert 2 ^ 24 == 26


# scenes


def test_video_without_cut_is_one_scene(spark):
    frames = frame_table(spark, {1: [[10, 10, 10, 10]] * 7})
    _, scenes = S.detect(frames)
    assert rows(scenes, "video_id", "scene_id", "start_frame", "end_frame") == [(1, 1, 0, 7)]


def test_cut_across_a_segment_border(spark):
    frames = frame_table(spark, {1: [[0] * 4] * 5 + [[200] * 4] * 6})
    scores = S.content_scores(frames, segment=5)
    cuts = S.adaptive_cuts(scores, segment=5)
    assert [r.frame_idx for r in cuts.filter("is_cut").collect()] == [5]


def test_unplaced_piece_gets_zero_and_overlap_takes_the_lowest(spark):
    scenes = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 40, 5000)], "video_id bigint, scene_id bigint, start_frame bigint, end_frame bigint")
    pieces = spark.createDataFrame([(1, 42, 48), (1, 45, 55), (1, 4000, 4010), (1, 30, 60), (2, 0, 1)], "video_id bigint, start_frame bigint, end_frame bigint")
    got = rows(S.first_enclosing(pieces, scenes, bin_frames=16))
    assert got == [(1, 30, 60, 0), (1, 4000, 4010, 2), (1, 42, 48, 1), (1, 45, 55, 2), (2, 0, 1, 0)]


def test_lower_middle(spark):
    pieces = spark.createDataFrame([(1, s, i, i + 1) for s, n in ((1, 1), (2, 2), (3, 3), (4, 4)) for i in range(n)], "video_id bigint, scene_id bigint, start_frame bigint, end_frame bigint")
    assert rows(S.lower_middle(S.ordered_members(pieces)), "scene_id", "pos") == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_unequal_counts_fail_in_strict_mode(spark):
    a = spark.range(3).select(F.lit(1).alias("k"), "id")
    b = spark.range(2).select(F.lit(1).alias("k"), F.col("id").alias("other"))
    arguments = (a, b, ["k"], ["id"], ["other"], [F.lit(0)], [F.lit(0)])
    with pytest.raises(PySparkException, match="counts differ"):
        FR.zip_positions(*arguments, strict=True).collect()
    assert FR.zip_positions(*arguments, strict=False).count() == 2


# detections


def test_cut_to_k_comes_before_the_class_filter(spark):
    boxes = [(1, 0, 0, 0.9, 1), (1, 0, 1, 0.8, 2), (1, 0, 2, 0.8, 1), (1, 0, 3, 0.7, 0)]
    df = spark.createDataFrame(boxes, "video_id bigint, frame_idx bigint, det_no bigint, conf double, cls int")
    assert DT.top_detections(df).count() == 0
    assert rows(DT.top_detections(df, k=4), "det_no") == [(3,)]
    assert rows(DT.top_detections(df, k=2, cls=1, min_conf=0.0), "det_no") == [(0,), (2,)]


def test_enlarged_box_stays_in_the_picture(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 5, 5), (1, 0, 7, 7, 7, 9)], "video_id bigint, frame_idx bigint, x1 int, y1 int, x2 int, y2 int")
    assert rows(DT.clamped(df, 6, 6, 0.2), "x1", "y1", "x2", "y2") == [(0, 0, 6, 6)]


def test_token_at_the_edges_does_not_count(spark):
    logits = [[9.0, -9.0, -9.0], [-9.0, 9.0, -9.0], [9.0, 8.0, -9.0]]
    df = spark.createDataFrame(list(enumerate(logits)), "id bigint, logits array<double>")
    assert rows(DT.best_tokens(df), "id", "token") == [(1, 1), (2, 0)]


# pixels


def labels_of(spark, mask):
    mask = np.asarray(mask)
    data = [(1, 0, *mask.shape, mask.ravel().tolist())]
    df = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, h int, w int, mask array<int>")
    return np.asarray(PX.connected_regions(df).first().labels).reshape(mask.shape)


def test_diagonal_pixels_are_one_region(spark):
    assert labels_of(spark, [[1, 0, 0], [0, 1, 0], [1, 0, 0]]).max() == 1
    assert len(set(labels_of(spark, [[1, 0, 1], [0, 0, 0], [0, 1, 0]]).ravel())) == 4


def test_long_winding_region(spark):
    mask = np.zeros((21, 21), dtype=int)
    mask[::2] = 1
    for i, row in enumerate(range(1, 21, 2)):
        mask[row, 20 if i % 2 == 0 else 0] = 1
    assert set(labels_of(spark, mask).ravel()) == {0, 1}


def test_random_regions_agree_with_a_search(spark):
    rng = np.random.default_rng(3)
    mask = (rng.random((16, 17)) < 0.4).astype(int)
    got, seen, number = labels_of(spark, mask), np.zeros_like(mask), {}
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        stack, members = [start], []
        seen[start] = 1
        while stack:
            y, x = stack.pop()
            members.append((y, x))
            for b in range(max(0, y - 1), min(16, y + 2)):
                for a in range(max(0, x - 1), min(17, x + 2)):
                    if mask[b, a] and not seen[b, a]:
                        seen[b, a] = 1
                        stack.append((b, a))
        assert len({got[m] for m in members}) == 1
        number[start] = got[start]
    assert len(set(number.values())) == len(number)


def test_zero_tile_and_tie_of_strongest_merge(spark):
    cells = [(1, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 1, 3, 4), (1, 0, 0, 0, 2, -4, 3), (1, 0, 0, 1, 0, 0, 0)]
    df = spark.createDataFrame(cells, "video_id bigint, frame_idx bigint, y int, x int, tile_no bigint, a int, b int")
    assert rows(PX.merge_strongest(df), "x", "a", "b") == [(0, 3, 4), (1, 0, 0)]


def test_missing_plane_is_an_error(spark):
    base = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], "video_id bigint, frame_idx bigint, y int, x int")
    planes = base.withColumns({"name": F.lit("L"), "v": F.lit(1.0)}).filter("x = 0")
    with pytest.raises(PySparkException, match="plane L is missing"):
        PX.channel_stack(base, planes, ["L"]).collect()


def test_color_round_trip(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (12, 200, 77), (250, 3, 128)], "r int, g int, b int")
    lab = C.with_lab(df)
    back = C.with_rgb_from_lab(lab, "lab_l", "lab_a", "lab_b", ("r1", "g1", "b1"))
    for row in back.collect():
        assert np.allclose([row.r1 * 255, row.g1 * 255, row.b1 * 255], [row.r, row.g, row.b], atol=0.2)
    hsv = C.with_bgr_from_hsv(C.with_hsv(df), "hsv_h", "hsv_s", "hsv_v", ("b1", "g1", "r1"))
    for row in hsv.collect():
        assert np.allclose([row.r1, row.g1, row.b1], [row.r, row.g, row.b], atol=4)


def test_short_batch_repeats_or_leaves_blank(spark):
    members = spark.createDataFrame([(1, i, f"m{i}") for i in range(4)], "g bigint, pos bigint, name string")
    batched = B.fixed_batches(members, 3)
    filled = B.filled_slots(batched, ["g"], 3)
    assert rows(filled.filter("batch_no = 1"), "slot", "name", "is_fill") == [(0, "m3", False), (1, "m3", True), (2, "m3", True)]
    blank = B.filled_slots(batched, ["g"], 3, repeat_last=False).filter("batch_no = 1")
    assert rows(blank, "slot", "name") == [(0, "m3"), (1, None), (2, None)]
    assert rows(B.without_fill(filled), "pos") == [(0,), (1,), (2,), (3,)]


def test_near_empty_result_falls_back(spark):
    original = frame_table(spark, {1: [[1] * 4] * 6, 2: [[1] * 4] * 6}).withColumn("o", F.lit("original"))
    restored = frame_table(spark, {1: [[2] * 4] * 5, 2: [[2] * 4] * 4}).withColumn("o", F.lit("restored"))
    got = FR.with_fallback(restored, original).groupBy("video_id", "o").count()
    assert rows(got) == [(1, "restored", 5), (2, "original", 6)]
