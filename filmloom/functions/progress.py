"""Progress, stage and output columns read from one log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmloom.functions.paths import resolve_under
from filmloom.functions.text import strip

# The texts each stage is told by, in order of precedence.
STAGE_MARKS = [
    ("restore", ["Running restoration", "Restoring:"], True),
    ("scene_split", ["Starting scene detection", "Scene split"], True),
    ("comfyui", ["ComfyUI"], True),
    ("colorize", ["colorized"], False),
    ("postprocess", ["postprocessed"], False),
    ("finalize", ["final video at:"], False),
]
OUTPUT_MARKS = ["final postprocessed video at:", "final video at:"]
RUNNING_CAP = 95
# How a line states a share of its work, and which of several tasks it is at.
SHARE_PATTERN = r"(?i)Progress:\s*(\d+)%"
TASK_PATTERN = r"(?i)Task\s+(\d+)\s*/\s*(\d+)"


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("bigint")


def percent(line: Column, cap: int | None = RUNNING_CAP) -> Column:
    """``Progress: n%``, else ``Task i/n`` as a percentage; capped while the job runs.

    A plain text search comes first, so most lines meet no pattern.
    """
    low = F.lower(line)
    share = F.floor(F.try_divide(_number(line, TASK_PATTERN).cast("double"), _number(line, TASK_PATTERN, 2).cast("double")) * 100)
    found = F.coalesce(
        F.when(low.contains("progress:"), _number(line, SHARE_PATTERN)), F.when(low.contains("task"), share)
    )
    return found if cap is None else F.when(found > cap, F.lit(cap).cast("bigint")).otherwise(found)


def _held(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(100)), F.lit(0)))


def first_percent(line: Column) -> Column:
    """The first one to three digits before a percent sign, held to 0..100."""
    return _held(_number(line, r"(\d{1,3})%"))


def bar_percent(line: Column) -> Column:
    """The word before the first ``%|`` of a progress bar, where it is a whole number; held to 0..100."""
    before = F.substring_index(line, "%|", 1)
    return F.when(line.contains("%|"), _held(_number(before, r"(?:^|\s)([+-]?\d+)\s*$")))


def bar_digits(line: Column) -> Column:
    """Digits directly before ``%|``, as they are."""
    return _number(line, r"(\d+)%\|")


def frame_percent(line: Column, frames: int = 1000) -> Column:
    """``frame=`` counts as a percentage of ``frames``, at most 100; needs ``fps`` in the line."""
    frame = _number(line, r"frame=\s*([+-]?\d+)(?:\s|$)")
    value = F.floor(frame / F.lit(float(frames)) * 100)
    return F.when(line.contains("frame=") & line.contains("fps") & frame.isNotNull(), F.least(value, F.lit(100)))


def stage(line: Column) -> Column:
    """The stage a line announces, or null."""
    out = None
    for name, marks, exact_case in STAGE_MARKS:
        text = line if exact_case else F.lower(line)
        hit = text.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | text.contains(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def final_path(line: Column) -> Column:
    """The announced final video as an absolute normal path, or null."""
    text = strip(F.regexp_extract(line, r"(?i)final\s+video\s+at:\s*(.+)$", 1))
    return F.when(text != "", resolve_under(text))


def live_output(line: Column) -> Column:
    """The text after an output mark, or null."""
    out = None
    for mark in OUTPUT_MARKS:
        after = strip(F.element_at(F.split(line, mark, 2), -1))
        out = F.when(line.contains(mark), after) if out is None else out.when(line.contains(mark), after)
    return F.nullif(out, F.lit(""))
