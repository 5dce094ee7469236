"""Path columns: suffixes, stems, normal form, containment, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upload suffixes, image suffixes, workspace root.
VIDEO_SUFFIXES = ["mp4", "avi", "mov", "mkv", "webm"]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg"]
WORKSPACE = "/workspace"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)[.][^.]+$", "$1")


def has_suffix(name: Column, suffixes: list[str]) -> Column:
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(suffixes)


def normal_path(path: Column) -> Column:
    """Collapse ``//``, ``.`` and ``..`` the POSIX way; an empty path is ``.``."""
    absolute = path.startswith("/")
    lead = (
        F.when(path.startswith("//") & ~path.startswith("///"), "//")
        .when(absolute, "/")
        .otherwise("")
    )

    def step(parts: Column, part: Column) -> Column:
        can_pop = (F.size(parts) > 0) & (F.try_element_at(parts, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), parts)
            .when((part == "..") & can_pop, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
            .when((part == "..") & absolute, parts)
            .otherwise(F.concat(parts, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    joined = F.concat(lead, F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def resolve_under(path: Column, root: str = WORKSPACE) -> Column:
    """Absolute paths as they are, relative ones under ``root``; both in normal form."""
    relative = F.concat(F.lit(f"{root}/"), F.ltrim(path, F.lit("/\\")))
    return normal_path(F.when(path.startswith("/"), path).otherwise(relative))


def is_inside(path: Column, root: str = WORKSPACE, boundary: bool = True) -> Column:
    """Containment of a normal path. Without ``boundary`` a sibling such as ``/workspace2`` passes."""
    if not boundary:
        return path.startswith(root)
    return (path == root) | path.startswith(f"{root}/")


def step_path(actual: Column, source: Column, step: str) -> Column:
    """``<source stem>/<step>__<hash of the input>/<step>.mp4``: same input, same place."""
    digest = F.left(F.sha1(actual.cast("binary")), F.lit(12))
    return F.concat(stem(source), F.lit(f"/{step}__"), digest, F.lit(f"/{step}.mp4"))


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))
