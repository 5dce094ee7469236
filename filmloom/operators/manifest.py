"""Manifest tables: columns, parsing, merging, write-back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import text as T

# Columns a sheet must have, and flags with their defaults.
REQUIRED_COLUMNS = [
    "YouTube URL", "Executed", "Start Time", "End Time", "Remarks", "face_upscale", "background_upscale",
    "background_upscale_value", "unet", "clahe", "crop_video", "start_time (00:00:00)", "end_time (01:22:33)",
]
FLAG_DEFAULTS = {
    "face_upscale": "False", "background_upscale": "False", "unet": "true", "clahe": "false", "crop_video": "false",
}
RESET_COLUMNS = ["Executed", "Start Time", "End Time", "Remarks", "Input Path"]
KEY = "YouTube URL"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def ensure_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS, default: str = "") -> DataFrame:
    return df.withColumns({c: F.lit(default) for c in required if c not in df.columns})


def common_columns(left: DataFrame, right: DataFrame, forced: str = "Input Path") -> list[str]:
    """Columns of both, in the left order, with ``forced`` at the end where the right side has it."""
    shared = [c for c in left.columns if c in right.columns and c != forced]
    return shared + ([forced] if forced in right.columns else [])


def as_text(df: DataFrame, columns: Sequence[str], null_text: str | None = None) -> DataFrame:
    """Cast columns to text; ``null_text`` stands in for null where given."""

    def cast(c: str) -> Column:
        value = col(c).cast("string")
        return value if null_text is None else F.coalesce(value, F.lit(null_text))

    return df.withColumns({c: cast(c) for c in columns})


def parse_flags(df: DataFrame, defaults: Mapping[str, str] = FLAG_DEFAULTS) -> DataFrame:
    """Replace flag texts by booleans and add ``error``, the first bad flag of the row."""
    texts = {c: T.null_like_default(col(c), d) for c, d in defaults.items()}
    errors = F.coalesce(*[T.bool_error(t, c) for c, t in texts.items()])
    return df.withColumn("error", errors).withColumns({c: T.checked_bool(t) for c, t in texts.items()})


def pending(df: DataFrame) -> DataFrame:
    return df.filter(T.is_pending(col("Executed"), col(KEY)))


def keep_first(local: DataFrame, online: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables by name, local rows first, one row per key. Null counts as a key.

    The first row per key is found with a rank filter, which Spark applies before the shuffle as
    well, so a key with many copies sends one row per task.
    """
    both = local.withColumn("__source", F.lit(0)).unionByName(
        online.withColumn("__source", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(col(key)).orderBy("__source", order)
    return both.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__source")


def duplicate_count(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows beyond the first of each key; null is one key."""
    per_key = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def merge_sheets(local: DataFrame, online: DataFrame, key: str = KEY, order: str = "line_no") -> DataFrame:
    """The local manifest followed by the online sheet, on their common columns, first row per key."""
    online = ensure_columns(online)
    final = common_columns(online, local)
    if "Input Path" in final and "Input Path" not in online.columns:
        online = online.withColumn("Input Path", F.lit(""))
    picked = [col(c) for c in final]
    merged = keep_first(local.select(*picked), online.select(*picked), key, order)
    return ensure_columns(merged, ["Input Path"])


def write_back(manifest: DataFrame, outcomes: DataFrame, key: str = "line_no") -> DataFrame:
    """Put run results into the manifest. An empty end time becomes ``N/A``; other rows stay."""
    done = outcomes.withColumn("new_end", F.coalesce(F.nullif("new_end", F.lit("")), F.lit("N/A")))
    names = {"Executed": "new_status", "Start Time": "new_start", "End Time": "new_end", "Remarks": "new_remarks"}
    joined = manifest.join(done, key, "left")
    return joined.withColumns({c: F.coalesce(col(n), col(c)) for c, n in names.items()}).select(
        *[col(c) for c in manifest.columns]
    )


def reset_matching(manifest: DataFrame, keys: DataFrame, key: str = KEY, columns: Sequence[str] = RESET_COLUMNS) -> DataFrame:
    """Null the given columns where the stripped key is in ``keys``; adds ``was_reset``.

    Whether the keys are broadcast is left to their measured size.
    """
    wanted = keys.select(F.col(keys.columns[0]).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    joined = manifest.join(wanted, T.strip(col(key)) == F.col("__key"), "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.withColumn("was_reset", hit).withColumns(
        {c: F.when(~hit, col(c)) for c in columns}
    ).drop("__key", "__hit")


def update_at(df: DataFrame, key: str, value: object, values: Mapping[str, str]) -> DataFrame:
    """Set columns to fixed values in the rows with the given key."""
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(col(c)) for c, v in values.items()})


# The texts of a notification.
SUBJECTS = {"Yes": "✅ Pipeline Completed", "otherwise": "❌ Pipeline Failed"}
BODY_LABELS = ["Video: ", "Start: ", "End: ", "Status: ", "Remarks: "]


def notifications(finished: DataFrame) -> DataFrame:
    """Subject and body per finished row."""
    subject = F.when(F.col("new_status") == "Yes", SUBJECTS["Yes"]).otherwise(SUBJECTS["otherwise"])
    fields = list(zip(BODY_LABELS, [KEY, "new_start", "new_end", "new_status", "new_remarks"]))
    lines = [F.concat(F.lit(label), T.strip(F.coalesce(col(c), F.lit(""))) if c == KEY else col(c)) for label, c in fields]
    return finished.select("line_no", subject.alias("subject"), F.concat_ws("\n", *lines).alias("body"))


def preview(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(order).limit(n)


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)
