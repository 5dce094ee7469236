"""User models over frames: batched calls, ordered folds, grids of frames.

The model is the caller's. Spark partitions, orders and regroups the frames; the function only
sees arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from filmloom.operators.batches import COLUMNS, SLOTS, filled_slots, fixed_batches, without_fill


def with_prediction(
    frames: DataFrame, column: str, make_model: Callable, shape: Sequence[int], out: str, out_type: DataType | str, batch_size: int = 64
) -> DataFrame:
    """Batched model calls; ``make_model`` runs once per Python worker and returns the function to call."""
    predict = predict_batch_udf(make_model, return_type=out_type, batch_size=batch_size, input_tensor_shapes=[list(shape)])
    return frames.withColumn(out, predict(column))


def fold_in_order(
    rows: DataFrame, keys: Sequence[str], order: str, step: Callable[[object, dict], tuple[object, object]], first: object, out: str, out_type: str
) -> DataFrame:
    """``step(previous, row) -> (next, output)`` along ``order`` within a key; keys run in parallel.

    The chain of one key is sequential by nature: a video without cuts is one task. Rows stream through in
    Arrow batches with only the previous result held, so a long key takes time but not memory. Keep the rows
    narrow; a picture belongs in a join afterwards.
    """
    keys = list(keys)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, first
        for pdf in batches:
            results = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, first
                state, value = step(state, row)
                results.append(value)
            yield pdf.assign(**{out: results})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` {out_type}"
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return placed.select(*names).mapInPandas(run, schema)


def map_grids(
    members: DataFrame, keys: Sequence[str], function: Callable[[np.ndarray], np.ndarray], slots: int = SLOTS, columns: int = COLUMNS
) -> DataFrame:
    """Put each batch of pictures on one canvas, call the function on it, and cut it apart again.

    ``members`` has ``pos``, ``h``, ``w`` and ``px``. Short batches repeat their last picture and
    the repeats are dropped afterwards. A canvas holds ``slots`` pictures, whatever the group's size.
    """
    keys = list(keys)
    rows_of_grid = -(-slots // columns)
    filled = filled_slots(fixed_batches(members, slots), keys, slots)
    grids = filled.groupBy(*keys, "batch_no").agg(
        F.first("h").alias("h"), F.first("w").alias("w"),
        F.array_sort(F.collect_list(F.struct("slot", "pos", "is_fill", "px"))).alias("cells"),
    )

    @F.pandas_udf("array<array<int>>")
    def call(pictures: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        def one(cells, h, w):
            stack = np.zeros((rows_of_grid * columns, h, w), dtype="int32")
            stack[: len(cells)] = [np.asarray(c).reshape(h, w) for c in cells]
            canvas = stack.reshape(rows_of_grid, columns, h, w).swapaxes(1, 2).reshape(rows_of_grid * h, columns * w)
            done = np.asarray(function(canvas)).reshape(rows_of_grid, h, columns, w).swapaxes(1, 2)
            return list(done.reshape(-1, h * w)[: len(cells)].astype("int32"))

        return pd.Series([one(c, h, w) for c, h, w in zip(pictures, heights, widths)])

    called = grids.withColumn("out", call.asNondeterministic()(F.transform("cells", lambda c: c["px"]), "h", "w"))  # called once per grid
    apart = called.select(*keys, "batch_no", "h", "w", F.explode(F.arrays_zip("cells", "out")).alias("c"))
    return without_fill(
        apart.select(*keys, "batch_no", F.col("c.cells.pos").alias("pos"), "h", "w", F.col("c.cells.is_fill").alias("is_fill"), F.col("c.out").alias("px"))
    ).drop("is_fill")
