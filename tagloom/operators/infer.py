"""Batched row maps and batch prediction through a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def batch_map(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: Sequence[str]
) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the named columns; only the columns of ``schema`` remain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.select(*columns).mapInPandas(run, schema)


def batch_predict(
    df: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], list[str]]],
    text: str = "input_sentence",
    batch_rows: int = 256,
) -> DataFrame:
    """``row_id, pred``. The factory runs once per task, so a model is loaded once per task.

    Rows keep their key, so no order has to be preserved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                yield pd.DataFrame({"row_id": part["row_id"], "pred": model(list(part[text]))})

    return df.select("row_id", text).mapInPandas(run, "row_id long, pred string")
