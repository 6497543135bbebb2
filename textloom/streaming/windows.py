"""Streams of texts: windows, counts in event time, carried entities. An extension: batch operators over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.windowing import explode_windows
from textloom.operators.context import merge_entities


def text_stream(spark: SparkSession, folder: str, schema: str = "text_id string, text string, at timestamp", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_stream(texts: DataFrame, key: str = "text_id", text: str = "text", size: int = 3, stride: int = 2) -> DataFrame:
    """Sentence windows of each arriving text; stateless."""
    return explode_windows(texts, key, text, size, stride)


def counts_in_time(rows: DataFrame, at: str, by: str, span: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows per time window and value; rows later than `late` are dropped by the watermark, which bounds the state."""
    window = F.window(at, span, slide) if slide else F.window(at, span)
    return rows.withWatermark(at, late).groupBy(window, by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", by, "n")


def carried_entities(rows: DataFrame, n: int = 5, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """(text_id, window_index, carried): entities handed on from the last n windows of a text, its state kept between batches
    and dropped after `timeout_ms` of silence; with None it stays, and a stream of what is available now can end. rows: text_id, window_index, entities."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [list(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("window_index", kind="stable")
        out = []
        for r in rows.itertuples():
            before = merge_entities(held)
            out.append((key[0], int(r.window_index), before))
            held = [*held, merge_entities([list(r.entities) if r.entities is not None else [], before])][-n:]
        state.update((held,))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["text_id", "window_index", "carried"])

    return rows.groupBy("text_id").applyInPandasWithState(
        run, "text_id string, window_index int, carried array<string>", "held array<array<string>>", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    )


def append_results(rows: DataFrame, path: str, checkpoint: str):
    """Append to parquet, exactly once, what has arrived by now; the stream's own checkpoint makes it resumable."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
