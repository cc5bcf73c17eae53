"""The change stream: file events gathered into batches that are flushed after a pause, or at the latest after a while."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEBOUNCE_MS, MAX_WAIT_MS = 750, 5000


def sessions(times: list[int], debounce: int = DEBOUNCE_MS, max_wait: int = MAX_WAIT_MS) -> list[tuple[int, int, int]]:
    """(first, number, flush) of each batch of sorted times: it flushes at min(last + debounce, first + max_wait), and what comes then or later begins another."""
    out: list[tuple[int, int, int]] = []
    for t in times:
        if out:
            first, n, flush = out[-1]
            if t < flush:
                out[-1] = (first, n + 1, min(t + debounce, first + max_wait))
                continue
        out.append((t, 1, min(t + debounce, t + max_wait)))
    return out


def debounce_batches(events: DataFrame, root: str = "root", path: str = "path", ms: str = "ms", debounce: int = DEBOUNCE_MS, max_wait: int = MAX_WAIT_MS) -> DataFrame:
    """(root, batch, first_ms, flush_ms, events, paths) of events(root, path, ms): batches of each root in order of time, with their distinct paths sorted.

    The end of a batch depends on its first event, which no window function carries, so each root is walked once, in order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ms, path], kind="stable")
        rows, at = [], 0
        paths = pdf[path].to_numpy()
        for i, (first, n, flush) in enumerate(sessions(pdf[ms].tolist(), debounce, max_wait)):
            rows.append((pdf[root].iloc[0], i, first, flush, n, sorted(set(paths[at : at + n]))))
            at += n
        return pd.DataFrame(rows, columns=[root, "batch", "first_ms", "flush_ms", "events", "paths"])

    kind = dict(events.dtypes)[root]
    return events.where(F.col(ms).isNotNull() & F.col(root).isNotNull()).select(root, path, ms).groupBy(root).applyInPandas(walk, f"{root} {kind}, batch int, first_ms long, flush_ms long, events int, paths array<string>")


def debounced_stream(events: DataFrame, debounce: int = DEBOUNCE_MS, max_wait: int = MAX_WAIT_MS) -> DataFrame:
    """A stream of events(root, path) as a stream of batches (root, paths, first_ms, flush_ms), by processing time.

    Each root's pending paths are state; its timer stands at min(last + debounce, first + max_wait).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            first, _, paths = state.get
            state.remove()
            yield pd.DataFrame({"root": [key[0]], "paths": [json.loads(paths)], "first_ms": [first], "flush_ms": [now]})
            return
        first, paths = now, set()
        if state.exists:
            first, _, held = state.get
            paths = set(json.loads(held))
        for pdf in frames:
            paths.update(pdf["path"].dropna())
        if now >= first + max_wait:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"root": [key[0]], "paths": [sorted(paths)], "first_ms": [first], "flush_ms": [now]})
            return
        state.update((first, now, json.dumps(sorted(paths))))
        state.setTimeoutDuration(max(1, min(debounce, first + max_wait - now)))

    return events.groupBy("root").applyInPandasWithState(step, "root string, paths array<string>, first_ms long, flush_ms long", "first long, last long, paths string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame], None], checkpoint: str, once: bool = False):
    """Runs apply(distinct paths of a micro-batch) over JSON event files that arrive in a folder; once: over those there are, and ends."""
    stream = spark.readStream.schema(schema).json(folder)

    def each(df: DataFrame, _: int) -> None:
        apply(df.select("path").where("path is not null").distinct())

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")).start()
