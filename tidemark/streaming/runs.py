"""Streaming forms: settling sessions, change detection with state, snapshots by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signals import QUIET_S


def quiet_sessions(events: DataFrame, quiet_s: float = QUIET_S, late: str = "1 minute") -> DataFrame:
    """(page_id, start, end, mutations): bursts of activity, closed by the quiet window.

    ``events``: page_id, ts. Late events are taken until the watermark passes.
    """
    gap = f"{int(quiet_s * 1000)} milliseconds"
    w = F.session_window("ts", gap)
    return (
        events.withWatermark("ts", late)
        .groupBy("page_id", w.alias("w"))
        .agg(F.count(F.lit(1)).alias("mutations"))
        .select("page_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mutations")
    )


def tally_windows(events: DataFrame, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, n): events per tumbling window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(key, F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("start"), "n")
    )


CHANGES = "url string, seq bigint, changed boolean"


def changes(pages: DataFrame) -> DataFrame:
    """(url, seq, changed) of a stream of fetched pages, against the last hash kept per url.

    ``pages``: url, seq, status, body. A 304 is unchanged; the first page of a url has
    changed. State per url is one hash.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, status, body in zip(rows["seq"], rows["status"], rows["body"]):
            if status == 304:
                out.append((key[0], seq, False))
                continue
            new = hashlib.sha256((body or "").encode()).hexdigest()
            out.append((key[0], seq, new != known))
            known = new
        if known is not None:
            state.update((known,))
        yield pd.DataFrame(out, columns=["url", "seq", "changed"])

    return pages.groupBy("url").applyInPandasWithState(step, CHANGES, "hash string", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on every micro-batch; the checkpoint makes a restart resume where it was."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
