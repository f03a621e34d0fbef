"""The streaming twin of the session operators: the same results from immutable files of JSON lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORDS = "session string, seq long, kind string, program string, id long, ts timestamp"
OUTPUT = "session string, program string, seq long, island long"
STATE = "last string, done long"
#: A session's records live for 14 days.
KEPT_MS = 14 * 24 * 3600 * 1000


def read_records(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """New files of a folder as they land. A file that was read isn't read again, so lines must come in new files."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_at_once).json(folder)


def _advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One (session, program): emits a row for each success right after a failure."""
    if state.hasTimedOut:
        state.remove()
        return
    last, done = state.get if state.exists else (None, 0)
    out = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, kind in zip(rows["seq"], rows["kind"]):
        if kind == "ok" and last == "failed":
            out.append((key[0], key[1], int(seq), int(done)))
            done += 1
        if kind in ("ok", "failed"):
            last = kind
    state.update((last, int(done)))
    latest = rows["ts"].max()
    base = state.getCurrentWatermarkMs() if pd.isna(latest) else max(state.getCurrentWatermarkMs(), int(latest.timestamp() * 1000))
    state.setTimeoutTimestamp(max(base, 0) + KEPT_MS)
    yield pd.DataFrame(out, columns=["session", "program", "seq", "island"])


def fixes(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """As ``operators.sessions.fixes`` filtered to fixed rows. State is two values for each (session, program), until
    the watermark of ``ts`` has passed its last record by 14 days; records more than ``late`` behind are left out."""
    keyed = records.withWatermark("ts", late).groupBy("session", "program")
    return keyed.applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(records: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records of each kind per window of time, final once the watermark has passed."""
    from pyspark.sql import functions as F

    return records.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
