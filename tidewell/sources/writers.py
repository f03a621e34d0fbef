"""Writers: records as files with their frontmatter, logs as lines, results as JSON, pruned logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order of fields in a record's frontmatter. Fixed values.
ORDER = ("schema", "id", "type", "status", "superseded_by", "stale_reason", "when", "verified", "expires", "verified_how", "tags", "queries", "labels", "meta")


def record_text(row: dict) -> str:
    """A record as a file: its fields in order as block YAML between two lines of ---, then the body; empty fields stay out."""
    import json

    import yaml

    front = {}
    for k in ORDER:
        v = row.get(k)
        if k == "meta" and v:
            v = json.loads(v)
        if v is None or v == {} or v == []:
            continue
        if k == "when":
            v = {key: values[0] if len(values) == 1 else list(values) for key, values in v.items()}
        front[k] = v
    return f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 16)}---\n{row['body']}"


def as_files(records: DataFrame) -> DataFrame:
    """``path, content`` of each record (columns as ``readers.lessons`` gives them)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ({k: _plain(v) for k, v in zip(frame.columns, values)} for values in frame.itertuples(index=False, name=None))
            yield pd.DataFrame([(r["path"], record_text(r)) for r in rows], columns=["path", "content"])

    wanted = [c for c in ("path", *ORDER, "body") if c in records.columns]
    return records.select(*wanted).mapInPandas(run, "path string, content string")


def _plain(v):
    if isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list) and v and isinstance(v[0], tuple):
        return {k: _plain(x) for k, x in v}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return int(v) if isinstance(v, float) and v.is_integer() else v


def append(rows: DataFrame, folder: str) -> None:
    """Rows as new files of JSON lines beside the old ones. Spark's committer renames whole files, so a reader never
    meets half a line."""
    rows.write.mode("append").json(folder)


def as_lines(rows: DataFrame) -> DataFrame:
    """``line``: each row as one line of JSON, columns in order."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def pruned(log: DataFrame, now: int, days: int = 90) -> DataFrame:
    """A log without its rows older than ``days``, nor those without a time."""
    return log.where(F.col("time").isNotNull() & (F.col("time") >= now - days * 86_400))


def live_sessions(records: DataFrame, now: int, days: int = 14) -> DataFrame:
    """The records of sessions whose last one is at most ``days`` old."""
    old = records.groupBy("session").agg(F.max("time").alias("last")).where(F.col("last") < now - days * 86_400)
    return records.join(old, "session", "left_anti")
