"""The hook gates as streams: one keyed by session, for all that a session's own events decide, and one keyed by
signature, for errors that another session had before. Both give what the batch operators of ``operators.hooks`` and
``operators.sessions`` give for the same rows, however the rows are dealt to files and batches.

A session's state are maps and a list, each changed by itself: outcomes and failures of its programs, what was injected
since a program's last fix, what was inferred and pushed, and the records that still count for the question at its end. A
timer takes all of it away when the watermark has passed the session's last event by 14 days. Rows of a batch ask the state
for a key once and write what they changed at the end, so its calls grow with the keys of a session, not with its events.
"""

from __future__ import annotations

import sys
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.hooks import ASKED_POINTS, CAPTURED, MOST_NUDGES, REMEMBERED_DAYS
from tidewell.operators.sessions import WORTH
from tidewell.streaming.sessions import KEPT_MS

EVENTS = (
    "session string, seq long, kind string, program string, id string, tier string, eligible boolean, seen boolean, answered boolean, upto long, ts timestamp"
)
GATES = "session string, seq long, gate string, program string, id string, explore boolean, score long, decision string, signals array<string>"
COUNTING = (*WORTH, "fixed")
COLUMNS = [c.split()[0] for c in EVENTS.split(", ") if not c.startswith("session ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of gates that are handed on at once.
MOST_OUT = 20_000


def score(counted: dict[tuple, int], failures: dict[str, int]) -> int:
    """Points of records counted by (kind, program); a fix counts two if its program failed three times by now."""
    return sum(n * WORTH.get(kind, 2 if failures.get(program, 0) >= 3 else 1) for (kind, program), n in counted.items())


class _Map:
    """A map state as the rows of a batch see it: each key is asked for once, changes are written by ``save``."""

    def __init__(self, state, whole: bool = False):
        self.state, self.whole, self.changed = state, whole, {}
        self.known = {tuple(k): tuple(v) for k, v in state.iterator()} if whole else {}

    def get(self, key: tuple) -> tuple | None:
        if key not in self.known:
            self.known[key] = tuple(self.state.getValue(key)) if not self.whole and self.state.containsKey(key) else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.known[key] = self.changed[key] = value

    def save(self) -> None:
        for key, value in self.changed.items():
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class _Since:
    """Records (seq, kind, program) after a bound that only rises, counted by (kind, program)."""

    def __init__(self, bound: int, rows: list[tuple]):
        self.bound, self.rows, self.counted = bound, deque(), Counter()
        for r in rows:
            self.add(r)

    def add(self, row: tuple) -> None:
        if row[0] > self.bound:
            self.rows.append(row)
            self.counted[row[1:]] += 1

    def rise(self, bound: int) -> None:
        self.bound = bound
        while self.rows and self.rows[0][0] <= bound:
            key = self.rows.popleft()[1:]
            self.counted[key] -= 1
            if not self.counted[key]:
                del self.counted[key]


def _columns(frames: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
    """All rows in the order of their numbers. Equal strings are one object: a session may have millions of rows."""
    parts: dict[str, list] = {c: [] for c in COLUMNS}
    for frame in frames:
        for c in COLUMNS:
            x = frame[c]
            if c == "seq":
                parts[c].append(x.to_numpy(np.int64))
            elif c == "ts":
                parts[c].append(np.array([x.max()], object))
            else:
                own = [None if v is None or v != v else sys.intern(v) if type(v) is str else v for v in x.tolist()]
                parts[c].append(np.array(own, object))
    made = {c: np.concatenate(x) for c, x in parts.items()}
    order = np.argsort(made["seq"], kind="stable")
    return {c: x if c == "ts" else x[order] for c, x in made.items()}


def _pieces(column: np.ndarray) -> Iterator:
    """The values, a part of the column made Python objects at a time."""
    for k in range(0, len(column), MOST_OUT):
        yield from column[k : k + MOST_OUT].tolist()


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in GATES.split(", ")])


class SessionGates(StatefulProcessor):
    """Emits the gates that a session's events open, in the order of the events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.programs = handle.getMapState("programs", "program string", "last string, failures long")
        self.waiting = handle.getMapState("waiting", "program string, id string", "seq long")
        self.inferred = handle.getMapState("inferred", "id string", "seq long")
        self.told = handle.getMapState("told", "id string", "seq long")
        self.once = handle.getMapState("once", "kind string, program string", "seq long")
        self.counting = handle.getListState("counting", "seq long, kind string, program string")
        self.session = handle.getValueState("session", "explored boolean, asked boolean, nudged int, upto long, extracted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _columns(rows)
        out: list[tuple] = []
        explored, asked, nudged, upto, extracted = self.session.get() if self.session.exists() else (False, False, 0, 0, 0)
        programs, waiting = _Map(self.programs, whole=True), _Map(self.waiting, whole=True)
        inferred, told, once = _Map(self.inferred), _Map(self.told), _Map(self.once)
        failures = {k[0]: v[1] for k, v in programs.known.items()}
        due_to: dict[str, set[str]] = {}  # records that wait for a program's fix
        for program, id_ in waiting.known:
            due_to.setdefault(program, set()).add(id_)
        held = sorted((tuple(r) for r in self.counting.get()), key=lambda r: r[0])
        offered_since, kept_since = _Since(upto, held), _Since(extracted, held)

        def count(*row) -> None:
            offered_since.add(row)
            kept_since.add(row)

        def emit(gate, program=None, id_=None, explore=None, points=None, decision=None, signals=None) -> None:
            out.append((key[0], seq, gate, program, id_, explore, points, decision, signals))

        names = ("seq", "kind", "program", "id", "tier", "eligible", "seen", "answered", "upto")
        for seq, kind, program, id_, tier, eligible, seen, answered, offered in zip(*(_pieces(found[c]) for c in names)):
            if kind in ("failed", "ok") and program is not None:
                last, n = programs.get((program,)) or (None, 0)
                if kind == "failed":
                    programs.put((program,), ("failed", n + 1))
                    failures[program] = n + 1
                    for mark, due in (("repeat", seen), ("nohit", answered is not None and not answered)):
                        if due and once.get((mark, program)) is None:
                            once.put((mark, program), (seq,))
                            count(seq, mark, program)
                            emit(mark, program)
                else:
                    programs.put((program,), ("ok", n))
                    failures.setdefault(program, n)
                    if last == "failed":
                        count(seq, "fixed", program)
                        emit("fixed", program)
                        for i in sorted(due_to.pop(program, ())):
                            waiting.put((program, i), None)
                            if inferred.get((i,)) is None:
                                inferred.put((i,), (seq,))
                                emit("inferred", program, i)
            if eligible and id_ is not None and (tier == "proven" or (tier == "candidate" and not explored)) and told.get((id_,)) is None:
                told.put((id_,), (seq,))
                explored = explored or tier == "candidate"
                emit("push", program, id_, tier == "candidate")
                if program is not None:
                    waiting.put((program, id_), (seq,))
                    due_to.setdefault(program, set()).add(id_)
            if kind in WORTH and kind not in ("repeat", "nohit"):
                count(seq, kind, program)
            asked, nudged = asked or kind == "asked", nudged + (kind == "nudged")
            if kind == "offered":
                upto = max(upto, int(offered or 0))
                offered_since.rise(upto)
            if kind == "stop":
                new = offered_since.counted
                points, own = score(new, failures), any(k[0] in ("remember", "correction") for k in new)
                block = points >= ASKED_POINTS and not asked
                decision = None if not own or not points else "block" if block else "nudge" if nudged < MOST_NUDGES else None
                emit("stop", points=points, decision=decision)
            elif kind == "end":
                new = kept_since.counted
                signals = sorted({" ".join(x for x in k if x is not None) for k in new if k[0] in CAPTURED})
                if signals:
                    emit("capture", points=max(1, min(3, score(new, failures))), signals=signals)
            if kind == "extracted":
                extracted = seq
                kept_since.rise(extracted)
            if len(out) >= MOST_OUT:
                yield _frame(out)
                out.clear()
        self.session.update((explored, asked, int(nudged), int(upto), int(extracted)))
        for state in (programs, waiting, inferred, told, once):
            state.save()
        fresh = [*(offered_since if upto <= extracted else kept_since).rows]
        self.counting.put(fresh) if fresh else self.counting.clear()
        self._keep(max((t for t in found["ts"] if not pd.isna(t)), default=pd.NaT), timerValues)
        yield _frame(out)

    def _keep(self, latest, timerValues) -> None:
        now = timerValues.getCurrentWatermarkInMs()
        for t in list(self.handle.listTimers()):
            if t > now:
                now = max(now, t - KEPT_MS)
                self.handle.deleteTimer(t)
        base = now if pd.isna(latest) else max(now, int(latest.timestamp() * 1000))
        self.handle.registerTimer(max(base, 0) + KEPT_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.programs, self.waiting, self.inferred, self.told, self.once, self.counting, self.session):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Signatures(StatefulProcessor):
    """Marks failures whose signature another session had before. The last row's session and time, and the last time of
    any other session, are all that is kept of a signature."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "session string, time long, other long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["time", "seq"])
        session, time, other = self.last.get() if self.last.exists() else (None, None, None)
        seen = []
        for s, t in zip(frame["session"], frame["time"].astype(int)):
            if s != session:
                session, other = s, time
            seen.append(other is not None and other >= t - self.days * 86_400)
            time = int(t)
        self.last.update((session, time, other))
        yield frame.assign(seen=seen)[["sig", "session", "seq", "time", "seen"]]

    def close(self) -> None:
        pass


def session_gates(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The gates (``GATES``) of a stream of ``EVENTS``; sequence numbers rise from batch to batch within a session, and
    so does what its offers had seen (``upto``)."""
    keyed = events.withWatermark("ts", late).groupBy("session")
    return keyed.transformWithStateInPandas(SessionGates(), GATES, "append", "EventTime")


def seen_before(failures: DataFrame, days: int = REMEMBERED_DAYS) -> DataFrame:
    """As ``hooks.seen_before``, for a stream whose times rise from batch to batch within a signature."""
    rows = failures.select("sig", F.col("session"), F.col("seq").cast("long").alias("seq"), F.col("time").cast("long").alias("time"))
    return rows.groupBy("sig").transformWithStateInPandas(Signatures(days), "sig string, session string, seq long, time long, seen boolean", "append", "None")


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """While a query is started: the state store that holds maps, lists and timers."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_end(made: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the rows there are now, written under ``folder`` and read again."""
    spark = made.sparkSession
    with map_state(spark):
        query = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")
