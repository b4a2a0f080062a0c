"""Editing sessions: what a session introduced beyond its snapshot, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.bounded import count_and_first, more

#: One row a finding; the rows of one event share event_id, an event without findings has one row without a fingerprint.
EVENT = "session_id string, event string, event_id string, source string, fingerprint string, level string, seq long"
WAITING = "event string, event_id string, source string, fingerprint string, level string, seq long"
RESULT = "session_id string, event_id string, fingerprint string, seq long, action string"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Fixed value: how many findings a message lists.
LISTED = 5
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def introduced(snapshot: DataFrame, current: DataFrame, session: str, fingerprint: str, order: list[str]) -> DataFrame:
    """Rows of current beyond the snapshot's count of their fingerprint in their session, the first in the order being the ones allowed."""
    allowed = snapshot.groupBy(session, fingerprint).agg(F.count("*").alias("_k"))
    nth = F.row_number().over(W.partitionBy(session, fingerprint).orderBy(*order))
    return current.withColumn("_n", nth).join(allowed, [session, fingerprint], "left").where(F.col("_n") > F.coalesce("_k", F.lit(0))).select(*current.columns)


def last_state(events: DataFrame, key: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Of each key the values of its last event."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{k}") for k, c in values.items()))).alias("m")).select(key, *(F.col(f"m._{k}").alias(k) for k in values))


def parse_events(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines in value, and the lines that are none: malformed ones go aside and stop nothing."""
    parsed = raw.withColumn("e", F.from_json(F.col(value).cast("string"), EVENT))
    fine = F.col("e.session_id").isNotNull() & F.col("e.event").isNotNull()
    return parsed.where(fine).select("e.*"), parsed.where(~F.coalesce(fine, F.lit(False))).select(value)


def session_checks(events: DataFrame) -> DataFrame:
    """session_id, event_id, fingerprint, seq, action: what each check of a session finds beyond the session's snapshot, in batch.

    The snapshot that a check counts against is that of the last start before it which took one: the session's first, or
    one whose source is startup. Its errors allow as many of a fingerprint in every check anew; warnings are never allowed.
    A stop event is a check of all that the session changed, of which only the errors come out.
    """
    ids = events.groupBy("session_id", "event", "event_id").agg(F.min("seq").alias("at"), F.max("source").alias("source"))
    w = W.partitionBy("session_id").orderBy("at")
    starts = ids.where("event = 'start'").withColumn("n", F.row_number().over(w)).where("n = 1 or source = 'startup'").select("session_id", F.col("event_id").alias("snapshot"), F.col("at").alias("taken"))
    checks = ids.where("event in ('check', 'stop')").select("session_id", "event_id", "at")
    before = checks.join(starts, "session_id", "left").where("taken is null or taken < at").groupBy("session_id", "event_id").agg(F.max_by("snapshot", "taken").alias("snapshot"))
    allowed = events.where("event = 'start' and level = 'error' and fingerprint is not null").groupBy("session_id", F.col("event_id").alias("snapshot"), "fingerprint").agg(F.count("*").alias("k"))
    found = events.where("(event = 'check' or event = 'stop' and level = 'error') and fingerprint is not null").withColumn("nth", F.row_number().over(W.partitionBy("session_id", "event_id", "fingerprint", "level").orderBy("seq")))
    judged = found.join(before, ["session_id", "event_id"], "left").join(allowed, ["session_id", "snapshot", "fingerprint"], "left")
    error = F.col("level") == "error"
    beyond = judged.where(~error | (F.col("nth") > F.coalesce("k", F.lit(0))))
    return beyond.select("session_id", "event_id", "fingerprint", "seq", F.when(error, "block").otherwise("context").alias("action"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype="int64" if c == "seq" else object) for k, c in enumerate(RESULT_COLUMNS)})


class _Sessions(StatefulProcessor):
    """One session: its snapshot's counts, and the rows that wait for the end of their event."""

    def __init__(self, grace_ms: int, ttl_ms: int):
        self.grace, self.ttl = grace_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", "event_id string", self.ttl)
        self.allowed = handle.getMapState("allowed", "fingerprint string", "n long", self.ttl)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The snapshot of an earlier run: session_id, snapshot, fingerprint, n; a snapshot without errors has one row without a fingerprint."""
        for r in initialState.itertuples():
            self.snapshot.update((r.snapshot,))
            if r.fingerprint is not None:
                self.allowed.updateValue((r.fingerprint,), (int(r.n),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace)
        for t in rows:
            self.waiting.appendList([(r.event, r.event_id, r.source, r.fingerprint, r.level, int(r.seq)) for r in t.itertuples()])
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = pd.DataFrame(list(self.waiting.get()), columns=[c.split()[0] for c in WAITING.split(", ")])
        self.waiting.clear()
        found = []
        events = waiting.groupby(["event", "event_id"])
        for _, (event, event_id) in sorted((int(t["seq"].min()), k) for k, t in events):
            own = events.get_group((event, event_id)).sort_values("seq")
            if event == "start":
                self._start(event_id, own)
            elif event in ("check", "stop"):
                found += [(key[0], event_id, *x) for x in self._check(event, own)]
        yield _frame(found)

    def _start(self, event_id: str, own: pd.DataFrame) -> None:
        if self.snapshot.exists() and (own["source"].dropna().max() if own["source"].notna().any() else None) != "startup":
            return
        self.snapshot.update((event_id,))
        self.allowed.clear()
        errors = own[(own["level"] == "error") & own["fingerprint"].notna()]
        for fingerprint, n in errors.groupby("fingerprint").size().items():
            self.allowed.updateValue((fingerprint,), (int(n),))

    def _check(self, event: str, own: pd.DataFrame) -> Iterator[tuple]:
        used: dict[str, int] = {}
        for r in own.itertuples():
            if r.fingerprint is None or (event == "stop" and r.level != "error"):
                continue
            if r.level == "error":
                used[r.fingerprint] = used.get(r.fingerprint, 0) + 1
                held = self.allowed.getValue((r.fingerprint,))
                if held is not None and used[r.fingerprint] <= held[0]:
                    continue
            yield r.fingerprint, int(r.seq), "block" if r.level == "error" else "context"

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, grace: str = "30 seconds", ttl: str = "24 hours", snapshots: DataFrame | None = None) -> DataFrame:
    """session_id, event_id, fingerprint, seq and action (block for errors, context for warnings) of what sessions introduce, as a stream; see session_checks.

    A session's rows wait for the grace time after the first of them; then a timer goes through their events in the order of
    seq, each event with all of its rows, so that the order of arrival within that time doesn't matter. State is a
    count for each fingerprint of the snapshot, which goes after the ttl, and the waiting rows. snapshots (session_id,
    snapshot, fingerprint, n) hands over those of an earlier run. Needs the state store that keeps state outside the heap:
    spark.sql.streaming.stateStore.providerClass as STATE_STORE.
    """
    ms = lambda x: pd.Timedelta(x).value // 1_000_000
    return events.groupBy("session_id").transformWithStateInPandas(_Sessions(ms(grace), ms(ttl)), RESULT, "append", "ProcessingTime", None if snapshots is None else snapshots.groupBy("session_id"))


def snapshots(events: DataFrame) -> DataFrame:
    """session_id, snapshot, fingerprint and n of the snapshots that hold after the events, as session_stream takes them over."""
    ids = events.where("event = 'start'").groupBy("session_id", "event_id").agg(F.min("seq").alias("at"), F.max("source").alias("source"))
    nth = F.row_number().over(W.partitionBy("session_id").orderBy("at"))
    last = ids.withColumn("nth", nth).where("nth = 1 or source = 'startup'").groupBy("session_id").agg(F.max_by("event_id", "at").alias("snapshot"))
    counts = events.where("event = 'start' and level = 'error' and fingerprint is not null").groupBy("session_id", F.col("event_id").alias("snapshot"), "fingerprint").agg(F.count("*").alias("n"))
    return last.join(counts, ["session_id", "snapshot"], "left").select("session_id", "snapshot", "fingerprint", "n")


def told(checks: DataFrame, findings: DataFrame, stops: DataFrame, most: int = LISTED) -> DataFrame:
    """session_id, event_id, action, n and listed (the first messages and "+n more") of checks(session_id, event_id, fingerprint, seq, action), by findings(event_id, seq, message).

    stops(session_id, event_id, again): a stop that follows from a stop doesn't block once more, it only tells (action
    message).
    """
    said = checks.join(findings.select("event_id", "seq", "message"), ["event_id", "seq"]).join(stops.select("session_id", "event_id", "again"), ["session_id", "event_id"], "left")
    said = said.withColumn("action", F.when((F.col("action") == "block") & F.coalesce("again", F.lit(False)), "message").otherwise(F.col("action")))
    few = count_and_first(said, ["session_id", "event_id", "action"], ["seq", "message"], most)
    return few.select("session_id", "event_id", "action", "n", more(F.transform("first", lambda x: x["message"]), F.col("n")).alias("listed"))
