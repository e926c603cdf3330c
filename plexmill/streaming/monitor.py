"""Events decided one by one in a stream, in order of event time, with the same rows as in a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Of the rows that a key's state holds back until the watermark has passed them.
_EVENT = "us long, event_id long, crash boolean, violation boolean, denied boolean, fatal boolean"
_OUT = "key string, ts timestamp, event_id long, action string, crashes long, violations long, recent array<long>"


def marked(events: DataFrame, key: str, crash: Column, violation: Column, denied: Column, fatal: Column) -> DataFrame:
    """(key, ts, us, event_id, crash, violation, denied, fatal): what a decision needs; a flag that is null is false."""
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(key).cast("string").alias("key"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id",
        flag(crash, "crash"), flag(violation, "violation"), flag(denied, "denied"), flag(fatal, "fatal"),
    )


def decided(rows: DataFrame, crashes: int = 3, violations: int = 5, ring: int = 5) -> DataFrame:
    """(key, ts, event_id, action, crashes, violations, recent) of `marked` events (batch).

    Events of a key count in order of ts and event_id.  One that is fatal, or enough crashes, quarantines
    for good; enough violations suspend; a denial warns.  recent: the ids of the last `ring` events, the event's own last.
    """
    w = Window.partitionBy("key").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("key").orderBy("us", "event_id").rowsBetween(1 - ring, 0)
    run = rows.withColumns({"crashes": F.count_if("crash").over(w), "violations": F.count_if("violation").over(w), "recent": F.collect_list("event_id").over(near)})
    run = run.withColumn("_q", F.max(F.col("fatal") | (F.col("crashes") >= crashes)).over(w))
    action = F.when(F.col("_q"), "quarantine").when(F.col("violations") >= violations, "suspend").when(F.col("denied"), "warn").otherwise("none")
    return run.select("key", "ts", "event_id", action.alias("action"), "crashes", "violations", "recent")


class _Decider(StatefulProcessor):
    """Holds a key's events back until the watermark has passed them, then decides them in order."""

    def __init__(self, crashes: int, violations: int, ring: int):
        self.crashes, self.violations, self.ring = crashes, violations, ring

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.counts = handle.getValueState("counts", "crashes long, violations long, quarantined boolean")
        self.recent = handle.getListState("recent", "event_id long")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            new = list(frame[["us", "event_id", "crash", "violation", "denied", "fatal"]].itertuples(index=False, name=None))
            if new:
                self.waiting.appendList([(int(us), int(i), *map(bool, flags)) for us, i, *flags in new])
                self.handle.registerTimer(-(-min(int(r[0]) for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get())
        due, later = [e for e in held if e[0] <= passed], [e for e in held if e[0] > passed]
        if not due:
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        c, v, q = self.counts.get() or (0, 0, False)
        recent = [r[0] for r in self.recent.get()]
        out = []
        for us, event_id, crash, violation, denied, fatal in due:
            c, v = c + crash, v + violation
            q = q or fatal or c >= self.crashes
            recent = [*recent, event_id][-self.ring :]
            action = "quarantine" if q else "suspend" if v >= self.violations else "warn" if denied else "none"
            out.append((key[0], pd.Timestamp(us, unit="us"), event_id, action, c, v, recent))
        self.counts.update((c, v, q))
        self.recent.put([(r,) for r in recent])
        yield pd.DataFrame(out, columns=["key", "ts", "event_id", "action", "crashes", "violations", "recent"])

    def close(self) -> None:
        pass


def decided_stream(rows: DataFrame, late: str = "1 day", crashes: int = 3, violations: int = 5, ring: int = 5) -> DataFrame:
    """`decided` for a stream of `marked` events: the same rows, each once its time is `late` behind the newest event.

    Events may come in any order within `late`; one that comes later than the watermark is left out.  A key's
    state is its counts, the last `ring` ids, and the events that wait.  The state store must be RocksDB
    (`spark.sql.streaming.stateStore.providerClass`).
    """
    return (
        rows.withWatermark("ts", late)
        .groupBy("key")
        .transformWithStateInPandas(_Decider(crashes, violations, ring), _OUT, "Append", "EventTime")
    )
