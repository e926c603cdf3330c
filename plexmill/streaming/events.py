"""Event streams: subscriptions, running counters, trailing windows, recovery states, audit chains.

Every operator takes a frame of events, batch or streaming, unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events appended to a folder of Parquet files, event time as a timestamp."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def of_type(events: DataFrame, event_type: str = "") -> DataFrame:
    return events.where(F.col("event_type") == event_type) if event_type else events


def subscribe(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, event_type: str = ""):
    """Hand every batch of new events to `handler`; nothing is dropped.  Returns the started query."""
    return of_type(events, event_type).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()


def publish(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def counters(events: DataFrame, key: str, violation: Column) -> DataFrame:
    """(key, events, violations, last): running counts; in a stream, in update mode."""
    return events.groupBy(key).agg(F.count("*").alias("events"), F.count_if(violation).alias("violations"), F.max("ts").alias("last"))


def velocity(events: DataFrame, key: str, asof: Column, days: int = 7) -> DataFrame:
    """(key, n): events within `days` before `asof`; all with days <= 0."""
    got = events if days <= 0 else events.where(F.col("ts") > asof - F.make_interval(days=F.lit(days)))
    return got.groupBy(key).agg(F.count("*").alias("n"))


def sliding_velocity(events: DataFrame, key: str, late: str = "1 day", days: int = 7) -> DataFrame:
    """(key, window, n) for a stream: counts over windows of `days`, each day."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", f"{days} days", "1 day")).agg(F.count("*").alias("n"))


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n events, latest first (batch)."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def recovery_states(events: DataFrame, key: str, crash: Column, violation: Column, denied: Column, escape: Column, crashes: int = 3, violations: int = 5, rejected: Column | None = None) -> DataFrame:
    """Each event with the action it leads to (batch).

    An escape, a rejected verification, or enough crashes, quarantines for good; enough
    violations suspend; a denial warns.
    """
    escape = escape if rejected is None else escape | rejected
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_c", F.count_if(crash).over(w)).withColumn("_v", F.count_if(violation).over(w))
    run = run.withColumn("_q", F.max(F.when(escape | (F.col("_c") >= crashes), 1).otherwise(0)).over(w))
    action = F.when(F.col("_q") == 1, "quarantine").when(F.col("_v") >= violations, "suspend").when(denied, "warn").otherwise("none")
    return run.withColumn("action", action).drop("_c", "_v", "_q")


def streaming_recovery(events: DataFrame, key: str, crash_type: str = "crash", violation_type: str = "violation", escape_type: str = "escape", crashes: int = 3, violations: int = 5) -> DataFrame:
    """(key, action, crashes, violations) for a stream, after each batch with events of the key."""
    import pandas as pd

    def step(k, batches, state):
        c, v, q = state.get if state.exists else (0, 0, False)
        for pdf in batches:
            kinds = pdf["event_type"]
            c += int((kinds == crash_type).sum())
            v += int((kinds == violation_type).sum())
            q = q or bool((kinds == escape_type).any()) or c >= crashes
        state.update((c, v, q))
        action = "quarantine" if q else "suspend" if v >= violations else "none"
        yield pd.DataFrame({"key": [str(k[0])], "action": [action], "crashes": [c], "violations": [v]})

    return events.groupBy(key).applyInPandasWithState(
        step, "key string, action string, crashes long, violations long", "c long, v long, q boolean", "update", "NoTimeout"
    )


def discrepancy(desired: Column, actual: Column) -> Column:
    """The first reason why a desired and an actual state differ."""
    return (
        F.when(actual.isNull() & (desired == "installed"), "not_installed")
        .when(actual.isNotNull() & (desired == "absent"), "should_be_absent")
        .when(~desired.eqNullSafe(actual), "state_differs")
        .otherwise("none")
    )


#: The fields of an audit event, in the order they are hashed; the hash before comes last.
AUDIT_FIELDS = [
    "sequence", "timestamp", "organization_id", "actor_id", "actor_type", "action", "target", "plugin_id", "version", "deployment_target",
    "policy_result", "outcome", "reason", "correlation_id",
]


def instant(ts: Column) -> Column:
    """A UTC instant as text: seconds, and as many decimals as it takes, without zeros at their end."""
    decimals = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""), F.lit("Z"))


def audit_hash(previous: Column, ts: str = "timestamp") -> Column:
    """SHA-256 of an audit event's fields and the hash before it; missing texts are empty."""
    text = lambda f: instant(F.col(ts)) if f == "timestamp" else F.coalesce(F.col(f).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", *map(text, AUDIT_FIELDS), previous), 256)


def event_hash(previous: Column, fields: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", previous, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)


def chain(events: DataFrame, fields: list[str], log: str, order: list[str], genesis: str = "", heads: DataFrame | None = None) -> DataFrame:
    """`events` with seq, prev_hash and hash: each log chained from its first event to its last (batch).

    heads: (log, seq, hash) of the last event of logs that go on, one row a log.  A hash needs the one before it, so a
    log is chained by one task, event by event; of a log only its last hash is held.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        last, seq, previous = (), 0, genesis
        for batch in batches:
            rows, before, after = [], [], []
            for key, text, n, head in zip(*(batch.column(c).to_pylist() for c in (log, "_text", "_seq", "_head")), strict=True):
                if (key,) != last:
                    last, seq, previous = (key,), n, head
                seq += 1
                rows.append(seq)
                before.append(previous)
                previous = hashlib.sha256(f"{previous}:{text}".encode()).hexdigest()
                after.append(previous)
            keep = [c for c in batch.schema.names if c not in ("_text", "_seq", "_head")]
            made = [pa.array(rows, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "seq", "prev_hash", "hash"])

    text = F.concat_ws(":", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    dealt = events.withColumn("_text", text)
    none = [F.lit(None).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_head")]
    if heads is None:
        dealt = dealt.select("*", *none)
    else:
        ends = heads.select(F.col(log).alias("_log"), F.col("seq").cast("long").alias("_seq"), F.col("hash").alias("_head"))
        dealt = dealt.join(ends, F.col(log).eqNullSafe(F.col("_log")), "left").drop("_log")
    dealt = dealt.withColumns({"_seq": F.coalesce("_seq", F.lit(0)), "_head": F.coalesce("_head", F.lit(genesis))})
    dealt = dealt.repartition(log).sortWithinPartitions(log, *order)
    schema = events.schema
    for name, kind in (("seq", "long"), ("prev_hash", "string"), ("hash", "string")):
        schema = T.StructType(schema.fields).add(name, kind)
    return dealt.mapInArrow(run, schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def chain_heads(spark: SparkSession, folder: str, log: str, before: int | None = None) -> DataFrame | None:
    """(log, seq, hash): the last event of each stored log, of batches below `before` if given; None where nothing is stored."""
    if not _exists(spark, f"{folder}/heads"):
        return None
    heads = spark.read.parquet(f"{folder}/heads")
    if before is not None:
        heads = heads.where(F.col("batch") < before)
    return heads.groupBy(log).agg(F.max_by(F.struct("seq", "hash"), "seq").alias("h")).select(log, "h.seq", "h.hash")


def append_chain(batch: DataFrame, number: int, folder: str, fields: list[str], log: str, order: list[str], genesis: str = "") -> None:
    """Chain a batch onto the stored logs of a folder: rows to events/batch=<number>, last hashes to heads/batch=<number>.

    Batches are numbered upwards, and a folder has one writer at a time.  A batch written again, after a failure, starts
    from the heads of batches below it and replaces what it wrote; so it fits `foreachBatch`.  Within a batch a
    log is chained by `order`; an event that comes in a later batch comes later in its chain.
    """
    spark = batch.sparkSession
    made = chain(batch, fields, log, order, genesis, chain_heads(spark, folder, log, number))
    made.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
    stored = spark.read.schema(made.schema).parquet(f"{folder}/events/batch={number}")
    ends = stored.groupBy(log).agg(F.max_by(F.struct("seq", "hash"), "seq").alias("h")).select(log, "h.seq", "h.hash")
    ends.write.mode("overwrite").parquet(f"{folder}/heads/batch={number}")


def chain_sink(events: DataFrame, folder: str, checkpoint: str, fields: list[str], log: str, order: list[str], genesis: str = "", **trigger):
    """Append a stream of events to the stored logs of a folder.  Returns the started query."""
    write = lambda batch, number: append_chain(batch, number, folder, fields, log, order, genesis)
    started = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


def verify_chain(events: DataFrame, fields: list[str], log: str = "log", genesis: str = "") -> DataFrame:
    """(log, seq, problem) of a hash chain: sequence gaps, wrong previous hashes, changed events.

    events: (log, seq, prev_hash, hash, ...); each log is a chain of its own.
    """
    w = Window.partitionBy(log).orderBy("seq")
    checked = events.withColumn("_ps", F.lag("seq").over(w)).withColumn("_ph", F.lag("hash").over(w))
    problem = (
        F.when(F.col("seq") != F.coalesce(F.col("_ps"), F.lit(0)) + 1, "gap")
        .when(F.col("prev_hash") != F.coalesce("_ph", F.lit(genesis)), "broken_link")
        .when(F.col("hash") != event_hash(F.col("prev_hash"), fields), "tampered")
    )
    return checked.withColumn("problem", problem).where("problem is not null").select(log, "seq", "problem")
