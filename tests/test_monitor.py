"""A stream decides every event as a batch does."""

import pytest
from pyspark.sql import functions as F

from plexmill.streaming import events, monitor

from .conftest import SF

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def flags(df):
    kind = F.col("event_type")
    return monitor.marked(df, "user_id", kind == "error", kind.isin("click", "view"), (kind == "error") & (F.col("value") > 50), (kind == "signup") & (F.col("value") < 5))


def rows(df):
    return sorted((r.key, r.ts, r.event_id, r.action, r.crashes, r.violations, tuple(r.recent)) for r in df.collect())


def test_stream_equals_batch_whatever_the_order_within_the_delay(rocks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = rocks.read.parquet(f"{SF}/events.parquet").where("user_id < 6").withColumn("ts", F.col("ts").cast("timestamp"))
    table = table.select("event_id", "ts", "user_id", "event_type", "value").cache()
    low, high = table.agg(F.min("ts"), F.max("ts")).first()
    span = (high - low) / 3
    late = f"{int(span.total_seconds()) + 1} seconds"

    def feed(df):
        events.publish(df.coalesce(1), source)
        live = events.stream(rocks, source, table.schema)
        query = monitor.decided_stream(flags(live), late).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    for k in range(3):  # each third of the time, its events in no order
        lower, upper = F.lit(low) + F.lit(k) * F.lit(span), F.lit(low) + F.lit(k + 1) * F.lit(span)
        feed(table.where((F.col("ts") >= lower) & ((F.col("ts") < upper) | F.lit(k == 2))).orderBy(F.xxhash64("event_id")))
    end = rocks.createDataFrame([(-1, 1 << 40)], "event_id long, s long").select(
        F.col("event_id").cast(table.schema["event_id"].dataType).alias("event_id"), F.lit(high).alias("ts") + F.expr("interval 20 years"), F.lit(-1).cast(table.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")
    ).toDF("event_id", "ts", "user_id", "event_type", "value")
    feed(end)
    got, want = rows(rocks.read.parquet(out)), rows(monitor.decided(flags(table)))
    assert got == want
    assert {r[3] for r in want} >= {"none", "suspend", "quarantine"}


def test_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, None, "a", "error"), (2, "2024-01-01", None, "error"), (3, "2024-01-01", "a", None), (4, "2024-01-01", "a", "signup")], "event_id long, ts string, user_id string, event_type string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.lit(1.0))
    assert [(r[2], r[3], r[6]) for r in rows(monitor.decided(flags(df)))] == [(3, "none", (3,)), (4, "quarantine", (3, 4))]
    assert monitor.decided(flags(df.limit(0))).isEmpty()
