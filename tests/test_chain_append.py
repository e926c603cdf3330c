"""A hash chain stored batch by batch."""

from pyspark.sql import functions as F

from plexmill.streaming import events

FIELDS = ["kind", "n"]


def stored(spark, folder):
    return spark.read.parquet(f"{folder}/events")


def rows(df):
    return sorted((r.log or "", r.seq, r.prev_hash, r.hash, r.n) for r in df.collect())


def test_ten_batches_equal_one(spark, tmp_path):
    all_ = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("log"), (F.col("id") % 7 % 3).cast("string"))).alias("log"), F.col("id").alias("n"), F.lit("x").alias("kind"))
    folder = str(tmp_path / "chain")
    for k in range(10):
        events.append_chain(all_.where(F.col("n").between(k * 30, k * 30 + 29)), k, folder, FIELDS, "log", ["n"])
    whole = events.chain(all_, FIELDS, "log", ["n"])
    assert rows(stored(spark, folder)) == rows(whole)
    assert events.verify_chain(stored(spark, folder), FIELDS).isEmpty()
    events.append_chain(all_.where("n >= 270"), 9, folder, FIELDS, "log", ["n"])  # the last once more, as after a failure
    assert rows(stored(spark, folder)) == rows(whole)
    events.append_chain(all_.limit(0), 10, folder, FIELDS, "log", ["n"])
    assert rows(stored(spark, folder)) == rows(whole)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, folder, state = (str(tmp_path / p) for p in ("in", "chain", "state"))
    part = lambda a, b: spark.range(a, b).select(F.lit("one").alias("log"), F.col("id").alias("n"), F.lit("x").alias("kind")).coalesce(1)
    for a, b in ((0, 20), (20, 50)):
        events.publish(part(a, b), source)
        live = spark.readStream.schema("log string, n long, kind string").parquet(source)
        events.chain_sink(live, folder, state, FIELDS, "log", ["n"], availableNow=True).awaitTermination()
    assert rows(stored(spark, folder)) == rows(events.chain(part(0, 50), FIELDS, "log", ["n"]))
