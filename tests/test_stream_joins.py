"""Streams against the batch operators, for several cuts into triggers and after a restart."""

import random

import pytest
from pyspark.sql import functions as F


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(df, name, base):
    q = df.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def cuts(n, seed):
    r = random.Random(seed)
    at = sorted(r.sample(range(1, n), 3))
    return list(zip([0, *at], [*at, n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_and_bundles_equal_the_batch_forms(spark, tmp_path, seed):
    from framelake.operators import streams as batch
    from framelake.streaming import joins, stateful

    schema, r, base = "user string, seq long, tag string, value long", random.Random(seed), f"file://{tmp_path}"
    rows = [(r.choice("uv"), k, r.choice("abcx"), k * 10) for k in range(90)]
    whole = spark.createDataFrame(rows, schema)
    src = lambda: stateful.replay(spark, f"{base}/in", schema)
    for a, b in cuts(90, seed):  # a restart between any two
        feed(spark, f"{base}/in", rows[a:b], schema)
        drain(joins.round_robin(src(), ["user"], "tag", "seq", "value", ["c", "a", "b"]), "turns", base)
        drain(joins.accumulate_slots(src(), ["user"], "tag", "seq", "value", ["a", "b", "c"]), "slots", base)
    want = batch.round_robin(whole.where("tag <> 'x'").withColumnRenamed("seq", "at"), ["user"], "tag", ["at"])
    want = want.select("user", "tag", "value", F.col("seq").cast("long"))
    got = spark.read.parquet(f"{base}/turns").select("user", "tag", "value", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    want = batch.accumulate_slots(whole, ["user"], "tag", "seq", "value", ["a", "b", "c"])
    plain = lambda df: sorted((x["user"], x["bundle"], x["tag"], tuple(x["items"])) for x in df.collect())
    assert plain(spark.read.parquet(f"{base}/slots")) == plain(want) and want.count() > 20


def test_a_backlog_beyond_its_limit_stops_the_query(spark, tmp_path):
    from framelake.streaming import joins, stateful

    schema, base = "user string, seq long, tag string, value long", f"file://{tmp_path}"
    feed(spark, f"{base}/in", [("u", k, "b", k) for k in range(5)], schema)
    src = lambda: stateful.replay(spark, f"{base}/in", schema)
    drain(joins.round_robin(src(), ["user"], "tag", "seq", "value", ["a", "b"], limit=5), "fits", base)
    with pytest.raises(Exception, match="the limit is 4"):
        drain(joins.round_robin(src(), ["user"], "tag", "seq", "value", ["a", "b"], limit=4), "over", base)


@pytest.mark.parametrize("seed", [3, 4])
def test_samples_equal_the_batch_form(spark, tmp_path, seed):
    """Rows out of order within the watermark; a last row of another key lets all timers fire; a late row changes nothing."""
    from framelake.operators.framing import sampling_windows as batch
    from framelake.streaming import joins, stateful

    schema, r, base = "user string, ts timestamp, value double", random.Random(seed), f"file://{tmp_path}"
    rows = sorted((r.randrange(60_000), r.choice("uv"), float(r.randrange(100))) for _ in range(120))
    mixed = sorted(rows, key=lambda x: x[0] + r.randrange(4000))  # up to four seconds late
    made = lambda some: spark.createDataFrame([(u, t, v) for t, u, v in some], "user string, ms long, value double").select("user", F.timestamp_millis("ms").alias("ts"), "value")
    src = lambda: stateful.replay(spark, f"{base}/in", schema)
    steps = [mixed[a:b] for a, b in cuts(120, seed)] + [[(10_000_000, "end", 0.0)], [(1_000, "u", 1e6)], [(20_000_000, "end", 0.0)]]
    for some in steps:
        made(some).coalesce(1).write.mode("append").parquet(f"{base}/in")
        drain(joins.sampling_windows(src(), ["user"], "ts", "value", 700, 2500, "5 seconds"), "samples", base)
    got = sorted(map(tuple, spark.read.parquet(f"{base}/samples").where("user <> 'end'").select("user", "sample", "at", "n", "sum").collect()))
    whole = spark.createDataFrame([(u, t, v) for t, u, v in rows], "user string, ms long, value double")
    want = sorted(map(tuple, batch(whole, ["user"], "ms", "value", 700, 2500).collect()))
    assert got == want and len(want) > 150
    assert sum(x[3] for x in want) > 120
