"""Streams give what batch queries give, replays change nothing, and tables are replaced by partition and joined by bucket."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import markov as C
from scoreloom.operators import stability as P
from scoreloom.operators import transforms as T
from scoreloom.plans import extended
from scoreloom.sources import tables as files
from scoreloom.streaming import arrears, monitor


def test_entity_counts_are_those_of_the_whole_sequence():
    rng = random.Random(2)
    for _ in range(200):
        events = [(rng.randrange(30), k, rng.randrange(3)) for k in range(rng.randrange(1, 15))]
        totals, own = dict.fromkeys(arrears.COUNTS, 0), arrears.Entity([], False)
        for e in events:
            own.add(e, totals)
        states = [s for _, _, s in sorted(events)]
        want = dict.fromkeys(arrears.COUNTS, 0)
        for before, after in zip([None, *states], states):
            for name, n in arrears.step(before, after).items():
                want[name] += n
        assert totals == want


def test_forgotten_events_bound_the_state():
    totals, own = dict.fromkeys(arrears.COUNTS, 0), arrears.Entity([], False)
    for t in range(10):
        own.add((t, t, t % 2), totals)
    own.forget(7)
    assert [e[0] for e in own.events] == [6, 7, 8, 9] and own.base
    own.add((5, 0, 1), totals)
    assert totals["too_late"] == 1
    own.add((6, 9, 2), totals)
    assert [e[0] for e in own.events] == [6, 6, 7, 8, 9] and totals["defaulted"] == 1
    own.forget(100)
    assert len(own.events) == 1


@pytest.fixture
def events(spark):
    return spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 23).alias("user_id"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("state"), F.when(F.col("id") % 9 != 0, F.sqrt("id")).alias("value"))


def test_stream_with_late_events_equals_batch(spark, events, tmp_path):
    stream = extended._as_stream(spark, events, f"{tmp_path}/in", 4)
    arrears.keep_changes(arrears.changes(stream, "user_id", "ts", "event_id", F.col("state"), "60 days"), f"{tmp_path}/kept", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = arrears.kept_kpis(spark, f"{tmp_path}/kept").first().asDict()
    want = C.arrears_kpis(events, "user_id", F.col("state"), ["ts", "event_id"]).first().asDict()
    assert got.pop("too_late") == 0 and got == pytest.approx(want)


def test_replayed_batches_change_nothing(spark, events, tmp_path):
    late = F.col("ts") >= "2024-01-15"
    edges = T.equal_frequency_edges(events.where(~late), "value", 5).first().edges
    stream = extended._as_stream(spark, events, f"{tmp_path}/in", 3)
    start = lambda state: monitor.keep_counts(stream, f"{tmp_path}/kept", F.date_format("ts", "yyyy-MM-dd"), "value", edges, f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
    start("one")
    first = sorted(monitor.kept_counts(spark, f"{tmp_path}/kept").collect(), key=str)
    start("two")  # without its progress, the stream sends all batches again
    assert sorted(monitor.kept_counts(spark, f"{tmp_path}/kept").collect(), key=str) == first
    assert sum(r.n for r in first) == 600
    got = monitor.kept_shares(monitor.kept_counts(spark, f"{tmp_path}/kept"), F.col("period") >= "2024-01-15", P.grid(events, 5))
    x = F.when(F.col("value").isNotNull(), T.by_edges(F.col("value"), F.array(*map(F.lit, edges)), 5))
    want = P.shares(events.withColumn("bin", x), "bin", late, bins=P.grid(events, 5))
    key = lambda df: sorted(((r.bin, round(r.expected, 9), round(r.actual, 9)) for r in df.collect()), key=str)
    assert key(got) == key(want) and len(key(got)) == 6
    monitor.compact_counts(spark, f"{tmp_path}/kept", f"{tmp_path}/compact")
    assert sorted(spark.read.parquet(f"{tmp_path}/compact").collect(), key=str) == first


def test_one_partition_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "v int, k int")
    files.overwrite_partitions(df, f"{tmp_path}/t", ("k",))
    files.overwrite_partitions(df.where("k = 1").withColumn("v", F.lit(-1)), f"{tmp_path}/t", ("k",))
    got = {r.k: (r.n, r.m) for r in spark.read.parquet(f"{tmp_path}/t").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m")).collect()}
    assert got == {0: (10, 0), 1: (10, -1), 2: (10, 2)}


def test_bucketed_join_has_no_exchange(spark, sf):
    names = ("bucketed_test_a", "bucketed_test_b")
    joined = extended.bucketed_join(spark, sf, names, 4)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in names:
        spark.sql(f"DROP TABLE {name}")
