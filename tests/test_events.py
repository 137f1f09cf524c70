"""The event operators on streams, at their edges, and frames as columns."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.streaming import events as E

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def rows(n, users, seed=1):
    rng = random.Random(seed)
    return [(k, START + dt.timedelta(milliseconds=rng.randint(0, 20_000)), rng.choice(users), float(k)) for k in range(n)]


def kept(own, gap):
    out, last = [], {}
    for r in sorted(own, key=lambda r: (r[1], r[0])):
        if r[2] not in last or (r[1] - last[r[2]]) // dt.timedelta(milliseconds=1) >= gap:
            out.append(r[0])
            last[r[2]] = r[1]
    return sorted(out)


def test_throttle_of_a_hot_key(spark):
    """One key with nine tenths of the rows, and a null key."""
    own = rows(3000, [1] * 9 + [None])
    df = spark.createDataFrame(own, SCHEMA).repartition(5)
    assert sorted(r.event_id for r in E.throttle(df, ["user_id"], 50).collect()) == kept(own, 50)
    assert E.throttle(df.limit(0), ["user_id"], 50).count() == 0


def test_throttle_query_with_nulls_and_clock_changes(spark, tmp_path):
    """Rows without a user or a time, and an hour that comes twice in the session's zone: the same as SQL."""
    at = lambda m: dt.datetime(2024, 11, 3, 4) + dt.timedelta(minutes=m)
    own = [(k, None if k % 11 == 0 else at(13 * k), None if k % 7 == 0 else k % 3) for k in range(120)]
    spark.createDataFrame(own, "event_id long, ts timestamp, user_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(r[0] for r in con.execute(Q.ORACLE["ev_throttle"]).fetchall())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(r.event_id for r in Q.ev_throttle(spark, str(tmp_path)).select("event_id").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_throttle_as_a_stream(spark, tmp_path):
    own = sorted(rows(200, [1, 2, 3]), key=lambda r: r[1])
    spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = E.throttle_stream(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), "user_id", 300)
    query = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    values = sorted(int(r.value) for r in spark.table("throttled").collect())
    assert values == kept(own, 300)


def test_frames_as_columns(spark):
    df = spark.createDataFrame([(1, 7, 5_000_000_000, b"abc"), (255, 2**32 - 1, 0, b"")], "k int, n long, t long, p binary")
    got = df.select(E.frames(F.col("k"), F.col("n"), F.col("t"), F.col("p")).alias("f"), "*").collect()
    for r in got:
        assert bytes(r.f) == E.encode_frame(r.k, r.n, r.t, bytes(r.p)) and E.decode_frame(bytes(r.f)) == (r.k, r.n, r.t & 0xFFFFFFFF, bytes(r.p))
    cut = spark.createDataFrame([(bytes(r.f),) for r in got] + [(bytes(got[0].f)[:-1],), (bytes(got[0].f) + b"x",), (b"short",), (b"",)], "f binary")
    parsed = [r.p for r in cut.select(E.parsed_frames(F.col("f")).alias("p")).collect()]
    assert [(p.kind, p.node, p.ts_ms, bytes(p.payload)) for p in parsed[:2]] == [(1, 7, 5_000_000_000 & 0xFFFFFFFF, b"abc"), (255, 2**32 - 1, 0, b"")]
    assert parsed[2:] == [None] * 4
    with pytest.raises(ValueError, match="length"):
        E.decode_frame(b"short")


def test_subscriptions_and_their_bounds(spark):
    at = lambda k: START + dt.timedelta(seconds=k)
    own = [(1, at(0), 1, "subscribe", "n", "out", 900, 0), (1, at(1), 2, "other", "x", "y", 1, 1), (2, at(0), 3, "subscribe", "n", "out", None, None), (3, at(0), 4, "subscribe", "n", "out", 5, 5), (3, at(0), 5, "unsubscribe", None, None, None, None), (4, at(0), 6, "subscribe", "a", "out", 1, 1), (4, at(2), 7, "subscribe", "b", "in", 2, 70)]
    df = spark.createDataFrame(own, "client long, ts timestamp, event_id long, kind string, node_id string, port string, max_size long, fps long")
    got = sorted(tuple(r) for r in E.subscriptions(df).collect())
    assert got == [(1, "n", "out", 256, 1), (2, "n", "out", 256, 5), (4, "b", "in", 2, 60)]


def test_broadcast_spreads_a_session(spark):
    """One session has nearly all frames: its rows are made in many tasks, also where clients are too many to be sent to all."""
    frames = [(k, None if k % 50 == 0 else 7 if k % 10 else k % 3, {"k": k}) for k in range(400)] + [(1, 7, {"k": 1})]
    clients = [(c, None if c == 0 else 7 if c % 4 else c % 3) for c in range(60)]
    left = spark.createDataFrame(frames, "event_id long, session long, payload map<string,long>")
    right = spark.createDataFrame(clients, "client long, session long")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = E.broadcast(left, right, "session").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    want = sorted((s, e, p["k"], c) for e, s, p in frames for c, t in clients if s is not None and s == t)
    assert sorted((r.session, r.event_id, r.payload["k"], r.client) for r in got) == want
    assert got[0].__fields__ == ["session", "event_id", "payload", "client", "task"]
    tasks = [r.task for r in got if r.session == 7]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 4


def test_gap_of_a_rate():
    assert [E.frame_gap_ms(f) for f in (1, 3, 60)] == [1000, 333, 16]
