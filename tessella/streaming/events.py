"""The editor's events: debounce, latest parameter, rate limit and fan-out, in batch and as streams."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares that the frames of a session are dealt over. Clients are few beside what they get, so copies of them cost little.
SHARES = 32

#: Tasks for each core, given as a number, since adaptive execution would join tasks by what they read, not by what they make.
TASKS_PER_CORE = 4


def debounce(events: DataFrame, keys: list[str], gap: str, watermark: str | None = None) -> DataFrame:
    """One row per burst of events of a key that are at most ``gap`` apart: its first and last time, and its number of events.

    Works on streams too, with a watermark.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    out = rows.groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return out.drop("s")


def latest(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The value of each key's last event; of two at the same time, the one with the larger id."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value), F.count(F.lit(1)).alias("n"))


def frame_gap_ms(fps: int) -> int:
    """Whole milliseconds between two frames."""
    return 1000 // fps


def _keep(ms: list[int], gap: int, last: int | None) -> tuple[list[bool], int | None]:
    out = []
    for t in ms:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out, last


def throttle(events: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """Drops an event if less than ``gap_ms`` (whole ms) have gone by since its key's last kept one.

    Which events stay depends on all before them, so a key's events pass through one task in order, which remembers the
    last kept time and nothing else: its memory does not grow with the key. An event without a time is not kept; times are
    counted in UTC, so a session's time zone changes nothing.
    """

    def run(batches):
        key, last = None, None
        for batch in batches:
            keep = []
            times = batch.column(names.index("ts")).cast(pa.int64()).to_pylist()  # microseconds
            for k, us in zip(batch.column(len(names)).to_pylist(), times, strict=True):
                if k != key:
                    key, last = k, None
                t = None if us is None else us // 1000
                keep.append(t is not None and (last is None or t - last >= gap_ms))
                last = t if keep[-1] else last
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    names = events.columns
    rows = events.withColumn("_key", F.to_json(F.struct(*keys)))
    return rows.repartition("_key").sortWithinPartitions("_key", "ts", "event_id").mapInArrow(run, events.schema)


def _unit(ts: pd.Series) -> int:
    """Ticks of the series in a millisecond."""
    return {"ns": 1_000_000, "us": 1_000, "ms": 1}.get(getattr(ts.dt, "unit", "ns"), 1_000_000)


def throttle_stream(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """The same as a stream, for events that come in order within a key: the state is the last kept time."""

    def run(group, parts, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        keep, last = _keep((rows["ts"].astype("int64") // _unit(rows["ts"])).tolist(), gap_ms, last)
        if last is not None:
            state.update((last,))
        yield rows[keep][[key, "ts", "value"]]

    kind = dict(events.dtypes)
    return events.select(key, "ts", "value").groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, ts timestamp, value {kind['value']}", "last long", "append", "NoTimeout")


def fan_out(subscriptions: DataFrame) -> DataFrame:
    """Per (node_id, port): subscribers, and the rate and size to serve; more than four subscribers get 2 frames a second."""
    out = subscriptions.groupBy("node_id", "port").agg(F.count(F.lit(1)).alias("subscribers"), F.max("fps").alias("fps"), F.max("size").alias("size"))
    return out.withColumn("fps", F.when(F.col("subscribers") > 4, F.lit(2)).otherwise(F.col("fps")))


def recent(saves: DataFrame, owner: str, item: str, keep: int = 10) -> DataFrame:
    """Each owner's last ``keep`` items, newest first, each once."""
    last = saves.groupBy(owner, item).agg(F.max("ts").alias("ts"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("ts"), F.asc(item)))
    return last.withColumn("rank", rank).where(F.col("rank") <= keep)


def subscriptions(controls: DataFrame) -> DataFrame:
    """Who is subscribed after ``controls(client, ts, event_id, kind, node_id, port, max_size, fps)``.

    A client has one subscription, its last ``subscribe``, unless an ``unsubscribe`` came after it; controls of other
    kinds change nothing. Sizes are held to 1 to 256 (256 if absent), rates to 1 to 60 (5 if absent).
    """
    own = ("node_id", "port", "max_size", "fps")
    last = controls.where(F.col("kind").isin("subscribe", "unsubscribe")).groupBy("client").agg(F.max_by(F.struct("kind", *own), F.struct("ts", "event_id")).alias("c"))
    held = lambda c, most, default: F.least(F.greatest(F.coalesce(F.col(f"c.{c}"), F.lit(default)), F.lit(1)), F.lit(most)).cast("long").alias(c)
    return last.where("c.kind = 'subscribe'").select("client", "c.node_id", "c.port", held("max_size", 256, 256), held("fps", 60, 5))


def runs(bursts: DataFrame, session: str) -> DataFrame:
    """``bursts(session, last_ts)`` with the number of the run that each starts: 1, 2, ... within its session."""
    order = Window.partitionBy(session).orderBy("last_ts")
    return bursts.withColumn("run_id", F.row_number().over(order).cast("long")).withColumn("status", F.lit("completed"))


def active(events: DataFrame, session: str, is_replace: Column) -> DataFrame:
    """The events other than replacements, each with the replacement before it (``pipeline_id``) and its number since.

    Numbers start anew with each replacement. Events before a session's first one have nothing to act on: they are left out.
    """
    order = Window.partitionBy(session).orderBy("ts", "event_id")
    rows = events.withColumn("_new", is_replace)
    rows = rows.withColumn("pipeline_id", F.last(F.when(F.col("_new"), F.col("event_id")), True).over(order))
    since = Window.partitionBy(session, "pipeline_id").orderBy("ts", "event_id")
    rows = rows.where("pipeline_id is not null").withColumn("number", (F.row_number().over(since) - 1).cast("long"))
    return rows.where("not _new").drop("_new")


def broadcast(frames: DataFrame, clients: DataFrame, session: str) -> DataFrame:
    """Each frame once for every client of its session.

    The result grows with frames times clients and is as large as it is; a session's frames are dealt by hash over ``SHARES``
    shares, each of which has all its clients, so that sessions few or large keep all cores busy. Merging reads a
    session's clients in a row and lets them spill, where a hash table would be walked entry by entry for each frame.
    """
    tasks = TASKS_PER_CORE * frames.sparkSession.sparkContext.defaultParallelism
    hashed = [c for c, kind in frames.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = frames.withColumn("_share", F.pmod(F.xxhash64(*hashed), F.lit(SHARES)).cast("int"))
    copies = clients.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    keys = [session, "_share"]
    return dealt.repartition(tasks, *keys).join(copies.repartition(tasks, *keys).hint("merge"), keys).drop("_share")


def cached(requests: DataFrame, entries: DataFrame, host: str) -> DataFrame:
    """``requests(host, now, reachable)`` with a ``status`` by ``entries(host, expires_at)``.

    ``ready`` from the cache while it has not expired, or else when the host can be reached; ``stale`` if only an expired
    entry is there; ``error`` if nothing is.
    """
    out = requests.join(entries, host, "left")
    fresh = F.coalesce(F.col("expires_at") > F.col("now"), F.lit(False))
    status = F.when(fresh | F.col("reachable"), "ready").when(F.col("expires_at").isNotNull(), "stale").otherwise("error")
    return out.withColumns({"status": status, "from_cache": fresh})


def frames(kind: Column, node: Column, ts_ms: Column, payload: Column) -> Column:
    """Frames as bytes: kind in one byte, node, time (its low 32 bits) and length in four each, then the payload."""
    word = lambda v, digits: F.unhex(F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit((1 << 4 * digits) - 1))), digits, "0"))
    return F.concat(word(kind, 2), word(node, 8), word(ts_ms, 8), word(F.octet_length(payload), 8), payload)


def parsed_frames(frame: Column) -> Column:
    """``kind, node, ts_ms, payload`` of a frame, or null if its length is not exactly what it says."""
    number = lambda at, size: F.conv(F.hex(F.substring(frame, at, size)), 16, 10).cast("long")
    size = F.octet_length(frame)
    good = (size >= 13) & (number(10, 4) == size - 13)
    return F.when(good, F.struct(number(1, 1).alias("kind"), number(2, 4).alias("node"), number(6, 4).alias("ts_ms"), F.substring(frame, 14, 1 << 30).alias("payload")))


_HEAD = struct.Struct(">BIII")


def encode_frame(kind: int, node: int, ts_ms: int, payload: bytes) -> bytes:
    return _HEAD.pack(kind, node, ts_ms & 0xFFFFFFFF, len(payload)) + payload


def decode_frame(data: bytes) -> tuple[int, int, int, bytes]:
    """Kind, node, time and payload; the length must be exact."""
    if len(data) < _HEAD.size or len(data) != _HEAD.size + _HEAD.unpack_from(data)[3]:
        raise ValueError("frame length")
    return (*_HEAD.unpack_from(data)[:3], data[_HEAD.size :])
