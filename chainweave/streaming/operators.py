"""Continuous operators over events: deduplication, windows, limiters, running state and reordering.

Each takes a streaming DataFrame. Registered queries run them over the events that are there (availableNow) into a table of the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainweave.operators.network import LIMITED
from chainweave.plans.lineage import shared_dir
from chainweave.registry import register
from chainweave.views import Ledger


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, whether the table is a folder or a single file."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    single = any(f.rstrip("/").endswith("/events.parquet") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)


def run_available(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what has arrived and gives its results: all appended rows, or in complete mode the last result table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/chainweave/{label}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if mode == "complete":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    query = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(stream: DataFrame, length: str = "1 hour") -> DataFrame:
    """Events and their value, in hundredths, by aligned window and type. The watermark bounds what append mode keeps."""
    w = stream.withWatermark("ts", "2 hours").groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n", "total")


def once_each(stream: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first event of each key; state lasts as long as the watermark may still let a repeat through."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def limit_rate(stream: DataFrame, window: int, most: int) -> DataFrame:
    """(key, at, id, accepted) of a stream (key, at, id): at most `most` accepted in (at - window, at]. State: the accepted times still in the window."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        accepted = []
        for at in rows["at"]:
            log = [t for t in log if t > at - window]
            accepted.append(len(log) < most)
            if accepted[-1]:
                log.append(int(at))
        state.update((log,))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "id": rows["id"].to_numpy(), "accepted": accepted})

    return stream.groupBy("key").applyInPandasWithState(step, "key bigint, at bigint, id bigint, accepted boolean", "log array<bigint>", "append", GroupStateTimeout.NoTimeout)


def running_average(stream: DataFrame, new: float = 0.3, start: float = 1000.0) -> DataFrame:
    """(key, n, value) after every batch: value = (1 - new) value + new sample, from `start`."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, start)
        for x in pd.concat(list(frames)).sort_values(["at", "id"])["amount"]:
            n, value = n + 1, value * (1 - new) + x * new
        state.update((n, value))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "value": [value]})

    return stream.groupBy("key").applyInPandasWithState(step, "key bigint, n bigint, value double", "n bigint, value double", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame) -> DataFrame:
    """(lane, height) of a stream (lane, height): heights leave in order from 0 on, each once; what comes too early waits in state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, waiting = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        waiting |= {int(h) for f in frames for h in f["height"] if h >= nxt}
        out = []
        while nxt in waiting:
            waiting.discard(nxt)
            out.append(nxt)
            nxt += 1
        state.update((nxt, sorted(waiting)))
        yield pd.DataFrame({"lane": [key[0]] * len(out), "height": out}).astype({"lane": "int64", "height": "int64"})

    return stream.groupBy("lane").applyInPandasWithState(step, "lane bigint, height bigint", "nxt bigint, waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)


def settlements(payments: DataFrame, confirmations: DataFrame, within: str = "24 hours") -> DataFrame:
    """Payments (payment, txid, asked) joined with confirmations (txid, seen) no later than `within`; unmatched ones come out with nulls once the watermark passes."""
    p = payments.withWatermark("asked", "1 hour").alias("p")
    c = confirmations.withWatermark("seen", "1 hour").alias("c")
    on = F.expr(f"p.txid = c.txid AND c.seen >= p.asked AND c.seen <= p.asked + INTERVAL {within}")
    return p.join(c, on, "leftOuter").select("p.payment", "p.txid", "p.asked", "c.seen")


def fan_out(stream: DataFrame, subscribers: dict[str, list[str]], deliver) -> object:
    """Gives each subscriber, batch by batch, the events of its types: deliver(name, DataFrame). One that raises is counted as failed and doesn't stop the others."""
    failed: dict[str, int] = {}

    def batch(df: DataFrame, _: int) -> None:
        for name, types in subscribers.items():
            try:
                deliver(name, df.filter(F.col("event_type").isin(types)))
            except Exception:  # noqa: BLE001
                failed[name] = failed.get(name, 0) + 1

    return stream.writeStream.foreachBatch(batch), failed


@register("stream_window_counts", "SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def _windows(ledger: Ledger) -> DataFrame:
    return run_available(window_counts(event_stream(ledger.spark, ledger.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))), "complete", "windows")


@register("stream_deduplicated", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def _once(ledger: Ledger) -> DataFrame:
    """Every event arrives twice and leaves once."""
    events = event_stream(ledger.spark, ledger.sf_dir)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return run_available(once_each(twice, ["event_id"]).select("event_id", "user_id", "event_type"), "append", "once")


@register("stream_connection_limiter", LIMITED)
def _limited(ledger: Ledger) -> DataFrame:
    """As connection_limiter, with state instead of a fold."""
    events = event_stream(ledger.spark, ledger.sf_dir)
    rows = events.select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return run_available(limit_rate(rows, 43200, 3), "append", "limiter")


@register("stream_latency_average", "SELECT peer AS key, count(*) AS n, round(list_reduce(list_prepend(1000.0::DOUBLE, list(amount ORDER BY sec, event_id)), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS value FROM peer_samples GROUP BY peer")
def _average(ledger: Ledger) -> DataFrame:
    events = event_stream(ledger.spark, ledger.sf_dir)
    rows = events.select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.col("value").alias("amount"))
    last = run_available(running_average(rows), "append", "average")
    return last.groupBy("key").agg(F.max("n").alias("n"), F.round(F.max_by("value", "n"), 6).alias("value"))


@register("stream_in_order", "SELECT user_id % 4 AS lane, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS height FROM events")
def _ordered(ledger: Ledger) -> DataFrame:
    """Places of each lane's events, which arrive in any order."""
    events = ledger["events"]
    from pyspark.sql import Window

    from chainweave.plans.lineage import cut

    place = (F.row_number().over(Window.partitionBy(F.expr("user_id % 4")).orderBy("event_id")) - 1).cast("long")
    cut_rows = cut(events.select(F.expr("user_id % 4").alias("lane"), place.alias("height")).orderBy(F.xxhash64("event_id")), "lanes")
    path = cut_rows.inputFiles()[0].rsplit("/", 1)[0]
    return run_available(in_order(ledger.spark.readStream.schema(cut_rows.schema).parquet(path)), "append", "ordered")
