"""Scan admission, byte budgets and event folding: batch forms, and streaming forms with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import reachable

PER_CLIENT, PER_DAY, PER_MONTH = 20, 80, 800
#: Parts in which a key's first rows are looked for.
SHARDS = 64


def first_of(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key in the order of (ts, request_id).

    Taken in SHARDS by id first, so a key that holds most rows is no single task: the last step sees SHARDS * most rows of a key."""
    order = ["ts", "request_id"]
    within = Window.partitionBy(*keys, "shard").orderBy(*order)
    some = rows.withColumn("shard", F.pmod(F.xxhash64("request_id"), F.lit(SHARDS))).withColumn("n", F.row_number().over(within)).filter(F.col("n") <= most)
    return some.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most).drop("n", "shard")


def admitted(requests: DataFrame, per_client: int = PER_CLIENT, per_day: int = PER_DAY, per_month: int = PER_MONTH) -> DataFrame:
    """request_id and verdict (admitted or the limit that refused) in the order of (ts, request_id).

    A request that a limit refuses does not reach the wider ones, so each limit takes the first of what passed the one before."""
    rows = requests.select("request_id", "ts", F.coalesce("client", F.lit(-1)).alias("client"), F.to_date("ts").alias("day"), F.trunc("ts", "month").alias("month"))
    one = first_of(rows, ["day", "client"], per_client)
    two = first_of(one, ["day"], per_day)
    three = first_of(two, ["month"], per_month)
    out = requests.select("request_id")
    for name, passed in (("client", one), ("day", two), ("month", three)):
        out = out.join(passed.select("request_id", F.lit(True).alias(name)), "request_id", "left")
    verdict = F.when(F.col("client").isNull(), "client").when(F.col("day").isNull(), "day").when(F.col("month").isNull(), "month").otherwise("admitted")
    return out.select("request_id", verdict.alias("verdict"))


def refunded(requests: DataFrame, per: str = "day") -> DataFrame:
    """Net count of each window: takes minus refunds (delta -1), which credit the window they happen in."""
    return requests.groupBy(F.date_trunc(per, "ts").alias("start")).agg(F.sum("delta").alias("net"))


def latest_events(events: DataFrame) -> DataFrame:
    """scan_id, the last payload of type 'page', number of events, and whether a terminal event came."""
    last = F.max_by("payload", F.when(F.col("type") == "page", F.col("seq")))
    return events.groupBy("scan_id").agg(last.alias("page"), F.count(F.lit(1)).alias("n_events"), F.max(F.col("type").isin("done", "error")).alias("ended"))


def recent_hosts(visits: DataFrame, most: int = 5) -> DataFrame:
    """client, host and place of each client's last distinct hosts."""
    seen = visits.groupBy("client", "host").agg(F.max(F.struct("ts", "request_id")).alias("at"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("at"))).cast("long")).filter(F.col("place") <= most).select("client", "host", "place")


def client_admission_stream(requests: DataFrame, per_client: int = PER_CLIENT, late: str = "1 hour") -> DataFrame:
    """Streaming form of the per-client limit: one count for each client and day in keyed state; rows of a batch go in order of (ts, request_id).

    A day's state goes when the watermark (``late`` behind the newest request) has left the day; requests behind the watermark are dropped."""
    reachable(requests.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        verdict = ["admitted" if n + i < per_client else "client" for i in range(len(rows))]
        state.update((n + len(rows),))
        end = int(pd.Timestamp(key[0], tz="UTC").timestamp() * 1000) + 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "verdict": verdict})

    keyed = requests.withWatermark("ts", late).withColumn("day", F.to_date("ts").cast("string"))
    return keyed.groupBy("day", "client").applyInPandasWithState(step, "request_id long, verdict string", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def counted_windows(requests: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests by client and tumbling window, for batch or stream (with a watermark)."""
    timed = requests.withWatermark("ts", late) if requests.isStreaming else requests
    return timed.groupBy(F.window("ts", width).alias("w"), "client").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "client", "n")
