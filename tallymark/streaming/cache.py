"""Lookup results remembered for a time, per (source, handle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import fresh_path

STORED = ("ok", "not_found")
ROWS = "request_id bigint, source string, handle string, ts timestamp, status string, cached boolean"
STATE = "source string, handle string, at double, status string"


def lookup_cache_batch(
    requests: DataFrame, state: DataFrame, ttl_seconds: float = 3600.0, lateness_seconds: float = 0.0
) -> DataFrame:
    """(kind, request and state columns): requests with their status, and the state they leave behind.

    Within the time to live of a stored result a request gets that result and renews nothing;
    otherwise it gets its live status, which is stored when it is ok or not_found. Spark puts a
    key's stored result and requests in time order by a sort that spills, and a task walks them
    from batch to batch with one stored result in hand, so that a key of any size takes no more
    memory than a small one. A result that no request can meet any more, as its time ended
    ``lateness_seconds`` before the latest request, leaves no state.
    """
    ttl, kept, slack = float(ttl_seconds), STORED, float(lateness_seconds)
    keyed = requests.where(F.coalesce("handle", F.lit("")) != "").select(
        "source", F.lower("handle").alias("_key"), F.lit(None).cast("double").alias("_at"),
        "request_id", "handle", "ts", "status",
    )
    held = state.select(
        "source", F.col("handle").alias("_key"), F.col("at").alias("_at"),
        F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("handle"),
        F.lit(None).cast("timestamp").alias("ts"), "status",
    )
    # The stored result has no request and comes first.
    both = held.unionByName(keyed).withColumn("_now", F.lit(requests.agg(F.max("ts")).scalar()))
    ordered = both.repartition("source", "_key").sortWithinPartitions(
        "source", "_key", F.col("ts").asc_nulls_first(), F.col("request_id").asc_nulls_first()
    )

    def run(batches):
        import numpy as np
        import pandas as pd

        columns = ["kind", "request_id", "source", "handle", "ts", "status", "cached", "at"]
        key, at, result, now = None, None, None, None

        def left():
            """The state of the key that ends, if a request can still meet it."""
            over = at is None or (now is not None and at + ttl + slack < now)
            return [] if over else [(*key, result, at)]

        def states(rows):
            made = pd.DataFrame(rows, columns=["source", "handle", "status", "at"])
            return made.assign(kind="state", request_id=None, ts=pd.NaT, cached=None)[columns]

        def known(text):
            return None if text is None or text != text else text

        for batch in batches:
            if not len(batch):
                continue
            latest = batch["_now"].iloc[0]
            now = None if pd.isna(latest) else latest.timestamp()
            source, name = batch["source"].to_numpy(dtype=object), batch["_key"].to_numpy(dtype=object)
            same = np.array([
                known(source[i]) == known(source[i - 1]) and name[i] == name[i - 1] for i in range(1, len(batch))
            ], dtype=bool)
            starts = np.r_[0, np.flatnonzero(~same) + 1, len(batch)]
            seconds = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            status = batch["status"].to_numpy(dtype=object).copy()
            storable = batch["status"].isin(kept).to_numpy()
            stored_at = batch["_at"].to_numpy(dtype="float64")
            hits, ended = np.zeros(len(batch), dtype=bool), []
            is_state = ~np.isnan(stored_at)
            for first, stop in zip(starts, starts[1:]):
                own = (known(source[first]), name[first])
                if own != key:
                    ended += left()
                    key, at, result = own, None, None
                row = first
                while row < stop and is_state[row]:
                    at, result = float(stored_at[row]), status[row]
                    row += 1
                # One step per stored result, not per request.
                while row < stop:
                    if at is not None:
                        fresh = row + int(np.searchsorted(seconds[row:stop], at + ttl, side="right"))
                        hits[row:fresh], status[row:fresh] = True, result
                        row = fresh
                    ahead = np.flatnonzero(storable[row:stop])
                    if not len(ahead):
                        break
                    row += int(ahead[0])
                    at, result = float(seconds[row]), status[row]
                    row += 1
            asked = ~is_state
            rows = pd.DataFrame({
                "kind": "row", "request_id": batch["request_id"].to_numpy()[asked], "source": source[asked],
                "handle": batch["handle"].to_numpy()[asked], "ts": batch["ts"].to_numpy()[asked],
                "status": status[asked], "cached": hits[asked], "at": np.nan,
            })
            yield rows
            if ended:
                yield states(ended)
        if key is not None and (last := left()):
            yield states(last)

    return ordered.mapInPandas(run, f"kind string, {ROWS}, at double")


@dataclass(frozen=True)
class LookupRun:
    """Requests with their status, and the results still held at the end."""

    rows: DataFrame
    state: DataFrame


def drain_lookup_cache(
    requests: DataFrame, ttl_seconds: float = 3600.0, lateness_seconds: float = 0.0, root: str | None = None
) -> LookupRun:
    """Run a stream of requests (request_id, source, handle, ts, status) over all input present.

    Each micro-batch writes its rows and its state in one go under its number, so that one that is
    run again after a failure replaces what it wrote. With the ``root`` of an earlier run, a stream
    goes on from where that one ended.
    """
    spark = requests.sparkSession
    root = root or fresh_path(spark, "lookups")
    layout = f"kind string, {ROWS}, at double"

    def step(batch: DataFrame, number: int) -> None:
        if number:
            before = spark.read.schema(layout).parquet(f"{root}/batch-{number - 1}")
            state = before.where("kind = 'state'").select("source", "handle", "at", "status")
        else:
            state = spark.createDataFrame([], STATE)
        done = lookup_cache_batch(batch, state, ttl_seconds, lateness_seconds)
        done.write.mode("overwrite").parquet(f"{root}/batch-{number}")

    query = (
        requests.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else None
    empty = spark.createDataFrame([], layout)
    every = spark.read.schema(layout).parquet(f"{root}/batch-*") if last is not None else empty
    final = spark.read.schema(layout).parquet(f"{root}/batch-{last}") if last is not None else empty
    return LookupRun(
        every.where("kind = 'row'").drop("kind", "at"),
        final.where("kind = 'state'").select("source", "handle", "at", "status"),
    )
