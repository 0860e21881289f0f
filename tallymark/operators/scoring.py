"""Calling a user-supplied scorer on every record, as a batch-wise Python stage.

Functions sent to the workers are defined inside the public ones and import what they need, so
that workers do not need this package on their path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.pandas.functions import pandas_udf

SCORE_COLUMNS = "score double, latency_ms double, error string"


def batch_score(
    df: DataFrame,
    scorer: Callable[[dict[str, Any]], float],
    inputs: Sequence[str],
    id_col: str = "id",
    retries: int = 3,
    backoff_s: float = 0.2,
    concurrency: int = 1,
    timeout_s: float | None = None,
) -> DataFrame:
    """(id, score, latency_ms, error): the scorer's result on each record of a batch.

    A failing call is retried after ``backoff_s`` times the attempt; a call that still fails, or
    exceeds ``timeout_s`` with its retries, becomes an error row and disturbs no other. With a
    timeout, calls run in ``concurrency`` child processes of the task, which are ended at the
    deadline, as they are if they die on their own; without one they run in as many threads. At
    most that many records are out at a time. The processes are children of one that starts before
    the task reads its first batch, so none holds a copy of its rows, and they serve all its batches.
    """
    fields, key = list(inputs), id_col

    def call(record):
        import time

        for attempt in range(1, retries + 1):
            started = time.perf_counter()
            try:
                score = float(scorer(record))
                return score, (time.perf_counter() - started) * 1000.0, None
            except Exception as error:  # noqa: BLE001 - isolation is the contract
                failure = f"{type(error).__name__}: {error}"
                if attempt < retries:
                    time.sleep(backoff_s * attempt)
        return None, (time.perf_counter() - started) * 1000.0, failure

    def in_threads(records):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            return list(pool.map(call, records))

    def children():
        """(results in order of records, end) by processes of one process that starts now."""
        import multiprocessing as mp
        import time
        from multiprocessing.connection import wait

        # Forked, so that the scorer need not be pickled.
        context = mp.get_context("fork")

        def manage(calls, other_side):
            """Answers (place, record) with (place, result); ``busy`` holds (process, pipe, place, deadline)."""
            other_side.close()
            idle, busy = [], []

            def serve(pipe, others):
                # A pipe's other copies are closed, so that it ends with the manager's side of it.
                for other in others:
                    other.close()
                try:
                    while (record := pipe.recv()) is not None:
                        pipe.send(call(record))
                except EOFError:
                    pass

            def started():
                mine, theirs = context.Pipe()
                others = [calls, mine, *(c[1] for c in busy), *(i[1] for i in idle)]
                process = context.Process(target=serve, args=(theirs, others), daemon=True)
                process.start()
                theirs.close()
                return process, mine

            def ended(process, pipe):
                pipe.close()
                process.kill()
                process.join()

            try:
                while True:
                    left = max(0.0, min(b[3] for b in busy) - time.monotonic()) if busy else None
                    ready = wait([calls, *(b[1] for b in busy)], left)
                    if calls in ready:
                        place, record = calls.recv()
                        process, pipe = idle.pop() if idle else started()
                        busy.append((process, pipe, place, time.monotonic() + timeout_s))
                        pipe.send(record)
                    now, still = time.monotonic(), []
                    for process, pipe, place, deadline in busy:
                        if pipe in ready:
                            try:
                                result = pipe.recv()
                                idle.append((process, pipe))
                            except (EOFError, OSError):
                                process.join(1.0)
                                result = (None, 0.0, f"process ended with {process.exitcode}")
                                ended(process, pipe)
                            calls.send((place, result))
                        elif now >= deadline:
                            ended(process, pipe)
                            calls.send((place, (None, timeout_s * 1000.0, f"timeout after {timeout_s}s")))
                        else:
                            still.append((process, pipe, place, deadline))
                    busy = still
            except (EOFError, ConnectionError):
                pass  # the task has ended
            finally:
                for process, pipe, *_ in [*busy, *idle]:
                    ended(process, pipe)

        asked, theirs = context.Pipe()
        manager = context.Process(target=manage, args=(theirs, asked))
        manager.start()
        theirs.close()

        def results_of(records, n):
            results, out = [None] * n, 0
            for at, record in enumerate(records):
                if out == max(1, concurrency):
                    place, results[place] = asked.recv()
                    out -= 1
                asked.send((at, record))
                out += 1
            for _ in range(out):
                place, results[place] = asked.recv()
            return results

        def end():
            asked.close()
            manager.join()

        return results_of, end

    def records_of(batch):
        """The records of a batch, made a few at a time."""
        for at in range(0, len(batch), 64):
            yield from batch[fields].iloc[at : at + 64].to_dict("records")

    def run(batches):
        import pandas as pd

        results_of, end = children() if timeout_s is not None else (lambda records, n: in_threads(records), lambda: None)
        try:
            for batch in batches:
                results = results_of(records_of(batch), len(batch))
                score, latency, error = zip(*results) if results else ((), (), ())
                yield pd.DataFrame(
                    {
                        key: batch[key].to_numpy(),
                        "score": pd.Series(score, dtype="float64"),
                        "latency_ms": pd.Series(latency, dtype="float64"),
                        "error": pd.Series(error, dtype="object"),
                    }
                )
        finally:
            end()

    id_type = df.schema[id_col].dataType.simpleString()
    columns = list(dict.fromkeys([id_col, *fields]))
    return df.select(*columns).mapInPandas(run, f"`{id_col}` {id_type}, {SCORE_COLUMNS}")


class UnknownScorerError(KeyError):
    """No scorer is registered under the name."""


class ScorerRegistry:
    """Scorers by name, with other accepted spellings and an optional fallback factory."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[], Callable]] = {}

    def register(self, *names: str, factory: Callable[[], Callable]) -> None:
        for name in names:
            self._factories[name.strip().lower()] = factory

    def create(self, name: str, fallback: Callable[[str], Callable] | None = None) -> Callable:
        """The named scorer. With ``fallback``, any failure gives ``fallback(reason)`` instead."""
        wanted = name.strip().lower()
        try:
            if wanted not in self._factories:
                known = ", ".join(sorted(self._factories))
                raise UnknownScorerError(f"unknown scorer {wanted!r}; known: {known}")
            return self._factories[wanted]()
        except Exception as error:
            if fallback is None:
                raise
            return fallback(f"{wanted}_unavailable: {type(error).__name__}: {error}")
