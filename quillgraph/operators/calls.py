"""Model calls as a plug point: bounded rate, retries, one log row a call.

The engine itself calls no model. ``called`` runs a given function over rows in the
executors; each partition has its own limiter, so a cluster's rate is the limit times the
tasks that run at once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RETRIES, BASE, JITTER, TIMEOUT = 6, 1.5, 0.6, 30.0
RETRYABLE = ("429", "500", "502", "503", "504", "rate limit", "quota", "timeout", "unavailable")


class Bucket:
    """Tokens that refill evenly, ``per_minute`` of them a minute."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.size, self.rate, self.clock, self.sleep = per_minute, per_minute / 60, clock, sleep
        self.left, self.at = per_minute, clock()

    def take(self, timeout: float = TIMEOUT) -> None:
        end = self.clock() + timeout
        while True:
            now = self.clock()
            self.left, self.at = min(self.size, self.left + (now - self.at) * self.rate), now
            if self.left >= 1:
                self.left -= 1
                return
            wait = (1 - self.left) / self.rate
            if now + wait > end:
                raise TimeoutError(f"no call within {timeout} seconds")
            self.sleep(wait)


def retryable(error: Exception) -> bool:
    return any(x in str(error).lower() for x in RETRYABLE)


def retried(call: Callable, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
    """The result of ``call()``; retryable errors wait ever longer, others and the last are raised."""
    for n in range(retries):
        try:
            return call()
        except Exception as e:
            if n == retries - 1 or not retryable(e):
                raise
            sleep(BASE * 2**n + draw() * JITTER)


def called(rows: DataFrame, client: Callable[[dict], dict], result: str, per_minute: float, task: str, model: str) -> DataFrame:
    """``rows`` with the fields of ``client(row)`` (DDL ``result``) and task, model, latency_ms, error behind them."""
    names = [f.split()[0].strip("`") for f in result.split(",")]
    kept = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {result}, task string, model string, latency_ms int, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(per_minute)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                bucket.take()
                began, error, got = time.monotonic(), None, {}
                try:
                    got = retried(lambda: client(row))
                except Exception as e:  # a failed call is a result: it is logged with its row
                    error = str(e)[:200]
                out.append([row[c] for c in kept] + [got.get(n) for n in names] + [task, model, int((time.monotonic() - began) * 1000), error])
            yield pd.DataFrame(out, columns=[*kept, *names, "task", "model", "latency_ms", "error"])

    return rows.mapInPandas(run, schema)
