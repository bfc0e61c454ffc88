"""How far a job is, told on a stream now and then."""

from __future__ import annotations

import sys
import threading
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession


def told(spark: SparkSession) -> str:
    """Done and all tasks of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i is not None]
    return ", ".join(f"stage {i.stageId}: {i.numCompletedTasks} of {i.numTasks} tasks" for i in sorted(infos, key=lambda i: i.stageId))


@contextmanager
def progress(spark: SparkSession, what: str, every: float = 5.0, out=None):
    """While the block runs, a line every few seconds; at its end the seconds that it took."""
    out, over, started = out or sys.stderr, threading.Event(), time.perf_counter()

    def tell() -> None:
        while not over.wait(every):
            print(f"{what}: {time.perf_counter() - started:.0f} s, {told(spark) or 'planning'}", file=out, flush=True)

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        yield
    finally:
        over.set()
        teller.join()
        print(f"{what}: done in {time.perf_counter() - started:.1f} s", file=out, flush=True)


def rate_line(done: int, seconds: float) -> str:
    return f"{done} documents, {done / max(seconds, 1e-9):.0f} a second"
