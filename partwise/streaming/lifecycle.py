"""Starting, watching and stopping streaming queries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql.streaming import StreamingQueryListener

STRIKES = 3


class StoreHealth:
    """STRIKES failed checks in a row make a store unavailable; one that passes makes it available again."""

    def __init__(self, strikes: int = STRIKES):
        self.strikes, self.failures, self.available = strikes, 0, True

    def check(self, probe) -> bool:
        try:
            ok = bool(probe())
        except Exception:  # noqa: BLE001 - a probe that raises has failed
            ok = False
        self.failures = 0 if ok else self.failures + 1
        self.available = self.failures < self.strikes
        return self.available


class Watch(StreamingQueryListener):
    """The last progress of each query: rows in, rows of state, and the watermark; and how it ended."""

    def __init__(self):
        self.last: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.last[str(p.id)] = {
            "batch": p.batchId,
            "rows_in": p.numInputRows,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "watermark": dict(p.eventTime or {}).get("watermark"),
        }

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def stop(queries, timeout_s: float = 30.0, drain: Callable[[], None] | None = None) -> bool:
    """Lets the running micro-batches end, then stops; True if all ended in time. What had not ended is run again from the
    checkpoint, which holds offsets, buffers and breakers together.

    drain: what tells the pipeline to flush (pipeline.command(..., "FLUSH", partitions)). Then everything that is there is
    processed first, commands too: buffered events go through deduplication and handler, and the checkpoint has none left."""
    end = time.monotonic() + timeout_s
    in_time = True
    if drain:
        drain()
        begun = datetime.now(timezone.utc).isoformat()
        idle = lambda q: any(p.timestamp > begun and not p.numInputRows for p in q.recentProgress)
        # A query with timers has a batch at every trigger: one begun since then that found nothing new says that all is done.
        for q in queries:
            timed = any(p.stateOperators for p in q.recentProgress)
            wait = threading.Thread(target=q.processAllAvailable, daemon=True)
            if not timed:
                wait.start()
            while q.isActive and (not idle(q) if timed else wait.is_alive()) and time.monotonic() < end:
                time.sleep(0.1)
            in_time &= idle(q) if timed else not wait.is_alive()
    for q in queries:
        while not drain and q.isActive and q.status["isTriggerActive"]:
            if time.monotonic() >= end:
                in_time = False
                break
            time.sleep(0.05)
        q.stop()  # a drained query is at most in a batch without rows
    return in_time


class Supervisor:
    """Pauses a pipeline whose store is not available: tick(), called every interval, checks the store; after STRIKES failures in
    a row all queries are stopped. What they had read is in the checkpoint; resume() goes on from there. A check that passes
    does not resume by itself unless again is set."""

    def __init__(self, start: Callable[[], list], probe: Callable[[], bool], strikes: int = STRIKES, again: bool = False):
        self.start, self.probe, self.again, self.health, self.queries = start, probe, again, StoreHealth(strikes), start()

    @property
    def paused(self) -> bool:
        return not self.queries

    def tick(self) -> bool:
        """Whether the store is available."""
        ok = self.health.check(self.probe)
        if not ok and self.queries:
            stop(self.queries)
            self.queries = []
        elif ok and self.paused and self.again:
            self.resume()
        return ok

    def resume(self) -> None:
        if self.paused:
            self.queries = self.start()

    def watch(self, interval_s: float) -> threading.Event:
        """Ticks in a thread until the event it returns is set."""
        over = threading.Event()

        def loop():
            while not over.wait(interval_s):
                self.tick()

        threading.Thread(target=loop, daemon=True).start()
        return over
