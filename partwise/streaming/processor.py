"""The machine on Spark's state: one transformWithState operator keyed by (topic, partition)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from ..config import ConsumerSettings
from ..schema import OUTPUT
from .machine import Machine, Store

NAMES = ["topic", "offset", "source_entity", "sequence_number", "payload", "at"]
COLUMNS = [c.strip().split(" ")[0] for c in OUTPUT.split(",")]


class Kept:
    """A MapState as a dict with a cache that is written back once a batch."""

    def __init__(self, state, key: Callable, load: Callable, dump: Callable):
        self.state, self.key, self.load, self.dump, self.cache, self.dirty = state, key, load, dump, {}, {}
        self.empty = not state.exists()  # then no lookup leaves the worker

    def get(self, k, default=None):
        if k not in self.cache:
            found = None if self.empty else self.state.getValue(self.key(k))
            self.cache[k] = None if found is None else self.load(found)
        return default if self.cache[k] is None else self.cache[k]

    def __contains__(self, k):
        return self.get(k) is not None

    def __getitem__(self, k):
        v = self.get(k)
        if v is None:
            raise KeyError(k)
        return v

    def __setitem__(self, k, v):
        self.cache[k] = v
        self.dirty[k] = None

    def pop(self, k):
        v = self[k]
        self.cache[k] = None
        self.dirty[k] = None
        return v

    def items(self):
        """All entries, those not yet written back too."""
        stored = [(k[0] if len(k) == 1 else tuple(k), self.load(v)) for k, v in self.state.iterator()] if not self.empty else []
        yield from ((k, v) for k, v in stored if k not in self.cache)
        yield from ((k, v) for k, v in self.cache.items() if v is not None)

    def save(self) -> None:
        for k in self.dirty:
            if self.cache[k] is None:
                self.state.removeKey(self.key(k))
            else:
                self.state.updateValue(self.key(k), self.dump(self.cache[k]))


class PartitionProcessor(StatefulProcessor):
    """handler(event: dict) returns a result name, or (result, latency in ms), or raises.

    streaming: state is kept, and timers fire by processing time: an idle partition's clock moves on as the wall clock does,
    from its last row on. No watermark is needed, so a partition that lags behind others loses nothing. Else the rows of a
    partition must come in order of offsets, state lives in dicts for the one pass, and everything is flushed at its end.
    """

    def __init__(self, handler: Callable[[dict], Any], settings: ConsumerSettings = ConsumerSettings(), flush: bool = False, streaming: bool = True):
        self.handler, self.settings, self.flush, self.streaming = handler, settings, flush, streaming

    def init(self, handle) -> None:
        self.handle = handle
        if not self.streaming:
            return
        self.core = handle.getValueState("core", "json string")
        self.entities = handle.getMapState("entities", "entity string", "expected long, last long, waiting array<long>")
        self.heads = handle.getMapState("heads", "entity string", "at long")
        self.buffer = handle.getMapState("buffer", "entity string, seq long", "json string")
        # Spark's own expiry goes by processing time; the machine evicts by the partition's clock.
        self.seen = handle.getMapState("seen", "key string", "at long")
        self.window = handle.getMapState("window", "begin long", "good int, bad int, latencies array<double>")
        self.held = handle.getListState("held", "json string")

    def _open(self, key) -> Machine:
        self.topic = key[0]
        if not self.streaming:
            return Machine(Store(), self.handler, self.settings, key[1])
        one = lambda k: (k,)
        self.kept = [
            Kept(self.entities, one, lambda v: [v[0], v[1], list(v[2])], lambda v: (v[0], v[1], v[2])),
            Kept(self.heads, one, lambda v: v[0], one),
            Kept(self.buffer, lambda k: k, lambda v: json.loads(v[0]), lambda v: (json.dumps(v),)),
            Kept(self.seen, one, lambda v: v[0], one),
            Kept(self.window, one, lambda v: [v[0], v[1], list(v[2])], lambda v: (v[0], v[1], v[2])),
        ]
        core = json.loads(self.core.get()[0]) if self.core.exists() else {}
        held = [json.loads(v[0]) for v in self.held.get()] if self.held.exists() else []
        self.held_before = len(held)
        return Machine(Store(core, *self.kept, held), self.handler, self.settings, key[1])

    def _save(self, machine: Machine, now: int) -> None:
        """Writes back what has changed, and sets the timer for what is due next; now: processing time."""
        for k in self.kept:
            k.save()
        held = machine.s.held
        if machine.drained:
            self.held.clear()
            self.held_before = 0
        if len(held) > self.held_before:
            self.held.appendList([(json.dumps(e),) for e in held[self.held_before :]])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = machine.due()
        if due is not None:
            machine.s.core["due"] = due
            self.handle.registerTimer(now + max(due - machine.s.core["clock"], 1))
        self.core.update((json.dumps(machine.s.core),))

    def _rows(self, machine: Machine) -> Iterator[pd.DataFrame]:
        if machine.rows:
            out = pd.DataFrame(machine.rows, columns=COLUMNS)
            machine.rows = []
            out["topic"] = self.topic
            out["emitted_at"] = pd.to_datetime(out["emitted_at"], unit="ms")
            for c in ("offset", "sequence_number"):
                out[c] = out[c].astype("Int64")
            for c in ("partition", "retry_count"):
                out[c] = out[c].astype("Int32")
            yield out.astype({c: object for c in out.columns if out[c].dtype == "float64"}).where(lambda d: d.notna(), None)

    def _feed(self, machine: Machine, got: pd.DataFrame) -> None:
        got = got.assign(at=got["timestamp"].astype("datetime64[ms]").astype("int64"))
        data = got[got["command"].isna()]
        columns = [data[n].astype("int64").tolist() if n in ("offset", "sequence_number", "at") else data[n].tolist() for n in NAMES]
        for values in zip(*columns, strict=True):
            machine.event(dict(zip(NAMES, values, strict=True)))
        for name, payload in got.loc[got["command"].notna(), ["command", "payload"]].itertuples(index=False):
            machine.command(name, payload)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self._open(key)
        if self.streaming:
            # The order of rows within a group is no contract; offsets are. A micro-batch has a bounded number of rows.
            self._feed(machine, pd.concat(list(rows), ignore_index=True).sort_values(["offset", "timestamp"], kind="stable"))
            self._save(machine, timerValues.getCurrentProcessingTimeInMs())
            yield from self._rows(machine)
            return
        last = -1
        for chunk in rows:
            if not chunk["offset"].is_monotonic_increasing or int(chunk["offset"].iloc[0]) < last:
                raise RuntimeError(f"the rows of partition {key[1]} do not come in order of offsets")
            last = int(chunk["offset"].iloc[-1])
            self._feed(machine, chunk)
            yield from self._rows(machine)
        if self.flush and machine.s.core:
            machine.flush(machine.s.core["clock"])
        yield from self._rows(machine)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._open(key)
        if machine.s.core:
            machine.advance(machine.s.core.get("due", machine.s.core["clock"]))
        self._save(machine, timerValues.getCurrentProcessingTimeInMs())
        yield from self._rows(machine)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A partition's state from a snapshot (column state): its buffers, keys and breaker go on where they were."""
        machine = self._open(key)
        machine.restore(initialState["state"].iloc[0])
        self._save(machine, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass
