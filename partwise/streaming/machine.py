"""What happens to one partition's events, a row at a time: gate, reorder, deduplicate, handle, observe, break.

The machine works on a Store of dict-likes, so it runs alike on Spark's state variables and on plain dicts. All times are
milliseconds of the partition's own clock, which follows its rows' times and never goes back. Every event gets one final row:
PROCESSED, DUPLICATE, LATE_DROPPED, REPLACED or DLQ; SIGNAL, TRANSITION, GAP, HELD, BACKPRESSURE and SNAPSHOT rows tell the
rest. A latency that the handler does not tell is measured, so only handlers that tell theirs make equal replays.
"""

from __future__ import annotations

import heapq
import json
import math
import time
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..config import ConsumerSettings


class TransientProcessingException(Exception):
    """May pass if tried again."""


class PermanentProcessingException(Exception):
    """Will not pass."""


class ValidationException(Exception):
    """The event is not valid."""


class DeserializationException(Exception):
    """The record cannot be read."""


class HeldRowsExceeded(RuntimeError):
    """A partition has been open for longer than its backlog has room."""


# The classification of each error; any other is PERMANENT.
CLASSIFICATION = {
    "TransientProcessingException": "TRANSIENT",
    "PermanentProcessingException": "PERMANENT",
    "ValidationException": "VALIDATION",
    "DeserializationException": "DESERIALIZATION",
}


@dataclass
class Store:
    """core: breaker, counts and flags; entities: [expected, last, buffered numbers]; heads: when the first buffered event
    of an entity came; buffer: events by entity and number; seen: handled keys with their time; window: [good, bad,
    latencies] by the start of a bucket; held: rows that wait for an open breaker."""

    core: dict[str, Any] = field(default_factory=dict)
    entities: Any = field(default_factory=dict)
    heads: Any = field(default_factory=dict)
    buffer: Any = field(default_factory=dict)
    seen: Any = field(default_factory=dict)
    window: Any = field(default_factory=dict)
    held: list[dict] = field(default_factory=list)


def fresh_core(now: int) -> dict[str, Any]:
    return {
        "state": "CLOSED",
        "entered": now,
        "failures": 0,
        "probe": [0, 0],
        "clock": now,
        "begun": now,
        "suppressed": {},
        "count": 0,
        "pressed": False,
        "evicted": now,
        "next_offset": 0,
    }


class Machine:
    def __init__(self, store: Store, handler: Callable[[dict], Any], settings: ConsumerSettings, partition: int, most_held: int = 1_000_000):
        self.s, self.handler, self.set, self.partition, self.most_held = store, handler, settings, partition, most_held
        self.rows: list[dict] = []
        self.drained = False  # whether held rows have left since the machine was made
        self._load()

    def _load(self) -> None:
        """What is made anew from the store: the deadlines as a heap, and the window's latencies, sorted."""
        self._deadlines = [(at, e) for e, at in self.s.heads.items()]
        heapq.heapify(self._deadlines)
        self._buckets = sorted(at for at, _ in self.s.window.items())
        kept = [self.s.window[at] for at in self._buckets]
        self._values = sorted(v for b in kept for v in b[2])
        self._good, self._bad = sum(b[0] for b in kept), sum(b[1] for b in kept)

    # ---- rows out

    def _emit(self, event: dict | None, disposition: str, now: int, **more) -> None:
        row = {"partition": self.partition, "disposition": disposition, "emitted_at": now, **more}
        if event:
            for k in ("topic", "offset", "source_entity", "sequence_number", "payload"):
                row[k] = event.get(k)
        self.rows.append(row)

    # ---- the clock: what is due

    def advance(self, now: int) -> None:
        core = self.s.core
        core["clock"] = now = max(now, core["clock"])
        if now - core["evicted"] >= self.set.dedup.eviction_interval_ms:
            self._evict(now)
        if core["state"] == "OPEN" and now > core["entered"] + self.set.breaker.cooldown_ms:
            self._turn("HALF_OPEN", now)
            held, self.s.held[:], self.drained = list(self.s.held), [], True
            for event in held:
                self._gated(event, now)
        if core["state"] == "HALF_OPEN" and now >= core["entered"] + self.set.breaker.probe_timeout_ms:
            self._probe(now, timed_out=True)
        late, due = now - self.set.reorder.timeout_ms, []
        while self._deadlines and self._deadlines[0][0] < late:
            due.append(heapq.heappop(self._deadlines))
        for at, entity in due:  # in order of time; the next head of an entity waits for the next call
            if self.s.heads.get(entity) != at:
                continue  # it has left since
            expected, last, waiting = self.s.entities[entity]
            if waiting[0] > expected:
                self._emit({"source_entity": entity}, "GAP", now, detail=f"{expected}-{waiting[0] - 1}")
            self.s.entities[entity] = [waiting[0], waiting[0] - 1, waiting]
            self._release(entity, now, "TIMEOUT")

    def _evict(self, now: int) -> None:
        """Forgets keys handled before the retention period; a key exactly as old stays."""
        cutoff = now - self.set.dedup.retention_ms
        for key in [k for k, at in self.s.seen.items() if at < cutoff]:
            self.s.seen.pop(key)
        self.s.core["evicted"] = now

    def due(self) -> int | None:
        """The next moment at which advance() has work."""
        core, at = self.s.core, []
        while self._deadlines and self.s.heads.get(self._deadlines[0][1]) != self._deadlines[0][0]:
            heapq.heappop(self._deadlines)
        if self._deadlines:
            at.append(self._deadlines[0][0] + self.set.reorder.timeout_ms + 1)
        if core.get("state") == "OPEN":
            at.append(core["entered"] + self.set.breaker.cooldown_ms + 1)
        if core.get("state") == "HALF_OPEN":
            at.append(core["entered"] + self.set.breaker.probe_timeout_ms)
        return min(at, default=None)

    # ---- one event

    def event(self, event: dict) -> None:
        if not self.s.core:
            self.s.core.update(fresh_core(event["at"]))
        self.advance(event["at"])
        self.s.core["next_offset"] = max(self.s.core["next_offset"], event["offset"] + 1)
        self._gated(event, self.s.core["clock"])

    def _gated(self, event: dict, now: int) -> None:
        if self.s.core["state"] == "OPEN":
            if len(self.s.held) >= self.most_held:
                raise HeldRowsExceeded(f"partition {self.partition} holds {len(self.s.held)} rows")
            self.s.held.append(event)
            self._emit(event, "HELD", now, stage="CIRCUIT_BREAKER_CHECK")
            return
        self._submit(event, now)

    def _submit(self, event: dict, now: int) -> None:
        entity, seq = event["source_entity"], event["sequence_number"]
        known = self.s.entities.get(entity)
        if known is None:
            self.s.entities[entity] = [seq + 1, seq, []]
            self._handle(event, now, "FIRST")
            return
        expected, last, waiting = known
        if seq <= last:
            duplicate = self._key(event) in self.s.seen
            self._emit(event, "DUPLICATE" if duplicate else "LATE_DROPPED", now, stage="DEDUPLICATION" if duplicate else "REORDER", idempotency_key=self._key(event))
        elif seq == expected:
            self.s.entities[entity] = [seq + 1, seq, waiting]
            self._handle(event, now, "IN_ORDER")
            if waiting:
                self._release(entity, now, "CONSECUTIVE")
        else:
            place = bisect_left(waiting, seq)
            if place < len(waiting) and waiting[place] == seq:  # the newer one takes its place, and waits since then
                self._emit(self.s.buffer[(entity, seq)], "REPLACED", now, stage="REORDER")
            else:
                waiting.insert(place, seq)
                self.s.core["count"] += 1
            self.s.buffer[(entity, seq)] = event | {"buffered_at": now}
            self.s.entities[entity] = known
            if place == 0:
                self._head(entity, now)
            self._pressure(now)

    def _head(self, entity: str, at: int | None) -> None:
        """The first event that waits came at that time; None: none waits."""
        if at is not None:
            self.s.heads[entity] = at
            heapq.heappush(self._deadlines, (at, entity))
        elif entity in self.s.heads:
            self.s.heads.pop(entity)

    def _release(self, entity: str, now: int, reason: str) -> None:
        """Releases the run of buffered events that is next; the first for reason, the others as consecutive."""
        expected, last, waiting = self.s.entities[entity]
        n = 0
        while n < len(waiting) and waiting[n] == expected + n:
            n += 1
        run = [self.s.buffer.pop((entity, expected + k)) for k in range(n)]
        if n:
            expected, last, waiting = expected + n, expected + n - 1, waiting[n:]
            self.s.core["count"] -= n
            self._head(entity, self.s.buffer[(entity, waiting[0])]["buffered_at"] if waiting else None)
        self.s.entities[entity] = [expected, last, waiting]
        self._pressure(now)
        for k, event in enumerate(run):
            self._handle(event, now, reason if k == 0 else "CONSECUTIVE")

    def flush(self, now: int) -> None:
        """The end of the input: what is held, as its cooldowns pass, and then everything buffered, by entity and number."""
        core = self.s.core
        if not core:
            return
        now = max(now, core["clock"])
        while self.s.held:  # each cooldown lets some through
            now = max(now, core["entered"] + self.set.breaker.cooldown_ms + 1)
            self.advance(now)
        for entity in sorted(e for e, _ in self.s.heads.items()):
            expected, last, waiting = self.s.entities[entity]
            run = [self.s.buffer.pop((entity, seq)) for seq in waiting]
            self.s.entities[entity] = [waiting[-1] + 1, waiting[-1], []]
            core["count"] -= len(run)
            self._head(entity, None)
            self._pressure(now)
            for event in run:
                self._handle(event, now, "FLUSH")

    def _pressure(self, now: int) -> None:
        core, r = self.s.core, self.set.reorder
        if not core["pressed"] and core["count"] >= r.max_buffer_size:
            core["pressed"] = True
            self._emit(None, "BACKPRESSURE", now, detail="on")
        elif core["pressed"] and core["count"] < r.resume_below:
            core["pressed"] = False
            self._emit(None, "BACKPRESSURE", now, detail="off")

    # ---- commands

    def command(self, name: str, payload: str | None = None) -> None:
        """FLUSH: drains what is held and buffered. CLEAR: forgets buffers, breaker and health, not the handled keys. RESET:
        closes the breaker, health starts anew. UNSUPPRESS: signals may rise again. SNAPSHOT: a row with the whole state as
        JSON. RESTORE: takes such a state for its own."""
        now = self.s.core.get("clock", 0)
        if name == "FLUSH":
            self.flush(now)
        elif name == "CLEAR":
            self.clear()
        elif name == "RESET" and self.s.core:
            if self.s.core["state"] != "CLOSED":
                self._turn("CLOSED", now)
            else:
                self._begin(now)
            held, self.s.held[:], self.drained = list(self.s.held), [], True
            for event in held:
                self._gated(event, now)
        elif name == "UNSUPPRESS" and self.s.core:
            self.s.core["suppressed"] = {}
        elif name == "SNAPSHOT":
            self._emit(None, "SNAPSHOT", now, detail=self.snapshot())
        elif name == "RESTORE":
            self.restore(payload or "{}")

    def clear(self) -> None:
        for part in (self.s.entities, self.s.heads, self.s.buffer, self.s.window):
            for k in [k for k, _ in part.items()]:
                part.pop(k)
        self.s.core.clear()
        self.s.held[:], self.drained = [], True
        self._load()

    def snapshot(self) -> str:
        parts = {name: [[k, v] for k, v in getattr(self.s, name).items()] for name in ("entities", "heads", "buffer", "seen", "window")}
        return json.dumps(parts | {"core": self.s.core, "held": self.s.held})

    def restore(self, snapshot: str) -> None:
        found = json.loads(snapshot)
        self.clear()
        for name in ("entities", "heads", "buffer", "seen", "window"):
            part = getattr(self.s, name)
            for k, v in found.get(name, []):
                part[tuple(k) if isinstance(k, list) else k] = v
        for entity, (expected, _, waiting) in self.s.entities.items():
            self.s.entities[entity] = [expected, expected - 1, list(waiting)]
        self.s.core.update(found.get("core", {}))
        if self.s.core:  # a breaker goes on as it was, its probe and the backpressure anew
            self.s.core |= {"probe": [0, 0], "pressed": False}
        self.s.held[:] = found.get("held", [])
        self._load()

    # ---- dedup and handler

    def _key(self, event: dict) -> str:
        return f"{event['source_entity']}:{event['sequence_number']}:{self.partition}"

    def _handle(self, event: dict, now: int, reason: str) -> None:
        key = self._key(event)
        handled = self.s.seen.get(key)
        if handled is not None and handled >= now - self.set.dedup.retention_ms:
            self._emit(event, "DUPLICATE", now, stage="DEDUPLICATION", release_reason=reason, idempotency_key=key)
            return
        d, wait, attempt = self.set.dead_letters, self.set.dead_letters.initial_backoff_ms, 0
        while True:
            begun, error = time.perf_counter(), None
            try:
                result = self.handler(event)
            except Exception as e:  # noqa: BLE001 - a handler's error is data
                result, error = None, e
            latency = (time.perf_counter() - begun) * 1000
            if isinstance(result, tuple):  # a handler may tell its own latency
                result, latency = result
            if error is None and result == "SUCCESS":
                self.s.seen[key] = now
                self._emit(event, "PROCESSED", now, stage="BUSINESS_LOGIC", release_reason=reason, retry_count=attempt, idempotency_key=key)
                self._observe(True, latency, now)
                return
            if error is None:
                error = PermanentProcessingException(f"the handler returned {result}")
            latency = getattr(error, "latency_ms", latency)
            kind = CLASSIFICATION.get(type(error).__name__, "PERMANENT")
            if kind == "TRANSIENT" and attempt < d.max_retry_count and min(wait, d.max_backoff_ms) <= d.max_sleep_ms:
                time.sleep(min(wait, d.max_backoff_ms) / 1000)
                attempt, wait = attempt + 1, min(wait * 2, d.max_backoff_ms)
                continue
            tries = attempt + 1 if kind == "TRANSIENT" else 0
            self._emit(event, "DLQ", now, stage="BUSINESS_LOGIC", release_reason=reason, classification=kind, retry_count=tries, idempotency_key=key, error_class=type(error).__name__, error_message=str(error)[:1000])
            self._observe(False, latency, now)
            return

    # ---- health and breaker

    def _observe(self, ok: bool, latency: float, now: int) -> None:
        core, window = self.s.core, self.s.window
        if not self._buckets or now - self._buckets[-1] >= 1000:
            self._buckets.append(now)
            window[now] = [0, 0, []]
        bucket = window[self._buckets[-1]]
        bucket[0 if ok else 1] += 1
        bucket[2].append(latency)
        window[self._buckets[-1]] = bucket
        insort(self._values, latency)
        self._good, self._bad = self._good + ok, self._bad + (not ok)
        while self._buckets[0] < now - self.set.health.window_ms:
            good, bad, old = window.pop(self._buckets.pop(0))
            self._good, self._bad = self._good - good, self._bad - bad
            for v in old:
                del self._values[bisect_left(self._values, v)]
        if core["state"] == "HALF_OPEN":
            core["probe"] = [core["probe"][0] + 1, core["probe"][1] + ok]
            if core["probe"][0] >= self.set.breaker.probe_batch_size:
                self._probe(now)
                return
        values, total = self._values, self._good + self._bad
        p99 = values[max(math.ceil(0.99 * len(values)) - 1, 0)] if values else 0.0
        rate = self._bad / total if total else 0.0
        b = self.set.breaker
        for kind, value, most in (("ERROR_RATE", rate, b.error_rate_threshold), ("LATENCY", p99, b.latency_threshold_ms)):
            if value < most:
                core["suppressed"].pop(kind, None)
            elif not core["suppressed"].get(kind):
                core["suppressed"][kind] = True
                self._emit(None, "SIGNAL", now, detail=f"{kind}:{value:.6f}:{most:g}")
                if core["state"] == "CLOSED":
                    self._turn("OPEN", now)

    def _begin(self, now: int) -> None:
        """Health starts anew."""
        for at in self._buckets:
            self.s.window.pop(at)
        self.s.core["begun"], self.s.core["suppressed"] = now, {}
        self._buckets, self._values, self._good, self._bad = [], [], 0, 0

    def _turn(self, state: str, now: int) -> None:
        core = self.s.core
        self._emit(None, "TRANSITION", now, detail=f"{core['state']}>{state}")
        core["failures"] = 0 if state == "CLOSED" else core["failures"] + (state == "OPEN")
        core["state"], core["entered"] = state, now
        if state == "HALF_OPEN":
            core["probe"] = [0, 0]
        if state == "CLOSED":
            self._begin(now)

    def _probe(self, now: int, timed_out: bool = False) -> None:
        total, good = self.s.core["probe"]
        ok = total == 0 or (total == good and not timed_out and good > 0)
        self._turn("CLOSED" if ok else "OPEN", now)
