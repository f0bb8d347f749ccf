import random

import pytest
from simulator import Reorder

from partwise.config import BreakerSettings, ConsumerSettings, DeadLetterSettings, DedupSettings, HealthSettings, ReorderSettings
from partwise.streaming import machine as m

CALM = BreakerSettings(error_rate_threshold=1.0, latency_threshold_ms=1e9)


def event(seq, offset=0, entity="e", at=0):
    return {"topic": "t", "offset": offset, "source_entity": entity, "sequence_number": seq, "payload": f"payload-{seq}", "at": at}


def ok(_):
    return "SUCCESS", 1.0


def runner(settings=None, handler=ok, **more):
    return m.Machine(m.Store(), handler, settings or ConsumerSettings(breaker=CALM, reorder=ReorderSettings(timeout_ms=10**9)), 7, **more)


def done(machine, what="PROCESSED"):
    return [(r["source_entity"], r["sequence_number"]) for r in machine.rows if r["disposition"] == what]


def details(machine, what):
    return [r["detail"] for r in machine.rows if r["disposition"] == what]


@pytest.mark.parametrize("seed", range(12))
def test_against_simulator(seed):
    rng = random.Random(seed)
    timeout = rng.choice([20, 60, 10**6])
    machine = runner(ConsumerSettings(breaker=CALM, reorder=ReorderSettings(timeout_ms=timeout)))
    sim, order, handled, gaps = Reorder(timeout), [], set(), []
    dispositions = []
    for offset in range(400):
        now, entity, seq = offset * 3, rng.choice("abc"), max(1, offset // 4 + rng.randint(-5, 5))
        machine.event(event(seq, offset, entity, now))
        left = [(e, s) for e, s, _ in sim.timed_out(now)]
        handled.update(left)
        what, out = sim.submit(entity, seq, offset, now)
        left += [(entity, s) for s, _ in out]
        if what == "LATE":
            dispositions.append("DUPLICATE" if (entity, seq) in handled else "LATE_DROPPED")
        for x in left:
            handled.add(x)
            order.append(x)
    machine.flush(10**9)
    order += [(e, s) for e, s, _ in sim.flush()]
    for e in "abc":  # the order between entities that time out together is no contract
        assert [x for x in done(machine) if x[0] == e] == [x for x in order if x[0] == e]
    assert [r["disposition"] for r in machine.rows if r["disposition"] in ("DUPLICATE", "LATE_DROPPED")] == dispositions
    assert [(r["source_entity"], *map(int, r["detail"].split("-"))) for r in machine.rows if r["disposition"] == "GAP"] == sim.gaps or sorted(details(machine, "GAP")) == sorted(f"{a}-{b}" for _, a, b in sim.gaps)
    final = [r for r in machine.rows if r["disposition"] in ("PROCESSED", "DUPLICATE", "LATE_DROPPED", "REPLACED", "DLQ")]
    assert sorted(r["offset"] for r in final) == list(range(400))  # one final row an event
    assert machine.s.core["next_offset"] == 400 and machine.s.core["count"] == 0


def test_first_is_accepted_whatever_it_is_and_runs_follow():
    machine = runner()
    for k, seq in enumerate([10, 12, 13, 9, 11]):
        machine.event(event(seq, k))
    assert [(r["sequence_number"], r["release_reason"]) for r in machine.rows if r["disposition"] == "PROCESSED"] == [(10, "FIRST"), (11, "IN_ORDER"), (12, "CONSECUTIVE"), (13, "CONSECUTIVE")]
    assert done(machine, "LATE_DROPPED") == [("e", 9)]


def test_backpressure_turns_on_once_and_off_below_the_lower_mark():
    machine = runner(ConsumerSettings(breaker=CALM, reorder=ReorderSettings(max_buffer_size=3, resume_threshold=0.8, timeout_ms=10**9)))
    for k, seq in enumerate([1, 3, 4, 6, 7, 2]):
        machine.event(event(seq, k))
    assert details(machine, "BACKPRESSURE") == ["on"]  # two are left, not below int(3 * 0.8)
    machine.event(event(5, 9))
    assert details(machine, "BACKPRESSURE") == ["on", "off"]


def test_timeout_is_strict_and_tells_the_gap():
    machine = runner(ConsumerSettings(breaker=CALM, reorder=ReorderSettings(timeout_ms=50)))
    for seq, at in ((1, 0), (5, 0), (6, 40)):
        machine.event(event(seq, at, at=at))
    machine.advance(50)
    assert done(machine) == [("e", 1)]
    machine.advance(51)
    assert done(machine) == [("e", 1), ("e", 5), ("e", 6)]
    assert details(machine, "GAP") == ["2-4"]


def test_retries_follow_the_backoff():
    tries = []

    def shaky(e):
        tries.append(e)
        raise m.TransientProcessingException("later")

    machine = runner(ConsumerSettings(breaker=CALM, dead_letters=DeadLetterSettings(initial_backoff_ms=10, max_backoff_ms=50)), shaky)
    machine.event(event(1))
    assert len(tries) == 4 and machine.rows[0]["retry_count"] == 4 and machine.rows[0]["classification"] == "TRANSIENT"
    tries.clear()
    machine = runner(ConsumerSettings(breaker=CALM), shaky)  # a second's wait goes to the dead letters at once
    machine.event(event(1))
    assert len(tries) == 1 and machine.rows[0]["retry_count"] == 1


@pytest.mark.parametrize(
    ("outcome", "kind"),
    [(m.PermanentProcessingException("x"), "PERMANENT"), (m.ValidationException("x"), "VALIDATION"), (m.DeserializationException("x"), "DESERIALIZATION"), (KeyError("x"), "PERMANENT"), ("TRANSIENT_FAILURE", "PERMANENT")],
)
def test_classification(outcome, kind):
    def handler(_):
        if isinstance(outcome, Exception):
            raise outcome
        return outcome

    machine = runner(handler=handler)
    machine.event(event(1))
    row = machine.rows[0]
    assert (row["disposition"], row["classification"], row["retry_count"], row["payload"]) == ("DLQ", kind, 0, "payload-1")


def test_failed_keys_are_not_remembered_and_old_ones_are_forgotten():
    machine = runner(ConsumerSettings(breaker=CALM, dedup=DedupSettings(retention_ms=100, eviction_interval_ms=10)))
    machine.event(event(1, 0, at=0))
    machine.event(event(1, 1, at=100))  # just as old as the period: still known
    machine.event(event(1, 2, at=150))
    assert [r["disposition"] for r in machine.rows] == ["PROCESSED", "DUPLICATE", "LATE_DROPPED"]
    assert machine._key(event(2)) == "e:2:7" and not machine.s.seen


def breaking(threshold=0.5, **more):
    state = {"bad": True}

    def handler(_):
        if state["bad"]:
            raise m.PermanentProcessingException("no")
        return "SUCCESS", 1.0

    b = BreakerSettings(error_rate_threshold=threshold, cooldown_ms=100, probe_batch_size=3, probe_timeout_ms=1000)
    return runner(ConsumerSettings(breaker=b), handler, **more), state


def test_breaker_opens_holds_probes_and_closes():
    machine, state = breaking()
    machine.event(event(1, 0, at=0))
    assert details(machine, "TRANSITION") == ["CLOSED>OPEN"] and machine.s.core["failures"] == 1
    machine.event(event(2, 1, at=100))  # strictly after the cooldown only
    assert done(machine, "HELD") == [("e", 2)]
    state["bad"] = False
    machine.event(event(3, 2, at=101))
    assert details(machine, "TRANSITION") == ["CLOSED>OPEN", "OPEN>HALF_OPEN"] and done(machine) == [("e", 2), ("e", 3)]
    machine.event(event(4, 3, at=102))
    assert details(machine, "TRANSITION")[-1] == "HALF_OPEN>CLOSED" and machine.s.core["failures"] == 0


def test_failing_probe_opens_again_and_an_idle_one_closes():
    machine, state = breaking()
    machine.event(event(1, 0, at=0))
    for k in range(3):
        machine.event(event(2 + k, 1 + k, at=200))
    assert details(machine, "TRANSITION") == ["CLOSED>OPEN", "OPEN>HALF_OPEN", "HALF_OPEN>OPEN"] and machine.s.core["failures"] == 2
    machine.advance(301)
    machine.advance(1301)
    assert details(machine, "TRANSITION")[-2:] == ["OPEN>HALF_OPEN", "HALF_OPEN>CLOSED"]


def test_held_rows_have_a_limit():
    machine, _ = breaking(most_held=2)
    machine.event(event(1, 0, at=0))
    machine.event(event(2, 1, at=1))
    machine.event(event(3, 2, at=1))
    with pytest.raises(m.HeldRowsExceeded):
        machine.event(event(4, 3, at=1))


def test_signals_rise_once_and_p99_needs_two_slow_of_a_hundred():
    machine = runner(ConsumerSettings(breaker=BreakerSettings(latency_threshold_ms=5000), health=HealthSettings(window_ms=10**6)), lambda e: ("SUCCESS", 6000.0 if e["sequence_number"] > 99 else 10.0))
    for k in range(1, 101):
        machine.event(event(k, k, at=k))
    assert not details(machine, "SIGNAL")
    machine.event(event(101, 101, at=100))
    assert [d.split(":")[0] for d in details(machine, "SIGNAL")] == ["LATENCY"]
