import pytest

from partwise.config import DeadLetterSettings
from partwise.streaming.lifecycle import StoreHealth, Supervisor, Watch, stop
from partwise.streaming.sinks import BufferFull, DeadLetterSink


class Sender:
    def __init__(self):
        self.down, self.sent = False, []

    def __call__(self, letters, tag):
        if self.down:
            raise OSError("no broker")
        self.sent += [r["key"] for r in letters.collect()]


def letters(spark, n, start=0):
    return spark.createDataFrame([(f"k{i}", "t") for i in range(start, start + n)], "key string, topic string")


def test_letters_are_staged_retried_and_never_lost(spark, tmp_path):
    send, alerts = Sender(), []
    sink = DeadLetterSink(spark, send, str(tmp_path / "staged"), DeadLetterSettings(max_buffer_size=5, initial_backoff_ms=10, max_route_attempts=2), alerts.append)
    assert sink.route(letters(spark, 1), 0) == "ROUTED" and send.sent == ["k0"]
    send.down = True
    assert sink.route(letters(spark, 3, 1), 0) == "BUFFERED" and sink.depth() == 3
    with pytest.raises(BufferFull):
        sink.route(letters(spark, 3, 4), 0)
    assert len(alerts) == 1 and sink.depth() == 3
    assert sink.retry(19) == 0 and sink.staged().first()["attempts"] == 1  # the first wait is twice the initial one
    assert sink.retry(20) == 0 and sink.staged().first()["attempts"] == 2
    assert sink.retry(1000) == 0 and len(alerts) == 2  # more attempts than allowed: an alert, and they stay
    send.down = False
    assert sink.retry(10_000) == 3 and sink.depth() == 0 and sorted(send.sent) == ["k0", "k1", "k2", "k3"]
    assert sink.retry(20_000) == 0


def test_staged_letters_survive_a_restart_and_a_failing_stage(spark, tmp_path):
    send, path = Sender(), str(tmp_path / "staged")
    settings = DeadLetterSettings(initial_backoff_ms=10)
    send.down = True
    first = DeadLetterSink(spark, send, path, settings)
    first.route(letters(spark, 2), 0)
    first.route(letters(spark, 2, 2), 1000)
    again = DeadLetterSink(spark, send, path, settings)  # another driver
    assert again.depth() == 4
    send.down = False

    def broken(df, kind):
        raise OSError("no room")

    again._stage = broken
    with pytest.raises(OSError):
        again.retry(500)  # two are due and sent, but what is left cannot be staged: nothing is deleted
    assert again.depth() == 4
    last = DeadLetterSink(spark, send, path, settings)
    assert last.retry(500) == 2 and last.depth() == 2 and len(last.parts()) == 1  # sent twice rather than lost
    assert last.retry(5000) == 2 and last.depth() == 0 and sorted(set(send.sent)) == ["k0", "k1", "k2", "k3"]


def test_supervisor_pauses_and_does_not_resume_by_itself():
    class Query:
        isActive, status = True, {"isTriggerActive": False}

        def stop(self):
            self.isActive = False

    up, started = [True], []

    def start():
        started.append([Query()])
        return started[-1]

    s = Supervisor(start, lambda: up[0])
    up[0] = False
    assert s.tick() and s.tick() and not s.tick() and s.paused and not started[0][0].isActive
    up[0] = True
    assert s.tick() and s.paused
    s.resume()
    assert not s.paused and len(started) == 2
    s.again, up[0] = True, False
    for _ in range(3):
        s.tick()
    up[0] = True
    assert s.tick() and not s.paused and len(started) == 3


def test_three_strikes():
    health = StoreHealth()

    def broken():
        raise OSError

    assert health.check(broken) and health.check(lambda: False) and not health.check(broken)
    assert health.check(lambda: True) and health.failures == 0


def test_watch_and_stop(spark, tmp_path):
    watch = Watch()
    spark.streams.addListener(watch)
    try:
        q = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("memory").queryName("watched").start()
        import time

        for _ in range(100):
            if watch.last.get(str(q.id), {}).get("rows_in"):
                break
            time.sleep(0.1)
        assert watch.last[str(q.id)]["rows_in"] > 0
        assert stop([q]) and not q.isActive
    finally:
        spark.streams.removeListener(watch)
