import shutil

import pytest
from pyspark.sql import functions as F

from partwise.config import BreakerSettings, ConsumerSettings, DedupSettings, ReorderSettings
from partwise.plans.catalog import fixture_handler
from partwise.sources import streams, synthetic
from partwise.streaming import machine as m
from partwise.streaming import pipeline



@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each state variable of each shuffle partition costs a commit a micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SETTINGS = ConsumerSettings(breaker=BreakerSettings(error_rate_threshold=0.4))


def raw_rows(spark, data):
    return streams.raw_view(spark.read.parquet(f"{data}/events.parquet")).drop("event_id")


def test_batch_is_the_machine_by_partition(spark, data):
    raw = raw_rows(spark, data)
    rows = pipeline.run_batch(spark, raw, fixture_handler, SETTINGS).collect()
    final = [r for r in rows if r["disposition"] in ("PROCESSED", "DUPLICATE", "LATE_DROPPED", "REPLACED", "DLQ")]
    events, bad = pipeline.parsed(raw)
    assert len({(r["partition"], r["offset"]) for r in final}) == len(final) == raw.count()  # one final row an event
    assert sum(r["stage"] == "DESERIALIZE" for r in rows) == bad.count()
    for p in range(6):
        machine = m.Machine(m.Store(), fixture_handler, SETTINGS, p)
        mine = events.where(F.col("partition") == p).orderBy("offset").collect()
        for r in mine:
            machine.event({k: r[k] for k in ("topic", "offset", "source_entity", "sequence_number", "payload")} | {"at": int(r["timestamp"].timestamp() * 1000)})
        machine.flush(int(mine[-1]["timestamp"].timestamp() * 1000))
        key = lambda r: (r["disposition"], r.get("offset") or -1, r.get("detail") or "", r.get("release_reason") or "")
        assert sorted(map(key, machine.rows)) == sorted(key(r.asDict()) for r in rows if r["partition"] == p and r["stage"] != "DESERIALIZE")


def test_stream_restarts_from_its_checkpoint(spark, data, tmp_path):
    raw = raw_rows(spark, data)
    calm_handler = lambda e: ("SUCCESS", 1.0)
    calm = ConsumerSettings(breaker=BreakerSettings(error_rate_threshold=1.0, latency_threshold_ms=1e9), reorder=ReorderSettings(timeout_ms=10**8), dedup=DedupSettings(retention_ms=10**9))
    src = tmp_path / "in"
    raw.where("offset <= 80").coalesce(1).write.parquet(f"{src}/a.dir")
    shutil.move(next((src / "a.dir").glob("*.parquet")), src / "a.parquet")
    shutil.rmtree(src / "a.dir")

    def go():
        stream = spark.readStream.schema(raw.schema).parquet(str(src))
        for q in pipeline.run(stream, calm_handler, calm, str(tmp_path / "out"), str(tmp_path / "ck")):
            assert q.awaitTermination(120)

    go()
    first = spark.read.parquet(str(tmp_path / "out/rows")).where("disposition = 'PROCESSED'").count()
    raw.where("offset > 80").coalesce(1).write.parquet(f"{src}/b.dir")
    shutil.move(next((src / "b.dir").glob("*.parquet")), src / "b.parquet")
    shutil.rmtree(src / "b.dir")
    go()
    got = spark.read.parquet(str(tmp_path / "out/rows")).where("disposition in ('PROCESSED', 'DLQ')").select("partition", "offset").collect()
    want = pipeline.process(pipeline.parsed(raw)[0], calm_handler, calm).where("disposition in ('PROCESSED', 'DLQ')").select("partition", "offset").collect()
    assert first > 0 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert pipeline.snapshot(spark, str(tmp_path / "ck/rows"), "core").count() == 6


def start_at(spark, rows, folder, name):
    """rows: (partition, offset, second, entity, seq) as one file of raw records in folder."""
    values = [("k", f'{{"accountId":"{e}","sequenceNumber":{q},"amount":{o},"currency":"USD","type":"{kind}"}}'.encode(), "events", p, o, at, []) for p, o, at, e, q, kind in rows]
    df = spark.createDataFrame(values, "key string, value binary, topic string, partition int, offset long, at long, headers array<struct<key:string,value:binary>>")
    df = df.withColumn("timestamp", F.timestamp_seconds("at")).select("key", "value", "topic", "partition", "offset", "timestamp", "headers")
    df.coalesce(1).write.parquet(f"{folder}/{name}.dir")
    shutil.move(next((folder / f"{name}.dir").glob("*.parquet")), folder / f"{name}.parquet")
    shutil.rmtree(folder / f"{name}.dir")
    return df


FINAL = "disposition in ('PROCESSED', 'DUPLICATE', 'LATE_DROPPED', 'REPLACED', 'DLQ')"


def once(spark, src, tmp_path, schema, handler, settings, **more):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(src))
    for q in pipeline.run(stream, handler, settings, str(tmp_path / "out"), str(tmp_path / "ck"), **more):
        assert q.awaitTermination(120)
        yield q


def test_a_lagging_partition_loses_nothing(spark, tmp_path):
    src = tmp_path / "in"
    schema = start_at(spark, [(0, k, 10_000 + k, "a", k + 1, "CREDIT") for k in range(5)], src, "a").schema
    start_at(spark, [(0, 5 + k, 14_000 + k, "a", k + 6, "CREDIT") for k in range(5)], src, "b")
    start_at(spark, [(1, k, 5000 + k, "b", k + 1, "CREDIT") for k in range(5)], src, "c")  # over an hour behind
    queries = list(once(spark, src, tmp_path, schema, lambda e: ("SUCCESS", 1.0), ConsumerSettings()))
    dropped = sum(s.numRowsDroppedByWatermark for q in queries for p in q.recentProgress for s in p.stateOperators)
    got = spark.read.parquet(str(tmp_path / "out/rows")).where(FINAL).select("partition", "offset").collect()
    assert dropped == 0 and sorted(map(tuple, got)) == [(p, o) for p, n in ((0, 10), (1, 5)) for o in range(n)]


def refuser():
    """A handler that refuses debits; made here, so that workers need not import this module."""
    from partwise.streaming.machine import PermanentProcessingException

    def handler(event):
        if '"DEBIT"' in event["payload"]:
            error = PermanentProcessingException("refused")
            error.latency_ms = 1.0
            raise error
        return "SUCCESS", 1.0

    return handler


def test_restart_keeps_open_breaker_and_buffers_and_drain_lets_them_out(spark, tmp_path):
    src, control = tmp_path / "in", tmp_path / "control"
    control.mkdir()
    settings = ConsumerSettings(breaker=BreakerSettings(error_rate_threshold=0.5, cooldown_ms=10**9), reorder=ReorderSettings(timeout_ms=10**9))
    # Partition 0 opens on its third row and holds the fourth; partition 1 waits for number 2.
    schema = start_at(spark, [(0, 0, 100, "a", 1, "CREDIT"), (0, 1, 101, "a", 2, "DEBIT"), (0, 2, 102, "a", 3, "CREDIT"), (1, 0, 100, "b", 1, "CREDIT"), (1, 1, 101, "b", 3, "DEBIT")], src, "a").schema

    def go(**more):
        list(once(spark, src, tmp_path, schema, refuser(), settings, control=str(control), **more))
        return spark.read.parquet(str(tmp_path / "out/rows"))

    go()
    found = {r["partition"]: r for r in pipeline.gauges(spark, str(tmp_path / "ck/rows")).collect()}
    assert (found[0]["circuit_state"], found[1]["circuit_state"]) == (1, 0) and found[1]["buffer_depth"] == 1 and found[1]["store_size"] == 1
    start_at(spark, [(0, 3, 103, "a", 4, "CREDIT"), (1, 2, 102, "b", 4, "CREDIT")], src, "b")
    rows = go()
    assert {(r["partition"], r["offset"]) for r in rows.where("disposition = 'HELD'").collect()} == {(0, 2), (0, 3)}
    assert pipeline.snapshot(spark, str(tmp_path / "ck/rows"), "buffer", 1).count() == 2 and pipeline.snapshot(spark, str(tmp_path / "ck/rows"), "buffer", 0).count() == 0
    pipeline.command(spark, str(control), "SNAPSHOT", [("events", 1)])
    state = go().where("disposition = 'SNAPSHOT'").first()["detail"]
    pipeline.command(spark, str(control), "FLUSH", [("events", 0), ("events", 1)])
    sent = []
    rows = go(send=lambda df, tag: sent.extend((r["topic"], bytes(r["value"])) for r in df.collect()))
    final = rows.where(FINAL).select("partition", "offset", "disposition").collect()
    assert sorted((r["partition"], r["offset"]) for r in final) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]  # one final row each
    assert len(sent) == 1 and b'"DEBIT"' in sent[0][1]  # a released event's letter keeps its payload
    letters = spark.read.parquet(str(tmp_path / "out/letters"))  # the letter of the first run, in its topic's folder
    assert set(letters.columns) == {"key", "value", "topic", "headers", "batch"} and [r["topic"] for r in letters.collect()] == ["dlq.unclassified"]
    # Another machine goes on from the snapshot: numbers 3 and 4 come out when 2 comes.
    other = m.Machine(m.Store(), lambda e: ("SUCCESS", 1.0), settings, 1)
    other.command("RESTORE", state)
    other.event({"topic": "events", "offset": 9, "source_entity": "b", "sequence_number": 2, "payload": "{}", "at": 103_000})
    assert [r["sequence_number"] for r in other.rows] == [2, 3, 4]
    other.command("CLEAR")
    other.event({"topic": "events", "offset": 10, "source_entity": "b", "sequence_number": 1, "payload": "{}", "at": 104_000})
    assert other.rows[-1]["disposition"] == "DUPLICATE" and other.rows[-1]["release_reason"] == "FIRST"  # buffers are gone, keys stay


def test_a_stream_starts_from_a_snapshot(spark, tmp_path):
    src = tmp_path / "in"
    old = m.Machine(m.Store(), lambda e: ("SUCCESS", 1.0), ConsumerSettings(), 0)
    for offset, seq in ((0, 1), (1, 3)):
        old.event({"topic": "events", "offset": offset, "source_entity": "a", "sequence_number": seq, "payload": "{}", "at": 1_000_000 + offset})
    schema = start_at(spark, [(0, 2, 1001, "a", 2, "CREDIT")], src, "a").schema
    initial = spark.createDataFrame([("events", 0, old.snapshot())], "topic string, partition int, state string")
    list(once(spark, src, tmp_path, schema, lambda e: ("SUCCESS", 1.0), ConsumerSettings(), initial=initial))
    got = spark.read.parquet(str(tmp_path / "out/rows")).where(FINAL).orderBy("sequence_number").select("sequence_number", "release_reason").collect()
    assert list(map(tuple, got)) == [(2, "IN_ORDER"), (3, "CONSECUTIVE")]


def test_timers_and_drain_of_a_running_stream(spark, tmp_path):
    import time
    import urllib.request

    from partwise.streaming.lifecycle import stop
    from partwise.streaming.metrics import Metrics

    src, control, metrics = tmp_path / "in", tmp_path / "control", Metrics()
    control.mkdir()
    schema = start_at(spark, [(0, 0, 100, "a", 1, "CREDIT"), (0, 1, 100, "a", 3, "CREDIT"), (1, 0, 100, "b", 1, "DEBIT")], src, "a").schema
    settings = ConsumerSettings(reorder=ReorderSettings(timeout_ms=500))
    stream = spark.readStream.schema(schema).parquet(str(src))
    queries = pipeline.run(stream, refuser(), settings, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=False, control=str(control), metrics=metrics)
    rows = lambda: spark.read.parquet(str(tmp_path / "out/rows"))
    for _ in range(200):
        if list(tmp_path.glob("out/rows/*/_SUCCESS")) and rows().where("release_reason = 'TIMEOUT'").count():
            break
        time.sleep(0.3)
    assert [r["detail"] for r in rows().where("disposition = 'GAP'").collect()] == ["2-2"]  # no further row was needed
    server = metrics.serve()
    page = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics").read().decode()
    server.shutdown()
    assert 'events_processed_total{topic="events",partition="0"} 2' in page and 'circuit_breaker_state{topic="events",partition="1"} 1' in page
    assert 'dlq_routed_total{topic="events",partition="1",classification="PERMANENT"} 1' in page and 'from="CLOSED",to="OPEN"' in page
    start_at(spark, [(0, 2, 101, "a", 9, "CREDIT"), (1, 1, 101, "b", 2, "CREDIT")], src, "b")
    assert stop(queries, 120, lambda: pipeline.command(spark, str(control), "FLUSH", [("events", 0), ("events", 1)]))
    final = rows().where(FINAL).select("partition", "offset").collect()
    assert sorted(map(tuple, final)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)] and not any(q.isActive for q in queries)
    metrics.unregister("events", 0)
    assert 'partition="0"' not in metrics.render()


def test_generators_check_their_arguments(spark):
    for account, count in (("", 5), (" ", 5), ("a", 0), ("a", 10_001)):
        with pytest.raises(ValueError):
            synthetic.sequenced(spark, account, count)
    shuffled = [r[0] for r in synthetic.out_of_order(spark, "a", 200, 100).orderBy("arrival").select("sequence_number").collect()]
    assert sorted(shuffled) == list(range(1, 201)) and shuffled != sorted(shuffled) and set(shuffled[:100]) == set(range(1, 101))


def test_settings_are_checked():
    for bad in (lambda: BreakerSettings(error_rate_threshold=0.001), lambda: ReorderSettings(max_buffer_size=0), lambda: ReorderSettings(resume_threshold=1.5), lambda: DedupSettings(retention_ms=0)):
        with pytest.raises(ValueError):
            bad()
    for bad in ({"topics": []}, {"topics": ["t"], "max_records": 0}, {"topics": ["t"], "max_files": 0}):
        with pytest.raises(ValueError):
            streams.subscribe(None, **bad)


def test_subscribing_to_files(spark, tmp_path):
    src = tmp_path / "in"
    rows = start_at(spark, [(0, k, 100 + k, "a", k + 1, "CREDIT") for k in range(3)], src, "a")
    assert rows.columns and streams.subscribe(spark, ["events"], format="parquet", path=str(src), max_files=2).isStreaming
