"""Named queries over the test tables, each with SQL that an independent engine runs on the same tables.

The stream view of `events` (sources.streams.stream_view) stands in for a topic of six partitions; its offsets serve as
seconds. The stateful machine is held against SQL a row at a time under settings of which one part after the other shows
(stateful_*); all of its parts at once, which SQL does not express, against the machine run in one process.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DeadLetterSettings
from ..functions import scalars
from ..operators import dead_letters, dedup, handler, health, metrics, sequence
from ..sources import streams, synthetic

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = 1704067200
LETTERS = DeadLetterSettings(topics={k: f"group.dlq.{k.lower()}" for k in ("DESERIALIZATION", "VALIDATION", "TRANSIENT")}, default_topic="group.dlq.unclassified")

VIEW = """base AS (
  SELECT event_id, event_type, value, props, user_id % 6 AS p, CAST(user_id AS VARCHAR) AS entity,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
         event_id + (event_id * 7919) % 1009 AS arrival
  FROM events),
dup AS (
  SELECT *, 0 AS copy FROM base WHERE event_id % 50 <> 7
  UNION ALL
  SELECT event_id, event_type, value, props, p, entity, seq, arrival + 300 AS arrival, 1 AS copy
  FROM base WHERE event_id % 20 = 0 AND event_id % 50 <> 7),
s AS (
  SELECT p, entity, seq, row_number() OVER (PARTITION BY p ORDER BY arrival, event_id, copy) AS off,
         event_id, copy, event_type, event_type = 'error' AS failed, value AS latency_ms, props
  FROM dup)"""
ORDERED = """a AS (
  SELECT *, first_value(seq) OVER (PARTITION BY p, entity ORDER BY off) AS anchor,
         row_number() OVER (PARTITION BY p, entity, seq ORDER BY off) AS occ FROM s),
f AS (
  SELECT p, entity, seq, max(off) OVER (PARTITION BY p, entity ORDER BY seq) AS rel0,
         seq - anchor + 1 = row_number() OVER (PARTITION BY p, entity ORDER BY seq) AS contig
  FROM a WHERE occ = 1 AND seq >= anchor),
r AS (SELECT p, entity, seq, CASE WHEN contig THEN rel0 END AS rel FROM f),
d AS (
  SELECT a.*, r.rel, CASE
    WHEN a.seq < a.anchor THEN 'BELOW_ANCHOR'
    WHEN r.rel IS NOT NULL AND a.off > r.rel THEN 'AFTER_RELEASE'
    WHEN r.rel = a.off THEN 'IN_ORDER'
    WHEN lead(a.off) OVER (PARTITION BY a.p, a.entity, a.seq ORDER BY a.off) < coalesce(r.rel, 9999999999) THEN 'REPLACED'
    WHEN r.rel IS NULL THEN 'FLUSHED' ELSE 'BUFFERED' END AS disposition
  FROM a LEFT JOIN r ON a.p = r.p AND a.entity = r.entity AND a.seq = r.seq)"""
KEYED = """k AS (
  SELECT *, entity || ':' || CAST(seq AS VARCHAR) || ':' || CAST(p AS VARCHAR) AS "key" FROM s)"""
HANDLED = """h0 AS (
  SELECT *, CASE WHEN failed THEN CASE event_id % 4 WHEN 0 THEN 'TransientProcessingException' WHEN 1 THEN 'PermanentProcessingException'
    WHEN 2 THEN 'ValidationException' ELSE 'IllegalStateException' END END AS error_class,
    CASE WHEN failed THEN 'event ' || CAST(event_id AS VARCHAR) || ' failed' END AS error_message FROM s),
h AS (
  SELECT *, error_class IS NULL AS ok, CASE error_class WHEN 'TransientProcessingException' THEN 'TRANSIENT' WHEN 'ValidationException' THEN 'VALIDATION'
    ELSE CASE WHEN error_class IS NOT NULL THEN 'PERMANENT' END END AS classification,
    1 AS attempts, CASE WHEN error_class = 'TransientProcessingException' THEN 1 ELSE 0 END AS retry_count FROM h0)"""
DEEP = """steps AS (
  SELECT p, off, 1 AS d FROM d WHERE disposition IN ('BUFFERED', 'FLUSHED')
  UNION ALL SELECT p, rel, -1 FROM d WHERE disposition = 'BUFFERED'
  UNION ALL SELECT p, off, 0 FROM d WHERE disposition NOT IN ('BUFFERED', 'FLUSHED')),
net AS (SELECT p, off, sum(d) AS d FROM steps GROUP BY p, off),
deep AS (SELECT p, off, CAST(sum(d) OVER (PARTITION BY p ORDER BY off) AS BIGINT) AS depth FROM net)"""
RATES = """w AS (
  SELECT p, off, count(*) OVER f AS n, count(CASE WHEN failed THEN 1 END) OVER f AS failures FROM s
  WINDOW f AS (PARTITION BY p ORDER BY off RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))"""


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _view(spark, sf_dir):
    return streams.stream_view(_events(spark, sf_dir))


def _handled(spark, sf_dir):
    return handler.handle(_view(spark, sf_dir))


def query(sql: str | None = None, *ctes: str):
    """Registers a function (spark, sf_dir) under its name, with its SQL over common table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)}\n" if ctes else "") + sql
        return f

    return register


def entry(spark, sf_dir):
    return partition_health(spark, sf_dir)


# ---- the whole pipeline (stateful: no SQL)


def fixture_handler(event: dict):
    """Debits fail with one of four errors; the amount is the latency."""
    import json

    from ..streaming import machine as m

    payload = json.loads(event["payload"])
    latency = float(payload["amount"])
    if payload["type"] != "DEBIT":
        return "SUCCESS", latency
    error = (m.TransientProcessingException, m.PermanentProcessingException, m.ValidationException, ValueError)[event["offset"] % 4]("debit refused")
    error.latency_ms = latency
    raise error


@query()
def stateful_pipeline(spark, sf_dir):
    """Every row of the breaker, reorder, dedup, handler and health machine over the raw view, one final row an event."""
    from ..config import BreakerSettings, ConsumerSettings
    from ..streaming import pipeline

    raw = streams.raw_view(_events(spark, sf_dir)).drop("event_id")
    return pipeline.run_batch(spark, raw, fixture_handler, ConsumerSettings(breaker=BreakerSettings(error_rate_threshold=0.4)))


@query()
def stateful_transitions(spark, sf_dir):
    """Signals and breaker transitions by partition, from the pipeline's rows."""
    rows = stateful_pipeline(spark, sf_dir).where("disposition in ('SIGNAL', 'TRANSITION')")
    return rows.groupBy("partition", "disposition", F.split("detail", ":")[0].alias("what")).agg(F.count("*").alias("n"))


# The same machine under settings of which one part at a time shows, each against SQL. Rows that cannot be parsed take no part.

FINAL = ("PROCESSED", "DUPLICATE", "LATE_DROPPED", "REPLACED", "DLQ")
PARSED = VIEW[: VIEW.rindex("s AS (")] + "s0 AS (" + VIEW[VIEW.rindex("s AS (") + 6 :] + ",\ns AS (SELECT * FROM s0 WHERE event_id % 97 <> 3)"


def late_fixture_handler(event: dict):
    """The fixture's handler, but nothing fails among the first offsets, so that not all of a window's events have failed."""
    return fixture_handler(event) if event["offset"] >= 10 else ("SUCCESS", 1.0)


def calm_handler(event: dict):
    return "SUCCESS", 1.0


def _machine(spark, sf_dir, handler, **settings):
    from ..config import BreakerSettings, ConsumerSettings, ReorderSettings
    from ..streaming import pipeline

    calm = {"breaker": BreakerSettings(error_rate_threshold=1.0, latency_threshold_ms=1e12), "reorder": ReorderSettings(timeout_ms=10**12), "dead_letters": LETTERS}
    raw = streams.raw_view(_events(spark, sf_dir)).drop("event_id")
    return pipeline.run_batch(spark, raw, handler, ConsumerSettings(**{**calm, **settings}))


def _final(rows):
    return rows.where(F.col("disposition").isin(*FINAL)).select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "disposition", "release_reason")


CALM = """c0 AS (SELECT *, failed AND off >= 10 AS bad, disposition IN ('IN_ORDER', 'BUFFERED', 'FLUSHED') AS handled, off = min(off) OVER (PARTITION BY p, entity) AS first FROM d),
c1 AS (SELECT *, bool_or(handled AND NOT bad) OVER (PARTITION BY p, entity, seq) AS known FROM c0),
c AS (SELECT *, CASE WHEN handled THEN CASE WHEN bad THEN 'DLQ' ELSE 'PROCESSED' END WHEN disposition = 'REPLACED' THEN 'REPLACED'
    WHEN disposition = 'AFTER_RELEASE' AND known THEN 'DUPLICATE' ELSE 'LATE_DROPPED' END AS outcome,
  CASE WHEN handled THEN CASE WHEN first THEN 'FIRST' WHEN disposition = 'IN_ORDER' THEN 'IN_ORDER' WHEN disposition = 'BUFFERED' THEN 'CONSECUTIVE' ELSE 'FLUSH' END END AS reason,
  CASE off % 4 WHEN 0 THEN 'TRANSIENT' WHEN 2 THEN 'VALIDATION' ELSE 'PERMANENT' END AS kind FROM c1)"""


@query(
    """SELECT p, off, outcome AS disposition, reason AS release_reason, CASE WHEN outcome = 'DLQ' THEN kind END AS classification,
  CASE WHEN outcome = 'DLQ' THEN CASE WHEN kind = 'TRANSIENT' THEN 1 ELSE 0 END WHEN outcome = 'PROCESSED' THEN 0 END AS retry_count FROM c
UNION ALL SELECT p, off, 'DLQ', NULL, 'DESERIALIZATION', 0 FROM s0 WHERE event_id % 97 = 3""",
    PARSED,
    ORDERED,
    CALM,
)
def stateful_calm(spark, sf_dir):
    """The final row of every event while no breaker opens and nothing times out."""
    rows = _machine(spark, sf_dir, late_fixture_handler).where(F.col("disposition").isin(*FINAL))
    return rows.select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "disposition", "release_reason", "classification", "retry_count")


@query(
    """, l AS (SELECT p, off, entity, kind, CASE WHEN kind = 'TRANSIENT' THEN 1 ELSE 0 END AS n FROM c WHERE outcome = 'DLQ'
  UNION ALL SELECT p, off, NULL, 'DESERIALIZATION', 0 FROM s0 WHERE event_id % 97 = 3)
SELECT CASE kind WHEN 'PERMANENT' THEN 'group.dlq.unclassified' ELSE 'group.dlq.' || lower(kind) END AS topic, entity AS "key", 'events' AS original_topic,
  CAST(p AS VARCHAR) AS original_partition, CAST(off AS VARCHAR) AS original_offset, kind AS error_classification, CAST(n AS VARCHAR) AS retry_count, coalesce(entity, '') AS source_entity FROM l""",
    PARSED,
    ORDERED,
    CALM,
)
def stateful_letters(spark, sf_dir):
    """The dead letters of the calm machine as they go to their topics."""
    from ..streaming import pipeline

    found = pipeline.letters(_machine(spark, sf_dir, late_fixture_handler), LETTERS)
    value = lambda name: F.element_at(F.filter("headers", lambda h: h["key"] == f"x-dlq-{name.replace('_', '-')}"), 1)["value"].cast("string").alias(name)
    return found.select("topic", "key", *map(value, ("original_topic", "original_partition", "original_offset", "error_classification", "retry_count", "source_entity")))


RETENTION = 40


@query(
    f"""SELECT p, off, CASE WHEN disposition IN ('IN_ORDER', 'BUFFERED', 'FLUSHED') THEN 'PROCESSED' WHEN disposition = 'REPLACED' THEN 'REPLACED'
  WHEN disposition = 'AFTER_RELEASE' AND off - rel <= {RETENTION} THEN 'DUPLICATE' ELSE 'LATE_DROPPED' END AS disposition FROM d""",
    PARSED,
    ORDERED,
)
def stateful_retention(spark, sf_dir):
    """Duplicates are known as long as their keys are kept; keys are evicted at each event."""
    from ..config import DedupSettings

    rows = _machine(spark, sf_dir, calm_handler, dedup=DedupSettings(retention_ms=RETENTION * 1000, eviction_interval_ms=1))
    return _final(rows.where("stage is null or stage != 'DESERIALIZE'")).drop("release_reason")


TIMEOUT = 20
# One step an event of the partition, for each of its entities: the head that has waited too long, then the event if it is this
# entity's. wait: (seq, off, since) by seq.
TIMED = f"""steps AS (SELECT p, off AS t, row_number() OVER (PARTITION BY p ORDER BY off) AS k FROM s),
ents AS (SELECT DISTINCT p, entity FROM s),
r AS (
  SELECT p, entity, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS nxt, CAST([] AS STRUCT(seq BIGINT, off BIGINT, since BIGINT)[]) AS wait, CAST([] AS BIGINT[]) AS done,
    CAST([] AS STRUCT(off BIGINT, disposition VARCHAR, reason VARCHAR, detail VARCHAR)[]) AS out FROM ents
  UNION ALL
  SELECT p, entity, k, CASE WHEN seq IS NULL THEN nxt1 WHEN how IN ('FIRST', 'IN_ORDER') THEN seq + 1 + len(run2) ELSE nxt1 END,
    CASE WHEN how = 'BUFFER' THEN list_sort(list_append(list_filter(wait1, lambda x: x.seq <> seq), {{'seq': seq, 'off': t, 'since': t}})) WHEN how = 'IN_ORDER' THEN wait1[len(run2) + 1 :] ELSE wait1 END,
    done1 || CASE WHEN how IN ('FIRST', 'IN_ORDER') THEN [seq] ELSE [] END || list_transform(run2, lambda x: x.seq),
    out1 || CASE WHEN how IN ('FIRST', 'IN_ORDER') THEN [{{'off': t, 'disposition': 'PROCESSED', 'reason': how, 'detail': CAST(NULL AS VARCHAR)}}]
        WHEN how = 'LATE' THEN [{{'off': t, 'disposition': CASE WHEN list_contains(done1, seq) THEN 'DUPLICATE' ELSE 'LATE_DROPPED' END, 'reason': NULL, 'detail': NULL}}]
        WHEN how = 'BUFFER' THEN list_transform(list_filter(wait1, lambda x: x.seq = seq), lambda x: {{'off': x.off, 'disposition': 'REPLACED', 'reason': CAST(NULL AS VARCHAR), 'detail': CAST(NULL AS VARCHAR)}}) ELSE [] END
      || list_transform(run2, lambda x: {{'off': x.off, 'disposition': 'PROCESSED', 'reason': 'CONSECUTIVE', 'detail': CAST(NULL AS VARCHAR)}})
  FROM (
    SELECT *, CASE WHEN how = 'IN_ORDER' THEN list_filter(wait1, lambda x, i: x.seq = seq + i) ELSE [] END AS run2 FROM (
      SELECT *, CASE WHEN seq IS NULL THEN NULL WHEN nxt1 IS NULL THEN 'FIRST' WHEN seq < nxt1 THEN 'LATE' WHEN seq = nxt1 THEN 'IN_ORDER' ELSE 'BUFFER' END AS how FROM (
        SELECT p, entity, k, t, seq, CASE WHEN late THEN wait[1].seq + len(run1) ELSE nxt END AS nxt1, wait[len(run1) + 1 :] AS wait1, done || list_transform(run1, lambda x: x.seq) AS done1,
          CASE WHEN late AND wait[1].seq > nxt THEN [{{'off': CAST(NULL AS BIGINT), 'disposition': 'GAP', 'reason': CAST(NULL AS VARCHAR), 'detail': nxt || '-' || (wait[1].seq - 1)}}] ELSE [] END
            || list_transform(run1, lambda x, i: {{'off': x.off, 'disposition': 'PROCESSED', 'reason': CASE WHEN i = 1 THEN 'TIMEOUT' ELSE 'CONSECUTIVE' END, 'detail': CAST(NULL AS VARCHAR)}}) AS out1
        FROM (
          SELECT *, CASE WHEN late THEN list_filter(wait, lambda x, i: x.seq = wait[1].seq + i - 1) ELSE [] END AS run1 FROM (
            SELECT r.p, r.entity, st.k, st.t, e.seq, r.nxt, r.wait, r.done, len(r.wait) > 0 AND r.wait[1].since < st.t - {TIMEOUT} AS late
            FROM r JOIN steps st ON st.p = r.p AND st.k = r.k + 1 LEFT JOIN s e ON e.p = r.p AND e.entity = r.entity AND e.off = st.t)))))),
x AS (SELECT p, unnest(out) AS o FROM r UNION ALL
  SELECT p, {{'off': w.off, 'disposition': 'PROCESSED', 'reason': 'FLUSH', 'detail': NULL}} FROM (SELECT p, unnest(wait) AS w FROM (SELECT *, max(k) OVER (PARTITION BY p) AS last FROM r) WHERE k = last))"""


@query("SELECT p, o.off AS off, o.disposition AS disposition, o.reason AS release_reason, o.detail AS detail FROM x", PARSED, TIMED)
def stateful_timeouts(spark, sf_dir):
    """The final rows and gaps while buffered events time out."""
    from ..config import ReorderSettings

    rows = _machine(spark, sf_dir, calm_handler, reorder=ReorderSettings(timeout_ms=TIMEOUT * 1000)).where("stage is null or stage != 'DESERIALIZE'")
    return rows.where(F.col("disposition").isin(*FINAL, "GAP")).select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "disposition", "release_reason", "detail")


def _breaking(spark, sf_dir, settings):
    """The machine over events that are an entity each, so that only gate, window, signals, breaker and probe show."""
    from ..config import ConsumerSettings
    from ..streaming import pipeline

    v = _view(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("latency_ms").alias("amount"), F.when(F.col("failed"), "DEBIT").otherwise("CREDIT").alias("type")))
    events = v.select(
        F.lit("events").alias("topic"),
        F.col("p").cast("int").alias("partition"),
        F.col("off").alias("offset"),
        F.concat(F.lit("e"), F.col("off").cast("string")).alias("source_entity"),
        F.lit(1).cast("long").alias("sequence_number"),
        payload.alias("payload"),
        F.timestamp_seconds("off").alias("timestamp"),
    )
    rows = pipeline.process(events, fixture_handler, ConsumerSettings(breaker=settings), flush=True)
    return rows.select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "disposition", "detail", F.unix_millis("emitted_at").alias("clock"))


def _breaker_sql(rate: float, latency: float, cooldown: int, batch: int, timeout: int) -> str:
    """One step reads an event or lets a held one go on: queue is what is to be gated next, win the window's events with their
    bucket's beginning."""
    row = "{{'off': {off}, 'disposition': {what}, 'detail': {detail}, 'clock': {at}}}".format
    turn = lambda old, new, at: row(off="CAST(NULL AS BIGINT)", what="'TRANSITION'", detail=f"{old} || '>' || {new}", at=at)
    signal = lambda kind, value, most: row(off="CAST(NULL AS BIGINT)", what="'SIGNAL'", detail=f"'{kind}:' || format('{{:.6f}}', {value}) || ':{most:g}'", at="now")
    return f"""steps AS (SELECT p, off, row_number() OVER (PARTITION BY p ORDER BY off) AS k FROM s),
ends AS (SELECT p, max(k) AS last FROM steps GROUP BY p),
r AS (
  SELECT p, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS now, 'CLOSED' AS state, CAST(0 AS BIGINT) AS entered, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS good, false AS sup_e, false AS sup_l,
    CAST([] AS STRUCT(st BIGINT, bad BOOLEAN, lat DOUBLE)[]) AS win, CAST([] AS BIGINT[]) AS queue, CAST([] AS BIGINT[]) AS held,
    CAST([] AS STRUCT(off BIGINT, disposition VARCHAR, detail VARCHAR, clock BIGINT)[]) AS out FROM ends
  UNION ALL
  SELECT p, CASE WHEN mode = 'read' THEN k + 1 ELSE k END, now, state3, entered3, CASE WHEN mode <> 'gate' AND state3 = 'HALF_OPEN' AND state <> 'HALF_OPEN' THEN 0 ELSE total1 END,
    CASE WHEN mode <> 'gate' AND state3 = 'HALF_OPEN' AND state <> 'HALF_OPEN' THEN 0 ELSE good1 END,
    state3 <> 'CLOSED' AND sup_e1 OR state3 = 'CLOSED' AND state = 'CLOSED' AND sup_e1, state3 <> 'CLOSED' AND sup_l1 OR state3 = 'CLOSED' AND state = 'CLOSED' AND sup_l1,
    CASE WHEN state3 = 'CLOSED' AND state <> 'CLOSED' THEN [] ELSE win1 END,
    CASE WHEN mode = 'gate' THEN queue[2:] WHEN wakes THEN held || CASE WHEN mode = 'read' THEN [item] ELSE [] END ELSE [item] END,
    CASE WHEN mode = 'gate' THEN CASE WHEN state = 'OPEN' THEN list_append(held, item) ELSE held END WHEN wakes THEN [] ELSE held END,
    CASE WHEN mode <> 'gate' THEN CASE WHEN state3 <> state THEN [{turn('state', 'state3', 'now')}] ELSE [] END
      WHEN state = 'OPEN' THEN [{row(off='item', what="'HELD'", detail='CAST(NULL AS VARCHAR)', at='now')}]
      ELSE [{row(off='item', what="CASE WHEN failed THEN 'DLQ' ELSE 'PROCESSED' END", detail='CAST(NULL AS VARCHAR)', at='now')}]
        || CASE WHEN probed THEN [{turn('state', 'state3', 'now')}] ELSE
          CASE WHEN over_e AND NOT sup_e THEN [{signal('ERROR_RATE', 'rate', rate)}] || CASE WHEN state = 'CLOSED' THEN [{turn('state', "'OPEN'", 'now')}] ELSE [] END ELSE [] END
          || CASE WHEN over_l AND NOT sup_l THEN [{signal('LATENCY', 'p99', latency)}] || CASE WHEN state = 'CLOSED' AND NOT (over_e AND NOT sup_e) THEN [{turn('state', "'OPEN'", 'now')}] ELSE [] END ELSE [] END END END
  FROM (SELECT *, CASE WHEN state3 <> state THEN now ELSE entered END AS entered3 FROM (
    SELECT *, CASE WHEN mode <> 'gate' THEN CASE WHEN wakes THEN 'HALF_OPEN' WHEN state = 'HALF_OPEN' AND now >= entered + {timeout} THEN CASE WHEN total = 0 THEN 'CLOSED' ELSE 'OPEN' END ELSE state END
        WHEN state = 'OPEN' THEN 'OPEN' WHEN probed THEN CASE WHEN total1 = good1 THEN 'CLOSED' ELSE 'OPEN' END
        WHEN state = 'CLOSED' AND (over_e AND NOT sup_e OR over_l AND NOT sup_l) THEN 'OPEN' ELSE state END AS state3,
      CASE WHEN handles AND NOT probed THEN over_e ELSE sup_e END AS sup_e1, CASE WHEN handles AND NOT probed THEN over_l ELSE sup_l END AS sup_l1 FROM (
      SELECT *, handles AND state = 'HALF_OPEN' AND total1 >= {batch} AS probed, rate >= {rate} AS over_e, p99 >= {latency} AS over_l FROM (
        SELECT *, len(list_filter(win1, lambda x: x.bad)) / len(win1) AS rate, list_sort(list_transform(win1, lambda x: x.lat))[CAST(ceil(0.99 * len(win1)) AS BIGINT)] AS p99 FROM (
          SELECT *, CASE WHEN handles THEN list_filter(list_append(win, {{'st': CASE WHEN len(win) = 0 OR now - win[-1].st >= 1000 THEN now ELSE win[-1].st END, 'bad': failed, 'lat': latency_ms}}), lambda x: x.st >= now - 60000) ELSE win END AS win1,
            total + CASE WHEN handles AND state = 'HALF_OPEN' THEN 1 ELSE 0 END AS total1, good + CASE WHEN handles AND state = 'HALF_OPEN' AND NOT failed THEN 1 ELSE 0 END AS good1 FROM (
            SELECT q.*, e.failed, e.latency_ms, mode = 'gate' AND state <> 'OPEN' AS handles, mode = 'end' OR mode = 'read' AND state = 'OPEN' AND now > entered + {cooldown} AS wakes FROM (
              SELECT r.* EXCLUDE (now, out), CASE WHEN len(queue) > 0 THEN 'gate' WHEN r.k < last THEN 'read' ELSE 'end' END AS mode,
                CASE WHEN len(queue) > 0 THEN r.now WHEN r.k < last THEN greatest(r.now, st.off * 1000) ELSE greatest(r.now, entered + {cooldown} + 1) END AS now,
                CASE WHEN len(queue) > 0 THEN queue[1] ELSE st.off END AS item
              FROM r JOIN ends ON ends.p = r.p LEFT JOIN steps st ON st.p = r.p AND st.k = r.k + 1
              WHERE len(queue) > 0 OR r.k < last OR len(held) > 0) q
            LEFT JOIN s e ON e.p = q.p AND e.off = q.item)))))))"""


BREAKING = {"stateful_breaker": (0.4, 480.0, 20_000, 3, 30_000), "stateful_probe": (0.3, 1e9, 15_000, 100, 10_000)}
OUTPUT = "SELECT p, o.off AS off, o.disposition AS disposition, o.detail AS detail, o.clock AS clock FROM (SELECT p, unnest(out) AS o FROM r)"


@query(OUTPUT, VIEW, _breaker_sql(*BREAKING["stateful_breaker"]))
def stateful_breaker(spark, sf_dir):
    """Every row while the breaker opens by rate and latency, holds, probes, and closes or opens again."""
    from ..config import BreakerSettings

    return _breaking(spark, sf_dir, BreakerSettings(*BREAKING["stateful_breaker"]))


@query(OUTPUT, VIEW, _breaker_sql(*BREAKING["stateful_probe"]))
def stateful_probe(spark, sf_dir):
    """The same with probes that only end by their time."""
    from ..config import BreakerSettings

    return _breaking(spark, sf_dir, BreakerSettings(*BREAKING["stateful_probe"]))


# ---- sources


@query("SELECT p, entity, seq, off, event_id, copy, failed, latency_ms FROM s", VIEW)
def stream_view(spark, sf_dir):
    return _view(spark, sf_dir).select("p", "entity", "seq", "off", "event_id", "copy", "failed", "latency_ms")


@query("SELECT p, off, entity AS source_entity, CASE WHEN event_id % 89 <> 5 THEN seq END AS sequence_number, event_id % 89 <> 5 AS parse_ok FROM s", VIEW)
def header_envelope(spark, sf_dir):
    raw = streams.from_headers(streams.raw_view(_events(spark, sf_dir)))
    return raw.select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "source_entity", "sequence_number", "parse_ok")


@query("SELECT 'account-1' AS account_id, i AS sequence_number, CAST((i * 7919 % 100000) / 100.0 AS DECIMAL(18,2)) AS amount, CASE i % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency, CASE i % 2 WHEN 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type, i AS arrival FROM (SELECT unnest(range(1, 1001)) AS i)")
def synthetic_sequenced(spark, sf_dir):
    return synthetic.sequenced(spark, "account-1", 1000)


@query("SELECT row_number() OVER (ORDER BY ((i - 1) // 100) * 100900000 + (i * 7919 + 17 * 104729) % 1009 * 10000 + i) AS place, i AS sequence_number FROM (SELECT unnest(range(1, 1001)) AS i)")
def synthetic_out_of_order(spark, sf_dir):
    from pyspark.sql import Window

    # The ranking is of at most synthetic.MOST generated rows.
    return synthetic.out_of_order(spark, "account-1", 1000, 100).select(F.row_number().over(Window.orderBy("arrival")).cast("long").alias("place"), "sequence_number")


@query("SELECT i AS sequence_number, i * 3 + c AS arrival FROM (SELECT unnest(range(1, 501)) AS i), (SELECT unnest(range(0, 3)) AS c)")
def synthetic_duplicates(spark, sf_dir):
    return synthetic.duplicates(spark, "account-1", 500, 2).select("sequence_number", "arrival")


@query("SELECT 'poison' AS \"key\", 'NOT_VALID_JSON{{{garbage!!!' AS value")
def synthetic_poison_pill(spark, sf_dir):
    return synthetic.poison_pill(spark)


# ---- projection, parse, filter


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT p, off, CASE WHEN event_id % 97 <> 3 THEN entity END AS source_entity, CASE WHEN event_id % 97 <> 3 THEN seq END AS sequence_number, CASE WHEN event_id % 97 <> 3 THEN CAST(latency_ms AS DECIMAL(18,2)) END AS amount, event_id % 97 <> 3 AS parse_ok FROM s", VIEW)
def json_envelope(spark, sf_dir):
    raw = streams.from_json(streams.raw_view(_events(spark, sf_dir)))
    return raw.select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), "source_entity", "sequence_number", F.col("payload.amount").alias("amount"), "parse_ok")


@query("SELECT p, off, 'DESERIALIZATION' AS classification, 'group.dlq.deserialization' AS destination, 0 AS retry_count FROM s WHERE event_id % 97 = 3", VIEW)
def parse_failures(spark, sf_dir):
    bad = streams.from_json(streams.raw_view(_events(spark, sf_dir))).where("not parse_ok")
    kind = F.lit("DESERIALIZATION")
    return bad.select(F.col("partition").cast("long").alias("p"), F.col("offset").alias("off"), kind.alias("classification"), dead_letters.topic_of(kind, LETTERS).alias("destination"), F.lit(0).alias("retry_count"))


@query("SELECT p, off, sha256('events|' || CAST(p AS VARCHAR) || '|' || CAST(off AS VARCHAR)) AS correlation_id FROM s", VIEW)
def correlation_ids(spark, sf_dir):
    return _view(spark, sf_dir).select("p", "off", scalars.correlation_id(F.lit("events")).alias("correlation_id"))


# ---- sequence


@query("SELECT p, off, entity, seq, anchor, rel, disposition FROM d", VIEW, ORDERED)
def reorder_dispositions(spark, sf_dir):
    return sequence.dispositions(_view(spark, sf_dir)).select("p", "off", "entity", "seq", "anchor", "rel", "disposition")


@query("SELECT p, entity, arg_min(seq, off) AS anchor FROM s GROUP BY p, entity", VIEW)
def reorder_anchors(spark, sf_dir):
    return sequence.anchors(_view(spark, sf_dir))


@query("SELECT p, entity, seq, off, row_number() OVER (PARTITION BY p, entity ORDER BY seq) AS place FROM d WHERE disposition = 'FLUSHED'", VIEW, ORDERED)
def reorder_flush(spark, sf_dir):
    return sequence.flush_order(_view(spark, sf_dir))


@query("SELECT p, off AS released_at, count(*) AS n FROM (SELECT p, rel AS off FROM d WHERE disposition IN ('IN_ORDER', 'BUFFERED')) GROUP BY p, off", VIEW, ORDERED)
def reorder_releases(spark, sf_dir):
    d = sequence.dispositions(_view(spark, sf_dir)).where("disposition in ('IN_ORDER', 'BUFFERED')")
    return d.groupBy("p", F.col("rel").alias("released_at")).agg(F.count("*").alias("n"))


@query(", g AS (SELECT p, entity, seq, lag(seq) OVER (PARTITION BY p, entity ORDER BY seq) AS b FROM (SELECT DISTINCT p, entity, seq FROM d WHERE disposition <> 'BELOW_ANCHOR')) SELECT p, entity, b + 1 AS missing_from, seq - 1 AS missing_to FROM g WHERE seq - b > 1", VIEW, ORDERED)
def sequence_gaps(spark, sf_dir):
    return sequence.gaps(_view(spark, sf_dir))


@query("SELECT p, off, depth FROM deep", VIEW, ORDERED, DEEP)
def buffer_depth(spark, sf_dir):
    return sequence.depth(_view(spark, sf_dir))


@query(
    """, m AS (SELECT *, CASE WHEN depth >= 40 THEN 1 WHEN depth < 32 THEN 0 END AS want FROM deep),
t AS (SELECT *, coalesce(last_value(want IGNORE NULLS) OVER (PARTITION BY p ORDER BY off), 0) AS active FROM m),
u AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY p ORDER BY off), 0) AS was FROM t)
SELECT p, off, depth, active = 1 AS active FROM u WHERE active <> was""",
    VIEW,
    ORDERED,
    DEEP,
)
def backpressure_changes(spark, sf_dir):
    return sequence.backpressure(_view(spark, sf_dir), 40)


# ---- deduplication


@query('SELECT p, off, "key" FROM k', VIEW, KEYED)
def dedup_keys(spark, sf_dir):
    return dedup.keys(_view(spark, sf_dir)).select("p", "off", "key")


@query('SELECT p, off, "key", row_number() OVER (PARTITION BY "key" ORDER BY off) > 1 AS duplicate FROM k', VIEW, KEYED)
def dedup_check(spark, sf_dir):
    return dedup.mark_duplicates(_view(spark, sf_dir)).select("p", "off", "key", "duplicate")


@query('SELECT p, off, "key", coalesce(bool_or(NOT failed) OVER (PARTITION BY "key" ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate FROM k', VIEW, KEYED)
def dedup_after_success(spark, sf_dir):
    return dedup.mark_after_success(_view(spark, sf_dir)).select("p", "off", "key", "duplicate")


@query('SELECT p, off, "key", coalesce(off - max(CASE WHEN NOT failed THEN off END) OVER (PARTITION BY "key" ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 40, false) AS duplicate FROM k', VIEW, KEYED)
def dedup_retention(spark, sf_dir):
    return dedup.mark_within(_view(spark, sf_dir), 40).select("p", "off", "key", "duplicate")


@query('SELECT "key", max(off) AS processed_at FROM k WHERE NOT failed GROUP BY "key" HAVING max(off) >= 500', VIEW, KEYED)
def dedup_evict(spark, sf_dir):
    return dedup.evict(dedup.store(_view(spark, sf_dir)), 500)


@query('SELECT p, count(DISTINCT "key") AS store_size FROM k WHERE NOT failed GROUP BY p', VIEW, KEYED)
def dedup_store_size(spark, sf_dir):
    return dedup.store_size(_view(spark, sf_dir))


@query(
    """, k AS (SELECT *, entity || ':' || CAST(seq AS VARCHAR) || ':' || CAST(p AS VARCHAR) AS "key" FROM d),
m AS (SELECT *, coalesce(bool_or(NOT failed) OVER (PARTITION BY "key" ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate FROM k)
SELECT p, off, "key", CASE WHEN duplicate THEN 'DUPLICATE' ELSE 'LATE_DROPPED' END AS outcome FROM m WHERE disposition IN ('BELOW_ANCHOR', 'AFTER_RELEASE')""",
    VIEW,
    ORDERED,
)
def late_dispositions(spark, sf_dir):
    return dedup.late_dispositions(_view(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dedup_lineitem_pairs(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT conv_id, max(turn) - min(turn) + 1 - count(*) AS missing, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def conversation_sequences(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("missing"), (F.max("turn") + 1).alias("next_turn"))


# ---- handler and retry


@query("SELECT p, off, ok, error_class, classification, attempts, retry_count FROM h", VIEW, HANDLED)
def handler_outcomes(spark, sf_dir):
    return _handled(spark, sf_dir).select("p", "off", "ok", "error_class", "classification", "attempts", "retry_count")


@query("SELECT p, off, CASE WHEN event_id % 3 = 0 THEN 'PERMANENT' END AS classification, event_id % 3 <> 0 AS ok, 1 AS attempts, 0 AS retry_count FROM s", VIEW)
def handler_results(spark, sf_dir):
    """A handler that tells a failure by its result, without an error: a permanent one, not tried again."""
    result = F.when(F.col("event_id") % 6 == 0, "TRANSIENT_FAILURE").when(F.col("event_id") % 3 == 0, "PERMANENT_FAILURE").otherwise("SUCCESS")
    handled = handler.handle(_view(spark, sf_dir), lambda: (result, F.lit(None).cast("string"), F.lit(None).cast("string")))
    return handled.select("p", "off", "classification", "ok", "attempts", "retry_count")


RETRIES = [(b, m, r) for b in (0, 10, 25, 50, 51, 1000) for m in (20, 50, 60000) for r in (1, 3, 10)]


@query(
    "SELECT b AS initial, m AS longest, r AS most, CAST(1 + least(r, coalesce((SELECT min(i) FROM (SELECT unnest(range(0, 11)) AS i) WHERE least(b * (2 ** i), m) > 50), 11)) AS BIGINT) AS attempts FROM (VALUES "
    + ", ".join(f"({b}, {m}, {r})" for b, m, r in RETRIES)
    + ") AS t(b, m, r)"
)
def retry_attempts(spark, sf_dir):
    df = spark.createDataFrame(RETRIES, "initial int, longest int, most int")
    return df.withColumn("attempts", scalars.attempts(*(F.col(c) for c in df.columns)))


# ---- health and signals


@query(
    "SELECT p, count(*) AS total_events, count(CASE WHEN failed THEN 1 END) AS failures, count(CASE WHEN failed THEN 1 END) / count(*) AS error_rate, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, CASE WHEN max(off) > min(off) THEN count(*) / (max(off) - min(off)) ELSE CAST(count(*) AS DOUBLE) END AS throughput FROM s GROUP BY p",
    VIEW,
)
def partition_health(spark, sf_dir):
    return health.partition_health(_view(spark, sf_dir))


@query("SELECT p, off, n, failures, failures / n AS error_rate FROM w", VIEW, RATES)
def sliding_error_rate(spark, sf_dir):
    return health.sliding_rates(_view(spark, sf_dir))


SLIDING = "quantile_disc(latency_ms, {q}) OVER (PARTITION BY p ORDER BY off RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS {n}"
PERCENTILES = "v AS (SELECT p, off, " + ", ".join(SLIDING.format(q=q, n=n) for q, n in health.QUANTILES) + " FROM s)"


@query("SELECT p, off, p50, p95, p99 FROM v", VIEW, PERCENTILES)
def sliding_percentiles(spark, sf_dir):
    return health.sliding_percentiles(_view(spark, sf_dir))


@query(
    ", t AS (SELECT p, off, n, off - min(off) OVER (PARTITION BY p) AS elapsed FROM w) SELECT p, off, n, CASE WHEN elapsed <= 0 THEN CAST(n AS DOUBLE) ELSE n / least(elapsed, 60) END AS throughput FROM t",
    VIEW,
    RATES,
)
def sliding_throughput(spark, sf_dir):
    return health.sliding_throughput(_view(spark, sf_dir))


def _errors(numerator: int) -> str:
    return f", x AS (SELECT *, failures * 10 >= n * {numerator} AS ex FROM w), y AS (SELECT *, coalesce(lag(ex) OVER (PARTITION BY p ORDER BY off), false) AS was FROM x) SELECT p, off, 'ERROR_RATE' AS type, failures / n AS current_value, CAST({numerator / 10} AS DOUBLE) AS threshold FROM y WHERE ex AND NOT was"


@query(_errors(3), VIEW, RATES)
def error_rate_signals(spark, sf_dir):
    return health.error_signals(_view(spark, sf_dir), 3, 10)


@query(_errors(5), VIEW, RATES)
def error_rate_signals_default(spark, sf_dir):
    return health.error_signals(_view(spark, sf_dir))


@query(
    ", x AS (SELECT *, p99 >= 200 AS ex FROM v), y AS (SELECT *, coalesce(lag(ex) OVER (PARTITION BY p ORDER BY off), false) AS was FROM x) SELECT p, off, 'LATENCY' AS type, p99 AS current_value, CAST(200 AS DOUBLE) AS threshold FROM y WHERE ex AND NOT was",
    VIEW,
    PERCENTILES,
)
def latency_signals(spark, sf_dir):
    return health.latency_signals(_view(spark, sf_dir), 200.0)


@query(
    "SELECT event_type, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v)) AS low, avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v)) AS high, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT event_type, CAST(event_id % 1000 AS BIGINT) AS v FROM events) GROUP BY event_type"
)
def trial_statistics(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", (F.col("event_id") % 1000).alias("v"))
    return health.trial_statistics(e, "v", "event_type")


# ---- breaker

PROBES = [(10, 10, 0, False), (5, 5, 0, False), (10, 9, 1, False), (5, 5, 0, True), (5, 3, 2, True), (0, 0, 0, True), (0, 0, 0, False)]


@query(
    "SELECT total, success, failure, timed_out, CASE WHEN total = 0 THEN 'CLOSED' WHEN failure > 0 OR timed_out THEN 'OPEN' WHEN success > 0 THEN 'CLOSED' ELSE 'OPEN' END AS state FROM (VALUES "
    + ", ".join(f"({a}, {b}, {c}, {d})" for a, b, c, d in PROBES)
    + ") AS t(total, success, failure, timed_out)"
)
def probe_decisions(spark, sf_dir):
    df = spark.createDataFrame(PROBES, "total int, success int, failure int, timed_out boolean")
    return df.withColumn("state", scalars.probe_decision(*(F.col(c) for c in df.columns)))


# ---- dead letters

KINDS = ["TransientProcessingException", "PermanentProcessingException", "DeserializationException", "ValidationException", "java.lang.IllegalStateException"]


@query(
    "SELECT error_class, CASE error_class WHEN 'TransientProcessingException' THEN 'TRANSIENT' WHEN 'DeserializationException' THEN 'DESERIALIZATION' WHEN 'ValidationException' THEN 'VALIDATION' ELSE 'PERMANENT' END AS classification FROM (VALUES "
    + ", ".join(f"('{k}')" for k in KINDS)
    + ") AS t(error_class)"
)
def classify_errors(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in KINDS], "error_class string").withColumn("classification", scalars.classify(F.col("error_class")))


DESTINATION = "CASE classification WHEN 'TRANSIENT' THEN 'group.dlq.transient' WHEN 'VALIDATION' THEN 'group.dlq.validation' ELSE 'group.dlq.unclassified' END"


@query(f"SELECT p, off, classification, {DESTINATION} AS destination FROM h WHERE NOT ok", VIEW, HANDLED)
def select_topics(spark, sf_dir):
    return dead_letters.route(_handled(spark, sf_dir), "events", EPOCH + F.col("off"), LETTERS).select("p", "off", "classification", "destination")


HEADER_SQL = {
    "original_topic": "'events'",
    "original_partition": "CAST(p AS VARCHAR)",
    "original_offset": "CAST(off AS VARCHAR)",
    "error_classification": "classification",
    "failure_timestamp": f"strftime(make_timestamp(({EPOCH} + off) * 1000000), '%Y-%m-%dT%H:%M:%SZ')",
    "retry_count": "CAST(retry_count AS VARCHAR)",
    "source_entity": "entity",
    "exception_class": "error_class",
    "exception_message": "error_message",
    "correlation_id": "sha256('events|' || CAST(p AS VARCHAR) || '|' || CAST(off AS VARCHAR))",
}


@query(f"SELECT p, off, entity AS \"key\", {', '.join(f'{v} AS {k}' for k, v in HEADER_SQL.items())} FROM h WHERE NOT ok", VIEW, HANDLED)
def dead_letter_headers(spark, sf_dir):
    letters = dead_letters.route(_handled(spark, sf_dir), "events", EPOCH + F.col("off"), LETTERS)
    return letters.select("p", "off", "key", *(F.col("headers")[f"x-dlq-{k.replace('_', '-')}"].alias(k) for k in HEADER_SQL))


@query("SELECT conv_id, turn, substring(coalesce(text, ''), 1, 1000) AS message FROM conversations")
def exception_messages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.substring(F.coalesce("text", F.lit("")), 1, dead_letters.MESSAGE_LENGTH).alias("message"))


@query(", n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY off) AS nth FROM h WHERE NOT ok) SELECT p, off, CASE WHEN nth <= 100 THEN 'BUFFERED' ELSE 'BUFFER_FULL' END AS routing FROM n", VIEW, HANDLED)
def dead_letter_buffer(spark, sf_dir):
    letters = dead_letters.route(_handled(spark, sf_dir), "events", EPOCH + F.col("off"), LETTERS)
    return dead_letters.buffered(letters, 100).select("p", "off", "routing")


@query("SELECT i AS attempts, CAST(least(1000 * (2 ** least(i, 20)), 60000) AS BIGINT) AS wait_ms FROM (SELECT unnest(range(0, 31)) AS i)")
def route_backoff(spark, sf_dir):
    return spark.range(31).select(F.col("id").alias("attempts"), scalars.backoff(1000, 60_000, F.col("id")).alias("wait_ms"))


@query("SELECT off, attempts, off * 100 + least(1000 * (2 ** attempts), 60000) <= 60000 AS due, attempts + 1 > 10 AS alert FROM (SELECT off, off % 12 AS attempts FROM h WHERE NOT ok AND p = 0)", VIEW, HANDLED)
def route_retries(spark, sf_dir):
    entries = _handled(spark, sf_dir).where("not ok and p = 0").select("off", (F.col("off") % 12).alias("attempts"), (F.col("off") * 100).alias("last_attempt"))
    return dead_letters.retry_due(entries, 60_000).select("off", "attempts", "due", "alert")


@query("SELECT p, off, attempts, off * 100 + least(1000 * (2 ** attempts), 60000) <= 60000 AS due, attempts + 1 > 10 AS alert FROM (SELECT p, off, off % 12 AS attempts FROM h WHERE NOT ok)", VIEW, HANDLED)
def route_retries_all_partitions(spark, sf_dir):
    """The retry pass over the dead letters of every partition; route_retries and its SQL judge partition 0 only."""
    entries = _handled(spark, sf_dir).where("not ok").select("p", "off", (F.col("off") % 12).alias("attempts"), (F.col("off") * 100).alias("last_attempt"))
    return dead_letters.retry_due(entries, 60_000).select("p", "off", "attempts", "due", "alert")


# ---- offsets and metrics


@query("SELECT p, max(off) + 1 AS next_offset FROM s GROUP BY p", VIEW)
def committed_offsets(spark, sf_dir):
    return metrics.committed_offsets(_view(spark, sf_dir))


@query(
    "SELECT p, count(CASE WHEN ok THEN 1 END) AS events_processed, count(CASE WHEN NOT ok THEN 1 END) AS events_failed, "
    + ", ".join(f"count(CASE WHEN classification = '{k}' THEN 1 END) AS dlq_{k.lower()}" for k in ("DESERIALIZATION", "VALIDATION", "TRANSIENT", "PERMANENT"))
    + " FROM h GROUP BY p",
    VIEW,
    HANDLED,
)
def event_counters(spark, sf_dir):
    return metrics.counters(_handled(spark, sf_dir))


@query("SELECT p, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM h WHERE ok GROUP BY p", VIEW, HANDLED)
def latency_timer(spark, sf_dir):
    return metrics.latency_timer(_handled(spark, sf_dir))


TRANSITIONS = """w AS (
  SELECT p, off, count(*) OVER f AS n, count(CASE WHEN failed THEN 1 END) OVER f AS failures FROM s
  WINDOW f AS (PARTITION BY p ORDER BY off RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN failures * 10 >= n * 3 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM w),
y AS (SELECT p, off, coalesce(lag(state) OVER (PARTITION BY p ORDER BY off), 'CLOSED') AS from_state, state FROM x),
z AS (SELECT * FROM y WHERE state <> from_state)"""


def _transitions(spark, sf_dir):
    return health.transitions(_view(spark, sf_dir))


@query("SELECT p, from_state, state, count(*) AS n FROM z GROUP BY p, from_state, state", VIEW, TRANSITIONS)
def transition_counters(spark, sf_dir):
    return metrics.transition_counts(_transitions(spark, sf_dir))


@query(
    ", l AS (SELECT p, arg_max(state, off) AS state FROM z GROUP BY p), g AS (SELECT p, arg_max(depth, off) AS buffer_depth FROM deep GROUP BY p), c AS (SELECT p, count(DISTINCT entity || ':' || seq) AS store_size FROM s WHERE NOT failed GROUP BY p) SELECT g.p, CAST(CASE l.state WHEN 'OPEN' THEN 1 ELSE 0 END AS INTEGER) AS circuit_state, buffer_depth, coalesce(store_size, 0) AS store_size FROM g LEFT JOIN l ON g.p = l.p LEFT JOIN c ON g.p = c.p",
    VIEW,
    ORDERED,
    DEEP,
    TRANSITIONS,
)
def partition_gauges(spark, sf_dir):
    v = _view(spark, sf_dir)
    return metrics.gauges(_transitions(spark, sf_dir), sequence.depth(v), dedup.store_size(v))


@query(
    ", l AS (SELECT p, arg_max(state, off) AS state FROM z GROUP BY p) SELECT CASE WHEN count(CASE WHEN state = 'OPEN' THEN 1 END) > 0 THEN 'DOWN' ELSE 'UP' END AS status, count(CASE WHEN state = 'CLOSED' THEN 1 END) AS closed, count(CASE WHEN state = 'OPEN' THEN 1 END) AS open, count(CASE WHEN state = 'HALF_OPEN' THEN 1 END) AS half_open, coalesce(string_agg(CASE WHEN state = 'OPEN' THEN 'events-' || CAST(p AS VARCHAR) END, ',' ORDER BY p), '') AS open_partitions FROM l",
    VIEW,
    TRANSITIONS,
)
def health_indicator(spark, sf_dir):
    last = _transitions(spark, sf_dir).groupBy("p").agg(F.max_by("state", "off").alias("state"))
    return metrics.health_indicator(last, "events")


@query(
    """, k AS (SELECT *, coalesce(bool_or(NOT failed) OVER (PARTITION BY p, entity, seq ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup FROM d)
SELECT p, off, sha256('events|' || CAST(p AS VARCHAR) || '|' || CAST(off AS VARCHAR)) AS correlation_id,
  CASE WHEN event_id % 97 = 3 THEN 'DESERIALIZE' WHEN disposition IN ('BELOW_ANCHOR', 'AFTER_RELEASE') THEN CASE WHEN dup THEN 'DEDUPLICATION' ELSE 'REORDER' END
  WHEN disposition = 'REPLACED' THEN 'REORDER' ELSE 'BUSINESS_LOGIC' END AS stage FROM k""",
    VIEW,
    ORDERED,
)
def pipeline_stages(spark, sf_dir):
    d = sequence.stages(dedup.mark_after_success(sequence.dispositions(_view(spark, sf_dir))), F.col("event_id") % 97 == 3)
    return d.select("p", "off", scalars.correlation_id(F.lit("events")).alias("correlation_id"), "stage")


@query(
    ", l AS (SELECT p, arg_max(state, off) AS state FROM z GROUP BY p), g AS (SELECT p, arg_max(depth, off) AS depth FROM deep GROUP BY p) SELECT 'group' AS consumer_group, 'UNKNOWN' AS status, count(*) AS partitions, string_agg(CAST(g.p AS VARCHAR) || '=' || coalesce(state, 'CLOSED'), ',' ORDER BY g.p) AS states, string_agg(CAST(g.p AS VARCHAR) || '=' || CAST(depth AS VARCHAR), ',' ORDER BY g.p) AS depths FROM g LEFT JOIN l ON g.p = l.p",
    VIEW,
    ORDERED,
    DEEP,
    TRANSITIONS,
)
def group_health_status(spark, sf_dir):
    last = _transitions(spark, sf_dir).groupBy("p").agg(F.max_by("state", "off").alias("state"))
    row = metrics.health_status(last, sequence.depth(_view(spark, sf_dir)), "group")
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return row.select("consumer_group", "status", "partitions", flat("states"), flat("depths"))
