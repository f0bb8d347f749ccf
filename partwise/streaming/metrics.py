"""Live metrics of a running pipeline: counters and gauges by partition, and an endpoint that a scraper reads."""

from __future__ import annotations

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CIRCUIT_STATES


class Metrics:
    """update() adds a micro-batch of output rows, summed up to a row for each partition and kind before it meets the driver;
    a partition registers with its first row. unregister() forgets one."""

    def __init__(self):
        self.counters: Counter = Counter()
        self.states: dict[tuple[str, int], str] = {}
        self._lock = threading.Lock()

    def update(self, rows: DataFrame) -> None:
        what = F.when(F.col("disposition").isin("TRANSITION"), F.col("detail")).otherwise(F.col("classification"))
        sums = rows.groupBy("topic", "partition", "disposition", what.alias("what")).agg(F.count("*").alias("n"))
        last = rows.withColumn("__place", F.monotonically_increasing_id()).where("disposition = 'TRANSITION'")
        last = last.groupBy("topic", "partition").agg(F.max_by(F.element_at(F.split("detail", ">"), -1), "__place").alias("state"))
        found, turned = sums.collect(), last.collect()
        with self._lock:
            for r in found:
                key = (r["topic"], r["partition"])
                self.states.setdefault(key, "CLOSED")
                self.counters[(*key, r["disposition"], r["what"])] += r["n"]
            self.states.update({(r["topic"], r["partition"]): r["state"] for r in turned})

    def unregister(self, topic: str, partition: int) -> None:
        with self._lock:
            self.states.pop((topic, partition), None)
            for k in [k for k in self.counters if k[:2] == (topic, partition)]:
                del self.counters[k]

    def render(self) -> str:
        """The metrics as text in the usual exposition format."""
        out = []
        with self._lock:
            for (topic, p), state in sorted(self.states.items()):
                out.append(f'circuit_breaker_state{{topic="{topic}",partition="{p}"}} {CIRCUIT_STATES.index(state)}')
            for (topic, p, disposition, what), n in sorted(self.counters.items(), key=str):
                at = f'topic="{topic}",partition="{p}"'
                if disposition == "PROCESSED":
                    out.append(f"events_processed_total{{{at}}} {n}")
                elif disposition == "DLQ":
                    out.append(f'events_failed_total{{{at},classification="{what}"}} {n}')
                    out.append(f'dlq_routed_total{{{at},classification="{what}"}} {n}')
                elif disposition == "TRANSITION":
                    old, new = what.split(">")
                    out.append(f'circuit_breaker_transitions_total{{{at},from="{old}",to="{new}"}} {n}')
                else:
                    out.append(f'rows_total{{{at},disposition="{disposition}"}} {n}')
        return "\n".join(out) + "\n"

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Serves render() at /metrics in a thread of its own; port 0: any free one. Stop with shutdown()."""
        metrics = self

        class Page(BaseHTTPRequestHandler):
            def do_GET(self):
                body = metrics.render().encode() if self.path == "/metrics" else b""
                self.send_response(200 if body else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Page)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
