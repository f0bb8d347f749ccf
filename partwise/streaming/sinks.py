"""A dead-letter sink that bears with an outage: what cannot be sent is staged, up to a limit, and sent later."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DeadLetterSettings
from ..operators.dead_letters import retry_due


class BufferFull(RuntimeError):
    """The staged letters have reached the limit: the batch fails, and the checkpoint brings it again."""


def by_topic(path: str, format: str = "parquet") -> Callable[[DataFrame, str], None]:
    """A function that writes letters to a folder for each topic; one with the same tag again replaces what it wrote."""

    def send(letters: DataFrame, tag: str) -> None:
        letters.write.mode("overwrite").partitionBy("topic").format(format).save(f"{path}/{tag}")

    return send


class DeadLetterSink:
    """send(letters, tag) writes letters to their topics and raises if it cannot; tag names the batch.

    Staged letters are a table of immutable parts in path, which a sink finds again after a restart: numbered folders, add (more
    letters) or base (all that is left, in place of every part with a lower number). A part counts once it is written whole;
    those it replaces are deleted after that. So no letter is lost whatever fails when, and one may be sent twice.
    """

    def __init__(self, spark: SparkSession, send: Callable[[DataFrame, str], None], path: str, settings: DeadLetterSettings = DeadLetterSettings(), alert: Callable[[str], None] = print):
        self.spark, self.send, self.path, self.settings, self.alert = spark, send, path.rstrip("/"), settings, alert

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self) -> list[tuple[int, str, str]]:
        """(number, kind, path) of all whole parts, by number."""
        make, folder, files = self._files()
        if not files.exists(folder):
            return []
        out = []
        for status in files.listStatus(folder):
            m = re.fullmatch(r"(\d+)-(add|base)-[0-9a-f]+", status.getPath().getName())
            if m and files.exists(make(status.getPath(), "_SUCCESS")):
                out.append((int(m[1]), m[2], status.getPath().toString()))
        return sorted(out)

    def parts(self) -> list[str]:
        """The paths of the parts that count."""
        found = self._parts()
        base = max((n for n, kind, _ in found if kind == "base"), default=0)
        return [p for n, _, p in found if n >= base]

    def staged(self) -> DataFrame | None:
        parts = self.parts()
        return self.spark.read.parquet(*parts) if parts else None

    def depth(self) -> int:
        staged = self.staged()
        return 0 if staged is None else staged.count()

    def _stage(self, letters: DataFrame, kind: str) -> None:
        number = max((n for n, _, _ in self._parts()), default=0) + 1
        letters.write.parquet(f"{self.path}/{number:012d}-{kind}-{uuid.uuid4().hex}")

    def _replace(self, letters: DataFrame) -> None:
        """Stages letters as all that is left, then deletes the parts before."""
        old = [p for _, _, p in self._parts()]
        self._stage(letters, "base")
        make, _, files = self._files()
        for p in old:
            files.delete(make(p), True)

    def route(self, letters: DataFrame, now: int, tag: str = "letters") -> str:
        """ROUTED, or BUFFERED if the sink is down; raises BufferFull rather than lose a letter."""
        try:
            self.send(letters, tag)
            return "ROUTED"
        except Exception as e:  # noqa: BLE001 - any failure of a sink is an outage
            reason = e
        room = self.settings.max_buffer_size - self.depth()
        if letters.limit(room + 1).count() > room:
            self.alert(f"dead letters: the buffer is full ({self.settings.max_buffer_size})")
            raise BufferFull(f"{self.settings.max_buffer_size} letters are staged") from reason
        self._stage(letters.withColumns({"attempts": F.lit(1), "last_attempt": F.lit(now).cast("long")}), "add")
        return "BUFFERED"

    def retry(self, now: int, tag: str = "retry") -> int:
        """One pass over what is staged: letters whose wait is over are sent; how many went. None is ever dropped."""
        staged = self.staged()
        if staged is None:
            return 0
        table = retry_due(staged, now, self.settings).persist()
        try:
            due = table.where("due").drop("due", "alert", "attempts", "last_attempt")
            n = due.count()
            if not n:
                return 0
            try:
                self.send(due, tag)
            except Exception:  # noqa: BLE001
                if late := table.where("due and alert").count():
                    self.alert(f"dead letters: {late} still cannot be sent after {self.settings.max_route_attempts} attempts")
                again = table.withColumns({"attempts": F.expr("attempts + cast(due as int)"), "last_attempt": F.when(F.col("due"), F.lit(now)).otherwise(F.col("last_attempt"))})
                self._replace(again.drop("due", "alert"))
                return 0
            self._replace(table.where("not due").drop("due", "alert"))
            return n
        finally:
            table.unpersist()
