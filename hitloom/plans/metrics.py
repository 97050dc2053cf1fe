"""What runs did, as rows of the stored table ``runs``: batch runs, batches of a stream, and streams.

A run that fails or finds nothing has its row too.  Counting rides along with the run's own first action, so
nothing is read twice.
"""

from __future__ import annotations

import datetime
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from hitloom.plans.tables import OWN_SCHEMAS, Tables

#: Seconds to wait for what an action has counted; a run without any action has counted nothing.
PATIENCE = 5.0
#: Letters of an error that are kept.
MESSAGE = 500


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


def append_run(tables: Tables, run: str, kind: str, started: datetime.datetime, status: str, rows: int | None, size: int | None, message: str | None) -> None:
    ended = _now()
    line = (started.date(), run, started, ended, kind, status, rows, size, message[:MESSAGE] if message else None)
    one = tables.spark.createDataFrame([line], OWN_SCHEMAS["runs"])
    one.coalesce(1).write.mode("append").partitionBy("day").parquet(tables.path("runs"))


class Run:
    """A run that is under way; ``watch`` what it reads."""

    def __init__(self) -> None:
        self._seen: Observation | None = None

    def watch(self, rows: DataFrame, size: str | None = None) -> DataFrame:
        """The same rows; the first action over them counts them, and sums column ``size``."""
        self._seen = Observation(f"run-{uuid.uuid4().hex}")
        total = F.sum(size) if size else F.lit(0)
        return rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).cast("bigint").alias("bytes"))

    def counted(self) -> tuple[int | None, int | None]:
        """Rows and bytes; nothing where no action has run over them."""
        found: list[dict] = []
        if self._seen is not None:
            waiting = threading.Thread(target=lambda: found.append(self._seen.get), daemon=True)
            waiting.start()
            waiting.join(PATIENCE)
        return (found[0].get("rows"), found[0].get("bytes")) if found else (None, None)


@contextmanager
def recorded(tables: Tables, kind: str, run: str | None = None) -> Iterator[Run]:
    """Appends a row when the block ends: ``done``, ``empty`` if it saw no rows, or ``failed``, and then the error goes on."""
    started, mine = _now(), Run()
    try:
        yield mine
    except BaseException as error:
        append_run(tables, run or uuid.uuid4().hex, kind, started, "failed", None, None, f"{type(error).__name__}: {error}")
        raise
    rows, size = mine.counted()
    append_run(tables, run or uuid.uuid4().hex, kind, started, "empty" if rows == 0 else "done", rows, size, None)


class StreamRuns(StreamingQueryListener):
    """Appends a row for each streaming query of the session that ends, under its name or ``stream``: also
    one that finds nothing new, or fails before its first batch."""

    def __init__(self, tables: Tables):
        self._tables, self._begun, self._rows = tables, {}, {}

    def onQueryStarted(self, event) -> None:
        self._begun[str(event.runId)] = (_now(), event.name or "stream")

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._rows[run] = self._rows.get(run, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        started, name = self._begun.pop(run, (_now(), "stream"))
        rows = self._rows.pop(run, 0)
        status = "failed" if event.exception else "done" if rows else "empty"
        append_run(self._tables, run, name, started, status, rows, None, event.exception)


def record_streams(tables: Tables) -> StreamRuns:
    """Records the streams of the session from now on, until ``spark.streams.removeListener``."""
    listener = StreamRuns(tables)
    tables.spark.streams.addListener(listener)
    return listener
