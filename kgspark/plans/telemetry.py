"""Progress of long work: phases with their seconds, counts, and events for whoever listens."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Telemetry:
    """Phases and counts of one run. Events: phase_start, phase_end, phase_skip, counts_update, complete, failed."""

    phases: list[tuple[str, float]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    listeners: list[queue.Queue] = field(default_factory=list)
    clock: Callable[[], float] = time.monotonic

    def subscribe(self, size: int = 64) -> queue.Queue:
        """A queue of events; a listener that doesn't keep up loses events, the work doesn't wait."""
        q: queue.Queue = queue.Queue(size)
        self.listeners.append(q)
        return q

    def unsubscribe(self, q: queue.Queue) -> None:
        if q in self.listeners:
            self.listeners.remove(q)

    def emit(self, kind: str, **data) -> None:
        for q in list(self.listeners):
            try:
                q.put_nowait({"event": kind, **data})
            except queue.Full:
                pass

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        self.emit("phase_start", phase=name)
        begin = self.clock()
        try:
            yield
        except Exception as e:
            self.emit("failed", phase=name, error=f"{type(e).__name__}: {e}"[:200])
            raise
        seconds = self.clock() - begin
        self.phases.append((name, seconds))
        self.emit("phase_end", phase=name, seconds=seconds)

    def skip(self, name: str) -> None:
        self.emit("phase_skip", phase=name)

    def count(self, **counts: int) -> None:
        self.counts.update(counts)
        self.emit("counts_update", **counts)

    def complete(self) -> dict:
        out = {"total_seconds": sum(s for _, s in self.phases), "phases": [{"name": n, "seconds": s} for n, s in self.phases], "counts": dict(self.counts)}
        self.emit("complete", **out)
        return out


class _Progress(StreamingQueryListener):
    def __init__(self, telemetry: Telemetry):
        self.telemetry = telemetry

    def onQueryStarted(self, event) -> None:
        self.telemetry.emit("stream_start", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.telemetry.emit("stream_progress", id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.telemetry.emit("stream_end", id=str(event.id))


def follow_streams(spark: SparkSession, telemetry: Telemetry) -> StreamingQueryListener:
    """Events of the session's streams go to ``telemetry`` too; the listener is returned for removal."""
    listener = _Progress(telemetry)
    spark.streams.addListener(listener)
    return listener
