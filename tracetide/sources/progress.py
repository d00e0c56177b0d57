"""How far the reading of VCD files has come: bytes, steps and changes so far, for batch reads and streams of the registered source.

Both tell what is known to be done, so that figures never fall: bytes of a batch are
those of as many tasks' ranges as tasks have ended, the smallest taken first; bytes of a
stream are the offsets of its last micro-batch, which outlive a restart. At the end both
are the files' sizes (a stream without `complete` stops before each file's last record).
An empty path gives zeros.
"""

from __future__ import annotations

import json
import threading
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tracetide.sources.vcd_source import SPLIT_BYTES, ChangeReader


class Progress(NamedTuple):
    files: int
    bytes: int
    steps: int
    changes: int


def _counts() -> list:
    """A change is a row with a code, a step one without."""
    code = F.col("code")
    return [F.count(F.when(code.isNull(), 1)).alias("steps"), F.count(code).alias("changes")]


class ReadProgress:
    """A batch read, followed from other threads.

    with ReadProgress(spark, path) as p: p.counted(rows).write...  and p.bytes() meanwhile. `split` is the source's splitBytes.
    The scan is taken to be the first stage of the block's jobs that has as many tasks as the read.
    """

    def __init__(self, spark: SparkSession, path: str, split: int = SPLIT_BYTES):
        self.context = spark.sparkContext
        parts = ChangeReader(path, split).partitions()
        self.files = len({r.file for p in parts for r in p.ranges})
        self.sizes = sorted(p.size for p in parts)
        self.total = sum(self.sizes)
        self.group = f"vcd-{uuid.uuid4().hex}"
        self._observed = Observation()
        self._most = 0

    def __enter__(self) -> ReadProgress:
        self._outer = [(k, self.context.getLocalProperty(k)) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
        self.context.setJobGroup(self.group, "VCD read")
        return self

    def __exit__(self, *_) -> None:
        for k, v in self._outer:
            self.context.setLocalProperty(k, v)

    def counted(self, rows: DataFrame) -> DataFrame:
        """rows of the source, whose steps and changes are counted as they pass; once for a ReadProgress."""
        return rows.observe(self._observed, *_counts())

    def bytes(self) -> int:
        """Bytes that are known to be read."""
        tracker = self.context.statusTracker()
        jobs = filter(None, map(tracker.getJobInfo, tracker.getJobIdsForGroup(self.group)))
        stages = filter(None, (tracker.getStageInfo(s) for s in sorted(s for j in jobs for s in j.stageIds)))
        done = next((s.numCompletedTasks for s in stages if s.numTasks == len(self.sizes)), 0)
        self._most = max(self._most, sum(self.sizes[:done]))
        return self._most

    def ended(self) -> Progress:
        """The whole read, after its action; waits for the counts."""
        seen = self._observed.get
        return Progress(self.files, self.total, seen["steps"], seen["changes"])


class StreamProgress(StreamingQueryListener):
    """Streams whose rows went through `counted`, one after another with one checkpoint; add it by spark.streams.addListener.

    `history` has a row for each micro-batch that read something. Counts begin with this object, bytes with the checkpoint.
    """

    def __init__(self):
        self.name = f"vcd-{uuid.uuid4().hex}"
        self.history: list[Progress] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def counted(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.name, *_counts())

    @property
    def now(self) -> Progress:
        return self.history[-1] if self.history else Progress(0, 0, 0, 0)

    def wait(self, run_id, timeout: float = 60.0) -> Progress:
        """The figures once the query's end was told: events follow a query by a moment."""
        with self._change:
            if not self._change.wait_for(lambda: str(run_id) in self._ended, timeout):
                raise TimeoutError(f"no end of {run_id} was told within {timeout} s")
            return self.now

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        at: dict[str, int] = {}
        for source in event.progress.sources:
            found = json.loads(source.endOffset or "null")
            at |= found if isinstance(found, dict) and all(isinstance(x, int) for x in found.values()) else {}
        with self._change:
            last = self.now
            new = Progress(len(at), sum(at.values()), last.steps + seen["steps"], last.changes + seen["changes"])
            if new != last:
                self.history.append(new)

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()
