"""Pass 2 over a stream of segments: what a chapter's batches have come to is kept as state, with timers for retries.

For each chapter the state holds segments that wait, how many batches failed, and how often the batch at hand was
tried. A full batch is tried at once; one whose attempt fails is tried again after a pause; after `limit` failed
batches the chapter goes on with single segments. What is left over when a chapter has been quiet for a while is
its last batch. State and outputs are of one micro-batch, so a restart goes on where the last one ended.
"""

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkwell.operators import classify

SEGMENT = "pos INT, segment_id STRING, text STRING, context_before STRING, context_after STRING"
ANSWER = "chapter_id STRING, pos INT, batch INT, batch_size INT, ok BOOLEAN, attempts INT, repair_attempts INT, item STRING, error STRING"
STATE = "failures INT, batch INT, attempt INT, mended INT, error STRING"


class Ladder(StatefulProcessor):
    def __init__(self, model: Callable, size: int, limit: int, attempts: int, pause_ms: int, quiet_ms: int, repair, repairs: int):
        import inspect

        self.model, self.plain = model, len(inspect.signature(model).parameters) == 1
        self.size, self.limit, self.attempts, self.pause, self.quiet = size, limit, attempts, pause_ms, quiet_ms
        self.repair, self.repairs = repair, repairs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.run = handle.getListState("waiting", SEGMENT), handle.getValueState("run", STATE)

    def _advance(self, key, now: int, rest: bool) -> Iterator:
        """Tries batches as long as they go well; rest tells that what is left over is a batch too."""
        import pandas as pd

        rows = sorted({tuple(r) for r in self.waiting.get()}, key=lambda r: r[0])
        failures, batch, attempt, mended, error = self.run.get() if self.run.exists() else (0, 0, 0, 0, "no reply")
        out, due = [], None
        while rows:
            n = 1 if failures >= self.limit else self.size
            if len(rows) < n and not rest and not attempt:
                break
            part = rows[:n]
            ids = [r[1] for r in part]
            error, got, more = classify.attempted(self.model, self.plain, attempt, error, classify.question(ids, *zip(*(r[2:] for r in part))), ids, self.repair, self.repairs - mended)
            attempt, mended = attempt + 1, mended + more
            if error is not None and attempt < self.attempts:
                due = now + self.pause
                break
            out += [(key[0], r[0], batch, len(part), error is None, attempt, mended, json.dumps(got[i]) if error is None else None, error) for r, i in zip(part, ids)]
            failures, batch, rows = failures + (error is not None), batch + 1, rows[n:]
            attempt, mended, error = 0, 0, "no reply"
        self.waiting.put(rows) if rows else self.waiting.clear()
        self.run.update((failures, batch, attempt, mended, error))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.handle.registerTimer(due if due is not None else now + self.quiet)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ANSWER.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fresh = [(int(p), str(i), t, b, a) for frame in rows for p, i, t, b, a in zip(frame["pos"], frame["segment_id"], frame["text"], frame["context_before"], frame["context_after"])]
        self.waiting.appendList(fresh)
        if self.run.exists() and self.run.get()[2]:  # a batch waits for its next attempt
            return iter(())
        return self._advance(key, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        return self._advance(key, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def answers(segments: DataFrame, model: Callable, size: int = 20, limit: int = 3, attempts: int = 3, pause_ms: int = 1000, quiet_ms: int = 5000, repair=None, repairs: int = 1) -> DataFrame:
    """A stream of ANSWER rows from a stream of segments (chapter_id and SEGMENT), each chapter's in order.

    Needs the RocksDB state store. A segment that arrives twice while it waits counts once.
    """
    processor = Ladder(model, size, limit, attempts, pause_ms, quiet_ms, repair, repairs)
    return segments.groupBy("chapter_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=ANSWER, outputMode="Append", timeMode="ProcessingTime")


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a folder of its own that a replay overwrites, so no call is logged twice."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return write
