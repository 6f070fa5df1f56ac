"""Progress of runs as a stateful stream: each run reports lines (phase, amount), is shown as waiting while it is silent, and
ends when it was silent for too long.

For each run the state holds the lines so far and the time of the last one. A batch puts out a row for each phase that
reported in it, with what came in this batch, so the rows of a phase add up to its total whatever the batches were. A timer
is set ``beat`` behind the last line; when the watermark passes it without a new one the run gets a row of kind waiting and
the next timer, and after ``quiet`` in all a row of kind ended, and its state goes. A line after that begins a new run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run_id long, kind string, phase string, n long, amount long, lines long, at long"
OUT = Row("run_id", "kind", "phase", "n", "amount", "lines", "at")
BEAT, QUIET = 15 * 60, 60 * 60


class Progress(StatefulProcessor):
    """Over lines (run_id, phase, amount, at); times are milliseconds. Plain rows: a table of pandas for each run and
    each question to the state cost far more than the few lines of a run. A run has one timer, whose time is in its state."""

    def __init__(self, beat: int, quiet: int):
        self.beat, self.quiet = beat * 1000, quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "lines long, last long, wake long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        lines, last, wake = self.run.get() or (0, 0, None)
        got: dict[str | None, list[int]] = {}
        for row in rows:
            held = got.setdefault(row.phase, [0, 0])
            held[0], held[1] = held[0] + 1, held[1] + (row.amount or 0)
            lines, last = lines + 1, max(last, row.at or 0)
        if wake != last + self.beat:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(last + self.beat)
        self.run.update((lines, last, last + self.beat))
        for phase, (n, amount) in got.items():
            yield OUT(key[0], "progress", phase, n, amount, lines, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """All that is due by now, in however few batches; the timer that has expired goes by itself."""
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        lines, last, _ = self.run.get()
        while at - last < self.quiet:
            yield OUT(key[0], "waiting", None, 0, 0, lines, at)
            at = min(at + self.beat, last + self.quiet)
            if at > now:
                self.handle.registerTimer(at)
                self.run.update((lines, last, at))
                return
        self.run.clear()
        yield OUT(key[0], "ended", None, 0, 0, lines, at)

    def close(self) -> None:
        pass


def progress(lines: DataFrame, late: str = "10 minutes", beat: int = BEAT, quiet: int = QUIET) -> DataFrame:
    """The feed over a stream of ``lines`` (run_id, phase, amount, ts)."""
    held = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return held.groupBy("run_id").transformWithState(Progress(beat, quiet), SCHEMA, "Update", "EventTime").withColumn("at", F.timestamp_millis("at"))


def fed(lines: DataFrame, out: str, checkpoint: str, **more) -> None:
    """Write the feed of all that is there; a batch replaces what an earlier try of it left."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = progress(lines, **more).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
