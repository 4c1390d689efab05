"""Ordered folds over streams.

The rows of a key wait in its state until the watermark has passed their time; then a
timer hands them to the fold in order, so that rows which arrive late, but within the
watermark, get the same answer as in a fold over stored rows. Rows behind the watermark
are dropped by Spark. A key without rows and with a finished state holds nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DELAY = "spark.watermarkDelayMs"


def event_time(stream: DataFrame) -> str:
    """The column that the stream's watermark is on."""
    for field in stream.schema:
        if DELAY in (field.metadata or {}):
            return field.name
    raise ValueError("an ordered fold over a stream needs a watermark")


class Fold(StatefulProcessor):
    def __init__(self, time: str, order: list[str], begin: Callable[[], object], step: Callable, names: list[str], added: list[str]):
        self.time, self.order, self.begin, self.step, self.names, self.added = time, order, begin, step, names, added

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("row", T.BinaryType())]))
        self.state = handle.getValueState("state", T.StructType([T.StructField("state", T.BinaryType())]))

    def _timer(self, rows: list[dict]) -> None:
        self.handle.registerTimer(int(min(r[self.time] for r in rows).timestamp() * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [r.asDict() for r in rows]
        new = [r for r in new if r[self.time] is not None]
        if new:
            self.waiting.appendList([(pickle.dumps(r),) for r in new])
            self._timer(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [pickle.loads(bytes(r[0])) for r in self.waiting.get()]
        ready = [r for r in rows if int(r[self.time].timestamp() * 1000) <= passed]
        left = [r for r in rows if int(r[self.time].timestamp() * 1000) > passed]
        ready.sort(key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        state = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.begin()
        for row in ready:
            state, values = self.step(state, row)
            yield Row(*self.names, *self.added)(*(row[c] for c in self.names), *values)
        self.state.update((pickle.dumps(state),))
        if left:
            self.waiting.put([(pickle.dumps(r),) for r in left])
            self._timer(left)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def streamed_fold(stream: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable, added: T.StructType) -> DataFrame:
    """stream with the columns that step returns; order must begin with what follows the event time."""
    names = stream.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema] + added.fields)
    fold = Fold(event_time(stream), order, begin, step, names, added.names)
    return stream.groupBy(*keys).transformWithState(fold, schema, "Append", "EventTime")
