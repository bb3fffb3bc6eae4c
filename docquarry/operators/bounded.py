"""A map over rows for work that may hang, raise or crash: each item has a time limit, and a failure is a value of its row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from multiprocessing import get_context
from multiprocessing.connection import wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Work = Callable[[str], object]
TIMEOUT = "timeout"


def _serve(link, work: Work) -> None:
    while True:
        item = link.recv()
        try:
            link.send((json.dumps(work(item)), None))
        except Exception as failure:  # whatever the work raises is the item's result
            link.send((None, f"{type(failure).__name__}: {failure}"))


class _Lane:
    """A process that does one item after the other and may be stopped at any time."""

    def __init__(self, work: Work):
        context = get_context("fork")
        self.link, far = context.Pipe()
        self.process = context.Process(target=_serve, args=(far, work), daemon=True)
        self.process.start()
        far.close()
        self.item, self.until = -1, 0.0

    def begin(self, item: int, value: str, seconds: float) -> None:
        self.item, self.until = item, time.monotonic() + seconds
        self.link.send(value)

    def stop(self) -> None:
        self.process.kill()
        self.process.join()
        self.link.close()


def run_all(values: list[str | None], work: Work, seconds: float, lanes: int) -> list[tuple[str | None, str | None]]:
    """(result as JSON, error) of each value in order, by at most ``lanes`` processes at a time; a null value has neither."""
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(values)
    waiting = iter([k for k, value in enumerate(values) if value is not None])
    busy: list[_Lane] = []

    def give(lane: _Lane) -> None:
        k = next(waiting, None)
        if k is None:
            lane.stop()
        else:
            lane.begin(k, values[k], seconds)
            busy.append(lane)

    try:
        for _ in range(min(lanes, sum(value is not None for value in values))):
            give(_Lane(work))
        while busy:
            ready = wait([lane.link for lane in busy], max(min(lane.until for lane in busy) - time.monotonic(), 0.0))
            for lane in list(busy):
                late = lane.until <= time.monotonic()
                if lane.link not in ready and not late:
                    continue
                busy.remove(lane)
                try:
                    out[lane.item] = lane.link.recv() if lane.link in ready else (None, TIMEOUT)
                    whole = lane.link in ready
                except (EOFError, OSError):
                    out[lane.item], whole = (None, "crash"), False
                if not whole:
                    lane.stop()
                    lane = _Lane(work)
                give(lane)
    finally:
        for lane in busy:
            lane.stop()
    return out


def bounded_map(rows: DataFrame, column: str, work: Work, seconds: float, lanes: int = 2, result: str = "result", error: str = "error") -> DataFrame:
    """``rows`` with ``work`` of a string column as JSON, or why there is none: ``timeout`` after ``seconds``, ``crash`` if the process
    ended, or the exception's name and text.

    Spark's tasks are what runs in parallel; each of them keeps at most ``lanes`` processes for one Arrow batch, so memory doesn't grow with the
    rows, and a process that hangs or crashes is ended and replaced without harm to its task. Rows keep their order within a partition. A
    null item is not worked on and gives nulls; so does an empty table give an empty one. ``result`` and ``error`` mustn't be columns yet.
    """
    if {result, error} & set(rows.columns):
        raise ValueError(f"{result} or {error} is a column of the rows")
    schema = T.StructType([*rows.schema.fields, T.StructField(result, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = run_all(batch.column(batch.schema.get_field_index(column)).to_pylist(), work, seconds, lanes)
            both = [pa.array([m[k] for m in made], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, result, error])

    return rows.mapInArrow(run, schema)
