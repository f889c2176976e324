"""Structured Streaming forms of the stateful operators.

A micro-batch may hold any number of a key's rows, in any order.  They are sorted in runs of ``RUN`` rows, and further runs wait in
temporary files of the worker, which end with the task; so a worker holds a bounded number of rows besides its state.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Rows that are sorted in memory at once; a merge holds half as many again at most.
RUN = 250_000
#: Runs that are merged at once.
_FAN = 8


def in_order(frames: Iterator[pd.DataFrame], by: list[str], size: int) -> Iterator[pd.DataFrame]:
    """All rows of ``frames`` sorted by ``by``, in frames of about ``size`` rows at most.

    ``_FAN`` runs of one level are merged into one of the next, so that memory and the number of files stay bounded.
    """
    with contextlib.ExitStack() as files:
        runs: list[tuple] = []  # (level, file), levels falling
        held: list[pd.DataFrame] = []
        count = 0

        def ordered() -> pd.DataFrame:
            return pd.concat(held, ignore_index=True).sort_values(by, ignore_index=True)

        def write(level: int, parts: Iterator[pd.DataFrame]):
            file, out, schema = files.enter_context(tempfile.TemporaryFile()), None, None
            for part in parts:
                made = pa.Table.from_pandas(part, schema, preserve_index=False)
                if out is None:
                    schema = made.schema
                    out = pa.ipc.new_file(file, schema)
                out.write_table(made, max_chunksize=max(1, size // (2 * _FAN)))
            out.close()
            runs.append((level, file))

        def merge_last():
            last = [runs.pop() for _ in range(_FAN)]
            write(last[-1][0] + 1, _merged([pa.ipc.open_file(f) for _, f in last], by, size))
            for _, file in last:
                file.close()

        def put_away():
            nonlocal held, count
            rows, held, count = ordered(), [], 0
            write(0, iter([rows]))
            while len(runs) >= _FAN and runs[-_FAN][0] == runs[-1][0]:
                merge_last()

        for frame in frames:
            for at in range(0, len(frame), size):
                held.append(frame.iloc[at : at + size])
                count += len(held[-1])
                if count >= size:
                    put_away()
        if not runs:
            if held:
                yield ordered()
            return
        if held:
            put_away()
        while len(runs) > _FAN:
            merge_last()
        yield from _merged([pa.ipc.open_file(f) for _, f in runs], by, size)


def _merged(runs: list, by: list[str], size: int) -> Iterator[pd.DataFrame]:
    """Pieces of all runs are sorted together, and the rows up to the first end of a piece go out: what is unread lies behind it."""
    unread = [iter(range(run.num_record_batches)) for run in runs]
    fair = max(1, size // len(runs))
    rest: list[pd.DataFrame] = []
    ended = list(range(len(runs)))
    while True:
        for i in ended:
            pieces, count = [], 0
            while count < fair and (n := next(unread[i], None)) is not None:
                pieces.append(runs[i].get_batch(n).to_pandas())
                count += len(pieces[-1])
            if pieces:
                made = pd.concat(pieces, ignore_index=True)
                made["__end"] = np.where(np.arange(len(made)) == len(made) - 1, i, -1)
                rest.append(made)
        if not rest:
            return
        rows = pd.concat(rest, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)
        ends = np.flatnonzero(rows["__end"].to_numpy() >= 0)
        ended = [int(rows["__end"].iat[ends[0]])]
        yield rows.iloc[: ends[0] + 1].drop(columns="__end")
        rest = [rows.iloc[ends[0] + 1 :]] if ends[0] + 1 < len(rows) else []


def running_counts(stream: DataFrame, key: str, row: str) -> DataFrame:
    """Each row with its 0-based number among the rows of its key so far, across micro-batches."""
    size = RUN

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for rows in in_order((f[[row]] for f in frames), [row], size):
            yield pd.DataFrame({"key": [keys[0]] * len(rows), "row": rows[row].to_numpy(), "seen": np.arange(seen, seen + len(rows))})
            seen += len(rows)
        state.update((seen,))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(
        run, f"key {kinds[key]}, row {kinds[row]}, seen long", "seen long", "append", GroupStateTimeout.NoTimeout)


def running_ema(stream: DataFrame, key: str, time: str, row: str, x: str, rate: float) -> DataFrame:
    """The decaying average of each row, with the last average and time of a key as state."""
    size = RUN

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e, last = state.get if state.exists else (0.0, None)
        for rows in in_order((f[list({time: 0, row: 0, x: 0})] for f in frames), [time, row], size):
            out = []
            for t, v in zip(rows[time], rows[x], strict=True):
                e = v + (e * float(np.exp(-rate * (t - last))) if last is not None else 0.0)
                last = float(t)
                out.append(e)
            yield pd.DataFrame({"key": [keys[0]] * len(rows), "row": rows[row].to_numpy(), "ema": out})
        state.update((e, last))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(
        run, f"key {kinds[key]}, row {kinds[row]}, ema double", "e double, last double", "append", GroupStateTimeout.NoTimeout)


def running_time_window(stream: DataFrame, key: str, time: str, row: str, x: str, delta: int) -> DataFrame:
    """The sum of each row and the earlier rows of its key at most ``delta`` time units back, across micro-batches.

    ``time`` is a whole number, and a later batch holds no earlier times of a key.  A key's state is its rows of the last
    ``delta`` units.  Invalid values make the sums that they are in invalid.
    """
    size = RUN

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_t, old_x = (np.array(a, k) for a, k in zip(state.get if state.exists else ([], []), (np.int64, float), strict=True))
        for rows in in_order((f[list({time: 0, row: 0, x: 0})] for f in frames), [time, row], size):
            t, v = np.r_[old_t, rows[time].to_numpy(np.int64)], np.r_[old_x, rows[x].to_numpy(float)]
            at = np.arange(len(old_t), len(t))
            first = np.searchsorted(t, t[at] - delta)
            sums = np.add.reduceat(v, np.column_stack([first, at + 1]).ravel()[:-1])[::2]
            keep = np.searchsorted(t, t[-1] - delta)
            old_t, old_x = t[keep:].copy(), v[keep:].copy()
            yield pd.DataFrame({"key": [keys[0]] * len(rows), "row": rows[row].to_numpy(), "total": sums})
        state.update((old_t.tolist(), old_x.tolist()))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(
        run, f"key {kinds[key]}, row {kinds[row]}, total double", "t array<bigint>, x array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_sums(stream: DataFrame, time: str, x: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Tumbling sums with a watermark."""
    w = F.window(time, size)
    made = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"))
    return made.select(F.col("w.start").alias("start"), *keys, "n", "total")


def drain(out: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there and write it to files."""
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
