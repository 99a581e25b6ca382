"""Kernels over streams: state is kept for each track, so a stream in any batches gives what one batch gives."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonaris.operators.recurrences import Kernel


def stream_kernel(samples: DataFrame, make: Callable[[], Kernel], most_waiting: int = 48_000) -> DataFrame:
    """A kernel over a streaming SAMPLES table.

    Frames of a track may come out of order: those after a gap wait in the state until it is filled, so output is in order.
    If more than ``most_waiting`` wait, the gap is given up: the kernel starts anew at the first waiting frame. Frames at or
    before the last one given out are late and dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel, due, waiting = pickle.loads(state.get[0]) if state.exists else (make(), 0, {})
        for pdf in parts:
            waiting.update({f: (a, b) for f, a, b in zip(pdf["frame"].tolist(), pdf["l"].tolist(), pdf["r"].tolist(), strict=True) if f >= due})
        made = []
        while due in waiting or len(waiting) > most_waiting:
            if due not in waiting:
                kernel, due = make(), min(waiting)
            ready = []
            while due in waiting:
                ready.append(waiting.pop(due))
                due += 1
            out = kernel.step(pd.DataFrame(ready, columns=["l", "r"]).to_numpy(float))
            made.append(pd.DataFrame({"track": key[0], "frame": range(due - len(out), due), "l": out[:, 0], "r": out[:, 1]}))
        state.update((pickle.dumps((kernel, due, waiting)),))
        if made:
            yield pd.concat(made)

    return samples.select("track", "frame", "l", "r").groupBy("track").applyInPandasWithState(run, "track long, frame long, l double, r double", "blob binary", "append", GroupStateTimeout.NoTimeout)
