"""Live validation of frame streams: the batch fold with its state kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolytics.operators.frames import STATE, Fold
from aerolytics.ship import ship


def validate_stream(stream: DataFrame) -> DataFrame:
    """(log_id, stream_seq, verdict, time) of a stream (log_id, stream_seq, kind, iteration, time32) as it arrives.

    ``verdict`` is valid, invalid, other (no main frame), or late: rows at or behind a place that was
    seen already.  32-bit time is unwrapped on the way.  The state of a log is six numbers.  A log's rows
    of one micro-batch are sorted together, so their number should be bounded at the source
    (``maxFilesPerTrigger`` and the like).
    """
    ship(stream.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, seen = state.get if state.exists else (False, -1, -1, False, 0, -1)
        own = Fold(*held)
        rows = pd.concat(list(batches)).sort_values("stream_seq", kind="stable")
        late = (rows["stream_seq"] <= seen) | rows["stream_seq"].duplicated()
        fresh = rows[~late]
        found, times = own.run(fresh["kind"].to_numpy(), fresh["iteration"].to_numpy(), fresh["time32"].to_numpy())
        if len(fresh):
            seen = int(fresh["stream_seq"].max())
        state.update((bool(own.valid), int(own.last_i), int(own.last_t), bool(own.ended), int(own.added), seen))
        verdict = pd.Series(found).map({1: "valid", 0: "invalid", -1: "other"}).to_numpy()
        yield pd.concat([fresh.assign(verdict=verdict, time=times), rows[late].assign(verdict="late", time=rows[late]["time32"])])[["log_id", "stream_seq", "verdict", "time"]]

    kind = dict(stream.dtypes)["log_id"]
    return stream.select("log_id", "stream_seq", "kind", "iteration", "time32").groupBy("log_id").applyInPandasWithState(
        fold, f"log_id {kind}, stream_seq long, verdict string, time long", f"{STATE}, seen long", "append", GroupStateTimeout.NoTimeout
    )
