"""The validity of frame streams: a fold over each log's rows, spread over tasks by chunks.

A chunk can't know the state that it is entered with, but the fold soon forgets it: after a main frame that is valid,
all that follows depends on that frame alone, but for whole turns of the 32-bit counter.  So a chunk is summed up, without its
entry, as the rows at which a fold that lost its place may find it again (intra frames, resume events, the first main frame after
those and at the start, unreadable bytes, times so small that they may mean a turn of the counter), and for each of them the
state at the chunk's end if the fold finds its place there.  Summaries hold about one row in an intra interval.  A pass over a
log's summaries, in order and in batches, gives each chunk its entry; a second pass over the rows folds all chunks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.operators.ordered import CHUNK
from aerolytics.ship import ship

MAX_TIME_JUMP, MAX_ITERATION_JUMP = 10_000_000, 5_000
WRAP = 1 << 32

STATE = "valid boolean, last_iteration long, last_time long, ended boolean, added long"
#: Kinds of rows that leave the stream's validity alone: other frames, other events, sync beeps.
QUIET = frozenset("BGHSV")


@dataclass
class Fold:
    """The validity of one log's stream, and its 64-bit time, row by row.

    ``kind`` is I or P for main frames, R for a resume event (its iteration and time are the new
    reference), E for the end of the log, B for a sync beep, G, H, S and V for other frames and events;
    anything else is unreadable bytes.  32-bit time is measured from the last *valid* main frame: what
    lies less than ten seconds behind it has run over, and 2^32 is added from then on.  ``raw`` skips
    the checks of iteration and time.
    """

    valid: bool = False
    last_i: int = -1
    last_t: int = -1
    ended: bool = False
    added: int = 0
    raw: bool = False

    def run(self, kind: np.ndarray, iteration: np.ndarray, time32: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verdicts (1 valid, 0 not, -1 for rows that are no main frame or come after the end) and times."""
        n = len(kind)
        out, times = np.full(n, -1, np.int8), np.zeros(n, np.int64)
        iteration, low = iteration.astype(np.int64) % WRAP, time32.astype(np.int64) % WRAP
        main = (kind == "I") | (kind == "P")
        plain = plain_steps(main, iteration, low, self.raw)
        breaks = np.append(np.flatnonzero(~plain), n)
        j, smooth = 0, False
        while j < n:
            if smooth and plain[j]:
                end = int(breaks[np.searchsorted(breaks, j)])
                out[j:end], times[j:end] = 1, low[j:end] + self.added
                self.last_i, self.last_t, j = int(iteration[end - 1]), int(times[end - 1]), end
                continue
            k, i, t = kind[j], int(iteration[j]), int(low[j])
            smooth = False
            if not self.ended and main[j]:
                if self.last_t != -1:
                    last = self.last_t % WRAP
                    if t < last and (t - last) % WRAP < MAX_TIME_JUMP:
                        self.added += WRAP
                t += self.added
                fits = self.raw or self.last_i == -1 or (self.last_i <= i < self.last_i + MAX_ITERATION_JUMP and self.last_t <= t < self.last_t + MAX_TIME_JUMP)
                self.valid = fits if k == "I" else self.valid and fits
                out[j] = smooth = self.valid
                if self.valid:
                    self.last_i, self.last_t = i, t
            else:
                t += self.added
                if not self.ended:
                    if k == "R":
                        self.last_i, self.last_t = i, t
                    elif k == "E":
                        self.ended = True
                    elif k not in QUIET:
                        self.valid = False
            times[j] = t
            j += 1
        return out, times


def plain_steps(main: np.ndarray, iteration: np.ndarray, low: np.ndarray, raw: bool) -> np.ndarray:
    """Rows that simply go on from the row before; where that one was valid, so are these, without a look at each."""
    di, dt = np.diff(iteration, prepend=-1), np.diff(low, prepend=-1)
    return main & (dt >= 0) & (raw | ((di >= 0) & (di < MAX_ITERATION_JUMP) & (dt < MAX_TIME_JUMP)))


# ---- chunks ----

#: valid, last iteration, last time, ended, added
State = tuple[bool, int, int, bool, int]
SUMMARY = "kinds string, iterations array<long>, times array<long>, ends array<int>, exits array<struct<valid:boolean,i:long,t:long,ended:boolean,added:long>>, ahead array<long>"


def _state(fold: Fold) -> State:
    return astuple(fold)[:5]


def _named(state: State) -> dict:
    return dict(zip(("valid", "i", "t", "ended", "added"), state, strict=True))


def _turned(state: State, added: int) -> State:
    """The state of a fold that had added so much more when it was started."""
    valid, i, t, ended, own = state
    return valid, i, t + added, ended, own + added


def summarise(kind: np.ndarray, iteration: np.ndarray, time32: np.ndarray, raw: bool = False) -> dict:
    """What a chunk makes of any entry: the rows where a fold may find its place, and the states that follow from each.

    ``ends`` holds, for each of these rows, the number of its state in ``exits`` (-1: no fold finds its place there), and ``ahead`` how
    much time that fold has added less.
    """
    n = len(kind)
    iteration, low = iteration.astype(np.int64) % WRAP, time32.astype(np.int64) % WRAP
    intra = kind == "I"
    main = intra | (kind == "P")
    other = ~main & ~np.isin(kind, list(QUIET))
    mains = np.flatnonzero(main)
    after = np.searchsorted(mains, np.append(np.flatnonzero(kind == "R"), 0), "left")
    first = np.zeros(n, bool)
    first[mains[after[after < len(mains)]]] = True
    start = intra | first
    kept = np.flatnonzero(start | other | (main & (low < MAX_TIME_JUMP)))
    breaks = np.append(0, np.cumsum(~plain_steps(main, iteration, low, raw)))
    starts = np.flatnonzero(start)
    found: dict[int, tuple[int, int]] = {}  # the number of a start's exit, and what is to be added to it
    exits: list[State] = []

    def look(fold: Fold, rows: np.ndarray) -> tuple[int, int] | None:
        """The exit from the first of these rows, all in ``kept``, where the fold finds its place."""
        at, size = 0, 8
        while at < len(rows):
            part = rows[at : at + size]
            verdicts, times = fold.run(kind[part], iteration[part], low[part])
            hit = np.flatnonzero(verdicts == 1)
            if len(hit):
                row = int(part[hit[0]])
                number, more = found[row]
                return number, more + int(times[hit[0]] - low[row])
            at, size = at + size, size * 8
        return None

    for place in range(len(starts) - 1, -1, -1):
        j = int(starts[place])
        fold = Fold(True, int(iteration[j]), int(low[j]), False, 0, raw)
        until = int(starts[place + 1]) if place + 1 < len(starts) else n - 1
        if place + 1 < len(starts) and breaks[until + 1] == breaks[j + 1]:
            found[j] = found[until]  # nothing but plain steps up to the next start
            continue
        verdicts, times = fold.run(kind[j + 1 : until + 1], iteration[j + 1 : until + 1], low[j + 1 : until + 1])
        ended = None
        if place + 1 < len(starts):
            if verdicts[-1] == 1:
                number, more = found[until]
                ended = number, more + int(times[-1] - low[until])
            elif not fold.ended:
                ended = look(fold, kept[np.searchsorted(kept, until, "right") :])
        if ended is None:
            exits.append(_state(fold))
            ended = len(exits) - 1, 0
        found[j] = ended
    return {
        "kinds": "".join(k if k in "IPRE" else "?" for k in kind[kept]), "iterations": iteration[kept], "times": low[kept],
        "ends": [found[j][0] if start[j] else -1 for j in kept.tolist()], "exits": exits, "ahead": [found[j][1] if start[j] else 0 for j in kept.tolist()],
    }


def leave(entry: State, summary: dict, raw: bool = False) -> State:
    """The state at the end of a chunk that is entered with the given one."""
    kinds, iteration, low = np.array(list(summary["kinds"]), "<U1"), np.asarray(summary["iterations"], np.int64), np.asarray(summary["times"], np.int64)
    fold, at, size = Fold(*entry, raw), 0, 8
    while at < len(kinds) and not fold.ended:
        verdicts, times = fold.run(kinds[at : at + size], iteration[at : at + size], low[at : at + size])
        hit = np.flatnonzero(verdicts == 1)
        if len(hit):
            row = at + int(hit[0])
            return _turned(tuple(summary["exits"][summary["ends"][row]]), int(summary["ahead"][row]) + int(times[hit[0]] - low[row]))
        at, size = at + size, size * 8
    return _state(fold)


def validate_logs(stream: DataFrame, raw: bool = False, rows: int = CHUNK) -> DataFrame:
    """(log_id, stream_seq, kind, iteration, time, valid) of (log_id, stream_seq, kind, iteration, time32).

    ``time`` is the 64-bit time; ``valid`` is null for rows that are no main frame or come after the end.
    ``stream_seq`` counts a log's rows; those of one chunk, at most ``rows`` of them, are a group, so that a long log spreads
    over tasks.  Only chunks that another one follows are summed up; where no log is that long, that branch is empty.  Rows
    without log_id or stream_seq have no place in a log and go.
    """
    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)
    log, seq = kinds["log_id"], kinds["stream_seq"]
    keys = ["log_id", "_chunk"]
    plain = stream.select("log_id", "stream_seq", "kind", F.coalesce(F.col("iteration").cast("long"), F.lit(0)).alias("iteration"), F.coalesce(F.col("time32").cast("long"), F.lit(0)).alias("time32"))
    chunked = plain.withColumn("_chunk", F.floor(F.col("stream_seq") / rows).cast("bigint")).where("log_id is not null and _chunk is not null")
    followed = chunked.select("log_id", (F.col("_chunk") - 1).alias("_chunk")).distinct()
    cut = chunked.repartition(*keys)

    def columns(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        table = table.sort_by("stream_seq")
        return table, [table[c].to_numpy() for c in ("kind", "iteration", "time32")]

    def sum_up(table: pa.Table) -> pa.Table:
        table, (kind, iteration, time32) = columns(table)
        made = summarise(kind, iteration, time32, raw)
        made["exits"] = [_named(s) for s in made["exits"]]
        return pa.Table.from_pylist([{k: table[k][0].as_py() for k in keys} | made], schema=schema)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = object(), _state(Fold())
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["log_id"] != of:
                    of, state = row["log_id"], _state(Fold())
                state = leave(state, row | {"exits": [tuple(s.values()) for s in row["exits"]]}, raw)
                out.append({"log_id": of, "_chunk": row["_chunk"] + 1, "_entry": _named(state)})
            yield pa.RecordBatch.from_pylist(out, schema=entered)

    def fold(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, (kind, iteration, time32) = columns(table)
        state = Fold(*entry["_entry"][0].as_py().values(), raw) if entry.num_rows else Fold(raw=raw)
        found, times = state.run(kind, iteration, time32)
        valid = pa.array(found == 1, mask=found < 0)
        return table.select(["log_id", "stream_seq", "kind", "iteration"]).append_column("time", pa.array(times)).append_column("valid", valid)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    summary_type = f"log_id {log}, _chunk long, {SUMMARY}"
    entry_type = f"log_id {log}, _chunk long, _entry struct<valid:boolean,i:long,t:long,ended:boolean,added:long>"
    schema, entered = to_arrow_schema(StructType.fromDDL(summary_type)), to_arrow_schema(StructType.fromDDL(entry_type))
    sums = cut.join(followed, keys).groupBy(*keys).applyInArrow(sum_up, summary_type)
    entries = sums.repartition("log_id").sortWithinPartitions(*keys).mapInArrow(enter, entry_type)
    return cut.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(fold, f"log_id {log}, stream_seq {seq}, kind string, iteration long, time long, valid boolean")
