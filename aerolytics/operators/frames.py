"""Order-dependent work on frame streams: time, validity, rebuilding from deltas, as-of joins, ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolytics.operators.attach import attach
from aerolytics.operators.ordered import lagged, last_known, running_sum
from aerolytics.operators.validity import MAX_ITERATION_JUMP, MAX_TIME_JUMP, STATE, WRAP, Fold, validate_logs  # noqa: F401
from aerolytics.scratch import stored
from aerolytics.ship import ship


# ---- time ----


def relative_time(frames: DataFrame) -> DataFrame:
    """Adds ``time_s``: seconds since the log's first frame."""
    first = frames.groupBy("log_id").agg(F.min_by("time", "frame_seq").alias("_t0"))
    return attach(frames, first).withColumn("time_s", (F.col("time") - F.col("_t0")) / 1_000_000.0).drop("_t0")


def log_signals(frames: DataFrame) -> DataFrame:
    """(log_id, frame_seq, time_s, gyro_* and setpoint_* as doubles): an axis that a log lacks is 0.0; no rows without ``time``."""
    from aerolytics.operators.stats import AXES

    names = [f"{s}_{a}" for s in ("gyro", "setpoint") for a in AXES]
    if "time" not in frames.columns:
        return frames.select("log_id", "frame_seq", F.lit(0.0).alias("time_s"), *[F.lit(0.0).alias(n) for n in names]).where("false")
    values = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in frames.columns else F.lit(0.0).alias(n) for n in names]
    return relative_time(frames.select("log_id", "frame_seq", "time", *values)).where("time_s is not null").select("log_id", "frame_seq", "time_s", *names)


def unwrap_by_steps(frames: DataFrame, order: str = "stream_seq", column: str = "time32") -> DataFrame:
    """Adds ``time``: the 32-bit counter with 2^32 added at each small step back over its end.

    An approximation for streams without corrupt frames: a step is taken from the row before, not from
    the last valid frame (``validate_logs`` does that).
    """
    before = F.col("_before32")
    wraps = F.when((F.col(column) < before) & (F.pmod(F.col(column) - before, F.lit(WRAP)) < MAX_TIME_JUMP), 1).otherwise(0)
    flagged = lagged(frames, ["log_id"], order, {"_before32": column}).withColumn("_wraps", wraps).drop("_before32")
    return running_sum(flagged, ["log_id"], order, "_wraps", "_turns").withColumn("time", F.col(column) + F.col("_turns") * F.lit(WRAP)).drop("_wraps", "_turns")


def _with_intervals(frames: DataFrame, config: DataFrame, order: str) -> DataFrame:
    return attach(frames, config.select("log_id", F.col("i_interval").alias("_i"), F.col("p_num").alias("_p"), F.col("p_denom").alias("_d")), order=order)


def _is_logged(iteration: Column) -> Column:
    return (iteration % F.col("_i") + F.col("_p") - 1) % F.col("_d") < F.col("_p")


def skipped_frames(frames: DataFrame, config: DataFrame, order: str = "frame_seq") -> DataFrame:
    """Adds ``skipped``: iterations between this frame and the one before that the log meant to leave out.

    The pattern repeats with each ``i_interval``: whole periods are counted at once, so a gap of any
    length costs at most two periods.
    """
    before = lagged(_with_intervals(frames, config, order), ["log_id"], order, {"_last": "loop_iteration"})
    first, end = F.col("_last") + 1, F.col("loop_iteration") - 1
    count = lambda a, b: F.when(a <= b, F.size(F.filter(F.sequence(a, b), lambda i: ~_is_logged(i)))).otherwise(0)
    periods = F.greatest(F.floor((end - first + 1) / F.col("_i")), F.lit(0)).cast("bigint")
    whole = periods * count(F.lit(0).cast("bigint"), F.col("_i").cast("bigint") - 1)
    return before.withColumn("skipped", F.coalesce(whole + count(first + periods * F.col("_i"), end), F.lit(0))).drop("_last", "_i", "_p", "_d")


def skipped_after(frames: DataFrame, config: DataFrame, most: int = 10_001, order: str = "frame_seq") -> DataFrame:
    """Adds ``skipped_after``: iterations that the log leaves out right after this frame's; at most ``most``.

    Every ``i_interval``-th iteration is logged, so no longer stretch needs looking at.
    """
    ahead = F.sequence(F.lit(1), F.least(F.col("_i"), F.lit(most + 1)))
    there = F.filter(ahead, lambda k: _is_logged(F.col("loop_iteration") + k))
    return _with_intervals(frames, config, order).withColumn("skipped_after", F.coalesce(F.array_min(there) - 1, F.lit(most))).drop("_i", "_p", "_d")


# ---- validity ----

def frame_gaps(frames: DataFrame, order: str = "stream_seq", iteration: str = "loop_iteration") -> DataFrame:
    """Adds ``gap``: whether a frame steps back or jumps from the one right before; no fold needed."""
    found = lagged(frames, ["log_id"], order, {"_i": iteration, "_t": "time"})
    di, dt = F.col(iteration) - F.col("_i"), F.col("time") - F.col("_t")
    return found.withColumn("gap", F.coalesce((di < 0) | (di >= MAX_ITERATION_JUMP) | (dt < 0) | (dt >= MAX_TIME_JUMP), F.lit(False))).drop("_i", "_t")


def frame_counts(validity: DataFrame) -> DataFrame:
    """(log_id, valid_frames, corrupt_frames)."""
    return validity.groupBy("log_id").agg(F.count_if("valid").alias("valid_frames"), F.count_if(~F.col("valid")).alias("corrupt_frames"))


# ---- rebuilding from deltas ----

# Names of the predictor codes that a main frame's fields may have, and the encodings whose values wrap at 32 bits.
PREDICTORS = {0: "zero", 1: "previous", 2: "straight_line", 3: "average_2", 4: "minthrottle", 5: "motor_0", 6: "inc", 8: "fifteen_hundred", 9: "vbatref", 11: "minmotor"}
WRAPPING = (0, 1, 3)
HISTORY = ("previous", "straight_line", "average_2")


@dataclass(frozen=True)
class FieldRule:
    """How a residual column is rebuilt: a predictor for each frame type, and how its values wrap."""

    i: str = "zero"
    p: str = "previous"
    signed: bool = True
    wraps: bool = True


def field_rules(definitions: DataFrame) -> DataFrame:
    """(layout, fields): one row per distinct set of main-frame fields; as many as there are firmware builds, not logs."""
    return log_layouts(definitions).select("layout", "fields").distinct()


def log_layouts(definitions: DataFrame) -> DataFrame:
    """(log_id, layout, fields): the fields of a log's main frames, and a digest that logs with equal fields share."""
    of = lambda t: definitions.where(F.col("frame_type") == t)
    i = of("I").select("log_id", "pos", "name", F.col("predictor").alias("i"), "signed", "width", F.col("encoding").alias("i_encoding"))
    p = of("P").select("log_id", "pos", F.col("predictor").alias("p"), F.col("encoding").alias("p_encoding"))
    fields = i.join(p, ["log_id", "pos"], "left").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "i", "p", "signed", "width", "i_encoding", "p_encoding"))).alias("fields"))
    return fields.select("log_id", F.sha2(F.to_json("fields"), 256).alias("layout"), "fields")


def rules_of(fields) -> dict[str, FieldRule]:
    """The rules of one layout's ``fields``; a P frame's value wraps as the I frame's."""
    return {
        f["name"]: FieldRule(PREDICTORS.get(f["i"], "zero"), PREDICTORS.get(f["p"], "zero"), bool(f["signed"]), f["width"] != 8 and f["i_encoding"] in WRAPPING)
        for f in fields
    }


def wrap32(value: Column, signed: bool = True) -> Column:
    low = F.pmod(value, F.lit(WRAP))
    return F.when(low >= WRAP // 2, low - WRAP).otherwise(low) if signed else low


def rebuild(raw: DataFrame, rules: dict[str, FieldRule], order: str = "stream_seq") -> DataFrame:
    """Adds ``<column>_value`` for the residual columns of ``rules``.

    An I frame starts a segment: its value is the residual and its own constant, and both histories
    are reset to it.  In the P frames after it, constants are added and histories go on; before the
    first I frame a history adds nothing.  Constants: ``minthrottle``, ``motor_output_low`` (minmotor)
    and ``vbatref`` are columns of that name, ``fifteen_hundred`` is 1500, ``motor_0`` is the rebuilt value
    of the rule ``motor_0`` (or a column ``motor_0_value``); ``zero`` and ``inc`` leave the residual.
    Values wrap at 32 bits, as signed or unsigned numbers, unless the rule says that they don't.

    Segments are short, so running sums restart often and each segment is a window of its own.
    ``average_2`` rounds at every step, so its columns pass row by row in sorted batches.
    """
    constants = {"zero": F.lit(0), "inc": F.lit(0), "fifteen_hundred": F.lit(1500), "minthrottle": F.col("minthrottle"), "minmotor": F.col("motor_output_low"), "vbatref": F.col("vbatref"), "motor_0": F.col("motor_0_value")}
    for column, rule in rules.items():
        if rule.i in HISTORY:
            raise ValueError(f"{column}: I frames that go on from the frame before aren't rebuilt")
    intra = F.col("frame_type") == "I"
    out = running_sum(raw.withColumn("_start", F.when(intra, 1).otherwise(0)), ["log_id"], order, "_start", "_segment").drop("_start")
    running = Window.partitionBy("log_id", "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = sorted(rules, key=lambda c: c != "motor_0")  # others may build on its values
    folded = [c for c in first if rules[c].p == "average_2"]
    for column in first:
        rule, name, delta = rules[column], f"{column}_value", F.col(column)
        base = F.when(intra, delta + constants[rule.i])
        if rule.p == "average_2":
            out = out.withColumn(name, F.coalesce(base, delta).cast("long"))
        elif rule.p == "previous":
            out = out.withColumn(name, F.when(F.col("_segment") == 0, delta).otherwise(F.sum(F.coalesce(base, delta)).over(running)))
        elif rule.p == "straight_line":
            # The first value stands for the two before it: steps are the running sum of the residuals after it.
            out = out.withColumn("_step", F.sum(F.when(intra, 0).otherwise(delta)).over(running))
            out = out.withColumn(name, F.when(F.col("_segment") == 0, delta).otherwise(F.first(base).over(running) + F.sum("_step").over(running))).drop("_step")
        else:
            out = out.withColumn(name, F.coalesce(base, delta + constants[rule.p]))
        if rule.wraps:
            out = out.withColumn(name, wrap32(F.col(name), rule.signed))
        if column == "motor_0" and column in folded:
            out = _averaged(out, {name: rule}, order)
            folded.remove(column)
    return (_averaged(out, {f"{c}_value": rules[c] for c in folded}, order) if folded else out).drop("_segment")


def _averaged(rows: DataFrame, rules: dict[str, FieldRule], order: str) -> DataFrame:
    """Columns under ``average_2`` whose I rows are whole and whose other rows are residuals, rebuilt in row order."""
    ship(rows.sparkSession)

    def step(value: int, rule: FieldRule) -> int:
        if not rule.wraps:
            return value
        value %= WRAP
        return value - WRAP if rule.signed and value >= WRAP // 2 else value

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, int] | None] = {}
        log = object()
        for batch in batches:
            ids, kinds, columns = batch.column("log_id").to_pylist(), batch.column("frame_type").to_pylist(), list(batch.columns)
            before = [log, *ids[:-1]]
            for name, rule in rules.items():
                at = batch.schema.get_field_index(name)
                values, last = columns[at].to_pylist(), held.get(name)
                for j, (x, kind, own, prior) in enumerate(zip(values, kinds, ids, before, strict=True)):
                    if own != prior:
                        last = None
                    if x is None:
                        continue
                    if kind == "I":
                        last = x, x
                    elif last is not None:
                        x = step(x + (last[0] + last[1]) // 2, rule)
                        last = x, last[0]
                    values[j] = x
                held[name], columns[at] = last, pa.array(values, pa.int64())
            log = ids[-1] if ids else log
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.repartition("log_id").sortWithinPartitions("log_id", order).mapInArrow(fold, rows.schema)


CONFIGURED = ("minthrottle", "motor_output_low", "vbatref")


def rebuild_fleet(raw: DataFrame, definitions: DataFrame, order: str = "stream_seq") -> DataFrame:
    """Adds ``<column>_value`` for the residual columns of logs of any layouts, by each log's own field definitions.

    The columns are those of ``raw`` beside log_id, the order, frame_type and the constants ``minthrottle``, ``motor_output_low``
    and ``vbatref``; a field ``motor[0]`` is the column ``motor_0``.  A log that lacks a field has no values of it, nor has one whose
    I frames go on from the frame before.  The rules are those of ``rebuild``, but they are data: an I frame and the rows up to the next are
    one row of arrays, which meets its layout's rules and is folded field by field, in expressions only.  Rows are grouped
    by (log, segment), so that a long log spreads over tasks; a segment has as many rows as lie between two I frames, and its
    cost grows with their square.
    """
    keys = ["log_id", order, "frame_type", *CONFIGURED]
    fields = [c for c in raw.columns if c not in keys]
    flagged = raw.withColumn("_start", F.when(F.col("frame_type") == "I", 1).otherwise(0))
    cut = running_sum(flagged, ["log_id"], order, "_start", "_segment").drop("_start")
    own = [F.col(c) for c in raw.columns if c != order]
    segments = cut.groupBy("log_id", "_segment").agg(F.array_sort(F.collect_list(F.struct(F.col(order), *own))).alias("_rows"))

    layouts = log_layouts(definitions)
    name = lambda f: F.regexp_replace(f["name"], r"\[(\d+)\]", "_$1")
    wraps = lambda f: (F.coalesce(f["width"], F.lit(4)) != 8) & f["i_encoding"].isin(*WRAPPING)
    rule = lambda f: F.struct(name(f).alias("key"), F.struct(f["i"].alias("i"), F.coalesce(f["p"], F.lit(0)).alias("p"), f["signed"].cast("boolean").alias("signed"), wraps(f).alias("wraps")).alias("value"))
    ruled = attach(segments, layouts.select("log_id", F.map_from_entries(F.transform("fields", rule)).alias("_rules")), order="_segment", rows=4_096, how="left")

    nothing = F.lit(None).cast("bigint")
    code_of = {v: k for k, v in PREDICTORS.items()}
    constants = {"minthrottle": "minthrottle", "minmotor": "motor_output_low", "vbatref": "vbatref"}

    bound = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  # a value that is used more than once is made once
    zero = F.lit(0).cast("bigint")

    def folded(column: str, motor: Column | None) -> Column:
        by = F.col(f"_rule_{column}")

        def told(row: Column, place: Column) -> Column:
            """A row's code, and its residual with the constant of it; nothing for an I frame that would go on from the frame before."""
            intra = row["frame_type"] == "I"

            def added(code: Column) -> Column:
                constant = F.when(code == code_of["fifteen_hundred"], F.lit(1500).cast("bigint"))
                for name, c in constants.items():
                    constant = constant.when(code == code_of[name], row[c].cast("bigint"))
                if motor is not None:
                    constant = constant.when(code == code_of["motor_0"], F.get(motor, place))
                fits = code.isNotNull() & ~(intra & code.isin(*[code_of[h] for h in HISTORY]))
                return F.struct(intra.alias("intra"), code.alias("code"), F.when(fits, row[column].cast("bigint") + F.coalesce(constant, zero)).alias("base"))

            return bound(F.when(intra, by["i"]).otherwise(by["p"]), added)

        def step(held: Column, row: Column) -> Column:
            a, b, code = held["a"], held["b"], row["code"]
            history = F.when(code == code_of["previous"], a).when(code == code_of["straight_line"], 2 * a - b).when(code == code_of["average_2"], F.shiftright(a + b, 1))
            value = row["base"] + F.when(row["intra"], zero).otherwise(F.coalesce(history, zero))
            low = bound(F.pmod(value, F.lit(WRAP)), lambda x: F.when(by["signed"] & (x >= WRAP // 2), x - WRAP).otherwise(x))

            def kept(x: Column) -> Column:
                last = F.when(row["intra"] | a.isNotNull(), F.coalesce(x, a))
                before = F.when(row["intra"], x).otherwise(F.when(x.isNull(), b).otherwise(a))
                return F.struct(last.alias("a"), before.alias("b"), F.concat(held["out"], F.array(x)).alias("out"))

            return bound(F.when(by["wraps"], low).otherwise(value), kept)

        start = F.struct(nothing.alias("a"), nothing.alias("b"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.transform("_rows", told), start, step, lambda s: s["out"])

    out = ruled.select("log_id", "_rows", *[F.try_element_at("_rules", F.lit(c)).alias(f"_rule_{c}") for c in fields])
    for column in sorted(fields, key=lambda c: c != "motor_0"):  # others may build on its values
        out = out.withColumn(f"{column}_value", folded(column, F.col("motor_0_value") if "motor_0_value" in out.columns else None))
    values = [f"{c}_value" for c in fields]
    rows = out.select("log_id", F.explode(F.arrays_zip(F.col("_rows").alias("row"), *[F.col(v) for v in values])).alias("z"))
    return rows.select("log_id", *[F.col(f"z.row.{c}").alias(c) for c in raw.columns if c != "log_id"], *[F.col(f"z.{v}").alias(v) for v in values])


# ---- as-of joins on a stream ----


def gps_coordinates(gps: DataFrame, homes: DataFrame) -> DataFrame:
    """(log_id, stream_seq, lat, lon): offsets plus the latest earlier home position, 0 before any."""
    both = gps.select("log_id", "stream_seq", "coord_0", "coord_1", F.lit(None).cast("long").alias("home_0"), F.lit(None).cast("long").alias("home_1"), F.lit(True).alias("fix")).unionByName(
        homes.select("log_id", "stream_seq", F.lit(0).cast("long").alias("coord_0"), F.lit(0).cast("long").alias("coord_1"), "home_0", "home_1", F.lit(False).alias("fix"))
    )
    home = F.when(~F.col("fix"), F.struct(F.coalesce("home_0", F.lit(0)).alias("x"), F.coalesce("home_1", F.lit(0)).alias("y")))
    found = last_known(both, ["log_id"], "stream_seq", home, "home").where("fix")
    add = lambda c, h: (F.col(c) + F.coalesce(f"home.{h}", F.lit(0)))
    return found.select("log_id", "stream_seq", add("coord_0", "x").alias("lat"), add("coord_1", "y").alias("lon"))


def gps_times(stream: DataFrame) -> DataFrame:
    """(log_id, stream_seq, gps_time) of rows of kind G in (log_id, stream_seq, kind, valid, time, delta).

    ``delta`` is added to the time of the latest earlier valid main frame; 0 stands for it if there is
    none, or if an invalid main frame came since.
    """
    main = F.col("kind") == "M"
    found = last_known(stream, ["log_id"], "stream_seq", F.when(main, F.struct(F.col("valid"), F.col("time"))), "m").where("kind = 'G'")
    return found.select("log_id", "stream_seq", (F.col("delta") + F.when(F.col("m.valid"), F.col("m.time")).otherwise(0)).alias("gps_time"))


# ---- ranges ----


def in_range(frames: DataFrame, catalog: DataFrame, order: str = "frame_seq") -> DataFrame:
    """The frames of visible logs with ``time_s`` inside the log's range, both ends included."""
    kept = catalog.where("visible").select("log_id", F.col("time_start_s").alias("_from"), F.col("time_end_s").alias("_until"))
    return attach(frames, kept, order=order).where(F.col("time_s").between(F.col("_from"), F.col("_until"))).drop("_from", "_until")


def preview(frames: DataFrame, budget: int = 20_000) -> DataFrame:
    """Every step-th frame of a log with more than ``budget`` frames, from the first on."""
    size = frames.groupBy("log_id").agg(F.count("*").alias("_n"))
    step = F.when(F.col("_n") > budget, F.floor(F.col("_n") / budget)).otherwise(1)
    return attach(frames, size).where(F.col("frame_seq") % step == 0).drop("_n")


def log_labels(logs: DataFrame, summary: DataFrame) -> DataFrame:
    """(log_id, label, time_start_s, time_end_s): file stem, number from 1, and the whole duration as range."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    joined = logs.join(summary.select("log_id", "duration_s"), "log_id")
    return joined.select("log_id", F.concat(stem, F.lit(" #"), (F.col("log_index") + 1).cast("string")).alias("label"), F.lit(0.0).alias("time_start_s"), F.col("duration_s").alias("time_end_s"))


#: Rows whose windows a task computes at once.
SPAN = 16_384


def rolling_rms(frames: DataFrame, window_s: float = 0.5) -> DataFrame:
    """(log_id, frame_seq, time_s, rms, n, dt): root mean square of the summed absolute setpoints in a centred window.

    The window's length follows from the log's median step; beyond the log's ends it counts zeros, and
    so does an axis that is absent.  Rows are dealt to spans, those near an edge to both sides of it, and
    each span's windows are differences of its prefix sums: one shuffle, whatever the window's length.
    """
    from aerolytics.operators.stats import AXES

    ship(frames.sparkSession)
    size = SPAN
    there = [F.abs(F.coalesce(F.col(f"setpoint_{a}").cast("double"), F.lit(0.0))) for a in AXES if f"setpoint_{a}" in frames.columns]
    power = sum(there, F.lit(0.0))
    timed = relative_time(frames.select("log_id", "frame_seq", "time", (power * power).alias("sq"))).select("log_id", "frame_seq", "time_s", "sq")
    steps = lagged(timed.select("log_id", "frame_seq", "time_s"), ["log_id"], "frame_seq", {"before": "time_s"}).withColumn("step", F.col("time_s") - F.col("before"))
    sizes = steps.groupBy("log_id").agg(F.count("*").alias("n"), F.percentile("step", F.lit(0.5)).alias("dt"))
    win = F.when(F.col("dt") > 0, F.least(F.greatest((F.lit(window_s) / F.when(F.col("dt") > 0, F.col("dt"))).cast("int"), F.lit(1)), F.col("n"))).otherwise(1).cast("bigint")
    held = attach(timed, sizes.withColumn("win", win))
    span = lambda at: F.floor(at / size).cast("bigint")
    low, high = span(F.greatest(F.col("frame_seq") - F.floor((F.col("win") - 1) / 2), F.lit(0))), span(F.least(F.col("frame_seq") + F.floor(F.col("win") / 2), F.col("n") - 1))
    rows = held.withColumn("span", F.explode(F.sequence(low, high))).groupBy("log_id", "n", "dt", "win", "span").agg(F.collect_list(F.struct("frame_seq", "time_s", "sq")).alias("r"))

    @F.pandas_udf("struct<seq:array<bigint>,time_s:array<double>,rms:array<double>>")
    def roll(span: pd.Series, win: pd.Series, seq: pd.Series, time: pd.Series, sq: pd.Series) -> pd.DataFrame:
        found = []
        for s, w, i, t, x in zip(span, win, seq, time, sq, strict=True):
            order = np.argsort(i)
            i, t, x = i[order], t[order], np.concatenate(([0.0], np.cumsum(x[order])))
            own = np.flatnonzero(i // size == s)
            lo, hi = np.searchsorted(i, i[own] - w // 2), np.searchsorted(i, i[own] + (w - 1) // 2, "right")
            found.append((i[own], t[own], np.sqrt(np.maximum(x[hi] - x[lo], 0.0) / w)))
        return pd.DataFrame(found, columns=["seq", "time_s", "rms"])

    made = rows.select("log_id", "n", "dt", roll("span", "win", "r.frame_seq", "r.time_s", "r.sq").alias("v"))
    return made.select("log_id", "n", "dt", F.explode(F.arrays_zip("v.seq", "v.time_s", "v.rms")).alias("v")).select("log_id", F.col("v.seq").alias("frame_seq"), "v.time_s", "v.rms", "n", "dt")


def active_range(frames: DataFrame, threshold: float = 0.15, window_s: float = 0.5, margin_s: float = 0.5) -> DataFrame:
    """(log_id, time_start_s, time_end_s): from the first to the last row with an rms of a share of the peak, with a margin.

    The whole log for fewer than 100 rows, no progress in time, or a peak below 1.
    """
    rms = stored(rolling_rms(frames, window_s))  # read twice
    tops = rms.groupBy("log_id").agg(F.max("rms").alias("peak"), F.max_by("time_s", "frame_seq").alias("end"), F.min_by("time_s", "frame_seq").alias("start"), F.first("n").alias("n"), F.first("dt").alias("dt"))
    active = attach(rms.select("log_id", "frame_seq", "time_s", "rms"), tops.select("log_id", F.col("peak").alias("_peak"))).where(F.col("rms") >= threshold * F.col("_peak"))
    ends = active.groupBy("log_id").agg(F.min_by("time_s", "frame_seq").alias("first"), F.max_by("time_s", "frame_seq").alias("last"))
    plain = (F.col("n") < 100) | (F.coalesce("dt", F.lit(0.0)) <= 0) | (F.col("peak") < 1.0) | F.col("first").isNull()
    return tops.join(ends, "log_id", "left").select(
        "log_id", F.when(plain, F.col("start")).otherwise(F.greatest("start", F.col("first") - margin_s)).alias("time_start_s"),
        F.when(plain, F.col("end")).otherwise(F.least("end", F.col("last") + margin_s)).alias("time_end_s"),
    )
