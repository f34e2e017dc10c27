"""Structured Streaming forms: calibration as a stream-static join, and checks that need the record before.

The checks keep one small row per flight, for as long as the query runs. Within a batch their rows
are put in order; rows that lie before one of an earlier batch are handled as `late` says: dropped, or
an error. The bracketing join keeps rows within the watermarks only, and later ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.calibration import COUNTER_WRAP
from ..operators.navigation import PLAUSIBLE


def calibrate_stream(cells: DataFrame, dark: DataFrame, gains: DataFrame, integration_ms: float) -> DataFrame:
    """Dark and gain steps on streamed cells (line, sample, band, value); the tables are static, so there is no state."""
    from ..operators.calibration import apply_gains, remove_dark

    return apply_gains(remove_dark(cells.withColumn("mask", F.lit(0)), dark), gains, integration_ms)


def missing_frames_stream(lines: DataFrame, late: str = "drop") -> DataFrame:
    """Lines (flight, line, frame) with the 16-bit counter's step from the flight's line before; state: the last line and counter.

    late: drop lines that lie before the last one, or raise.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("line")
        newest, last = state.get if state.exists else (None, None)
        if newest is not None:
            behind = rows["line"] < newest
            if late == "raise" and behind.any():
                raise ValueError("line goes backwards")
            rows = rows[~behind]
        deltas = []
        for frame in rows["frame"]:
            delta = None if last is None else int(frame) - last
            deltas.append(delta + COUNTER_WRAP if delta is not None and delta <= 3 - COUNTER_WRAP else delta)
            last = int(frame)
        if len(rows):
            state.update((int(rows["line"].iloc[-1]), last))
        yield pd.DataFrame({"flight": key[0], "line": rows["line"], "frame": rows["frame"], "delta": pd.array(deltas, "Int64")})

    schema = f"flight {dict(lines.dtypes)['flight']}, line long, frame long, delta long"
    return lines.groupBy("flight").applyInPandasWithState(step, schema, "line long, last long", "append", GroupStateTimeout.NoTimeout)


def plausibility_stream(nav: DataFrame, late: str = "drop") -> DataFrame:
    """Navigation records with their quality bits; state: the flight's last record. late: drop rows that go back in time, or raise."""
    names = list(PLAUSIBLE)

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("time")
        last = dict(zip(names, state.get, strict=True)) if state.exists else None
        out = []
        for row in rows.to_dict("records"):
            if last is not None and row["time"] < last["time"]:
                if late == "raise":
                    raise ValueError("time goes backwards")
                continue
            quality = 0
            for name, (limit, bit) in PLAUSIBLE.items():
                if last is not None:
                    gap = abs(row[name] - last[name])
                    quality += bit * ((min(gap, 360 - gap) if name == "heading" else gap) > limit)
            out.append({"flight": key[0], "time": row["time"], "quality": quality})
            last = row
        if last is not None:
            state.update(tuple(float(last[n]) for n in names))
        yield pd.DataFrame(out, columns=["flight", "time", "quality"])

    schema = f"flight {dict(nav.dtypes)['flight']}, time double, quality int"
    return nav.groupBy("flight").applyInPandasWithState(check, schema, ", ".join(f"{n} double" for n in names), "append", GroupStateTimeout.NoTimeout)


def bracket_stream(scans: DataFrame, nav: DataFrame, delay: str = "30 seconds", gap: str = "1 second") -> DataFrame:
    """T4, T5: each scan (flight, ts, more columns) with the records (flight, nav_ts, more columns) around it, before and after.

    As in the batch form, before is the last record under the scan's time, after the first from there on;
    both lie within `gap` of it, and are null where no record does. A scan comes out once the watermark of
    `delay` has passed it; scans without any record within the gap, and those without a time, do not.
    Repeated scans are one.
    """
    record = F.struct("nav_ts", *[c for c in nav.columns if c not in ("flight", "nav_ts")])
    s = scans.withWatermark("ts", delay).alias("s")
    n = nav.withWatermark("nav_ts", delay).select(F.col("flight").alias("_flight"), "nav_ts", record.alias("_record")).alias("n")
    near = (F.col("flight") == F.col("_flight")) & F.col("nav_ts").between(F.col("ts") - F.expr(f"interval {gap}"), F.col("ts") + F.expr(f"interval {gap}"))
    under = F.col("nav_ts") < F.col("ts")
    return s.join(n, near).groupBy(*scans.columns).agg(
        F.max_by("_record", F.when(under, F.col("nav_ts"))).alias("before"), F.min_by("_record", F.when(~under, F.col("nav_ts"))).alias("after"))
