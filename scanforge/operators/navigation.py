"""Navigation: time series by flight (flight, time, lat, lon, hei, roll, pitch, heading).

A flight may be long, so the as-of joins cut time into slots and carry only each slot's first and
last record to its neighbours: rows are sorted within (flight, slot), not within a flight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["lat", "lon", "hei", "roll", "pitch", "heading"]
#: The largest plausible steps, and the bits of the quality flag.
PLAUSIBLE = {"time": (0.05, 64), "lat": (0.0001, 1), "lon": (0.0001, 2), "hei": (0.5, 4), "roll": (0.12, 8), "pitch": (1.0, 16), "heading": (1.0, 32)}
#: Days from which a number of leap seconds holds.
LEAP_SECONDS = [("2006-01-01", 14), ("2009-01-01", 15), ("2012-07-01", 16), ("2015-07-01", 17), ("2017-01-01", 18)]
FRAME_WRAP = 10000
SLOT_SECONDS = 3600.0
ROWS_PER_TASK = 500_000


def plausibility(nav: DataFrame, force: bool = False) -> DataFrame:
    """Adds quality, the bits of fields whose step from the record before is too large; time may not go back unless forced."""
    own = Window.partitionBy("flight").orderBy("seq") if "seq" in nav.columns else Window.partitionBy("flight").orderBy("time")
    flag = F.lit(0)
    for name, (limit, bit) in PLAUSIBLE.items():
        step = F.abs(F.col(name) - F.lag(name).over(own))
        if name == "heading":
            step = F.least(step, 360 - step)
        flag = flag + F.when(step > limit, bit).otherwise(0)
    back = F.coalesce(F.col("time") < F.lag("time").over(own), F.lit(False))
    if not force:
        flag = F.when(back, F.raise_error(F.lit("time goes backwards"))).otherwise(flag)
    return nav.withColumn("quality", flag.cast("int"))


def triangle_weights(kernel: int) -> list[float]:
    """Weights of offsets -h+1 to h-1 for an odd kernel, h = (kernel - 1) / 2; they sum to 1."""
    if kernel < 3 or kernel % 2 == 0:
        raise ValueError("the kernel must be odd and at least 3")
    h = (kernel - 1) // 2
    return [(h - abs(i)) / h**2 for i in range(1 - h, h)]


def smooth(nav: DataFrame, kernel: int, fields: list[str] | None = None) -> DataFrame:
    """Triangular smoothing; the first and last (kernel + 1) / 2 records of a flight stay. Headings are unwrapped around the centre."""
    own = Window.partitionBy("flight").orderBy("time")
    weights = triangle_weights(kernel)
    h, edge = len(weights) // 2, (kernel + 1) // 2
    place = F.row_number().over(own)
    many = F.count("*").over(Window.partitionBy("flight"))
    inside = (place > edge) & (place <= many - edge)
    out = {}
    for name in fields or FIELDS:
        total = F.lit(0.0)
        for i, weight in zip(range(-h, h + 1), weights, strict=True):
            near = F.lag(name, -i).over(own) if i else F.col(name)
            if name == "heading":
                turn = near - F.col(name)
                near = F.when(turn > 180, near - 360).when(turn < -180, near + 360).otherwise(near)
            total = total + near * weight
        if name == "heading":
            total = F.when(total < 0, total + 360).when(total >= 360, total - 360).otherwise(total)
        out[name] = F.when(inside, total).otherwise(F.col(name))
    return nav.withColumns(out)


def pieces(*frames: DataFrame) -> int:
    """Tasks over the rows of frames together, so that one sorts about ROWS_PER_TASK of them however many there are."""
    return max(1, -(-sum(f.count() for f in frames) // ROWS_PER_TASK))


def bracket(scans: DataFrame, nav: DataFrame, slot: float = SLOT_SECONDS) -> DataFrame:
    """Each scan (flight, time, more columns) with the records around it, before and after.

    before is the last record with a time under the scan's, after the first from there on. Each record carries
    the one after it, so all frames run forward from the first row and cost no more than a sort.
    """
    cut = F.floor(F.col("time") / slot).cast("long")
    within, by_slot = Window.partitionBy("flight", "slot"), Window.partitionBy("flight").orderBy("slot")
    few, many = pieces(nav), pieces(nav, scans)
    points = nav.select("flight", cut.alias("slot"), "time", F.struct("time", *FIELDS).alias("record")).repartition(few, "flight", "slot")
    # The record's fields settle the order of equal times, and place keeps it through the second sort.
    points = points.withColumns({"place": F.row_number().over(within.orderBy("record")), "follows": F.lead("record").over(within.orderBy("record"))})
    first, last = F.max(F.when(F.col("place") == 1, F.col("record"))), F.max(F.when(F.col("follows").isNull(), F.col("record")))
    edges = points.filter("place = 1 OR follows IS NULL").groupBy("flight", "slot").agg(first.alias("first"), last.alias("last")).repartition(few, "flight")
    edges = edges.select("flight", "slot", F.struct("slot", "last", F.lag("last").over(by_slot).alias("earlier"), F.lead("first").over(by_slot).alias("later")).alias("edge"), F.when(F.row_number().over(by_slot) == 1, F.col("first")).alias("start"))
    others = [c for c in scans.columns if c not in ("flight", "time")]
    asked = scans.select("flight", cut.alias("slot"), "time", F.struct("time", *others).alias("scan"))
    slots = asked.select("flight", "slot").repartition(many, "flight", "slot").distinct().withColumn("kind", F.lit(1)).unionByName(edges.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    forward = Window.partitionBy("flight").orderBy("slot", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.repartition(many, "flight").withColumns({"edge": F.last("edge", True).over(forward), "start": F.max("start").over(Window.partitionBy("flight"))}).filter("kind = 1")
    carried = F.when(F.col("edge.slot") < F.col("slot"), F.col("edge.last")).otherwise(F.col("edge.earlier"))
    coming = F.when(F.col("edge").isNull(), F.col("start")).otherwise(F.col("edge.later"))
    slots = slots.select("flight", "slot", carried.alias("carried"), coming.alias("coming")).repartition(many, "flight", "slot")
    rows = points.select("flight", "slot", "time", F.lit(1).alias("kind"), "place", "record", "follows").unionByName(asked.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition(many, "flight", "slot")
    order = within.orderBy("time", "kind", "place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.max(F.when(F.col("place") == 1, F.col("record"))).over(within)
    rows = rows.withColumns({"prev": F.last(F.when(F.col("kind") == 1, F.struct("record", "follows")), True).over(order), "start": start}).filter("kind = 0")
    rows = rows.withColumn("next", F.when(F.col("prev").isNull(), F.col("start")).otherwise(F.col("prev.follows"))).select("flight", "slot", "scan", F.col("prev.record").alias("prev"), "next")
    rows = rows.join(slots, ["flight", "slot"], "left")
    return rows.select("flight", "scan.*", F.coalesce("prev", "carried").alias("before"), F.coalesce("next", "coming").alias("after"))


def interpolate(scans: DataFrame, nav: DataFrame, slot: float = SLOT_SECONDS) -> DataFrame:
    """Linear interpolation at the scans' times; null outside the record. Headings go the short way round."""
    b = bracket(scans, nav, slot)
    share = (F.col("time") - F.col("before.time")) / (F.col("after.time") - F.col("before.time"))
    out = []
    for name in FIELDS:
        x, y = F.col(f"before.{name}"), F.col(f"after.{name}")
        if name == "heading":
            y = F.when(y - x > 350, y - 360).when(x - y > 350, y + 360).otherwise(y)
        value = x + (y - x) * share
        if name == "heading":
            value = F.when(value < 0, value + 360).when(value >= 360, value - 360).otherwise(value)
        exact = F.when(F.col("after.time") == F.col("time"), F.col(f"after.{name}"))
        out.append(F.coalesce(exact, value).alias(name))
    return b.select(*[c for c in b.columns if c not in ("before", "after")], *out)


def spline(scans: DataFrame, nav: DataFrame) -> DataFrame:
    """A natural cubic spline by flight. The tridiagonal system needs a flight's records together: one task for each flight."""
    schema = f"flight {dict(scans.dtypes)['flight']}, time double, " + ", ".join(f"{f} double" for f in FIELDS)

    def fit(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        points, at = points.sort_values("time"), asked["time"].to_numpy()
        t = points["time"].to_numpy()
        y = points[FIELDS].to_numpy(float).copy()
        turning = FIELDS.index("heading")
        y[:, turning] = np.degrees(np.unwrap(np.radians(y[:, turning])))
        value = natural_spline(t, y, at) if len(t) > 1 else np.full((len(at), len(FIELDS)), np.nan)
        value[:, turning] %= 360
        return pd.DataFrame({"flight": [key[0]] * len(at), "time": at} | {name: value[:, k] for k, name in enumerate(FIELDS)})

    return nav.select("flight", "time", *FIELDS).groupBy("flight").cogroup(scans.select("flight", "time").groupBy("flight")).applyInPandas(fit, schema)


def natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at `at`, not a number outside [t0, tn]; columns of y are fields, solved together."""
    if y.ndim == 1:
        return natural_spline(t, y[:, None], at)[:, 0]
    n, h = len(t), np.diff(t)
    second = np.zeros(y.shape)
    if n > 2:
        rise = np.diff(y, axis=0) / h[:, None]
        diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(rise, axis=0)
        for i in range(1, n - 2):  # Thomas algorithm
            w = h[i] / diagonal[i - 1]
            diagonal[i] -= w * h[i]
            right[i] -= w * right[i - 1]
        for i in range(n - 3, -1, -1):
            second[i + 1] = (right[i] - h[i + 1] * second[i + 2]) / diagonal[i]
    i = np.clip(np.searchsorted(t, at, side="left") - 1, 0, n - 2)
    a, b = ((t[i + 1] - at) / h[i])[:, None], ((at - t[i]) / h[i])[:, None]
    value = a * y[i] + b * y[i + 1] + ((a**3 - a) * second[i] + (b**3 - b) * second[i + 1]) * h[i, None] ** 2 / 6
    return np.where(((at >= t[0]) & (at <= t[-1]))[:, None], value, np.nan)


INTERPOLATORS = {"linear": interpolate, "spline": spline}


def attitude_offset(scans: DataFrame, nav: DataFrame, position: DataFrame, offset: float) -> DataFrame:
    """position's rows with roll, pitch and heading as they are `offset` seconds later."""
    late = interpolate(scans.select("flight", "time").withColumn("time", F.col("time") + offset), nav).select("flight", (F.col("time") - offset).alias("time"), "roll", "pitch", "heading")
    tasks = pieces(scans, scans)
    own, late = (f.repartition(tasks, "flight", "time") for f in (position.drop("roll", "pitch", "heading"), late))
    return own.join(late, ["flight", "time"])


def scan_times(lines: DataFrame) -> DataFrame:
    """Rows (flight, start, fps, lines, crop) to one row per scan with its time."""
    return lines.select("flight", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("scan"), "start", "fps", "crop").select("flight", "scan", (F.col("start") + (F.col("scan") + F.col("crop")) / F.col("fps")).alias("time"))


def shift_times(nav: DataFrame, offset: float) -> DataFrame:
    """New scan times from each flight's start and mean separation, ceil(|offset| / separation) fewer, moved by offset."""
    f = nav.groupBy("flight").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n"))
    f = f.filter("n > 1").withColumn("sep", (F.col("last") - F.col("first")) / (F.col("n") - 1))
    f = f.withColumn("keep", F.col("n") - F.ceil(F.abs(F.lit(offset)) / F.col("sep"))).filter("keep > 0")
    start = F.col("first") + F.lit(max(offset, 0.0))
    return f.select("flight", F.explode(F.sequence(F.lit(0), (F.col("keep") - 1).cast("int"))).alias("scan"), start.alias("start"), "sep").select("flight", "scan", (F.col("start") + F.col("scan") * F.col("sep")).alias("time"))


def nearest_sync(starts: DataFrame, syncs: DataFrame, by: str = "flight") -> DataFrame:
    """For each start (flight, start) the sync (seq, gps) that is nearest in whole seconds, the first of ties.

    Partial aggregation keeps one row per start and task; starts are few for each flight.
    """
    gap = F.abs(F.col("gps") - F.col("start")).cast("long")
    return starts.join(syncs, by).groupBy(by, "start").agg(F.min(F.struct(gap.alias("gap"), "seq", "gps")).alias("m")).select(by, "start", F.col("m.seq").alias("seq"), F.col("m.gps").alias("gps"), F.col("m.gap").alias("gap"))


def sync_of_frames(frames: DataFrame, syncs: DataFrame, by: str = "flight") -> DataFrame:
    """Each frame (flight, frame) with the sync whose interval [frame, next sync's frame) holds it."""
    rows = syncs.select(by, "frame", F.lit(0).alias("kind"), F.struct(F.col("frame").alias("sync_frame"), "gps").alias("sync")).unionByName(frames.select(by, "frame", F.lit(1).alias("kind")), allowMissingColumns=True)
    held = F.last("sync", True).over(Window.partitionBy(by).orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("held", held).filter("kind = 1").select(by, "frame", F.col("held.sync_frame").alias("sync_frame"), F.col("held.gps").alias("gps"))


def normalise_syncs(syncs: DataFrame, by: str = "flight") -> DataFrame:
    """Per-second messages (seq, gps, delay, frame) as whole-second ones. Repairs depend on the repaired record before, so a flight's messages (one a second) are one group."""

    def repair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq").reset_index(drop=True)
        gps, frames, wraps = frame["gps"].to_numpy() + 1, frame["frame"].to_numpy() - 1, 0
        for i in range(1, len(gps)):
            if gps[i] == gps[i - 1]:
                gps[i] += 1
            elif gps[i] == gps[i - 1] + 2:
                gps[i] -= 1
            if frames[i] + wraps < frames[i - 1]:
                wraps += FRAME_WRAP
            frames[i] += wraps
        return frame.assign(gps=gps, frame=frames, delay=1 - frame["delay"])

    return syncs.groupBy(by).applyInPandas(repair, syncs.schema)


def unroll_days(records: DataFrame, by: str = "flight") -> DataFrame:
    """Seconds of the day (column second, in order of seq) made continuous over midnight."""
    own = Window.partitionBy(by).orderBy("seq")
    back = (F.col("second") < F.lag("second").over(own)).cast("int")
    return records.withColumn("time", F.col("second") + 86400 * F.coalesce(F.sum(back).over(own), F.lit(0)))


def leap_seconds(date: Column) -> Column:
    """Those that hold on a day; an error before 2006."""
    out = F.raise_error(F.lit("no leap seconds are known before 2006")).cast("int")
    for day, seconds in LEAP_SECONDS:
        out = F.when(date >= F.lit(day).cast("date"), F.lit(seconds)).otherwise(out)
    return out


def limits(nav: DataFrame, low: int | None = None, high: int | None = None, column: str = "scan") -> DataFrame:
    """Extremes of latitude, longitude, height and roll by flight, over scans of [low, high)."""
    if low is not None:
        nav = nav.filter((F.col(column) >= low) & (F.col(column) < high))
    return nav.groupBy("flight").agg(*[f(n).alias(f"{k}_{n}") for n in ("lat", "lon", "hei", "roll") for k, f in (("min", F.min), ("max", F.max))])


def check_times(first_scan: float, nav_first: float, nav_last: float, sync_gap: float) -> Iterator[str]:
    """Warnings about a start far from the navigation; an error if it cannot belong to it."""
    day = 86400
    if first_scan > nav_last or (abs(first_scan - nav_first) > day and abs(first_scan - nav_last) > day):
        raise ValueError("the scan's start is not within the navigation")
    if abs(first_scan - nav_first) > day or abs(first_scan - nav_last) > day:
        yield "the scan's start is more than a day from one end of the navigation"
    if sync_gap > 30:
        yield "the scan's start is more than 30 seconds from its sync message"


def boresight(nav: DataFrame, roll: float, pitch: float, heading: float) -> DataFrame:
    """F16."""
    return nav.withColumns({"roll": F.col("roll") + roll, "pitch": F.col("pitch") + pitch, "heading": F.col("heading") + heading})


def lever_arm(nav: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """the position moved by an arm of the aircraft's frame."""
    from ..functions import geodesy as g

    arm = g.look_to_ecef((F.lit(x), F.lit(y), F.lit(z)), F.col("lat"), F.col("lon"), F.col("roll"), F.col("pitch"), F.col("heading"))
    base = g.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("hei"))
    moved = nav.withColumns({f"_{n}": a + b for n, a, b in zip("xyz", base, arm, strict=True)})
    lat, lon, hei = g.ecef_to_llh(F.col("_x"), F.col("_y"), F.col("_z"))
    return moved.withColumns({"lat": lat, "lon": lon, "hei": hei}).drop("_x", "_y", "_z")
