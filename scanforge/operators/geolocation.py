"""Geolocation: where each pixel's ray meets the ellipsoid or the elevation model.

Rays are columns; scans are independent. The elevation model is cut into square tiles; each ray goes
to the tiles under its path between the highest and the lowest terrain, so neither the model nor a
flight line is held in one place; the rays of a tile are dealt over groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as g

MAX_VIEW_ANGLE = 80.0
MAX_VIEWS = 1 << 16
TILE = 64
EDGE = 1e-8
RAYS_PER_GROUP, CELLS_AT_ONCE = 1 << 16, 1 << 17


def bin_views(views: DataFrame, binning: int, start: int = 0, count: int | None = None) -> DataFrame:
    """View vectors (sample, rx, ry, rz) averaged over `binning` samples, then cropped and numbered from 0."""
    v = views.groupBy(F.floor(F.col("sample") / binning).cast("int").alias("sample")).agg(*[F.avg(c).alias(c) for c in ("rx", "ry", "rz")])
    v = v.filter(F.col("sample") >= start)
    return (v if count is None else v.filter(F.col("sample") < start + count)).withColumn("sample", F.col("sample") - start)


def rays(scans: DataFrame, views: DataFrame, combine: bool = False, max_angle: float = MAX_VIEW_ANGLE) -> DataFrame:
    """A row per scan and sample with origin (x, y, z) and direction (dx, dy, dz), null beyond max_angle.

    combine adds view and attitude angles for one rotation; else the view's own rotation comes first.
    Views are a detector's samples: at most MAX_VIEWS, which is checked, so they are broadcast.
    """
    if views.limit(MAX_VIEWS + 1).count() > MAX_VIEWS:
        raise ValueError("view vectors must be one for each sample of a detector")
    p = scans.crossJoin(F.broadcast(views))
    col, down = F.col, (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    if combine:
        v = g.look_to_ecef(down, col("lat"), col("lon"), col("roll") + col("rx"), col("pitch") + col("ry"), col("heading") + col("rz"))
    else:
        v = g.look_to_ecef(down, col("lat"), col("lon"), col("roll"), col("pitch"), col("heading"), (col("rx"), col("ry"), col("rz")))
    o = g.llh_to_ecef(col("lat"), col("lon"), col("hei"))
    p = p.withColumns(dict(zip(("x", "y", "z", "dx", "dy", "dz"), (*o, *v), strict=True)))
    toward = -(col("x") * col("dx") + col("y") * col("dy") + col("z") * col("dz")) / F.sqrt(col("x") ** 2 + col("y") ** 2 + col("z") ** 2)
    bad = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), toward)))) > max_angle
    return p.withColumns({c: F.when(~bad, col(c)) for c in ("dx", "dy", "dz")})


def bad_view_angles(p: DataFrame) -> DataFrame:
    """A19."""
    return p.agg(F.count_if(F.col("dx").isNull()).alias("bad"))


def _hit(distance: Column) -> tuple[Column, Column, Column]:
    return tuple(F.col(o) + distance * F.col(d) for o, d in zip("xyz", ("dx", "dy", "dz"), strict=True))


def locate(p: DataFrame, height: float = 0.0) -> DataFrame:
    """F8, F2: rays with distance and longitude, latitude and height where they meet the raised ellipsoid; null without a hit."""
    p = p.withColumn("distance", g.ray_ellipsoid((F.col("x"), F.col("y"), F.col("z")), (F.col("dx"), F.col("dy"), F.col("dz")), F.col("hei"), height))
    lat, lon, hei = g.ecef_to_llh(*_hit(F.col("distance")))
    return p.withColumns({"pixel_lat": lat, "pixel_lon": lon, "pixel_hei": hei})


def nadir(p: DataFrame) -> DataFrame:
    """by scan the sample that looks most steeply down."""
    down = -(F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz"))
    return p.groupBy("scan").agg(F.max_by("sample", down).alias("nadir"))


def atmosphere(located: DataFrame) -> DataFrame:
    """Adds azimuth, zenith and distance from each pixel to the sensor."""
    d, az, ze = g.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("hei"), F.col("pixel_lon"), F.col("pixel_lat"), F.col("pixel_hei"))
    return located.withColumns({"azimuth": az, "zenith": ze, "path": d})


def slope_aspect(dem: DataFrame, xspace: float, yspace: float, top: float) -> DataFrame:
    """Slope and aspect of the cells with all eight neighbours; dem is (r, c, h), top the latitude of row 0."""
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1 - k // 3).alias("a"), F.lit(1 - k % 3).alias("b")) for k in range(9)]))
    near = dem.select("r", "c", "h", shifts.alias("s")).select((F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), "s.k", "h")
    z = near.groupBy("r", "c").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("h"))).alias(f"z{k}") for k in range(9)]).filter("n = 9")
    xs, ys = g.metres_per_degree(F.lit(top) - F.col("r") * yspace)
    slope, aspect = g.horn([F.col(f"z{k}") for k in range(9)], xspace, yspace, xs, ys)
    return z.select("r", "c", slope.alias("slope"), aspect.alias("aspect"))


def height_at(points: DataFrame, dem: DataFrame, left: float, top: float, xspace: float, yspace: float) -> DataFrame:
    """Points (lon, lat) with the height of their cell; null outside. A cell without height is an error."""
    height = F.when(F.col("h").isNull(), F.raise_error(F.lit("the elevation model has a cell without height")).cast("double")).otherwise(F.col("h"))
    dem = dem.select("r", "c", height.alias("h"))
    row, col = F.floor((F.lit(top) - F.col("lat")) / yspace + 0.01).cast("long"), F.floor((F.col("lon") - left) / xspace + 0.01).cast("long")
    return points.withColumns({"r": row, "c": col}).join(dem, ["r", "c"], "left")


def dem_area(nav: DataFrame, views: DataFrame, xspace: float, yspace: float) -> tuple[float, float, float, float] | None:
    """West, south, east and north of the swath: the navigation's extremes, and the widest view from the greatest height, grown by one cell."""
    n = nav.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.max("hei"), F.max(F.abs("roll"))).first()
    v = views.agg(F.max(F.abs("rx")), F.max(F.abs("ry"))).first()
    if n[0] is None or v[0] is None:
        return None
    angle = np.radians(min(89.0, n[5] + max(v[0], v[1])))
    reach = n[4] * np.tan(angle)
    lat = np.radians(max(abs(n[0]), abs(n[1])))
    dy, dx = reach / 110_574 + yspace, reach / (111_320 * max(np.cos(lat), 0.01)) + xspace
    return n[2] - dx, n[0] - dy, n[3] + dx, n[1] + dy


def select_dem(dem: DataFrame, area: tuple[float, float, float, float], left: float, top: float, xspace: float, yspace: float) -> DataFrame:
    """The cells of an area, its bounds snapped outward; the filter reaches the scan."""
    west, south, east, north = area
    rows, cols = (int(np.floor((top - north) / yspace)), int(np.ceil((top - south) / yspace))), (int(np.floor((west - left) / xspace)), int(np.ceil((east - left) / xspace)))
    return dem.filter(F.col("r").between(*rows) & F.col("c").between(*cols))


def _ecef(lat: np.ndarray, lon: np.ndarray, h: np.ndarray) -> np.ndarray:
    phi, lam = np.radians(lat), np.radians(lon)
    c = np.sqrt(1 - g.EE * np.sin(phi) ** 2)
    return np.stack([(g.A / c + h) * np.cos(phi) * np.cos(lam), (g.A / c + h) * np.cos(phi) * np.sin(lam), (g.A * (1 - g.EE) / c + h) * np.sin(phi)], -1)


def _llh(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude, longitude and height by Bowring's iteration on the reduced latitude, to a nanometre near the ground."""
    x, y, z = p[..., 0], p[..., 1], p[..., 2]
    r = np.hypot(x, y)
    beta = np.arctan2(z * g.A, r * g.B)
    for _ in range(3):
        phi = np.arctan2(z + g.EE2 * g.B * np.sin(beta) ** 3, r - g.EE * g.A * np.cos(beta) ** 3)
        beta = np.arctan2((1 - g.FLATTENING) * np.sin(phi), np.cos(phi))
    n = g.A / np.sqrt(1 - g.EE * np.sin(phi) ** 2)
    height = np.where(np.abs(phi) < 1.5, r / np.cos(phi) - n, np.abs(z) / np.maximum(np.abs(np.sin(phi)), 1e-12) - n * (1 - g.EE))
    return np.degrees(phi), np.degrees(np.arctan2(y, x)), height


def _turned(axis: int, angle: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors turned about an axis (0 x, 1 y, 2 z) by degrees."""
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = v.copy()
    out[:, i], out[:, j] = c * v[:, i] - s * v[:, j], s * v[:, i] + c * v[:, j]
    return out


def _directions(f: pd.DataFrame, combine: bool) -> np.ndarray:
    """The rays' directions in the earth-centred frame, as look_to_ecef has them."""
    v = np.tile([0.0, 0.0, 1.0], (len(f), 1))
    view, attitude = (f["rx"], f["ry"], f["rz"]), (f["roll"], f["pitch"], f["heading"])
    turns = [[a + b for a, b in zip(view, attitude, strict=True)]] if combine else [view, attitude]
    for rx, ry, rz in turns:
        for axis, angle in ((1, ry), (0, rx), (2, rz)):
            v = _turned(axis, angle.to_numpy(float), v)
    return _turned(2, f["lon"].to_numpy(float), _turned(1, -(f["lat"].to_numpy(float) + 90), v))


def _raised_hit(o: np.ndarray, d: np.ndarray, height: np.ndarray, level: float) -> np.ndarray:
    """Distances to the ellipsoid raised by level; not a number without one ahead."""
    s = np.array([1 / (g.A + level) ** 2] * 2 + [1 / (g.B + level) ** 2])
    a, b, c = (d * d * s).sum(1), 2 * (o * d * s).sum(1), (o * o * s).sum(1) - 1
    with np.errstate(invalid="ignore"):
        root = np.sqrt(b * b - 4 * a * c)
    near, far = (root - b) / (2 * a), (-b - root) / (2 * a)
    hit = np.where((near - height) ** 2 < (far - height) ** 2, near, far)
    return np.where(hit >= 0, hit, np.nan)


def ray_triangles(origin: np.ndarray, direction: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """distances of one ray, or of a row of rays each, to planes of triangles (rows), infinite where it misses: barycentric u, v >= -EDGE, u + v <= 1 + EDGE."""
    e1, e2 = b - a, c - a
    p = np.cross(direction, e2)
    det = (e1 * p).sum(-1)
    with np.errstate(all="ignore"):
        s = origin - a
        u = (s * p).sum(-1) / det
        q = np.cross(s, e1)
        v = (q * direction).sum(-1) / det
        t = (e2 * q).sum(-1) / det
    return np.where((u >= -EDGE) & (v >= -EDGE) & (u + v <= 1 + EDGE) & (t >= 0), t, np.inf)


def locate_on_dem(scans: DataFrame, views: DataFrame, dem: DataFrame, left: float, top: float, xspace: float, yspace: float, combine: bool = False) -> DataFrame:
    """Scan, sample and where the ray first meets the terrain (lon, lat, height, distance); null without a hit.

    The terrain is two triangles between neighbouring heights (r, c, h), cut along the diagonal from upper left to lower right.
    """
    if views.limit(MAX_VIEWS + 1).count() > MAX_VIEWS:
        raise ValueError("view vectors must be one for each sample of a detector")
    low, high = dem.agg(F.min("h"), F.max("h")).first()
    p = scans.select("scan", "lat", "lon", "hei", "roll", "pitch", "heading").crossJoin(F.broadcast(views.select("sample", "rx", "ry", "rz")))
    none = F.lit(None).cast("double")
    if low is None:
        return p.select("scan", "sample", none.alias("lon"), none.alias("lat"), none.alias("height"), none.alias("distance"))
    kinds = dict(p.dtypes)
    names = ["x", "y", "z", "dx", "dy", "dz"]

    def aim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rays and the cells under their path between the highest and the lowest terrain, grown by one."""
        for f in frames:
            o, d = _ecef(f["lat"].to_numpy(float), f["lon"].to_numpy(float), f["hei"].to_numpy(float)), _directions(f, combine)
            down = -(o * d).sum(1) / np.linalg.norm(o, axis=1)
            ends = []
            for level in (high + 1.0, low - 1.0):
                lat, lon, _ = _llh(o + _raised_hit(o, d, f["hei"].to_numpy(float), level)[:, None] * d)
                ends.append(((top - lat) / yspace, (lon - left) / xspace))
            rows, cols = np.sort([ends[0][0], ends[1][0]], 0), np.sort([ends[0][1], ends[1][1]], 0)
            out = pd.DataFrame(np.hstack((o, d)), columns=names)
            out.insert(0, "sample", f["sample"].to_numpy())
            out.insert(0, "scan", f["scan"].to_numpy())
            seen = np.isfinite(rows).all(0) & np.isfinite(cols).all(0) & (down >= np.cos(np.radians(MAX_VIEW_ANGLE)))
            for name, cell in (("r0", rows[0] - 1), ("r1", rows[1] + 1), ("c0", cols[0] - 1), ("c1", cols[1] + 1)):
                out[name] = np.floor(np.where(seen, cell, 0)).astype(np.int64)
            yield out[seen]

    rays = p.mapInPandas(aim, f"scan {kinds['scan']}, sample {kinds['sample']}, " + ", ".join(f"{n} double" for n in names) + ", r0 long, r1 long, c0 long, c1 long")
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE))
    asked = rays.withColumn("tr", F.explode(tiles("r0", "r1"))).withColumn("tc", F.explode(tiles("c0", "c1")))
    # The rays of a tile are dealt over groups of bounded size, each of which gets the tile once.
    groups = asked.groupBy("tr", "tc").agg(F.ceil(F.count("*") / RAYS_PER_GROUP).cast("int").alias("groups"))
    asked = asked.join(groups, ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64("scan", "sample"), F.col("groups")).cast("int")).drop("groups")
    # A tile has the heights of its cells and of the next row and column.
    share = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / TILE), F.floor((F.col(c) - 1) / TILE))))
    posts = dem.select("r", "c", "h", share("r").alias("tr")).select("*", share("c").alias("tc")).join(groups, ["tr", "tc"])
    posts = posts.select("tr", "tc", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "r", "c", "h")

    def march(key: tuple, own: pd.DataFrame, posts: pd.DataFrame) -> pd.DataFrame:
        """The first of the triangles of a tile that each ray meets; rays with their cells go in slices of about CELLS_AT_ONCE."""
        top_row, left_col = int(key[0]) * TILE, int(key[1]) * TILE
        h = np.full((TILE + 1, TILE + 1), np.nan)
        h[posts["r"].to_numpy() - top_row, posts["c"].to_numpy() - left_col] = posts["h"].to_numpy(float)
        rows, cols = np.meshgrid(top_row + np.arange(TILE + 1), left_col + np.arange(TILE + 1), indexing="ij")
        v = _ecef(top - rows * yspace, left + cols * xspace, h)
        r0, c0 = np.maximum(own["r0"].to_numpy() - top_row, 0), np.maximum(own["c0"].to_numpy() - left_col, 0)
        tall, wide = np.minimum(own["r1"].to_numpy() - top_row, TILE - 1) - r0 + 1, np.minimum(own["c1"].to_numpy() - left_col, TILE - 1) - c0 + 1
        number = np.maximum(tall, 0) * np.maximum(wide, 0)
        o, d = own[names[:3]].to_numpy(float), own[names[3:]].to_numpy(float)
        distance = np.full(len(own), np.inf)
        crossed = np.flatnonzero(number)
        slices = np.cumsum(number[crossed]) // CELLS_AT_ONCE
        for some in np.split(crossed, np.flatnonzero(np.diff(slices)) + 1) if len(crossed) else ():
            first = np.concatenate(([0], np.cumsum(number[some])[:-1]))
            ray = np.repeat(some, number[some])
            k = np.arange(len(ray)) - np.repeat(first, number[some])
            r, c = r0[ray] + k // wide[ray], c0[ray] + k % wide[ray]
            a, e = v[r, c], v[r + 1, c + 1]
            t = np.minimum(ray_triangles(o[ray], d[ray], a, v[r, c + 1], e), ray_triangles(o[ray], d[ray], a, e, v[r + 1, c]))
            distance[some] = np.minimum.reduceat(t, first)
        hit = np.isfinite(distance)
        return pd.DataFrame({"scan": own["scan"][hit], "sample": own["sample"][hit], "distance": distance[hit]})

    of = ["tr", "tc", "part"]
    hits = asked.groupBy(*of).cogroup(posts.groupBy(*of)).applyInPandas(march, f"scan {kinds['scan']}, sample {kinds['sample']}, distance double")
    hits = hits.groupBy("scan", "sample").agg(F.min("distance").alias("distance"))
    p = p.join(hits, ["scan", "sample"], "left")

    def land(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            o, d = _ecef(f["lat"].to_numpy(float), f["lon"].to_numpy(float), f["hei"].to_numpy(float)), _directions(f, combine)
            lat, lon, height = _llh(o + f["distance"].to_numpy(float)[:, None] * d)
            yield pd.DataFrame({"scan": f["scan"], "sample": f["sample"], "lon": lon, "lat": lat, "height": height, "distance": f["distance"]})

    out = p.mapInPandas(land, f"scan {kinds['scan']}, sample {kinds['sample']}, lon double, lat double, height double, distance double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("lon", "lat", "height", "distance")})
