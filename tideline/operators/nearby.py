"""Medians and weighted sums of the values around a place, exact, without rows for pairs of places and values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.geo import EARTH_KM, FAR_WEIGHT, KM_SCALE

#: Steps that a task takes together; values are copied only to the tasks whose steps they reach.
BLOCK = 8
#: Distances that a task holds at once.
HELD = 4_000_000


def near_medians(spots: DataFrame, values: DataFrame, by: list[str], step: str, windows: dict[int, list[int]], km: float) -> DataFrame:
    """``window, by, step, lat, lon, median, n`` of each spot and window with values: the median and number of the values of the same ``by`` within
    ``km`` whose step differs from the spot's by one of the window's offsets.

    ``spots`` has by, step, lat, lon (distinct rows); ``values`` has these, x and f (how often). A task holds a few steps' spots and values. It
    counts the values by place and by bucket of the sorted values; the product of who is near whom with these counts says in which bucket
    each spot's median lies, and only that bucket's values are looked at one by one.
    """
    offsets = sorted({o for every in windows.values() for o in every})
    block = lambda c: F.floor(c / BLOCK).cast("int")
    placed = "lat is not null and lon is not null"
    s = spots.where(placed).select(*by, F.col(step).cast("int").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("_block", block(F.col("t")))
    reach = F.array_distinct(F.array(*(block(F.col("t") - o) for o in offsets)))
    named = [F.col(c).alias(c) for c in by]  # not the attributes of ``spots``, which may come from the same table
    v = values.where(placed).where("x is not null").groupBy(*named, F.col(step).cast("int").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("x").cast("double").alias("x")).agg(F.sum("f").cast("double").alias("f"))
    v = v.withColumn("_block", F.explode(reach))
    schema = spots.select(*by).schema.add("t", "integer").add("lat", "double").add("lon", "double").add("window", "integer").add("median", "double").add("n", "long")

    def medians(left: pa.Table, right: pa.Table) -> pa.Table:
        t, lat, lon = (left.column(c).to_numpy() for c in ("t", "lat", "lon"))
        vt, vlat, vlon, x, f = (right.column(c).to_numpy() for c in ("t", "lat", "lon", "x", "f"))
        found = []
        if len(t) and len(x):
            order = np.argsort(x, kind="stable")
            near = _Near(np.stack([lat, lon], axis=1), np.stack([vlat, vlon], axis=1)[order], km)
            for at in np.unique(t):
                rows = np.flatnonzero(t == at)
                for name, every in windows.items():
                    chosen = np.flatnonzero(np.isin(vt[order], at + np.array(every)))
                    found += [(some, np.full(len(some), name), *got) for some, *got in _of_window(rows, chosen, x[order], f[order], near)]
        row, name, median, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        out = left.take(pa.array(row, pa.int64()))
        columns = [*(out.column(c) for c in (*by, "t", "lat", "lon")), pa.array(name.astype(np.int32)), pa.array(median.astype(np.float64)), pa.array(n.astype(np.int64))]
        return pa.table(columns, names=[*by, "t", "lat", "lon", "window", "median", "n"])

    got = s.groupBy(*by, "_block").cogroup(v.groupBy(*by, "_block")).applyInArrow(medians, schema)
    return got.withColumnRenamed("t", step)


def _km(spots: np.ndarray, places: np.ndarray) -> np.ndarray:
    (a, lon), (b, lon2) = spots.T[:, :, None], places.T[:, None, :]
    h = np.sin(np.radians(b - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(b)) * np.sin(np.radians(lon2 - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class _Near:
    """Which places of values lie within ``km`` of which spots; kept where few places make it small, else found anew for each chunk."""

    def __init__(self, spots: np.ndarray, values: np.ndarray, km: float):
        self.km = km
        self.spots, self.spot = (a.reshape(s) for a, s in zip(np.unique(spots, axis=0, return_inverse=True), ((-1, 2), -1), strict=True))
        self.places, self.place = (a.reshape(s) for a, s in zip(np.unique(values, axis=0, return_inverse=True), ((-1, 2), -1), strict=True))
        whole = len(self.spots) * len(self.places) <= 4 * HELD
        self.kept = np.concatenate([self._of(self.spots[k : k + 256], self.places) for k in range(0, len(self.spots), 256)]) if whole else None

    def _of(self, spots: np.ndarray, places: np.ndarray) -> np.ndarray:
        return _km(spots, places) <= self.km

    def rows(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        if self.kept is not None:
            return self.kept[np.ix_(self.spot[rows], places)]
        return self._of(self.spots[self.spot[rows]], self.places[places])


def _of_window(rows: np.ndarray, chosen: np.ndarray, x: np.ndarray, f: np.ndarray, near: _Near):
    """``(rows, median, n)`` of the spots ``rows`` with values, chunk by chunk, over the ``chosen`` of the sorted values."""
    if not len(chosen):
        return
    x, f = x[chosen], f[chosen]
    places, at = np.unique(near.place[chosen], return_inverse=True)
    size = -(-len(x) // max(16, min(256, int(len(x) ** 0.5))))  # values of a bucket
    buckets = -(-len(x) // size)
    counts = np.bincount(at * buckets + np.arange(len(x)) // size, weights=f, minlength=len(places) * buckets).reshape(len(places), buckets)
    chunk = max(1, HELD // max(len(places), buckets))
    for some in (rows[k : k + chunk] for k in range(0, len(rows), chunk)):
        close = near.rows(some, places)
        upto = np.cumsum(close.astype(np.float64) @ counts, axis=1)  # whole numbers
        n = upto[:, -1]
        has = np.flatnonzero(n > 0)
        ends = [np.zeros(len(some)), np.zeros(len(some))]
        for end, place in zip(ends, (np.floor((n - 1) / 2), np.floor(n / 2)), strict=True):
            bucket = (upto <= place[:, None]).sum(axis=1)
            for i in has:
                low = bucket[i] * size
                held = np.cumsum(f[low : low + size] * close[i, at[low : low + size]])
                before = upto[i, bucket[i] - 1] if bucket[i] else 0.0
                end[i] = x[low + np.searchsorted(held, place[i] - before, side="right")]
        yield some[has], (0.5 * ends[0] + 0.5 * ends[1])[has], n[has]


def ranked_sums(groups: DataFrame, sources: DataFrame, by: list[str], factors: dict[tuple, float]) -> DataFrame:
    """``groups`` with ``every``: the sum of ``raw`` of the sources of the same ``by`` and of at least the same rank, each times the weight of the
    distance (``geo.w_geo``) and the factor of the two kinds (kind, kind).

    Both tables have by, lat, lon, rank, kind (rows of ``groups`` are distinct). Sources are added up by place, rank and kind; the weights of a
    period's places times these sums give all groups of a place at once, so that distances are of places and not of rows.
    """
    columns = [*by, "lat", "lon", "rank", "kind"]
    named = [F.col(c).alias(c) for c in (*by, "rank", "kind")]  # not the attributes of ``groups``, which may come from the same table
    s = sources.select(*named, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("raw").cast("double").alias("raw"))
    g = groups.select(columns)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        every = np.zeros(left.num_rows)
        if left.num_rows and right.num_rows:
            at = lambda t: np.stack([t.column(c).cast(pa.float64()).to_numpy() for c in ("lat", "lon")], axis=1)
            (spots, spot), (places, place) = (np.unique(at(t), axis=0, return_inverse=True) for t in (left, right))
            kinds = [list(zip(t.column("rank").to_pylist(), t.column("kind").to_pylist(), strict=True)) for t in (left, right)]
            (mine, my), (theirs, their) = ((names := sorted(set(k)), np.array(list(map({n: i for i, n in enumerate(names)}.get, k)))) for k in kinds)
            mass = np.bincount(place.reshape(-1) * len(theirs) + their, weights=right.column("raw").to_numpy(), minlength=len(places) * len(theirs)).reshape(len(places), -1)
            share = np.array([[factors[a, b] if r >= rank else 0.0 for rank, a in mine] for r, b in theirs])
            chunk = max(1, HELD // len(places))
            total = np.concatenate([np.maximum(FAR_WEIGHT, np.exp(-_km(spots[k : k + chunk], places) / KM_SCALE)) @ mass @ share for k in range(0, len(spots), chunk)])
            every = total[spot.reshape(-1), my]
        return left.append_column("every", pa.array(every, pa.float64()))

    return g.groupBy(*by).cogroup(s.groupBy(*by)).applyInArrow(sums, T.StructType([*g.schema.fields, T.StructField("every", T.DoubleType())]))
