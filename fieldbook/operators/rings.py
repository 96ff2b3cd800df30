"""How many places lie within each of several distances of a point, and the nearest few, without a row for each pair.

Places are cut into strips of equal count by latitude and ordered by longitude in each. A circle covers one span of a strip:
what surely lies in it is counted by two look-ups, and only the places near the circle's line are measured.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

_STRIP = 8.0  # places in a strip as long as it is high, about
_AT_ONCE = 1 << 18  # strips or measured places taken at once
_HALVED, _LITTLE = 16, 8  # times a circle is halved for the nearest few, and how many times as many it may measure


class Places:
    """Places of one block, equal ones once with their number."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, earth: float):
        good = np.isfinite(lat) & np.isfinite(lon)
        (lat, lon), many = np.unique(np.stack([lat[good], lon[good]]), axis=1, return_counts=True)  # ordered by latitude
        n = len(lat)
        self.n, self.earth = n, earth
        strips = max(1, int(math.sqrt(n / _STRIP)))
        strip = np.arange(n) * strips // max(n, 1)
        order = np.lexsort((lon, strip))
        self.lat, self.lon = lat[order], lon[order]
        self.many = np.r_[0, np.cumsum(many[order])]
        cut = np.searchsorted(strip, np.arange(strips + 1))
        self.south, self.north = (lat[cut[:-1]], lat[cut[1:] - 1]) if n else (lat, lat)
        low, high = np.radians(np.abs(self.south)), np.radians(np.abs(self.north))
        self.least_cos = np.maximum(np.cos(np.maximum(low, high)), 0.0)
        self.most_cos = np.where((self.south <= 0) & (self.north >= 0), 1.0, np.cos(np.minimum(low, high)))
        self.west = lon.min() if n else 0.0
        self.wide = (lon.max() - self.west if n else 0.0) + 1.0
        self.place = strip * self.wide + (self.lon - self.west)
        self.slack = 8 * np.spacing(strips * self.wide + 720.0) + 1e-12

    def distance(self, at: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        a, o = self.lat[at], self.lon[at]
        h = (np.sin(np.radians(lat - a) / 2) ** 2
             + np.cos(np.radians(a)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - o) / 2) ** 2)
        return 2.0 * self.earth * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

    def _strips(self, lat: np.ndarray, radius):
        """(point, strip) for each strip that a circle around the point may touch."""
        reach = np.degrees(radius / self.earth) * (1 + 1e-9) + 1e-12
        first = np.searchsorted(self.north, lat - reach, "left")
        count = np.maximum(np.searchsorted(self.south, lat + reach, "right") - first, 0)
        point = np.repeat(np.arange(len(lat)), count)
        return point, np.arange(len(point)) - np.repeat(np.cumsum(count) - count, count) + first[point]

    def _span(self, strip, lon, half):
        """Positions from and to which a strip's places lie within ``half`` degrees of a longitude."""
        ends = [np.searchsorted(self.place, strip * self.wide + np.clip(lon + h - self.west, -0.5, self.wide - 0.5), side)
                for h, side in ((-half, "left"), (half, "right"))]
        return ends[0], np.maximum(*ends)

    def _spans(self, point, strip, lat, lon, radius):
        """Of each strip the span that may lie within the radius (one, or one a point), and the part of it that surely does."""
        a, o, radius = lat[point], lon[point], np.broadcast_to(radius, lat.shape)[point]
        south, north = np.radians(self.south[strip] - a), np.radians(self.north[strip] - a)
        hav = lambda x: np.sin(x / 2) ** 2
        far = np.maximum(hav(south), hav(north))
        close = np.where((south <= 0) & (north >= 0), 0.0, np.minimum(hav(south), hav(north)))
        whole, own = hav(np.minimum(radius / self.earth, math.pi)), np.maximum(np.cos(np.radians(a)), 0.0)
        half = lambda h, c: np.degrees(2 * np.arcsin(np.sqrt(np.clip(h / np.maximum(c * own, 1e-300), 0.0, 1.0))))
        may = half(whole * (1 + 1e-9) + 1e-18 - close, self.least_cos[strip]) * (1 + 1e-9) + self.slack
        inner = whole * (1 - 1e-9) - 1e-18 - far
        sure = half(inner, self.most_cos[strip]) * (1 - 1e-9) - self.slack
        from_, to = self._span(strip, o, np.where(whole * (1 + 1e-9) + 1e-18 >= close, np.minimum(may, 180.0), -1.0))
        to = np.maximum(to, from_)
        start, end = self._span(strip, o, np.where((inner > 0) & (sure > 0), np.minimum(sure, 180.0 - self.slack), 0.0))
        none = (inner <= 0) | (sure <= 0) | (end <= start)
        start, end = np.where(none, to, np.clip(start, from_, to)), np.where(none, to, np.clip(end, from_, to))
        return from_, start, end, to

    def _measured(self, point, begin, end, lat, lon, own):
        """(point, place, distance) of the places from ``begin`` up to ``end``, some at a time. Half a turn west counts, east does not."""
        size = end - begin
        some = np.flatnonzero(size > 0)
        for part in _pieces(size[some]):
            k = some[part]
            n = size[k]
            p = np.repeat(point[k], n)
            at = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[k], n)
            turn = self.lon[at] - lon[p]
            once = (turn >= -180.0) & (turn < 180.0)
            p, at = p[once], at[once]
            yield p, at, self.distance(at, lat[p], own[p])

    def counts(self, lat: np.ndarray, lon: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Places within the radius of each point, the line included."""
        out = np.zeros(len(lat), dtype=np.int64)
        for rows in _pieces(self._touched(lat, radius)):
            point, strip = self._strips(lat[rows], radius)
            from_, start, end, to = self._spans(point, strip, lat[rows], lon[rows], radius)
            got = np.zeros(rows.stop - rows.start, dtype=np.int64)
            np.add.at(got, point, self.many[end] - self.many[start])
            for begin, stop in ((from_, start), (end, to)):
                for p, at, d in self._measured(point, begin, stop, lat[rows], lon[rows], own[rows]):
                    hit = d <= radius
                    np.add.at(got, p[hit], (self.many[at + 1] - self.many[at])[hit])
            out[rows] = got
        return out

    def _touched(self, lat, radius):
        reach = np.degrees(radius / self.earth) * (1 + 1e-9) + 1e-12
        return np.searchsorted(self.south, lat + reach, "right") - np.searchsorted(self.north, lat - reach, "left") + 1

    def _held(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray):
        """Places that surely lie within each point's radius, and the different ones that may."""
        sure, may = np.zeros((2, len(lat)), dtype=np.int64)
        for rows in _pieces(self._touched(lat, radius)):
            point, strip = self._strips(lat[rows], radius[rows])
            from_, start, end, to = self._spans(point, strip, lat[rows], lon[rows], radius[rows])
            np.add.at(sure[rows], point, self.many[end] - self.many[start])
            np.add.at(may[rows], point, to - from_)
        return sure, may

    def nearest(self, lat: np.ndarray, lon: np.ndarray, own: np.ndarray, radius: float, few: int) -> list[np.ndarray]:
        """The least distances within the radius, ``few`` at most.

        Each point's circle is halved between one that holds too few and one that surely holds enough, until it has little
        to measure.
        """
        found: list[np.ndarray] = [np.empty(0)] * len(lat)
        if not self.n or not few:
            return found
        low, high = np.zeros(len(lat)), np.full(len(lat), float(radius))
        sure, may = self._held(lat, lon, high)
        for _ in range(_HALVED):
            k = np.flatnonzero((sure >= few) & (may > _LITTLE * few))
            if not len(k):
                break
            mid = (low[k] + high[k]) / 2
            now, may_now = self._held(lat[k], lon[k], mid)
            enough = now >= few
            low[k] = np.where(enough, low[k], mid)
            high[k] = np.where(enough, mid, high[k])
            may[k] = np.where(enough, may_now, may[k])
        for rows in _pieces(np.maximum(self._touched(lat, high), may)):
            point, strip = self._strips(lat[rows], high[rows])
            from_, _, _, to = self._spans(point, strip, lat[rows], lon[rows], high[rows])
            least = _Least(rows.stop - rows.start, few)
            for p, at, d in self._measured(point, from_, to, lat[rows], lon[rows], own[rows]):
                hit = d <= radius
                least.add(p[hit], d[hit], (self.many[at + 1] - self.many[at])[hit])
            found[rows] = least.lists()
        return found

    def nought(self, lat: np.ndarray, lon: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places at each point itself."""
        out = np.zeros(len(lat), dtype=np.int64)
        point, strip = self._strips(lat, 0.0)
        from_, _, _, to = self._spans(point, strip, lat, lon, 0.0)
        for p, at, d in self._measured(point, from_, to, lat, lon, own):
            hit = d == 0
            np.add.at(out, p[hit], (self.many[at + 1] - self.many[at])[hit])
        return out


class _Least:
    """The least few values of each of some points, added in parts."""

    def __init__(self, points: int, few: int):
        self.few, self.points = few, points
        self.p, self.d = np.empty(0, dtype=np.int64), np.empty(0)

    def add(self, p, d, many):
        many = np.minimum(many, self.few)
        p, d = np.r_[self.p, np.repeat(p, many)], np.r_[self.d, np.repeat(d, many)]
        order = np.lexsort((d, p))
        p, d = p[order], d[order]
        keep = np.arange(len(p)) - np.searchsorted(p, p) < self.few
        self.p, self.d = p[keep], d[keep]

    def lists(self):
        return np.split(self.d, np.searchsorted(self.p, np.arange(1, self.points)))


def _pieces(sizes: np.ndarray) -> list[slice]:
    """Runs of entries whose sizes make about ``_AT_ONCE`` together."""
    if not len(sizes):
        return []
    part = (np.cumsum(sizes) - sizes) // _AT_ONCE
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]


def tally(lat: np.ndarray, lon: np.ndarray, shift: np.ndarray, places: Places, radius: float, edges: Sequence[float], few: int):
    """Of each point the places within the radius, at the point, and within each edge; and the nearest few distances.

    ``shift`` is what is added to a point's longitude to meet places across the date line; distances are taken without it.
    """
    (a, o, turn), same = np.unique(np.stack([lat, lon, shift]), axis=1, return_inverse=True)
    same = same.reshape(-1)
    at = a, o + turn, o
    total = places.counts(*at, radius)
    sums = [total, places.nought(*at), *(total if e >= radius else places.counts(*at, e) if e >= 0 else np.zeros_like(total) for e in edges)]
    near = places.nearest(*at, radius, few)
    return [s[same] for s in sums], [near[k] for k in same.tolist()]
