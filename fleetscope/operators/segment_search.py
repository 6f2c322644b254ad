"""Nearest segment of every point among the points and segments of one tile, exact, in arrays.

The points are searched on a grid of their own. Its first cells are twice as wide as the points are apart, so that listing the segments
and meeting them cost about the same. A point meets the segments of its cell, then those of the neighbour cells that start within its distance.
It is done when its distance is below the cell's side; the others go on with cells four times as wide, the last with all segments.
"""

from __future__ import annotations

import numpy as np

PAIRS = 1 << 15                 # point-segment pairs measured at once
PIECES = 1 << 20                # pieces of segments listed in one grid, about
FACTOR = 4                      # how much wider the next cells are
SLACK_M = 1e-3                  # covers the rounding of cell borders
NO_ROAD = np.iinfo(np.int64).max


class _Search:
    def __init__(self, px, py, osm_id, ax, ay, bx, by):
        ok = np.isfinite(ax) & np.isfinite(ay) & np.isfinite(bx) & np.isfinite(by)
        self.osm_id, self.ax, self.ay = osm_id[ok], ax[ok], ay[ok]
        self.dx, self.dy = bx[ok] - self.ax, by[ok] - self.ay
        self.l2 = self.dx * self.dx + self.dy * self.dy
        self.over = np.where(self.l2 == 0, 1.0, self.l2)        # a segment without length: (0 + 0) / 1
        self.length = np.sqrt(self.l2)
        self.px, self.py = px, py
        self.dist = np.full(len(px), np.inf)
        self.road = np.full(len(px), NO_ROAD)

    def meet(self, points, first, count, listed) -> None:
        """``points`` (each once) meet the segments ``listed[first:first + count]``; the nearest, of these the lowest id, is kept."""
        some = count > 0
        points, first, count = points[some], first[some], count[some]
        ends, at = np.cumsum(count), 0
        while at < len(points):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            p, n = points[at:to], count[at:to]
            start = np.cumsum(n) - n
            s = listed[np.arange(start[-1] + n[-1]) + np.repeat(first[at:to] - start, n)]
            x, y = np.repeat(self.px[p], n), np.repeat(self.py[p], n)
            ax, ay, dx, dy = self.ax[s], self.ay[s], self.dx[s], self.dy[s]
            t = np.minimum(1.0, np.maximum(0.0, ((x - ax) * dx + (y - ay) * dy) / self.over[s]))
            gx, gy = x - (ax + t * dx), y - (ay + t * dy)
            d = np.sqrt(gx * gx + gy * gy)
            low = np.minimum.reduceat(d, start)
            equal = np.flatnonzero(d == np.repeat(low, n))
            road = self.osm_id[s[equal]]
            if len(equal) > len(p):
                road = np.minimum.reduceat(road, np.searchsorted(equal, start))
            better = (low < self.dist[p]) | ((low == self.dist[p]) & (road < self.road[p]))
            p = p[better]
            self.dist[p], self.road[p] = low[better], road[better]
            at = to

    def listing(self, x0, y0, nx, ny, cell):
        """Segments by cell of the grid at (x0, y0): those of cell k (row by row) are ``listed[first[k]:first[k + 1]]``."""
        t0, t1 = np.zeros(len(self.ax)), np.ones(len(self.ax))
        for a, d, low, high in ((self.ax, self.dx, x0 - SLACK_M, x0 + nx * cell + SLACK_M), (self.ay, self.dy, y0 - SLACK_M, y0 + ny * cell + SLACK_M)):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                u, v = (low - a) / d, (high - a) / d
            along = d == 0
            t0 = np.where(along, t0, np.maximum(t0, np.minimum(u, v)))
            t1 = np.where(along, np.where((a >= low) & (a <= high), t1, -1.0), np.minimum(t1, np.maximum(u, v)))
        s = np.flatnonzero(t0 <= t1)
        span = t1[s] - t0[s]
        n = np.maximum(1, np.ceil(self.length[s] * span / cell * 1.001)).astype(np.int64)       # shorter than a cell: two columns and rows at most
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        step, begin, s = np.repeat(span / n, n), np.repeat(t0[s], n), np.repeat(s, n)
        t, u = begin + k * step, begin + (k + 1) * step
        ends = []
        for a, d, low, most in ((self.ax[s], self.dx[s], x0, nx), (self.ay[s], self.dy[s], y0, ny)):
            e, f = (a + t * d - low) / cell, (a + u * d - low) / cell
            ends += [np.clip(np.floor(g), 0, most - 1).astype(np.int64) for g in (np.minimum(e, f), np.maximum(e, f))]
        cx, cx1, cy, cy1 = ends
        wide, high = np.flatnonzero(cx1 > cx), np.flatnonzero(cy1 > cy)
        both = wide[cy1[wide] > cy[wide]]
        bits = len(self.ax).bit_length()
        key = lambda x, y, i: ((y[i] * nx + x[i]) << bits) | s[i]
        keys = np.concatenate([((cy * nx + cx) << bits) | s, key(cx1, cy, wide), key(cx, cy1, high), key(cx1, cy1, both)])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        first = np.concatenate([[0], np.cumsum(np.bincount(keys >> bits, minlength=nx * ny))])
        return first, keys & ((1 << bits) - 1)

    def on_grid(self, points, cell):
        """One pass over ``points``; returns those that are not done."""
        x, y = self.px[points], self.py[points]
        x0, y0 = x.min() - cell, y.min() - cell                 # a ring of cells around the points
        nx, ny = (int(np.floor((v.max() - v0) / cell)) + 2 for v, v0 in ((x, x0), (y, y0)))
        first, listed = self.listing(x0, y0, nx, ny, cell)
        cx, cy = np.floor((x - x0) / cell).astype(np.int64), np.floor((y - y0) / cell).astype(np.int64)
        k = cy * nx + cx
        self.meet(points, first[k], first[k + 1] - first[k], listed)
        west, south = x - (x0 + cx * cell), y - (y0 + cy * cell)
        gaps = {-1: (west, south), 0: (np.zeros(len(x)),) * 2, 1: (cell - west, cell - south)}
        known = np.isfinite(self.dist[points])
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                gx, gy = gaps[i][0], gaps[j][1]
                near = np.flatnonzero(known & (np.sqrt(gx * gx + gy * gy) <= self.dist[points] + SLACK_M)) if i or j else []
                if len(near):
                    k = (cy[near] + j) * nx + cx[near] + i
                    self.meet(points[near], first[k], first[k + 1] - first[k], listed)
        return points[~(self.dist[points] < cell - SLACK_M)]

    def run(self):
        n, left = len(self.ax), np.arange(len(self.px))
        if not n or not len(left):
            return self.dist, self.road
        w, h = max(1.0, np.ptp(self.px)), max(1.0, np.ptp(self.py))
        cell = max(1.0, 2 * np.sqrt(w * h / len(left)), np.minimum(self.length, np.hypot(w, h)).sum() / PIECES)
        while len(left) * n > PAIRS and cell < max(w, h):
            left = self.on_grid(left, cell)
            cell *= FACTOR
        self.meet(left, np.zeros(len(left), np.int64), np.full(len(left), n), np.arange(n))
        return self.dist, self.road


def nearest_segment(px, py, osm_id, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every point's nearest segment and the lowest ``osm_id`` at exactly that distance (inf and NO_ROAD without a segment).

    The distance is computed by the operations of ``roads.point_segment_distance``, in their order. Segments without a finite position are left out.
    """
    return _Search(px, py, osm_id, ax, ay, bx, by).run()
