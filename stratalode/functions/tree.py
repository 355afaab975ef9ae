"""Boxes of nearby points, so that a search for nearest ones leaves out those that are too far."""

from __future__ import annotations

import numpy as np

#: A bound is lowered by this share, as it isn't rounded like a distance.
SLACK = 1e-9


def split(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where parts of at most `most` begin: halved at the median of the widest column."""
    order, todo, begins = np.arange(len(x)), [(0, len(x))], []
    while todo:
        low, high = todo.pop()
        if high - low <= most:
            begins.append(low)
            continue
        own, mid = order[low:high], (high - low) // 2
        p = x[own]
        order[low:high] = own[np.argpartition(p[:, int(np.argmax(p.max(0) - p.min(0)))], mid)]
        todo += [(low, low + mid), (low + mid, high)]
    return order, np.sort(np.array(begins, np.int64))


class Boxes:
    """Parts of the rows of x with their bounds."""

    def __init__(self, x: np.ndarray, most: int = 64):
        self.order, self.begins = split(x, most)
        self.ends = np.append(self.begins[1:], len(x))
        # a row for each column of x
        self.lows, self.highs = (np.ascontiguousarray(f.reduceat(x[self.order], self.begins, axis=0).T) for f in (np.minimum, np.maximum))

    def away(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each part, a bound below the squared distance of its rows to those between low and high."""
        out = np.zeros(len(self.begins))
        for a, b, l, h in zip(self.lows, self.highs, low, high, strict=True):
            gap = a - h
            np.maximum(gap, l - b, out=gap)
            np.maximum(gap, 0, out=gap)
            gap *= gap
            out += gap
        out *= 1 - SLACK
        return out

    def rows(self, parts: np.ndarray) -> np.ndarray:
        sizes = self.ends[parts] - self.begins[parts]
        ends = np.cumsum(sizes)
        return self.order[np.repeat(self.begins[parts] - ends + sizes, sizes) + np.arange(ends[-1])]


def squares(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed in the order of columns."""
    d2 = np.zeros((len(q), len(points)))
    for d in range(q.shape[1]):
        gap = q[:, d, None] - points[None, :, d]
        gap *= gap
        d2 += gap
    return d2


def nearest(q: np.ndarray, points: np.ndarray, boxes: Boxes, k: int, most: int = 32):
    """For parts of the queries: (rows of q, candidate rows of points, squared distances); the candidates hold the k
    nearest of each of these queries with all ties."""
    k = min(k, len(points))
    order, begins = split(q, most)
    for own in np.split(order, begins[1:]):
        some = q[own]
        bound = boxes.away(some.min(0), some.max(0))
        parts = np.argsort(bound, kind="stable")
        enough = int(np.searchsorted(np.cumsum((boxes.ends - boxes.begins)[parts]), 2 * k)) + 1
        at = boxes.rows(parts[:enough])
        d2 = squares(some, points[at])
        far = np.partition(d2, k - 1, axis=1)[:, k - 1].max()
        wanted = parts[enough:][bound[parts[enough:]] <= far]
        if len(wanted):
            more = boxes.rows(wanted)
            at, d2 = np.concatenate([at, more]), np.concatenate([d2, squares(some, points[more])], 1)
        yield own, at, d2
