"""Rotation to an anisotropic space, squared distances and weights, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """Three angles in degrees and three ranges; only the ranges' ratios to the first count."""

    a1: float = 0.0
    a2: float = 0.0
    a3: float = 0.0
    r1: float = 1.0
    r2: float = 1.0
    r3: float = 1.0

    @classmethod
    def of(cls, values: Sequence[float]) -> Search:
        """From six numbers, or the older five without the first range."""
        values = tuple(values)
        if len(values) == 5:
            values = (*values[:3], 1.0, *values[3:])
        if len(values) != 6:
            raise ValueError("a search has three angles and three ranges")
        return cls(*map(float, values))

    def matrix(self) -> list[list[float]]:
        """Azimuth, dip and plunge in GSLIB's convention: three axes, the second and third scaled by r1 / r2 and r1 / r3."""
        azimuth = math.radians((90 if 0 <= self.a1 <= 270 else 450) - self.a1)
        dip, plunge = math.radians(-self.a2), math.radians(self.a3)
        along = (math.cos(dip) * math.cos(azimuth), math.cos(dip) * math.sin(azimuth), -math.sin(dip))
        flat = (-math.sin(azimuth), math.cos(azimuth), 0.0)
        up = (math.sin(dip) * math.cos(azimuth), math.sin(dip) * math.sin(azimuth), math.cos(dip))
        turn = lambda c, s: [c * f + s * u for f, u in zip(flat, up, strict=True)]
        second, third = turn(math.cos(plunge), math.sin(plunge)), turn(-math.sin(plunge), math.cos(plunge))
        return [list(along), [self.r1 / self.r2 * x for x in second], [self.r1 / self.r3 * x for x in third]]

    def values(self) -> tuple[float, ...]:
        return astuple(self)


def rotated(search: Search, coords: Sequence[str | Column]) -> list[Column]:
    """The rotated coordinates: the matrix, cut to as many dimensions as there are coordinates, is folded into literals."""
    columns = [F.col(c).cast("double") if isinstance(c, str) else c for c in coords]
    out = []
    for row in search.matrix()[: len(columns)]:
        terms = [F.lit(w) * c for w, c in zip(row, columns, strict=False)]
        out.append(sum(terms[1:], terms[0]))
    return out


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def anisotropic_distance(search: Search, a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance after both places are rotated and scaled."""
    return distance(rotated(search, a), rotated(search, b))


def idw(d2: Column, regularise: float = 2.0, least: float = 1e-7) -> Column:
    """Inverse-distance weight before normalising: 1 / (regularise + max(d, least) ** 2)."""
    return 1.0 / (F.lit(regularise) + F.pow(F.greatest(F.sqrt(d2), F.lit(least)), F.lit(2.0)))


def binary(d2: Column, reach: float = 1e10) -> Column:
    return F.when(F.sqrt(d2) <= reach, 1.0).otherwise(0.0)


def odd_mahalanobis(x: Sequence[Column], inverse: Sequence[Sequence[float]]) -> Column:
    """sum of x_i ** 2 times the i-th row sum of the inverse covariance (the form that the clustering metrics use)."""
    terms = [F.lit(float(sum(row))) * c * c for c, row in zip(x, inverse, strict=True)]
    return sum(terms[1:], terms[0])
