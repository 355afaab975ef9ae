"""Moments, covariances, column-wise transforms and kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import inverse_normal

RIDGE = 1e-3


def moments(frame: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, mean, var, std): population moments, a row per variable."""
    one = frame.agg(*(F.struct(F.lit(c).alias("variable"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.stddev_pop(c).alias("std")).alias(c) for c in variables))
    return one.select(F.inline(F.array(*variables)))


def weighted_moments(frame: DataFrame, variables: Sequence[str], weight: str) -> DataFrame:
    """(variable, mean, var, std), weighted. Second moments are taken about the mean, in a second pass."""
    w = F.col(weight)
    means = frame.agg(F.sum(w).alias("sw"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}") for c in variables))
    rows = frame.select(weight, *variables).crossJoin(F.broadcast(means))  # one row
    out = rows.agg(*(F.struct(F.lit(c).alias("variable"), F.first(f"m_{c}").alias("mean"), (F.sum(w * (F.col(c) - F.col(f"m_{c}")) ** 2) / F.first("sw")).alias("var")).alias(c) for c in variables))
    return out.select(F.inline(F.array(*variables))).withColumn("std", F.sqrt("var"))


def covariance(frame: DataFrame, variables: Sequence[str], ridge: float = RIDGE, weight: str | None = None) -> DataFrame:
    """(a, b, cov): population covariance of every two variables, the ridge added on the diagonal; weighted if asked."""
    pairs = [(a, b) for a in variables for b in variables]
    bump = {(a, b): ridge if a == b else 0.0 for a, b in pairs}
    if weight is None:
        one = frame.agg(*((F.covar_pop(a, b) + F.lit(bump[a, b])).alias(f"{a}__{b}") for a, b in pairs))
    else:
        w = F.col(weight)
        means = frame.agg(F.sum(w).alias("sw"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}") for c in variables))
        rows = frame.select(weight, *variables).crossJoin(F.broadcast(means))  # one row
        one = rows.agg(*((F.sum(w * (F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))) / F.first("sw") + F.lit(bump[a, b])).alias(f"{a}__{b}") for a, b in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("cov")) for a, b in pairs))))


def standardise(frame: DataFrame, variables: Sequence[str], floor: float | None = 1e-10) -> DataFrame:
    """The frame with each variable less its mean, over its population standard deviation (floor at least; without a
    floor a constant column becomes null). One aggregated row meets all rows, so nothing is shuffled but that row."""
    stats = frame.agg(*(x for c in variables for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    scale = lambda c: F.greatest(F.col(f"_s_{c}"), F.lit(floor)) if floor is not None else F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
    rows = frame.crossJoin(F.broadcast(stats))  # one row
    return rows.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in variables}).drop(*(x for c in variables for x in (f"_m_{c}", f"_s_{c}")))


def range_ranks(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The rows with _rank, their place from 1 among those of equal `by`, and _all, how many those are.

    Rows are dealt out by ranges of (by, order); places are counted within a range and added to the counts of the ranges
    before, so no task sorts all rows of one `by`. The order must leave no ties.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, by, *order).withColumn("_part", F.spark_partition_id())
    # which range a row falls in must not change between the two uses of it
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))).persist()
    sizes = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(by, "_part", F.coalesce(ahead, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("_all"))
    found = rows.join(F.broadcast(sizes), [by, "_part"])  # fewer rows than ranges and values of `by` together
    return found.withColumn("_rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def normal_score(frame: DataFrame, variables: Sequence[str], id: str = "id") -> DataFrame:
    """The frame with each variable replaced by the standard normal quantile of (rank - 0.5) / n; ties rank by id.

    All variables go through one range partitioning, by variable, value and id.
    """
    cells = F.inline(F.array(*(F.struct(F.lit(n).alias("_c"), F.col(c).cast("double").alias("_v")) for n, c in enumerate(variables))))
    found = range_ranks(frame.select(F.col(id).alias("_id"), cells), "_c", ["_v", "_id"])
    found = found.select("_id", "_c", inverse_normal((F.col("_rank") - 0.5) / F.col("_all").cast("double")).alias("_z"))
    wide = found.groupBy("_id").agg(*(F.max(F.when(F.col("_c") == n, F.col("_z"))).alias(f"_z{n}") for n in range(len(variables))))
    place = {c: f"_z{n}" for n, c in enumerate(variables)}
    others = [c for c in frame.columns if c not in place and c != id]
    if others:
        wide = frame.select(F.col(id).alias("_id"), *others).join(wide, "_id")
    return wide.select(*(F.col(place[c]).alias(c) if c in place else F.col("_id").alias(c) if c == id else F.col(c) for c in frame.columns))


def density(frame: DataFrame, variables: Sequence[str], band: float = -1.0, tiny: float = 1e-10, id: str = "id") -> DataFrame:
    """(id, density): sum of Gaussian kernels of all points at each point.

    band -1 standardises first and takes 0.2. The kernel's exponent is the odd Mahalanobis form; the divisor is the
    covariance's Frobenius norm times (2 pi) ** (variables / 2). Points are shipped in blocks to every row: the operator
    is quadratic by definition, and no pair of rows is ever a row.
    """
    points = frame.select(id, *(F.col(c).cast("double").alias(c) for c in variables))
    if band == -1:
        points, band = standardise(points, variables, floor=None), 0.2
    rows = {(r["a"], r["b"]): r["cov"] for r in covariance(points, variables).collect()}
    cov = np.array([[rows[a, b] for b in variables] for a in variables])
    divisor = max(tiny, math.sqrt((cov**2).sum()) * (2 * math.pi) ** (0.5 * len(variables)))
    inverse = np.linalg.inv(cov) / (2 * band) if band > 0 else np.linalg.inv(cov)
    found = kernel_sums(points, points.withColumn("of", F.lit(0).cast("long")), variables, {0: inverse.sum(1)}, id)
    return found.select(id, (F.col("total") / F.lit(float(divisor))).alias("density"))


def kernel_sums(at: DataFrame, points: DataFrame, variables: Sequence[str], row_sums: dict[int, np.ndarray], id: str = "id", block: int = 50_000) -> DataFrame:
    """(id, of, total): for each group `of` of the points, sum over its points of exp(- sum of row_sums[of] * gap ** 2).
    The points of all groups are broadcast a bounded block at a time, and each block takes one pass."""
    names = sorted(row_sums)
    n = points.count()
    blocks = max(1, -(-n // block))
    out = None
    for b in range(blocks):
        own = points.where(F.pmod(F.xxhash64(id), F.lit(blocks)) == b) if blocks > 1 else points
        table = own.select("of", *variables).toArrow()
        of, places = table.column("of").to_numpy(), np.stack([table.column(c).to_numpy() for c in variables], 1)
        shared = at.sparkSession.sparkContext.broadcast({name: places[of == name] for name in names})

        def run(batches, shared=shared):
            for batch in batches:
                x = np.stack([batch.column(1 + j).to_numpy() for j in range(len(variables))], 1)
                for name, p in shared.value.items():
                    total = np.zeros(len(x))
                    for a in range(0, len(x), 256):
                        e = np.zeros((len(x[a : a + 256]), len(p)))
                        for j, r in enumerate(row_sums[name]):
                            e += r * (x[a : a + 256, j, None] - p[None, :, j]) ** 2
                        total[a : a + 256] = np.exp(-e).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), name, np.int64)), pa.array(total)], names=[id, "of", "total"])

        part = at.select(F.col(id).cast("long").alias(id), *variables).mapInArrow(run, f"{id} long, of long, total double")
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else out.groupBy(id, "of").agg(F.sum("total").alias("total"))


def odd_form(variables: Sequence[str], row_sums: Sequence[float]) -> Column:
    terms = [F.lit(float(r)) * F.col(c) * F.col(c) for c, r in zip(variables, row_sums, strict=True)]
    return sum(terms[1:], terms[0])
