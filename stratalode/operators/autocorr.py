"""Spatial weights, local and global autocorrelation over neighbour edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import Samples
from ..functions.geometry import Search, binary, idw
from .neighbors import knn, rotate

MORAN, GETIS = "morans", "getis"
METRICS = {1: MORAN, 2: GETIS, MORAN: MORAN, GETIS: GETIS}


def metric_name(metric: int | str) -> str:
    found = METRICS.get(metric.lower() if isinstance(metric, str) else metric)
    if found is None:
        raise ValueError(f"no autocorrelation metric {metric!r}: morans (1) or getis (2)")
    return found


def edges(samples: Samples, k: int, search: Search, drop_self: bool = False) -> DataFrame:
    """(i, rk, j, d2): the k nearest samples of each, itself among them; drop_self leaves it out afterwards."""
    places = rotate(samples.plain(), search, samples.coords)
    found = knn(places, places, k, len(samples.coords))
    return found.where("i <> j") if drop_self else found


def weights(found: DataFrame, kind: str = "idw") -> DataFrame:
    """Edges with w: inverse-distance weights that sum to one per i, or 1 / 0 within a reach."""
    if kind == "binary":
        return found.withColumn("w", binary(F.col("d2")))
    per = Window.partitionBy("i")
    return found.withColumn("w", idw(F.col("d2"))).withColumn("w", F.col("w") / F.sum("w").over(per))


def weights_matrix(samples: Samples, k: int, search: Search) -> DataFrame:
    """The row-standardised weights as (i, j, w); what is absent is zero."""
    return weights(edges(samples, k, search)).select("i", "j", "w")


def local_autocorr(samples: Samples, metric: int | str, k: int, search: Search, found: DataFrame | None = None) -> DataFrame:
    """(id, a_<variable>...): the local statistic of every variable; a sample with fewer than two other neighbours keeps its raw values.

    Moran: the weighted mean of the products with neighbours, negated where both values are negative, over the
    neighbours' weighted variance (1e-8 at least). Getis: the neighbours' mean over the sum of the sample's variables.
    found: the edges, if they are there already.
    """
    metric, v = metric_name(metric), samples.variables
    plain = samples.plain().select("id", *v)
    found = edges(samples, k, search) if found is None else found
    near = weights(found.where("i <> j"), "idw" if metric == MORAN else "binary")
    own = plain.select(F.col("id").alias("i"), *(F.col(c).alias(f"z_{c}") for c in v))
    other = plain.select(F.col("id").alias("j"), *(F.col(c).alias(f"n_{c}") for c in v))
    n, w = F.count("*").alias("n"), F.col("w")
    rows = near.join(other, "j").groupBy("i")
    if metric == GETIS:
        found = rows.agg(n, F.sum(w).alias("sw"), *(F.sum(w * F.col(f"n_{c}")).alias(f"s_{c}") for c in v)).join(own, "i")
        total = F.greatest(F.lit(1e-10), sum((F.col(f"z_{c}") for c in v[1:]), F.col(f"z_{v[0]}")))
        values = {c: F.col(f"s_{c}") / (total * F.col("sw")) for c in v}
    else:
        # the sample's own value is a factor of every product, so it joins once, after the sums over neighbours; those
        # are of gaps from one neighbour's value, which keeps the variance exact where the values lie far from zero
        gap = {c: F.col(f"n_{c}") - F.first(f"n_{c}").over(Window.partitionBy("i")) for c in v}
        sums = [x for c in v for x in (
            F.sum(w * F.col(f"n_{c}")).alias(f"s_{c}"), F.sum(F.when(F.col(f"n_{c}") < 0, w * F.col(f"n_{c}"))).alias(f"b_{c}"),
            F.sum(w * F.col(f"g_{c}")).alias(f"m_{c}"), F.sum(w * F.col(f"g_{c}") * F.col(f"g_{c}")).alias(f"q_{c}"),
        )]
        rows = near.join(other, "j").select("i", "w", *(f"n_{c}" for c in v), *(gap[c].alias(f"g_{c}") for c in v)).groupBy("i")
        found = rows.agg(n, F.sum(w).alias("sw"), *sums).join(own, "i")
        top = {c: F.col(f"z_{c}") * (F.col(f"s_{c}") - F.when(F.col(f"z_{c}") < 0, 2 * F.coalesce(f"b_{c}", F.lit(0.0))).otherwise(0.0)) for c in v}
        spread = {c: F.col(f"q_{c}") / F.col("sw") - (F.col(f"m_{c}") / F.col("sw")) ** 2 for c in v}
        values = {c: top[c] / (F.greatest(spread[c], F.lit(1e-8)) * F.col("sw")) for c in v}
    found = found.select(F.col("i").alias("id"), "n", *(values[c].alias(f"a_{c}") for c in v))
    return plain.join(found, "id", "left").select("id", *(F.when(F.col("n") > 1, F.col(f"a_{c}")).otherwise(F.col(c)).alias(f"a_{c}") for c in v))


def global_autocorr(samples: Samples, metric: int | str, k: int, search: Search) -> DataFrame:
    """One row with g_<variable>...; a sample is a neighbour of itself here."""
    metric, v = metric_name(metric), samples.variables
    plain = samples.plain().select("id", *v)
    if metric == MORAN:
        means = plain.agg(*(F.avg(c).alias(f"m_{c}") for c in v))
        plain = plain.crossJoin(F.broadcast(means)).select("id", *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in v))  # one row
    near = weights(edges(samples, k, search))
    rows = near.join(plain.select(F.col("id").alias("i"), *(F.col(c).alias(f"z_{c}") for c in v)), "i").join(plain.select(F.col("id").alias("j"), *(F.col(c).alias(f"n_{c}") for c in v)), "j")
    product = {c: F.col(f"z_{c}") * F.col(f"n_{c}") for c in v}
    if metric == GETIS:
        return rows.agg(*((F.sum(F.col("w") * product[c]) / F.sum(product[c])).alias(f"g_{c}") for c in v))
    top = rows.agg(*(F.sum(F.col("w") * product[c]).alias(f"t_{c}") for c in v))
    return top.crossJoin(plain.agg(*(F.sum(F.col(c) * F.col(c)).alias(f"b_{c}") for c in v))).select(*((F.col(f"t_{c}") / F.col(f"b_{c}")).alias(f"g_{c}") for c in v))


def named(variables: Sequence[str], prefix: str) -> list[str]:
    return [f"{prefix}_{c}" for c in variables]
