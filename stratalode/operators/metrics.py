"""Separation and compactness of clusters, from per-cluster sufficient statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Search
from .autocorr import edges
from .moments import RIDGE, kernel_sums, range_ranks, standardise


def cluster_moments(frame: DataFrame, variables: Sequence[str], label: str = "cluster", by: Sequence[str] = (), ridge: float = RIDGE) -> DataFrame:
    """(by, cluster, n, mean array, var array, rows array): rows are the row sums of the inverse of the covariance with a ridge.

    One aggregation with map-side partial sums; the inverses are taken of the few aggregated rows.
    """
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    stats = frame.groupBy(*by, F.col(label).cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in variables)).alias("mean"), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("cov"))
    m = len(variables)
    at = {p: i for i, p in enumerate(pairs)}
    diagonal = [at[c, c] for c in variables]
    order = [[at[min(a, b, key=variables.index), max(a, b, key=variables.index)] for b in variables] for a in variables]

    def run(batches):
        for batch in batches:
            cov = np.array(batch.column(batch.schema.get_field_index("cov")).to_pylist(), float).reshape(-1, len(pairs))
            full = cov[:, np.array(order)] + ridge * np.eye(m)
            sums = np.linalg.inv(full).sum(2) if len(full) else np.zeros((0, m))
            yield batch.drop_columns(["cov"]).append_column("var", pa.array(cov[:, diagonal].tolist(), pa.list_(pa.float64()))).append_column("rows", pa.array(sums.tolist(), pa.list_(pa.float64())))

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema if f.name != "cov"}
    return stats.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", var array<double>, rows array<double>")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def wcss(frame: DataFrame, variables: Sequence[str], label: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """(by, wcss): squared distances to the clusters' means, summed."""
    per = frame.groupBy(*by, label).agg((F.count("*") * sum((F.var_pop(c) for c in variables[1:]), F.var_pop(variables[0]))).alias("s"))
    return per.groupBy(*by).agg(F.sum("s").alias("wcss"))


def mwcss(frame: DataFrame, variables: Sequence[str], label: str = "cluster", by: Sequence[str] = (), ridge: float = RIDGE) -> DataFrame:
    """(by, mwcss): the same in the odd Mahalanobis form of each cluster's covariance."""
    per = cluster_moments(frame, variables, label, by, ridge)
    return per.groupBy(*by).agg(F.sum(F.col("n") * _dot(F.col("rows"), F.col("var"))).alias("mwcss"))


def _pairs(left: DataFrame, right: DataFrame, by: Sequence[str], all_pairs: bool) -> DataFrame:
    kind = "struct<cluster:bigint,n:bigint,mean:array<double>,var:array<double>,rows:array<double>>"
    pack = lambda f, n: f.select(*by, F.struct("cluster", "n", "mean", "var", "rows").cast(kind).alias(n))
    a, b = pack(left, "a"), pack(right, "b")
    out = a.join(b, list(by)) if by else a.crossJoin(b)  # K rows each
    return out if all_pairs else out.where("a.cluster < b.cluster")


def _gap(a: str, b: str) -> Column:
    return F.zip_with(F.col(f"{a}.mean"), F.col(f"{b}.mean"), lambda x, y: (x - y) * (x - y))


def ward(a: str = "a", b: str = "b") -> Column:
    """Ward distance of two clusters' structs: the between part of the squares about the middle of their means."""
    q = (F.col(f"{a}.n") + F.col(f"{b}.n")) / 4.0 * _sum(_gap(a, b))
    within = F.col(f"{a}.n") * _sum(F.col(f"{a}.var")) + F.col(f"{b}.n") * _sum(F.col(f"{b}.var"))
    return q / F.greatest(within + q, F.lit(1e-6))


def ward_mahalanobis(a: str = "a", b: str = "b") -> Column:
    """The same with each side measured by the row sums of its own inverse covariance; it may leave [0, 1]."""
    side = lambda x: F.col(f"{x}.n") * _dot(F.col(f"{x}.rows"), _gap(a, b)) / 4.0
    q = side(a) + side(b)
    within = sum((F.col(f"{x}.n") * _dot(F.col(f"{x}.rows"), F.col(f"{x}.var")) for x in (a, b)), F.lit(0.0))
    return q / (within + q)


def ward_table(frame: DataFrame, variables: Sequence[str], label: str = "cluster", mahalanobis: bool = False) -> DataFrame:
    """(a, b, distance) for every two clusters, a < b."""
    m = cluster_moments(frame, variables, label)
    return _pairs(m, m, (), False).select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"), (ward_mahalanobis() if mahalanobis else ward()).alias("distance"))


def ward_sum(frame: DataFrame, variables: Sequence[str], label: str = "cluster", mahalanobis: bool = False) -> DataFrame:
    """One row (distance): summed over pairs a < b, over the number of samples. The second cluster of a pair is measured
    on standardised variables, the first on them as they come (the same if they come standardised)."""
    raw = cluster_moments(frame, variables, label)
    scaled = cluster_moments(standardise(frame.select(label, *variables), variables, floor=None), variables, label)
    pairs = _pairs(raw, scaled, (), False)
    total = pairs.agg(F.sum(ward_mahalanobis() if mahalanobis else ward()).alias("s"))
    return total.crossJoin(frame.agg(F.count("*").alias("n"))).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("distance"))


def kld(frame: DataFrame, variables: Sequence[str], label: str = "cluster", band: float = -1.0, id: str = "id") -> DataFrame:
    """One row (distance): symmetrised Kullback-Leibler sums between the clusters' kernel densities, over the samples.

    Needs three clusters or more. Each cluster's covariance (of the variables as they come) gives its kernel; band -1
    standardises the points. They are broadcast in bounded blocks, and a block meets every sample in one pass. A density that underflows to zero
    drops out of the sum.
    """
    stats = {r["cluster"]: r for r in cluster_moments(frame, variables, label).collect()}
    if len(stats) < 3:
        raise ValueError("three clusters or more are needed")
    points = frame.select(F.col(id).cast("long").alias(id), F.col(label).cast("long").alias("cluster"), *(F.col(c).cast("double").alias(c) for c in variables))
    norms = {}
    for r in frame.groupBy(F.col(label).cast("long").alias("cluster")).agg(F.array(*(F.covar_pop(a, b) for a in variables for b in variables)).alias("cov")).collect():
        cov = np.array(r["cov"]).reshape(len(variables), -1) + RIDGE * np.eye(len(variables))
        norms[r["cluster"]] = float(np.sqrt((cov**2).sum()) * (2 * np.pi) ** (0.5 * len(variables)))
    scaled = standardise(points, variables, floor=None) if band == -1 else points
    out = kernel_sums(scaled, scaled.withColumnRenamed("cluster", "of"), variables, {c: np.array(r["rows"]) for c, r in stats.items()}, id)
    norm = F.create_map(*(F.lit(x) for c in norms for x in (c, max(1e-10, norms[c]))))
    out = out.select(id, "of", (F.col("total") / norm[F.col("of")]).alias("p"))
    own = points.select(id, "cluster").join(out, id)
    home = own.where("cluster = of").select(id, F.col("p").alias("home"))
    terms = own.where("cluster <> of").join(home, id).select((F.col("home") * F.ln(F.try_divide("home", "p"))).alias("t"))
    return terms.agg((0.5 * F.sum("t")).alias("s")).crossJoin(frame.agg(F.count("*").alias("n"))).select((F.col("s") / F.col("n")).alias("distance"))


def spatial_entropy(near: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, entropy) of neighbours' labels; near: (i, j), labels: (by, id, cluster). Shares are of all neighbours."""
    size = near.groupBy("i").agg(F.count("*").alias("k"))
    counts = near.select("i", "j").join(labels.select(*by, F.col("id").alias("j"), "cluster"), "j").groupBy(*by, "i", "cluster").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("k")
    return counts.join(size, "i").groupBy(*by, F.col("i").alias("id")).agg((-F.sum(p * F.ln(p))).alias("entropy"))


METRICS: dict[str, Callable] = {"wcss": wcss, "mwcss": mwcss}


def permuted(labels: DataFrame, seed: int) -> DataFrame:
    """(real, id, cluster) with the clusters of each realisation dealt to other samples by a seeded hash: the sample of
    the n-th least id gets the cluster of the sample of the n-th least hash. Both are ranked by ranges."""
    here = range_ranks(labels.select("real", "id"), "real", ["id"])
    hashed = labels.select("real", "id", "cluster", F.xxhash64("id", "real", F.lit(seed)).alias("_h"))
    there = range_ranks(hashed, "real", ["_h", "id"]).select("real", "_rank", "cluster")
    return here.join(there, ["real", "_rank"]).select("real", "id", "cluster")


def cluster_metrics(samples, labels: DataFrame, k: int, search: Search, metric: str | Callable = "mwcss", seed: int = 69069, reference: DataFrame | None = None) -> DataFrame:
    """(real, mv, sp): the multivariate metric and the summed entropy of each realisation, both over their values for the
    reference labels of that realisation, by default a random permutation of its own. metric: wcss, mwcss, or a function
    (frame, variables, label, by) of a frame."""
    function = METRICS[metric] if isinstance(metric, str) else metric
    plain, near = samples.plain(), edges(samples, k, search)
    out = None
    for name, rows in (("", labels), ("_ref", permuted(labels, seed) if reference is None else reference)):
        full = rows.join(plain.select("id", *samples.variables), "id")
        mv = function(full, samples.variables, "cluster", ("real",))
        mv = mv.toDF("real", f"mv{name}")
        sp = spatial_entropy(near, rows, ("real",)).groupBy("real").agg(F.sum("entropy").alias(f"sp{name}"))
        both = mv.join(sp, "real")
        out = both if out is None else out.join(both, "real")
    return out.select("real", (F.col("mv") / F.nullif(F.col("mv_ref"), F.lit(0.0))).alias("mv"), (F.col("sp") / F.nullif(F.col("sp_ref"), F.lit(0.0))).alias("sp"))


def stats_text(frame: DataFrame, mv: str = "mv", sp: str = "sp") -> Column:
    return F.format_string("MV: %.2f\nSP: %.2f", F.col(mv), F.col(sp))


def cluster_metrics_single(samples, labels: DataFrame, k: int, search: Search, metric: str | Callable = "wcss", seed: int = 69069, reference: DataFrame | None = None) -> DataFrame:
    """One row (mv, sp) for one labelling (id, cluster), both over their values for the reference labels (id, cluster),
    by default permuted ones."""
    one = lambda rows: None if rows is None else rows.select(F.lit(0).cast("long").alias("real"), "id", "cluster")
    return cluster_metrics(samples, one(labels), k, search, metric, seed, one(reference)).select("mv", "sp")


def label_stats(samples, labels: DataFrame, k: int, search: Search, metric: str | Callable = "wcss", seed: int = 69069, reference: DataFrame | None = None) -> DataFrame:
    """One row (mv, sp, label): the two metrics of a labelling, and the text that annotates a map with them."""
    found = cluster_metrics_single(samples, labels, k, search, metric, seed, reference)
    return found.withColumn("label", stats_text(found))
