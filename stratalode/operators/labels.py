"""Cluster labels of many realisations: shares, agreement, recoding. Labels are rows (real, id, cluster)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import _pairs, cluster_moments, ward


def proportions(labels: DataFrame) -> DataFrame:
    """(real, cluster, n, p)."""
    counts = labels.groupBy("real", "cluster").agg(F.count("*").alias("n"))
    total = counts.groupBy("real").agg(F.sum("n").alias("all"))
    return counts.join(total, "real").select("real", "cluster", "n", (F.col("n") / F.col("all")).alias("p"))


def accepted(labels: DataFrame, least: float = 0.001, most: float = 0.999) -> DataFrame:
    """(real): realisations whose clusters' shares all lie strictly between least and most."""
    return proportions(labels).groupBy("real").agg(F.min("p").alias("low"), F.max("p").alias("high")).where((F.col("low") > least) & (F.col("high") < most)).select("real")


def code_map(frame: DataFrame, column: str) -> DataFrame:
    """(code, icode): the distinct codes in order, numbered from 0. Codes are few; they are ranked after distinct."""
    from pyspark.sql import Window

    return frame.select(F.col(column).alias("code")).distinct().withColumn("icode", (F.row_number().over(Window.orderBy("code")) - 1).cast("long"))


def contingency(labels: DataFrame, base: DataFrame) -> DataFrame:
    """(real, base, cluster, n) for labels against base (id, base)."""
    return labels.join(base.select("id", "base"), "id").groupBy("real", "base", "cluster").agg(F.count("*").alias("n"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / F.lit(2.0)


def adjusted_rand(labels: DataFrame, base: DataFrame) -> DataFrame:
    """(real, ari). Where chance explains everything (one cluster on both sides) it is null."""
    cells = contingency(labels, base)
    both = cells.groupBy("real").agg(F.sum(pairs_of(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    margin = lambda c, name: cells.groupBy("real", c).agg(F.sum("n").alias("m")).groupBy("real").agg(F.sum(pairs_of(F.col("m"))).alias(name))
    rows = both.join(margin("base", "si"), "real").join(margin("cluster", "sj"), "real")
    chance = F.col("si") * F.col("sj") / F.nullif(pairs_of(F.col("all")), F.lit(0.0))
    return rows.select("real", ((F.col("s") - chance) / F.nullif(0.5 * (F.col("si") + F.col("sj")) - chance, F.lit(0.0))).alias("ari"))


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row in the one-to-one choice of the largest sum; up to 8 rows by trying all, so that of equal
    choices the first in order counts; more by successive shortest paths."""
    n = len(gain)
    if n <= 8:
        best = max(itertools.permutations(range(n)), key=lambda p: (round(sum(gain[i, j] for i, j in enumerate(p)), 9), [-j for j in p]))
        return list(best)
    cost = gain.max() - gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            gap = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], way[1:][better] = gap[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _best(score: str, largest: bool):
    def run(key, table):
        rows, columns = sorted(table["cluster"].unique()), sorted(table["base"].unique())
        if len(rows) != len(columns):
            raise ValueError(f"realisation {key}: {len(rows)} clusters against {len(columns)}")
        gain = table.pivot_table(index="cluster", columns="base", values=score, fill_value=0.0).reindex(index=rows, columns=columns, fill_value=0.0).to_numpy(float)
        chosen = assignment(gain if largest else -gain)
        total = sum(gain[i, j] for i, j in enumerate(chosen))
        out = pd.DataFrame({"cluster": rows, "code": [columns[j] for j in chosen], "total": total})
        for name, value in zip(("real", "real2"), key, strict=False):
            out.insert(0, name, value)
        return out

    return run


def recode_map(labels: DataFrame, base: DataFrame) -> DataFrame:
    """(real, cluster, code, score): the renaming of each realisation's clusters that agrees most with the base, and the
    share of samples that then agree. Only K x K tables are gathered, one per realisation."""
    cells = contingency(labels, base).select("real", "cluster", "base", F.col("n").cast("double").alias("n"))
    n = base.agg(F.count("*").alias("all"))
    found = cells.groupBy("real").applyInPandas(_best("n", True), "real long, cluster long, code long, total double")
    return found.crossJoin(F.broadcast(n)).select("real", "cluster", "code", (F.col("total") / F.col("all")).alias("score"))


def recode(labels: DataFrame, base: DataFrame) -> DataFrame:
    """(real, id, cluster, score): labels in the base's codes."""
    return labels.join(recode_map(labels, base), ["real", "cluster"]).select("real", "id", F.col("code").alias("cluster"), "score")


def recode_map_by_variables(labels: DataFrame, base: DataFrame, variables_of: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(real, cluster, code, score): the renaming with the least mean Ward distance between clusters of one name."""
    data = variables_of.select("id", *variables)
    ours = cluster_moments(labels.join(data, "id"), variables, "cluster", ("real",))
    theirs = cluster_moments(base.join(data, "id"), variables, "base")
    reals = ours.select("real").distinct()
    pairs = _pairs(ours, theirs.crossJoin(F.broadcast(reals)), ("real",), True).select("real", F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("base"), ward().alias("d"))  # K rows each
    found = pairs.groupBy("real").applyInPandas(_best("d", False), "real long, cluster long, code long, total double")
    size = theirs.agg(F.count("*").alias("k"))
    return found.crossJoin(F.broadcast(size)).select("real", "cluster", "code", (F.col("total") / F.col("k")).alias("score"))


def pairwise_similarity(labels: DataFrame) -> DataFrame:
    """(real, real2, similarity): the best agreement of every two realisations after renaming. Samples meet by id, and
    only counts of label pairs are kept."""
    other = labels.select(F.col("real").alias("real2"), "id", F.col("cluster").alias("base"))
    cells = labels.join(other, "id").groupBy("real", "real2", "cluster", "base").agg(F.count("*").cast("double").alias("n"))
    found = cells.groupBy("real", "real2").applyInPandas(_two, "real long, real2 long, total double")
    size = labels.groupBy("real").agg(F.count("*").alias("all"))
    return found.join(size, "real").select("real", "real2", (F.col("total") / F.col("all")).alias("similarity"))


def _two(key, table):
    full = table.pivot_table(index="cluster", columns="base", values="n", fill_value=0.0).to_numpy(float)
    if full.shape[0] != full.shape[1]:
        raise ValueError(f"realisations {key}: numbers of clusters differ")
    return pd.DataFrame({"real": [key[0]], "real2": [key[1]], "total": [sum(full[i, j] for i, j in enumerate(assignment(full)))]})
