"""Exact nearest-neighbour joins in an anisotropic space."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree
from ..functions.geometry import Search, rotated, squared_distance

#: Points that are broadcast and measured against every query at most (three doubles and an id each).
BROADCAST_POINTS = 50_000
#: Points that are broadcast with boxes around nearby ones at most; more are joined by grid cells.
BOXED_POINTS = 1_000_000
#: Points above which the queries that meet them are dealt out over all tasks.
DEALT_POINTS = 5_000


def rotate(frame: DataFrame, search: Search, coords: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """keep, and the rotated coordinates as r0, r1, r2."""
    return frame.select(*keep, *(c.alias(f"r{n}") for n, c in enumerate(rotated(search, coords))))


def _blocks(q: np.ndarray, points: np.ndarray, own: np.ndarray):
    for at in range(0, len(q), 512):
        yield np.arange(at, min(at + 512, len(q))), slice(None), tree.squares(q[at : at + 512], points[own])


def _nearest(shared, k: int, dims: int, by_group: bool, reach: float | None, boxed: bool):
    def run(batches):
        ids, points, group = shared.value
        members = {None: np.arange(len(ids))} if not by_group else {g: np.flatnonzero(group == g) for g in np.unique(group).tolist()}
        boxes = {name: tree.Boxes(points[own]) for name, own in members.items()} if boxed else {}
        for batch in batches:
            i = batch.column(0).to_numpy()
            q = np.stack([batch.column(1 + d).to_numpy() for d in range(dims)], 1) if len(i) else np.empty((0, dims))
            parts = []
            for name, own in members.items():
                if not len(i):
                    continue
                for asked, at, d2 in tree.nearest(q, points[own], boxes[name], k) if boxed else _blocks(q, points, own):
                    met = ids[own[at]]
                    take = min(k, len(own))
                    last = np.partition(d2, take - 1, axis=1)[:, take - 1]
                    rows, cols = np.nonzero(d2 <= last[:, None])
                    order = np.lexsort((met[cols], d2[rows, cols], rows))
                    rows, cols = rows[order], cols[order]
                    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    near = rank < take
                    if reach is not None:
                        near &= d2[rows, cols] <= reach * reach
                    rows, cols, rank = rows[near], cols[near], rank[near]
                    parts.append((i[asked[rows]], np.full(len(rows), -1 if name is None else name), rank + 1, met[cols], d2[rows, cols]))
            if parts:
                i_, g, rank, j, d2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(i_), pa.array(rank.astype(np.int64)), pa.array(j), pa.array(d2)]
                names = ["i", "rk", "j", "d2"]
                if by_group:
                    columns.append(pa.array(g.astype(np.int64)))
                    names.append("grp")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def knn(queries: DataFrame, points: DataFrame, k: int, dims: int, by_group: bool = False, reach: float | None = None, broadcast: int = BROADCAST_POINTS) -> DataFrame:
    """(i, rk, j, d2[, grp]): of each query (id, r0..), the k nearest points (id, r0..[, grp]), ties by id.

    The points are counted: up to `broadcast` of them go to every task, where blocks of queries are measured against
    them; up to BOXED_POINTS go there too, where queries meet only the boxes of points that can be near enough; more are
    joined by grid cells, without any broadcast. by_group ranks within each group of points; reach drops
    farther ones. Queries keep themselves if they are among the points.
    """
    coords = [f"r{d}" for d in range(dims)]
    n = points.count()
    schema = "i long, rk long, j long, d2 double" + ", grp long" * by_group
    if n == 0:
        return queries.sparkSession.createDataFrame([], schema)
    if n <= max(broadcast, BOXED_POINTS):
        rows = points.select("id", *coords, *(["grp"] if by_group else [])).toArrow()
        ids = rows.column("id").to_numpy()
        values = np.stack([rows.column(c).to_numpy() for c in coords], 1)
        group = rows.column("grp").to_numpy() if by_group else None
        shared = queries.sparkSession.sparkContext.broadcast((ids, values, group))
        asked = queries.select("id", *coords)
        if n > DEALT_POINTS:  # a table in one file would be one task
            asked = asked.repartition(queries.sparkSession.sparkContext.defaultParallelism)
        return asked.mapInArrow(_nearest(shared, k, dims, by_group, reach, n > broadcast), schema)
    return grid_knn(queries, points, k, dims, by_group, reach)


#: Queries that cells leave open and that go to all points by broadcast, a block at a time.
OPEN_QUERIES = 4096


def _open(shared, k: int, dims: int, by_group: bool):
    """For a few queries, the k nearest of a task's points in each group."""

    def run(batches):
        asked, q = shared.value
        best: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            points = np.stack([batch.column(1 + d).to_numpy() for d in range(dims)], 1) if len(ids) else np.empty((0, dims))
            groups = batch.column(1 + dims).to_numpy() if by_group else np.zeros(len(ids), np.int64)
            for g in np.unique(groups).tolist():
                own = np.flatnonzero(groups == g)
                for at in range(0, len(own), 2048):
                    some = own[at : at + 2048]
                    for low in range(0, len(q), 512):
                        d2 = np.zeros((len(q[low : low + 512]), len(some)))
                        for d in range(dims):
                            gap = q[low : low + 512, d, None] - points[None, some, d]
                            d2 += gap * gap
                        held = best.get((g, low))
                        name = np.broadcast_to(ids[some], d2.shape)
                        if held is not None:
                            d2, name = np.concatenate([held[0], d2], 1), np.concatenate([held[1], name], 1)
                        order = np.lexsort((name, d2), axis=1)[:, :k]
                        best[g, low] = np.take_along_axis(d2, order, 1), np.take_along_axis(name, order, 1)
        for (g, low), (d2, name) in best.items():
            columns = [pa.array(np.repeat(asked[low : low + 512], d2.shape[1])), pa.array(name.reshape(-1)), pa.array(d2.reshape(-1)), pa.array(np.full(d2.size, g))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "id", "d2", "grp"])

    return run


def grid_knn(queries: DataFrame, points: DataFrame, k: int, dims: int, by_group: bool = False, reach: float | None = None, rounds: int = 24) -> DataFrame:
    """knn() by equal cells: each query meets the points of its own and the adjacent cells. It is done if it has its k (or
    a smaller group's all) and the last is no farther than the rim of those cells, or if the rim is beyond reach; else it
    goes another round with cells three times as wide.

    Of points at one place only the k of least id can be neighbours; the others leave first. The first cells are so
    narrow that the fullest holds few points, so clusters are answered there. What the rounds leave open, points far out
    or of small groups, is measured against all points: the queries go to every task, OPEN_QUERIES at a time, and no cell
    gathers the points.
    """
    coords = [f"r{d}" for d in range(dims)]
    groups = ["grp"] if by_group else []
    place = Window.partitionBy(*coords, *groups).orderBy("id")
    points = points.select("id", *coords, *groups).withColumn("at", F.row_number().over(place)).where(F.col("at") <= k).drop("at")
    box = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in coords for f in (F.min, F.max))).first()
    spans = [max(box[f"max_{c}"] - box[f"min_{c}"], 1e-12) for c in coords]
    sizes = [r["n"] for r in points.groupBy("grp").agg(F.count("*").alias("n")).collect()] if by_group else [box["n"]]
    wanted = sum(min(k, n) for n in sizes)
    per_cell = max(2 * k, 16) / 3**dims * len(sizes)
    width = max((np.prod(spans) * per_cell / box["n"]) ** (1 / dims), max(spans) * 1e-6)
    cells = lambda prefix, w: [F.floor((F.col(f"{prefix}{c}") - F.lit(box[f"min_{c}"])) / w).cast("long") for c in coords]
    while width > max(spans) * 1e-6:
        full = points.groupBy(*cells("", width)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if full <= 16 * per_cell + k:
            break
        width /= 3
    left, out = queries.select("id", *coords), None
    steps = list(itertools.product((-1, 0, 1), repeat=dims))
    for _ in range(rounds):
        if width >= max(spans) or not left.limit(OPEN_QUERIES + 1).count() > OPEN_QUERIES:
            break
        near = points.withColumn("cell", F.array(*cells("", width)))
        moves = F.array(*(F.array(*(c + F.lit(s) for c, s in zip(cells("q_", width), step, strict=True))) for step in steps))
        asked = left.select(F.col("id").alias("i"), *(F.col(c).alias(f"q_{c}") for c in coords)).select("*", F.explode(moves).alias("cell"))
        pairs = asked.join(near, "cell").withColumn("d2", squared_distance([F.col(f"q_{c}") for c in coords], [F.col(c) for c in coords]))
        rank = F.row_number().over(Window.partitionBy("i", *groups).orderBy("d2", "id"))
        # the rim: the nearest border of the block of cells around a query
        inner = [F.pmod(F.col(f"q_{c}") - F.lit(box[f"min_{c}"]), F.lit(width)) for c in coords]
        rim = F.least(*(x + width for x in inner), *(2 * width - x for x in inner))
        found = pairs.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k).withColumn("rim", rim).persist()
        whole = (F.col("n") >= wanted) & (F.sqrt("far") <= F.col("rim"))
        if reach is not None:
            whole |= F.col("rim") >= reach
        complete = found.groupBy("i").agg(F.count("*").alias("n"), F.max("d2").alias("far"), F.first("rim").alias("rim")).where(whole).select("i")
        done = found.join(complete, "i", "left_semi").select("i", "rk", F.col("id").alias("j"), "d2", *groups)
        out = done if out is None else out.unionByName(done)
        left = left.join(complete.select(F.col("i").alias("id")), "id", "left_anti").persist()
        width *= 3
    n = left.count()
    blocks = -(-n // OPEN_QUERIES)
    for block in range(blocks):
        own = left.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        asked = own.column("id").to_numpy(), np.stack([own.column(c).to_numpy() for c in coords], 1)
        shared = queries.sparkSession.sparkContext.broadcast(asked)
        found = points.mapInArrow(_open(shared, k, dims, by_group), "i long, id long, d2 double, grp long")
        rank = F.row_number().over(Window.partitionBy("i", "grp").orderBy("d2", "id"))
        done = found.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k).select("i", "rk", F.col("id").alias("j"), "d2", *groups)
        out = done if out is None else out.unionByName(done)
    if out is None:
        return queries.sparkSession.createDataFrame([], "i long, rk long, j long, d2 double" + ", grp long" * by_group)
    return out.where(F.col("d2") <= reach * reach) if reach is not None else out
