"""Sample tables that the registered queries run on, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import Samples
from ..functions.geometry import Search

V = ("v1", "v2", "v3", "v4")
PLAIN, ANISO, ANISO3 = Search(), Search(45, 0, 0, 100, 50, 20), Search(45, 20, 10, 100, 50, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, v1..v4, domaincode, dh) from the embeddings."""
    e = lambda n: F.col("embedding")[n].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), e(6).alias("z"), *(e(2 + n).alias(v) for n, v in enumerate(V)), F.col("label").cast("long").alias("domaincode"), (F.col("vec_id") % 25).alias("dh"))


def samples(spark: SparkSession, sf_dir: str, coords: str = "xy", variables=V) -> Samples:
    return Samples(frame(spark, sf_dir), tuple(coords), tuple(variables))


def labels(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """(real, id, cluster): realisation r cuts the samples into k parts by v_r."""
    rows = frame(spark, sf_dir)
    out = None
    for r, v in enumerate(V, 1):
        part = rows.select(F.lit(r).cast("long").alias("real"), "id", F.ntile(k).over(Window.orderBy(v, "id")).cast("long").alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where("real = 1").select("id", F.col("cluster").alias("base"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with the first realisation's cluster."""
    return frame(spark, sf_dir).join(base(spark, sf_dir).withColumnRenamed("base", "cluster"), "id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large table for column-wise operators: scaled line items, by return flag."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 1e5).alias("p"), (F.col("l_discount") * 10).alias("d"), F.col("l_returnflag").alias("flag"), (F.col("l_tax") + 0.01).alias("w"))


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def quick(c: str, digits: int = 6) -> Column:
    """tidy() for very many rows: only what is near a half, or large, is rounded by its decimal digits."""
    much = F.col(c) * 10.0**digits
    plain = (F.abs(much) < 1e9) & (F.abs(much - F.floor(much) - 0.5) > 1e-3)
    return F.when(plain, F.rint(much) / 10.0**digits + F.lit(0.0)).otherwise(tidy(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long."""
    return df.select(*(tidy(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name) for f in df.schema))


# --- SQL ---------------------------------------------------------------------------------------------------------------
S = """s as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[7] as double) as z,
    cast(embedding[3] as double) as v1, cast(embedding[4] as double) as v2, cast(embedding[5] as double) as v3, cast(embedding[6] as double) as v4,
    cast(label as bigint) as domaincode, vec_id % 25 as dh from embeddings)"""
LABELS = """lab as (select cast(1 as bigint) as real, id, cast(ntile(4) over (order by v1, id) as bigint) as cluster from s union all select 2, id, ntile(4) over (order by v2, id) from s
    union all select 3, id, ntile(4) over (order by v3, id) from s union all select 4, id, ntile(4) over (order by v4, id) from s),
    base as (select id, cluster as base from lab where real = 1), c as (select s.*, base as cluster from s join base using (id))"""
LINES = "l as (select l_quantity / 50 as q, l_extendedprice / 1e5 as p, l_discount * 10 as d, l_returnflag as flag, l_tax + 0.01 as w from lineitem)"


def num(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def turned(search: Search, coords: str, of: str = "") -> list[str]:
    """The rotated coordinates as SQL."""
    return [" + ".join(f"{num(w)} * {of}{c}" for w, c in zip(row, coords, strict=False)) for row in search.matrix()[: len(coords)]]


def rot(search: Search, coords: str, name: str = "r", source: str = "s", more: str = "") -> str:
    return f"{name} as (select id{more}, " + ", ".join(f"{e} as r{n}" for n, e in enumerate(turned(search, coords))) + f" from {source})"


def near(k: int, dims: int, a: str = "r", b: str = "r", name: str = "nn", by: str = "") -> str:
    d2 = " + ".join(f"(a.r{n} - b.r{n}) * (a.r{n} - b.r{n})" for n in range(dims))
    more = f", b.{by} as grp" if by else ""
    part = f", b.{by}" if by else ""
    return f"{name} as (select * from (select a.id as i, b.id as j, {d2} as d2{more}, row_number() over (partition by a.id{part} order by {d2}, b.id) as rk from {a} a, {b} b) where rk <= {k})"


IDW = "1 / (2 + power(greatest(sqrt(d2), 1e-7), 2))"
R = lambda e, n=6: f"round({e}, {n}) + 0.0"
