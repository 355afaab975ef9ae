"""The registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Samples
from ..functions import covariance as C
from ..functions.geometry import Search
from ..operators import autocorr, clusterers, consensus, ensembles, kriging, labels, metrics, moments, neighbors, pairings
from . import fixtures as X
from .fixtures import ANISO, ANISO3, IDW, LABELS, LINES, PLAIN, R, S, V, near, num, rot

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        name = function.__name__
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# --- geometry and neighbours ---------------------------------------------------------------------------------------------
def _rotate(spark, sf, search, coords):
    return X.rounded(neighbors.rotate(X.frame(spark, sf), search, tuple(coords)))


_a = "radians(90 - 45)"


@query(f"with {S} select id, {R('cos(' + _a + ') * x + sin(' + _a + ') * y')} as r0, {R('2 * (-sin(' + _a + ') * x + cos(' + _a + ') * y)')} as r1 from s")
def rotate_2d(spark, sf):
    return _rotate(spark, sf, ANISO, "xy")


_b, _c = "radians(-20)", "radians(10)"


@query(
    f"""with {S} select id, {R(f'cos({_b}) * cos({_a}) * x + cos({_b}) * sin({_a}) * y - sin({_b}) * z')} as r0,
    {R(f'2 * ((-cos({_c}) * sin({_a}) + sin({_c}) * sin({_b}) * cos({_a})) * x + (cos({_c}) * cos({_a}) + sin({_c}) * sin({_b}) * sin({_a})) * y + sin({_c}) * cos({_b}) * z)')} as r1,
    {R(f'5 * ((sin({_c}) * sin({_a}) + cos({_c}) * sin({_b}) * cos({_a})) * x + (-sin({_c}) * cos({_a}) + cos({_c}) * sin({_b}) * sin({_a})) * y + cos({_c}) * cos({_b}) * z)')} as r2 from s"""
)
def rotate_3d(spark, sf):
    return _rotate(spark, sf, ANISO3, "xyz")


def _edges(df: DataFrame) -> DataFrame:
    return df.select("i", "rk", "j", X.tidy("d2").alias("d2"))


_EDGES = f"select i, rk, j, {R('d2')} as d2 from nn"


@query(f"with {S}, {rot(PLAIN, 'xy')}, {near(10, 2)} {_EDGES}")
def knn_self(spark, sf):
    return _edges(autocorr.edges(X.samples(spark, sf), 10, PLAIN))


@query(f"with {S}, {rot(ANISO3, 'xyz')}, {near(8, 3)} {_EDGES}")
def knn_self_aniso(spark, sf):
    return _edges(autocorr.edges(X.samples(spark, sf, "xyz"), 8, ANISO3))


@query(f"with {S}, {rot(PLAIN, 'xy')}, {near(10, 2)} {_EDGES}")
def knn_self_grid(spark, sf):
    places = neighbors.rotate(X.frame(spark, sf), PLAIN, ("x", "y"))
    return _edges(neighbors.grid_knn(places, places, 10, 2))


@query(f"with {S}, {rot(ANISO, 'xy', 'a', '(select * from s where id % 2 = 0)')}, {rot(ANISO, 'xy', 'b', '(select * from s where id % 2 = 1)')}, {near(5, 2, 'b', 'a')} {_EDGES}")
def knn_two_table(spark, sf):
    places = neighbors.rotate(X.frame(spark, sf), ANISO, ("x", "y"))
    return _edges(neighbors.knn(places.where("id % 2 = 1"), places.where("id % 2 = 0"), 5, 2))


@query(f"with {S}, {rot(PLAIN, 'xy', more=', domaincode')}, {near(4, 2, by='domaincode')} select i, grp, rk, j, {R('d2')} as d2 from nn where d2 <= 0.25")
def knn_per_category(spark, sf):
    places = neighbors.rotate(X.frame(spark, sf).withColumnRenamed("domaincode", "grp"), PLAIN, ("x", "y"), ("id", "grp"))
    return neighbors.knn(places, places, 4, 2, by_group=True, reach=0.5).select("i", "grp", "rk", "j", X.tidy("d2").alias("d2"))


@query(f"with {S}, r as (select id, v1 as r0, v2 as r1, v3 as r2, v4 as r3 from s), {near(10, 4)} {_EDGES}")
def knn_attribute_space(spark, sf):
    points = X.frame(spark, sf).select("id", *(F.col(v).alias(f"r{n}") for n, v in enumerate(V)))
    return _edges(neighbors.knn(points, points, 10, 4))


@query(f"with {S}, {rot(ANISO, 'xy')}, {near(10, 2)} select i, j, {R(f'{IDW} / sum({IDW}) over (partition by i)')} as w from nn where i <> j")
def idw_weights(spark, sf):
    return X.rounded(autocorr.weights(autocorr.edges(X.samples(spark, sf), 10, ANISO, drop_self=True)).select("i", "j", "w"))


@query(f"with {S}, {rot(ANISO, 'xy')}, {near(10, 2)} select i, j, case when sqrt(d2) <= 1e10 then 1.0::double else 0.0::double end as w from nn where i <> j")
def binary_weights(spark, sf):
    return autocorr.weights(autocorr.edges(X.samples(spark, sf), 10, ANISO, drop_self=True), "binary").select("i", "j", "w")


@query(f"with {S}, {rot(ANISO, 'xy')}, {near(6, 2)} select i, j, {R(f'{IDW} / sum({IDW}) over (partition by i)')} as w from nn")
def weights_matrix(spark, sf):
    return X.rounded(autocorr.weights_matrix(X.samples(spark, sf), 6, ANISO))


@query(
    f"""with recursive {S}, {rot(PLAIN, 'xy')}, {near(10, 2)}
    select n.i, count(*) as n, {R('sqrt(max(d2))')} as far, {R('sum(abs(a.v1 - b.v1))')} as gap from nn n join s a on a.id = n.i join s b on b.id = n.j group by n.i"""
)
def pointwise_distance(spark, sf):
    s = X.frame(spark, sf)
    rows = autocorr.edges(X.samples(spark, sf), 10, PLAIN).join(s.select(F.col("id").alias("i"), F.col("v1").alias("a")), "i").join(s.select(F.col("id").alias("j"), F.col("v1").alias("b")), "j")
    return rows.groupBy("i").agg(F.count("*").alias("n"), X.tidy(F.sqrt(F.max("d2"))).alias("far"), X.tidy(F.sum(F.abs(F.col("a") - F.col("b")))).alias("gap"))


# --- autocorrelation -------------------------------------------------------------------------------------------------------
_moran = lambda v: f"sum(case when z.{v} < 0 and n.{v} < 0 then -1 else 1 end * w * z.{v} * n.{v}) / (greatest(sum(w * (n.{v} - m.{v}) * (n.{v} - m.{v})) / sum(w), 1e-8) * sum(w))"


@query(
    f"""with {S}, {rot(PLAIN, 'xy')}, {near(10, 2)}, e as (select i, j, {IDW} / sum({IDW}) over (partition by i) as w from nn where i <> j),
    m as (select i, {', '.join(f'sum(w * {v}) / sum(w) as {v}' for v in V)} from e join s on s.id = j group by i)
    select e.i as id, {', '.join(f'{R(_moran(v))} as a_{v}' for v in V)} from e join s z on z.id = e.i join s n on n.id = e.j join m on m.i = e.i group by e.i"""
)
def local_morans(spark, sf):
    return X.rounded(autocorr.local_autocorr(X.samples(spark, sf), "morans", 10, PLAIN))


@query(
    f"""with {S}, {rot(ANISO, 'xy')}, {near(10, 2)}
    select i as id, {', '.join(f'{R(f"sum(n.{v}) / (greatest(1e-10, any_value(z.v1 + z.v2 + z.v3 + z.v4)) * count(*))", 3)} as a_{v}' for v in V)}
    from nn join s z on z.id = i join s n on n.id = j where i <> j and z.v1 + z.v2 + z.v3 + z.v4 > 0.001 group by i"""
)
def local_getis(spark, sf):
    # the rows of the given SQL, which are not all: local_getis_all has every sample
    rows = X.frame(spark, sf).where("v1 + v2 + v3 + v4 > 0.001").select("id")
    return X.rounded(autocorr.local_autocorr(X.samples(spark, sf), "getis", 10, ANISO).join(rows, "id"), 3)


_total = "z.v1 + z.v2 + z.v3 + z.v4"
_getis = lambda v: f"sum(n.{v}) / (greatest(1e-10, any_value({_total})) * count(*))"
_digits = ((0.001, 9), (1e-6, 6), (float("-inf"), 2))  # a small sum makes large values, of which fewer digits are exact


@query(
    f"""with {S}, {rot(ANISO, 'xy')}, {near(10, 2)}
    select i as id, {', '.join('case ' + ' '.join(f"when any_value({_total}) > {num(a) if a > 0 else "'-infinity'::double"} then {R(_getis(v), n)}" for a, n in _digits) + f' end as a_{v}' for v in V)}
    from nn join s z on z.id = i join s n on n.id = j where i <> j group by i"""
)
def local_getis_all(spark, sf):
    """Every sample; those whose variables sum to 1e-10 or less have that as their sum."""
    found = autocorr.local_autocorr(X.samples(spark, sf), "getis", 10, ANISO)
    found = found.join(X.frame(spark, sf).select("id", (F.col("v1") + F.col("v2") + F.col("v3") + F.col("v4")).alias("_total")), "id")
    by = lambda c: F.coalesce(*(F.when(F.col("_total") > a, X.tidy(c, n)) for a, n in _digits)).alias(c)
    return found.select("id", *(by(f"a_{v}") for v in V))


_pairs = "from nn join y z on z.id = i join y n on n.id = j"
_w = f"nn as (select i, j, {IDW} / sum({IDW}) over (partition by i) as w from near)"


@query(
    f"""with {S}, {rot(PLAIN, 'xy')}, {near(10, 2, name='near')}, {_w}, y as (select id, {', '.join(f'{v} - avg({v}) over () as {v}' for v in V)} from s),
    t as (select {', '.join(f'sum(w * z.{v} * n.{v}) as {v}' for v in V)} {_pairs}), b as (select {', '.join(f'sum({v} * {v}) as {v}' for v in V)} from y)
    select {', '.join(f'{R(f"t.{v} / b.{v}")} as g_{v}' for v in V)} from t, b"""
)
def global_morans(spark, sf):
    return X.rounded(autocorr.global_autocorr(X.samples(spark, sf), "morans", 10, PLAIN))


@query(f"with {S}, {rot(PLAIN, 'xy')}, {near(10, 2, name='near')}, {_w}, y as (select * from s) select {', '.join(f'{R(f"sum(w * z.{v} * n.{v}) / sum(z.{v} * n.{v})")} as g_{v}' for v in V)} {_pairs}")
def global_getis(spark, sf):
    return X.rounded(autocorr.global_autocorr(X.samples(spark, sf), "getis", 10, PLAIN))


# --- moments and transforms ------------------------------------------------------------------------------------------------
def _union(rows: list[str]) -> str:
    return " union all ".join(rows)


L = ("q", "p", "d")


@query(f"with {LINES} " + _union([f"select '{v}' as variable, {R(f'avg({v})')} as mean, {R(f'var_pop({v})')} as var, {R(f'stddev_pop({v})')} as std from l" for v in L]))
def mean_var_std(spark, sf):
    return X.rounded(moments.moments(X.lines(spark, sf), L))


@query(
    f"with {LINES}, m as (select {', '.join(f'sum(w * {v}) / sum(w) as {v}' for v in L)} from l), t as (select {', '.join(f'sum(w * (l.{v} - m.{v}) * (l.{v} - m.{v})) / sum(w) as {v}' for v in L)} from l, m) "
    + _union([f"select '{v}' as variable, {R(f'm.{v}')} as mean, {R(f't.{v}')} as var, {R(f'sqrt(t.{v})')} as std from m, t" for v in L])
)
def weighted_moments(spark, sf):
    return X.rounded(moments.weighted_moments(X.lines(spark, sf), L, "w"))


@query(f"with {LINES} " + _union([f"select '{a}' as a, '{b}' as b, {R(f'covar_pop({a}, {b}) + {0.001 if a == b else 0.0}')} as cov from l" for a in L for b in L]))
def cov_reg(spark, sf):
    return X.rounded(moments.covariance(X.lines(spark, sf), L))


@query(
    f"with {LINES}, m as (select {', '.join(f'sum(w * {v}) / sum(w) as {v}' for v in L)} from l) "
    + _union([f"select '{a}' as a, '{b}' as b, {R(f'sum(w * (l.{a} - m.{a}) * (l.{b} - m.{b})) / sum(w) + {0.001 if a == b else 0.0}')} as cov from l, m" for a in L for b in L])
)
def weighted_cov(spark, sf):
    return X.rounded(moments.covariance(X.lines(spark, sf), L, weight="w"))


@query(f"with {S} select id, {', '.join(f'{R(f"({v} - avg({v}) over ()) / greatest(stddev_pop({v}) over (), 1e-10)")} as {v}' for v in V)} from s")
def standardize(spark, sf):
    return X.rounded(moments.standardise(X.frame(spark, sf).select("id", *V), V))


from ..functions.normal import inverse_normal_sql  # noqa: E402


@query(f"with {S}, k as (select id, {', '.join(f'(row_number() over (order by {v}, id) - 0.5::double) / count(*) over () as {v}' for v in V)} from s) select id, {', '.join(f'{R(inverse_normal_sql(v))} as {v}' for v in V)} from k")
def nscore(spark, sf):
    return X.rounded(moments.normal_score(X.frame(spark, sf).select("id", *V), V))


_INV2 = "cc as (select var_pop(v1) + 0.001 as a, covar_pop(v1, v2) as b, var_pop(v2) + 0.001 as d from {0}), inv as (select (d - b) / (a * d - b * b) as i1, (a - b) / (a * d - b * b) as i2, sqrt(a * a + 2 * b * b + d * d) as f from cc)"


@query(f"with {S}, {_INV2.format('s')} select id, {R('i1 * v1 * v1 + i2 * v2 * v2')} as m from s, inv")
def mdistance(spark, sf):
    import numpy as np

    s = X.frame(spark, sf)
    cov = {(r["a"], r["b"]): r["cov"] for r in moments.covariance(s, V[:2]).collect()}
    inverse = np.linalg.inv(np.array([[cov[a, b] for b in V[:2]] for a in V[:2]]))
    return X.rounded(s.select("id", moments.odd_form(V[:2], inverse.sum(1)).alias("m")))


_STD2 = "t as (select id, (v1 - avg(v1) over ()) / stddev_pop(v1) over () as v1, (v2 - avg(v2) over ()) / stddev_pop(v2) over () as v2 from s)"


@query(f"with {S}, {_STD2}, {_INV2.format('t')} select a.id, {R('sum(exp(-(i1 * (b.v1 - a.v1) * (b.v1 - a.v1) + i2 * (b.v2 - a.v2) * (b.v2 - a.v2)) / 0.4)) / greatest(1e-10, any_value(f) * 2 * pi())', 5)} as density from t a, t b, inv group by a.id")
def gausskde_2v(spark, sf):
    return X.rounded(moments.density(X.frame(spark, sf), V[:2]), 5)


# --- metrics -----------------------------------------------------------------------------------------------------------------
@query(f"with {S}, {LABELS}, {rot(PLAIN, 'xy')}, {near(10, 2)}, n as (select i, cluster, count(*) / 10.0::double as p from nn join c on c.id = j group by i, cluster) select i as id, {R('-sum(p * ln(p))')} as entropy from n group by i")
def spatial_entropy(spark, sf):
    near_ = autocorr.edges(X.samples(spark, sf), 10, PLAIN)
    return X.rounded(metrics.spatial_entropy(near_, X.clustered(spark, sf).select("id", "cluster")))


@query(f"with {LINES}, g as (select flag, count(*) * (var_pop(q) + var_pop(p) + var_pop(d)) as s from l group by flag) select {R('sum(s)', 3)} as wcss from g")
def wcss(spark, sf):
    return X.rounded(metrics.wcss(X.lines(spark, sf), L, "flag"), 3)


@query(f"with {S}, {LABELS}, g as (select count(*) * (var_pop(v1) + var_pop(v2) + var_pop(v3) + var_pop(v4)) as s from c group by cluster) select {R('sum(s)')} as wcss from g")
def elbow_wcss_given_labels(spark, sf):
    return X.rounded(metrics.wcss(X.clustered(spark, sf), V))


_PER = "g as (select cluster, count(*) as n, avg(v1) as m1, avg(v2) as m2, var_pop(v1) as s1, var_pop(v2) as s2, covar_pop(v1, v2) as b from {0} group by cluster), k as (select *, ((s2 + 0.001) - b) / ((s1 + 0.001) * (s2 + 0.001) - b * b) as i1, ((s1 + 0.001) - b) / ((s1 + 0.001) * (s2 + 0.001) - b * b) as i2 from g)"


@query(f"with {S}, {LABELS}, {_PER.format('c')} select {R('sum(n * (i1 * s1 + i2 * s2))')} as mwcss from k")
def mwcss_2v(spark, sf):
    return X.rounded(metrics.mwcss(X.clustered(spark, sf), V[:2]))


_q4 = " + ".join(f"(x.{v} - y.{v}) * (x.{v} - y.{v})" for v in V)
_G4 = "select cluster, count(*) as n, {}, {} as s from {{}} group by cluster".format(", ".join(f"avg({v}) as {v}" for v in V), " + ".join(f"var_pop({v})" for v in V))
_ward = f"((x.n + y.n) / 4.0 * ({_q4})) / greatest(x.n * x.s + y.n * y.s + (x.n + y.n) / 4.0 * ({_q4}), 1e-6)"


@query(f"with {S}, {LABELS}, g as ({_G4.format('c')}) select x.cluster as a, y.cluster as b, {R(_ward)} as distance from g x join g y on x.cluster < y.cluster")
def wards(spark, sf):
    return X.rounded(metrics.ward_table(X.clustered(spark, sf), V))


_ST4 = f"t as (select cluster, {', '.join(f'({v} - avg({v}) over ()) / stddev_pop({v}) over () as {v}' for v in V)} from c)"


@query(f"with {S}, {LABELS}, {_ST4}, g as ({_G4.format('c')}), h as ({_G4.format('t')}) select {R(f'sum({_ward}) / (select count(*) from s)', 9)} as distance from g x join h y on x.cluster < y.cluster")
def tdiff_wards(spark, sf):
    return X.rounded(metrics.ward_sum(X.clustered(spark, sf), V), 9)


_half = "(x.m{0} - y.m{0}) * (x.m{0} - y.m{0}) / 4"
_Q = f"(x.n * (x.i1 * {_half.format(1)} + x.i2 * {_half.format(2)}) + y.n * (y.i1 * {_half.format(1)} + y.i2 * {_half.format(2)}))"
_BC = "(x.n * (x.i1 * x.s1 + x.i2 * x.s2) + y.n * (y.i1 * y.s1 + y.i2 * y.s2))"


@query(f"with {S}, {LABELS}, {_PER.format('c')} select x.cluster as a, y.cluster as b, {R(f'{_Q} / ({_BC} + {_Q})')} as distance from k x join k y on x.cluster < y.cluster")
def wards_mdist_2v(spark, sf):
    return X.rounded(metrics.ward_table(X.clustered(spark, sf), V[:2], mahalanobis=True))


_PER2 = _PER.replace("g as", "g2 as").replace("from g)", "from g2)").replace("k as", "k2 as")
_ST2 = "t as (select cluster, (v1 - avg(v1) over ()) / stddev_pop(v1) over () as v1, (v2 - avg(v2) over ()) / stddev_pop(v2) over () as v2 from c)"


@query(f"with {S}, {LABELS}, {_ST2}, {_PER.format('c')}, {_PER2.format('t')} select {R(f'sum({_Q} / ({_BC} + {_Q})) / (select count(*) from s)', 9)} as distance from k x join k2 y on x.cluster < y.cluster")
def tdiff_wards_mdist_2v(spark, sf):
    return X.rounded(metrics.ward_sum(X.clustered(spark, sf), V[:2], mahalanobis=True), 9)


@query(
    f"""with {S}, c as (select *, domaincode % 3 as cluster from s), {_PER.format('c')},
    p as (select a.id, a.cluster as home, b.cluster as whose, sum(exp(-(i1 * (b.v1 - a.v1) * (b.v1 - a.v1) + i2 * (b.v2 - a.v2) * (b.v2 - a.v2)))) / greatest(1e-10, any_value(sqrt((s1 + 0.001) * (s1 + 0.001) + 2 * k.b * k.b + (s2 + 0.001) * (s2 + 0.001))) * 2 * pi()) as p
        from c a, c b join k on k.cluster = b.cluster group by a.id, a.cluster, b.cluster),
    h as (select id, p from p where home = whose)
    select {R('0.5 * sum(h.p * ln(h.p / nullif(p.p, 0))) / (select count(*) from s)')} as distance from p join h using (id) where home <> whose"""
)
def kde_kld_2v(spark, sf):
    rows = X.frame(spark, sf).withColumn("cluster", F.col("domaincode") % 3)
    return X.rounded(metrics.kld(rows, V[:2], band=0.2))


@query(f"with {S}, {LABELS}, w as (select count(*) * (var_pop(v1) + var_pop(v2) + var_pop(v3) + var_pop(v4)) as s from c group by cluster), {rot(PLAIN, 'xy')}, {near(10, 2)}, n as (select i, cluster, count(*) / 10.0::double as p from nn join c on c.id = j group by i, cluster) select format('MV: {{:.2f}}\nSP: {{:.2f}}', (select sum(s) from w), (select -sum(p * ln(p)) from n)) as label")
def label_stats_format(spark, sf):
    c = X.clustered(spark, sf)
    mv = metrics.wcss(c, V).withColumnRenamed("wcss", "mv")
    sp = metrics.spatial_entropy(autocorr.edges(X.samples(spark, sf), 10, PLAIN), c.select("id", "cluster")).agg(F.sum("entropy").alias("sp"))
    return mv.crossJoin(sp).select(metrics.stats_text(mv).alias("label"))


# --- labels --------------------------------------------------------------------------------------------------------------------
@query(f"with {S}, d as (select domaincode as cluster, count(*) as n from s group by 1) select cluster, n, {R('n / (select count(*) from s)')} as p from d")
def proportions(spark, sf):
    rows = X.frame(spark, sf).select(F.lit(0).alias("real"), "id", F.col("domaincode").alias("cluster"))
    return X.rounded(labels.proportions(rows).select("cluster", "n", "p"))


@query(f"with {S}, d as (select dh as real, domaincode as cluster, count(*) as n from s group by 1, 2), p as (select real, n / sum(n) over (partition by real) as p from d) select real from p group by real having min(p) > 0.04 and max(p) < 0.3")
def accept_filter(spark, sf):
    rows = X.frame(spark, sf).select(F.col("dh").alias("real"), "id", F.col("domaincode").alias("cluster"))
    return labels.accepted(rows, 0.04, 0.3)


@query(f"with {S} select code, row_number() over (order by code) - 1 as icode from (select distinct domaincode as code from s)")
def code_map(spark, sf):
    return labels.code_map(X.frame(spark, sf), "domaincode")


@query(f"with {S}, h as (select dh from (select distinct dh from s) order by dh * 7 % 25, dh limit 20) select id, dh, dh in (select dh from h) as train from s")
def dh_split_join(spark, sf):
    s = X.frame(spark, sf)
    chosen = s.select("dh").distinct().orderBy(F.col("dh") * 7 % 25, "dh").limit(20).withColumn("train", F.lit(True))
    return s.join(F.broadcast(chosen), "dh", "left").select("id", "dh", F.coalesce("train", F.lit(False)).alias("train"))


@query(f"with {S} select domaincode as cluster, count(*) as n, {R('avg(x)')} as x, {R('avg(y)')} as y, {', '.join(f'{R(f"avg({v})")} as {v}' for v in V)} from s group by 1")
def cluster_init_stats(spark, sf):
    return X.rounded(X.frame(spark, sf).groupBy(F.col("domaincode").alias("cluster")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("x", "y", *V))))


@query(
    f"""with {S}, g as ({_G4.format('(select *, domaincode as cluster from s)')}),
    n as (select x.cluster as a, y.cluster as b, row_number() over (partition by x.cluster order by {_q4}, y.cluster) as rk, {_ward} as distance from g x join g y on x.cluster <> y.cluster),
    m as (select *, row_number() over (partition by a order by distance, b) as best from n where rk <= 4)
    select a, b, {R('distance')} as distance from m where best = 1"""
)
def secondary_merge_step(spark, sf):
    from pyspark.sql import Window

    g = metrics.cluster_moments(X.frame(spark, sf), V, "domaincode")
    p = metrics._pairs(g, g, (), True).where("a.cluster <> b.cluster")
    gap = F.aggregate(metrics._gap("a", "b"), F.lit(0.0), lambda s, x: s + x)
    p = p.select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"), gap.alias("gap"), metrics.ward().alias("distance"))
    p = p.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))).where("rk <= 4")
    best = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return X.rounded(p.withColumn("best", best).where("best = 1").select("a", "b", "distance"))


@query(f"with {S}, {LABELS} select real, base, cluster, count(*) as n from lab join base using (id) group by all")
def contingency(spark, sf):
    return labels.contingency(X.labels(spark, sf), X.base(spark, sf))


@query(
    f"""with {S}, {LABELS}, t as (select real, base, cluster, count(*) as n from lab join base using (id) group by all),
    a as (select real, sum(n * (n - 1) / 2) as s, sum(n) as m from t group by real), i as (select real, sum(n * (n - 1) / 2) as si from (select real, base, sum(n) as n from t group by all) group by real),
    j as (select real, sum(n * (n - 1) / 2) as sj from (select real, cluster, sum(n) as n from t group by all) group by real)
    select real, {R('(s - si * sj / (m * (m - 1) / 2)) / (0.5 * (si + sj) - si * sj / (m * (m - 1) / 2))')} as ari from a join i using (real) join j using (real)"""
)
def adjusted_rand_index(spark, sf):
    return X.rounded(labels.adjusted_rand(X.labels(spark, sf), X.base(spark, sf)))


_PERMS = "perm as (select a.i as p1, b.i as p2, c.i as p3, d.i as p4 from range(1, 5) a(i), range(1, 5) b(i), range(1, 5) c(i), range(1, 5) d(i) where a.i <> b.i and a.i <> c.i and a.i <> d.i and b.i <> c.i and b.i <> d.i and c.i <> d.i)"
_BEST = "select *, row_number() over (partition by {0} order by total {1}, p1, p2, p3, p4) as rk from (select {0}, p1, p2, p3, p4, sum({2}) as total from t, perm where base = case cluster when 1 then p1 when 2 then p2 when 3 then p3 else p4 end group by all)"
_LIST = "unnest([1, 2, 3, 4]::bigint[]) as cluster, unnest([p1, p2, p3, p4]) as code"
_T = "t as (select g.real, g.cluster, g.base, coalesce(n, 0) as n from (select r.real, c4.cluster, b4.base from (select distinct real from lab) r, (select unnest([1, 2, 3, 4]::bigint[]) as cluster) c4, (select unnest([1, 2, 3, 4]) as base) b4) g left join (select real, base, cluster, count(*) as n from lab join base using (id) group by all) q using (real, cluster, base))"


@query(f"with {S}, {LABELS}, {_PERMS}, {_T}, b as ({_BEST.format('real', 'desc', 'n')}) select real, {_LIST}, {R('total / (select count(*) from s)')} as score from b where rk = 1")
def reclass_k4(spark, sf):
    return X.rounded(labels.recode_map(X.labels(spark, sf), X.base(spark, sf)))


@query(
    f"""with {S}, {LABELS}, {_PERMS}, d as (select real, cluster, v1, v2, v3, v4 from lab join s using (id)),
    x as (select real, cluster, count(*) as n, {', '.join(f'avg({v}) as {v}' for v in V)}, {' + '.join(f'var_pop({v})' for v in V)} as s from d group by all),
    y as (select cluster as base, count(*) as n, {', '.join(f'avg({v}) as {v}' for v in V)}, {' + '.join(f'var_pop({v})' for v in V)} as s from c group by all),
    t as (select real, x.cluster, base, round({_ward}, 9) as n from x, y), b as ({_BEST.format('real', 'asc', 'n')})
    select real, {_LIST}, {R('total / 4')} as score from b where rk = 1"""
)
def reclass_byvar_k4(spark, sf):
    s = X.frame(spark, sf)
    return X.rounded(labels.recode_map_by_variables(X.labels(spark, sf), X.base(spark, sf), s, V))


@query(f"with {S}, {LABELS}, {_PERMS}, t as (select a.real, b.real as real2, a.cluster, b.cluster as base, count(*) as n from lab a join lab b using (id) group by all), b as ({_BEST.format('real, real2', 'desc', 'n')}) select real, real2, {R('total / (select count(*) from s)')} as similarity from b where rk = 1")
def pairwise_similarity_k4(spark, sf):
    return X.rounded(labels.pairwise_similarity(X.labels(spark, sf)))


# --- pairings and consensus ----------------------------------------------------------------------------------------------------
_W = "wide as (select id, max(case when real = 1 then cluster end) as c1, max(case when real = 2 then cluster end) as c2, max(case when real = 3 then cluster end) as c3, max(case when real = 4 then cluster end) as c4 from lab group by id)"
_same = lambda n: f"case when a.c{n} = b.c{n} then 1 else 0 end"
_P = f"pp as (select a.id as i, b.id as j, (1 + {' + '.join(_same(n) for n in (1, 2, 3, 4))}) / 4.0::double as p from wide a join wide b on a.id < b.id)"


@query(f"with {S}, {LABELS}, {_W}, {_P} select i, j, p from pp")
def pairings_unweighted(spark, sf):
    return pairings.pairings(X.labels(spark, sf))


@query(f"with {S}, {LABELS}, {_W} select a.id as i, b.id as j, {R(f'({" + ".join(f"{n} * {_same(n)}" for n in (1, 2, 3, 4))}) / 10.0::double')} as p from wide a join wide b on a.id < b.id")
def pairings_weighted(spark, sf):
    weights = spark.createDataFrame([(n, float(n)) for n in (1, 2, 3, 4)], "real long, w double")
    return pairings.pairings(X.labels(spark, sf), weights, shown=X.tidy)


@query(
    f"""with {S}, {LABELS}, {_W}, {_P}, e as (select i, j, p from pp union all select j, i, p from pp), t as (select i, base, sum(p) as s from e join base on base.id = j group by all),
    last as (select base, max(id) as last from base group by base), r as (select base, 1 + sum(p) as r from last join e on i = last group by base)
    select b.id, r.base as cluster, {R('coalesce(s, 0) / r')} as p from base b, r left join t on t.i = b.id and t.base = r.base"""
)
def cluster_probability(spark, sf):
    return X.rounded(pairings.membership(X.labels(spark, sf), X.base(spark, sf).withColumnRenamed("base", "cluster")))


@query(
    f"""with {S}, {LABELS}, {_PERMS}, {_T}, b as ({_BEST.format('real', 'desc', 'n')}), m as (select real, {_LIST} from b where rk = 1),
    f as (select id, code, count(*) as n from lab join m using (real, cluster) group by all)
    select g.id, g.cluster, {R('coalesce(n, 0) / 4.0::double')} as p from (select base.id, c4.cluster from base, (select unnest([1, 2, 3, 4]::bigint[]) as cluster) c4) g left join f on f.id = g.id and f.code = g.cluster"""
)
def cluster_probability_bycount(spark, sf):
    return X.rounded(pairings.cluster_probability_by_count(X.labels(spark, sf), X.base(spark, sf).withColumnRenamed("base", "cluster")))


_u = ", ".join(f"u{n}" for n in (1, 2, 3, 4))


def _fold(step: int) -> str:
    i = step + 1
    means = ", ".join(f"{i - 1} / {i}.0::double * f.u{n} + 1 / {i}.0::double * avg(f.u{n}) over (partition by cluster) as u{n}" for n in (1, 2, 3, 4))
    return f"f{step} as (select f.id, {means} from f{step - 1} f join lab using (id) join o on o.real = lab.real and o.n = {step})"


@query(
    f"""with {S}, {LABELS}, t as (select real, base, cluster, count(*) as n from lab join base using (id) group by all),
    a as (select real, sum(n * (n - 1) / 2) as s, sum(n) as m from t group by real), i as (select real, sum(n * (n - 1) / 2) as si from (select real, base, sum(n) as n from t group by all) group by real),
    j as (select real, sum(n * (n - 1) / 2) as sj from (select real, cluster, sum(n) as n from t group by all) group by real),
    o as (select real, row_number() over (order by (s - si * sj / (m * (m - 1) / 2)) / (0.5 * (si + sj) - si * sj / (m * (m - 1) / 2)) desc, real desc) as n from a join i using (real) join j using (real)),
    f0 as (select id, {', '.join(f'case when base = {n} then 1.0::double else 0.0::double end as u{n}' for n in (1, 2, 3, 4))} from base), {', '.join(_fold(n) for n in (1, 2, 3, 4))}
    select id, unnest([1, 2, 3, 4])::bigint as code, round(unnest([{_u}]), 6) + 0.0 as u from f4"""
)
def consensus_agg(spark, sf):
    return X.rounded(pairings.cumulative(X.labels(spark, sf), X.base(spark, sf)))


# --- covariance ------------------------------------------------------------------------------------------------------------------
def _cova(spark, sf, kind):
    h2 = F.col("d2") * 4
    rows = autocorr.edges(X.samples(spark, sf), 10, PLAIN)
    return rows.select("i", "j", X.tidy(C.structure_covariance(kind, h2, 0.5, 1.25)).alias("cov"))


_NN10 = f"with {S}, {rot(PLAIN, 'xy')}, {near(10, 2)}"
_h = "(sqrt(d2 * 4) / 0.5)"
_COV = {1: f"case when {_h} > 1 then 0 else 1 - {_h} * (1.5 - 0.5 * {_h} * {_h}) end", 2: f"exp(-3 * {_h})", 3: f"exp(-3 * {_h} * {_h})"}
_cova_sql = lambda kind: f"{_NN10} select i, j, {R(f'case when d2 * 4 < 1e-9 then 1.25 else {_COV[kind]} end')} as cov from nn"


@query(_cova_sql(1))
def cova_spherical(spark, sf):
    return _cova(spark, sf, C.SPHERICAL)


@query(_cova_sql(2))
def cova_exponential(spark, sf):
    return _cova(spark, sf, C.EXPONENTIAL)


@query(_cova_sql(3))
def cova_gaussian(spark, sf):
    return _cova(spark, sf, C.GAUSSIAN)


MODEL = C.Variogram(0.1, (C.Structure(C.SPHERICAL, 0.5, 0.8, PLAIN), C.Structure(C.EXPONENTIAL, 0.4, 0.3, ANISO)))


def _model_sql(a: str, b: str, coords: str, own: bool) -> str:
    out = []
    for s in MODEL.structures:
        pad = "xyz"[: len(coords)]
        row = s.search.matrix()
        d2 = " + ".join("power(" + " + ".join(f"{num(w)} * ({a}{c} - {b}{c})" for w, c in zip(r, pad, strict=False)) + ", 2)" for r in row)
        h = f"(sqrt({d2}) / {s.reach if own else MODEL.structures[0].reach})"
        unit = f"case when {h} > 1 then 0 else 1 - {h} * (1.5 - 0.5 * {h} * {h}) end" if s.kind == 1 else f"exp(-3 * {h})"
        out.append(f"{s.sill} * (case when {d2} < 1e-9 then {num(MODEL.total)} else {unit} end)")
    return " + ".join(out)


@query(f"with {S} select a.id as i, b.id as j, {R('case when a.id = b.id then ' + num(MODEL.total) + ' else ' + _model_sql('a.', 'b.', 'xy', False) + ' end')} as cov from s a join s b on a.id <= b.id")
def pairwise_cov(spark, sf):
    return kriging.pairwise(X.samples(spark, sf), MODEL).select("i", "j", X.quick("cov").alias("cov"))


@query(f"with {S}, o as (select 0.1::double as x, 0.2::double as y) select s.id, {R(_model_sql('s.', 'o.', 'xy', True))} as cov from s, o")
def pointwise_cov(spark, sf):
    return X.rounded(kriging.pointwise(X.samples(spark, sf), (0.1, 0.2), MODEL))


@query(f"with g as (select i as cell, 0.05 + (i % 20) * 0.1::double as x, 0.05 + ((i // 20) % 15) * 0.1::double as y, 0.05 + (i // 300) * 0.2::double as z from range(1500) r(i)), o as (select 0.55::double as x, 0.4::double as y, 0.3::double as z) select cell, {R(_model_sql('g.', 'o.', 'xyz', False))} as cov from g, o")
def centered_cov_grid(spark, sf):
    return X.rounded(kriging.centred(kriging.grid(spark, 20, 0.05, 0.1, 15, 0.05, 0.1, 5, 0.05, 0.2), (0.55, 0.4, 0.3), MODEL))


def _krige2(weights: str) -> str:
    """SQL of the estimate from the two nearest others, with a system of two rows solved by hand."""
    c, r1, r2 = _model_sql("p.", "q.", "xy", False), _model_sql("s.", "p.", "xy", True), _model_sql("s.", "q.", "xy", True)
    return f"""with {S}, {rot(PLAIN, 'xy')}, {near(3, 2)}, e as (select i, j, row_number() over (partition by i order by rk) as n from nn where i <> j),
    t as (select s.id, p.v1 as f, q.v1 as g, {num(MODEL.total)} as t, {c} as c, {r1} as r1, {r2} as r2 from e a join e b on b.i = a.i and a.n = 1 and b.n = 2 join s on s.id = a.i join s p on p.id = a.j join s q on q.id = b.j)
    select id, {R(weights)} as estimate from t"""


@query(_krige2("((t * r1 - c * r2) * f + (t * r2 - c * r1) * g) / (t * t - c * c)"))
def sk_estimate_near2(spark, sf):
    return X.rounded(kriging.estimate(X.samples(spark, sf), "v1", MODEL, 3, PLAIN, ordinary=False))


@query(_krige2("g + (0.5 + 0.5 * (r1 - r2) / (t - c)) * (f - g)"))
def ok_estimate_near2(spark, sf):
    return X.rounded(kriging.estimate(X.samples(spark, sf), "v1", MODEL, 3, PLAIN))


# --- metrics of realisations against given reference labels --------------------------------------------------------------------
_METRICS = f"""with {S}, {LABELS}, {rot(PLAIN, 'xy')}, {near(10, 2)},
    w as (select real, sum(m) as mv from (select real, cluster, count(*) * (var_pop(v1) + var_pop(v2) + var_pop(v3) + var_pop(v4)) as m from lab join s using (id) group by all) group by real),
    n as (select real, i, cluster, count(*) / 10.0::double as p from nn join lab on lab.id = j group by all), e as (select real, -sum(p * ln(p)) as sp from n group by real),
    m as (select * from w join e using (real)), st as (select a.real, a.mv / b.mv as mv, a.sp / b.sp as sp from m a join m b on a.real = b.real % 4 + 1)"""


def _against_next(spark, sf):
    """Each realisation's metrics against the labels of the one before."""
    own = X.labels(spark, sf)
    return metrics.cluster_metrics(X.samples(spark, sf), own, 10, PLAIN, "wcss", reference=own.withColumn("real", F.col("real") % 4 + 1))


@query(f"{_METRICS} select real, {R('mv')} as mv, {R('sp')} as sp from st")
def cluster_metrics_given(spark, sf):
    return X.rounded(_against_next(spark, sf))


@query(f"{_METRICS} select {R('mv')} as mv, {R('sp')} as sp, format('MV: {{:.2f}}\nSP: {{:.2f}}', mv, sp) as label from st where real = 2")
def label_stats_given(spark, sf):
    one = lambda r: X.labels(spark, sf).where(F.col("real") == r).select("id", "cluster")
    return X.rounded(metrics.label_stats(X.samples(spark, sf), one(2), 10, PLAIN, reference=one(1)))


_PICK = "(select real from st where real not in ({}) order by power(sp - {}, 2) + power(mv - {}, 2), real limit 1)"


@query(f"{_METRICS}, p1 as {_PICK.format('0', '0.5', '0.0')}, p2 as {_PICK.format('select real from p1', '0.25', '0.25')} select * from lab where real in (select real from p1 union all select real from p2)")
def subensemble_given(spark, sf):
    model = ensembles.Ensemble(X.samples(spark, sf), nreal=4, near=10, search=PLAIN)
    model.labels, model.stats = X.labels(spark, sf), _against_next(spark, sf)
    return model.subensemble(2)


# --- iterative operators: no SQL -----------------------------------------------------------------------------------------------
@query()
def kmeans(spark, sf):
    return clusterers.cluster(X.frame(spark, sf), V, 4, "kmeans", 2)[0]


@query()
def gmm(spark, sf):
    return clusterers.cluster(X.frame(spark, sf), V, 3, "gmm")[0]


@query()
def ward(spark, sf):
    return clusterers.hier_labels(X.frame(spark, sf), V, 4)


@query()
def spectral_pic(spark, sf):
    return consensus.consensus(X.labels(spark, sf), 4, method="power")[0]


@query()
def rf_predict(spark, sf):
    c = X.clustered(spark, sf)
    return clusterers.predict_labels(c.where("dh < 20"), c.where("dh >= 20"), ("x", "y", *V))


@query()
def accluster(spark, sf):
    return clusterers.accluster(X.samples(spark, sf), 4, "kmeans", "getis", 10, PLAIN, 2)


@query()
def acensemble(spark, sf):
    model = ensembles.RandomSubspace(X.samples(spark, sf), nreal=8, near=10, search=PLAIN, least=0.01, holes="dh", methods=("kmeans", "hier"))
    return model.fit(4).labels


@query()
def dssensemble(spark, sf):
    return ensembles.DualSpace(X.samples(spark, sf), nreal=8, near=10, search=PLAIN).fit(6).labels


@query()
def ssdssensemble(spark, sf):
    model = ensembles.SemiSupervised(X.samples(spark, sf), nreal=4, near=10, search=PLAIN)
    model.fit()
    return model.predict()


@query()
def krigecluster(spark, sf):
    every = X.samples(spark, sf)
    codes = [r[0] for r in every.frame.select("domaincode").distinct().collect()]
    models = {(c, v): C.Variogram(0.1, (C.Structure(C.SPHERICAL, 0.9, 0.8),)) for c in codes for v in range(len(V))}
    return ensembles.KrigingPath(every, nreal=2, models=models, most_near=8, path_search=Search(0, 0, 0, 100, 100, 100)).fit().labels


@query()
def ok_estimate(spark, sf):
    return kriging.estimate(X.samples(spark, sf), "v1", MODEL, 10, PLAIN)


@query()
def sk_estimate(spark, sf):
    return kriging.estimate(X.samples(spark, sf), "v1", MODEL, 10, PLAIN, ordinary=False)


@query()
def consensus_hier(spark, sf):
    return consensus.consensus(X.labels(spark, sf), 4, method="hier", reference=X.base(spark, sf))[0]


@query()
def consensus_spec(spark, sf):
    return consensus.consensus(X.labels(spark, sf), 4, method="spec")[0]


@query()
def cluster_metrics(spark, sf):
    return metrics.cluster_metrics(X.samples(spark, sf), X.labels(spark, sf), 10, PLAIN)


@query()
def subensemble(spark, sf):
    model = ensembles.Ensemble(X.samples(spark, sf), nreal=4, near=10, search=PLAIN)
    model.labels = X.labels(spark, sf)
    return model.subensemble(2)


@query()
def mds_embed(spark, sf):
    return clusterers.embed(X.frame(spark, sf), V)


@query()
def elbow(spark, sf):
    return clusterers.elbow(X.frame(spark, sf), V, 5, 2)


@query(f"with {S} select " + ", ".join(f"cast(printf('%.8g', cast({c} as double)) as double) as {c}" for c in ("id", "x", "y", *V)) + " from s")
def geoeas_roundtrip(spark, sf):
    import tempfile

    from ..sources.geoeas import read_geoeas, write_geoeas

    shared = spark.conf.get("spark.checkpoint.dir", None) or ("file://" + tempfile.mkdtemp(prefix="stratalode-") if spark.sparkContext.master.startswith("local") else None)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{shared}/geoeas-{spark.sparkContext.applicationId}"
    write_geoeas(X.frame(spark, sf).select("id", "x", "y", *V), path, "id", ["id", "x", "y", *V])
    return read_geoeas(spark, path).drop("_row")


def _rename(old: str, new: str) -> None:
    QUERIES[new] = QUERIES.pop(old)
    ORACLES[new] = ORACLES.pop(old)


_rename("pairings_unweighted", "pairings")
__all__ = ["ORACLES", "QUERIES", "SparkSession"]
