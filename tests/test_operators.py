"""Operators against values worked out by hand and independent NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.frames import Samples
from stratalode.functions import covariance as C
from stratalode.functions.geometry import Search
from stratalode.functions.normal import inverse_normal
from stratalode.operators import autocorr, clusterers, consensus, ensembles, kernels, kriging, labels, metrics, moments, neighbors, pairings
from stratalode.sources import geoeas, parfiles


def frame(spark, n=60, seed=1):
    rng = np.random.RandomState(seed)
    rows = [(i, *map(float, rng.rand(2) * 10), *map(float, rng.randn(3) + (i % 3) * 4), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, a double, b double, c double, code long")


def samples(spark, **k):
    return Samples(frame(spark, **k), ("x", "y"), ("a", "b", "c"))


def test_rotation():
    assert np.allclose(Search().matrix(), [[0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    h = math.sqrt(0.5)
    assert np.allclose(Search(45, 0, 0, 100, 50, 20).matrix(), [[h, h, 0], [-2 * h, 2 * h, 0], [0, 0, 5]])
    assert Search.of((1, 2, 3, 4, 5)).r1 == 1
    with pytest.raises(ValueError):
        Search.of((1, 2))


def test_normal_quantiles(spark):
    p = [0.5 / 4, 1.5 / 4, 2.5 / 4, 3.5 / 4, 1e-10, 0.02]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got[:4], [-1.150349, -0.318639, 0.318639, 1.150349], atol=1e-6)
    assert all(abs(0.5 * math.erfc(-z / math.sqrt(2)) - q) < 1e-12 for z, q in zip(got, p, strict=True))


def test_normal_score_is_a_permutation(spark):
    f = frame(spark).withColumn("a", F.round("a"))  # ties
    got = moments.normal_score(f.select("id", "a"), ["a"])
    values = sorted(r["a"] for r in got.collect())
    want = [r[0] for r in spark.range(60).select(inverse_normal((F.col("id") + 0.5) / 60)).collect()]
    assert np.allclose(values, sorted(want))


def brute(q, p, k):
    out = {}
    for i, *a in q:
        d = sorted((sum((u - v) ** 2 for u, v in zip(a, b, strict=True)), j) for j, *b in p)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("way", ["broadcast", "grid"])
def test_knn(spark, way):
    rng = np.random.RandomState(3)
    p = [(i, *map(float, np.round(rng.rand(2) ** 3, 2))) for i in range(150)]  # repeated places, uneven
    f = spark.createDataFrame(p, "id long, r0 double, r1 double")
    q = f.where("id % 3 = 0")
    got = neighbors.knn(q, f, 6, 2, broadcast=1000 if way == "broadcast" else 0).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["i"], r["rk"])):
        lists.setdefault(r["i"], []).append(r["j"])
    assert lists == brute([x for x in p if x[0] % 3 == 0], p, 6)


def test_knn_more_than_there_are(spark):
    f = spark.createDataFrame([(0, 0.0), (1, 1.0)], "id long, r0 double")
    assert neighbors.knn(f, f, 5, 1).count() == 4
    assert neighbors.knn(f, f.where("false"), 5, 1).count() == 0


def test_weights(spark):
    near = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 4.0)], "i long, rk long, j long, d2 double")
    assert np.allclose(sorted(r["w"] for r in autocorr.weights(near).collect()), [1 / 3, 2 / 3])


def test_single_neighbour_keeps_raw_values(spark):
    s = samples(spark)
    got = {r["id"]: r["a_a"] for r in autocorr.local_autocorr(s, "getis", 2, Search()).collect()}
    assert got == {r["id"]: r["a"] for r in s.frame.collect()}
    with pytest.raises(ValueError):
        autocorr.local_autocorr(s, "geary", 5, Search())


def test_moran_by_numpy(spark):
    s = samples(spark)
    got = {r["id"]: r["a_a"] for r in autocorr.local_autocorr(s, 1, 6, Search()).collect()}
    rows = {r["id"]: r for r in s.frame.collect()}
    near = {}
    for r in autocorr.edges(s, 6, Search(), drop_self=True).collect():
        near.setdefault(r["i"], []).append((r["j"], r["d2"]))
    for i, found in near.items():
        w = np.array([1 / (2 + max(math.sqrt(d), 1e-7) ** 2) for _, d in found])
        w /= w.sum()
        z, n = rows[i]["a"], np.array([rows[j]["a"] for j, _ in found])
        sign = np.where((z < 0) & (n < 0), -1, 1)
        var = max((w * (n - (w * n).sum()) ** 2).sum(), 1e-8)
        assert abs(got[i] - (sign * w * z * n).sum() / var) < 1e-9


def test_ward(spark):
    f = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 4.0), (1, 6.0)], "cluster long, v double")
    assert abs(metrics.ward_table(f, ["v"]).first()["distance"] - 0.8) < 1e-12
    a, b = kernels.Stats.of(np.array([[0.0], [2.0]])), kernels.Stats.of(np.array([[4.0], [6.0]]))
    assert abs(kernels.ward(a, b) - 0.8) < 1e-12
    rng = np.random.RandomState(0)
    x, y = rng.randn(30, 3), rng.randn(40, 3) + 1
    merged = kernels.Stats.of(x) + kernels.Stats.of(y)
    assert np.allclose(merged.cov, np.cov(np.vstack([x, y]).T, bias=True))


def test_ward_mahalanobis_against_sums():
    rng = np.random.RandomState(0)
    x, y = rng.randn(30, 2), rng.randn(40, 2) + 1
    rows = [np.linalg.inv(np.cov(v.T, bias=True) + 1e-3 * np.eye(2)).sum(1) for v in (x, y)]
    middle = (x.mean(0) + y.mean(0)) / 2
    measure = lambda v, c, r: float((((v - c) ** 2) @ r).sum())
    a = measure(x, middle, rows[0]) + measure(y, middle, rows[1])
    b = measure(x, x.mean(0), rows[0]) + measure(y, y.mean(0), rows[1])
    assert abs(kernels.ward_mahalanobis(kernels.Stats.of(x), kernels.Stats.of(y), 1e-3) - (a - b) / a) < 1e-9


def test_zero_variance(spark):
    f = spark.createDataFrame([(0, 1.0), (1, 1.0)], "id long, v double")
    assert [r["v"] for r in moments.standardise(f, ["v"]).collect()] == [0.0, 0.0]
    assert [r["v"] for r in moments.standardise(f, ["v"], floor=None).collect()] == [None, None]


def labelled(spark, *reals):
    return spark.createDataFrame([(r, i, c) for r, row in enumerate(reals) for i, c in enumerate(row)], "real long, id long, cluster long")


def test_pairings(spark):
    got = {(r["i"], r["j"]): r["p"] for r in pairings.pairings(labelled(spark, (1, 1, 2), (1, 2, 2))).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5, (1, 2): 1.0}
    blocks = {(r["i"], r["j"]): r["p"] for r in pairings.pairings(labelled(spark, (1, 1, 2), (1, 2, 2)), block=1).collect()}
    assert blocks == got


def test_rand(spark):
    base = spark.createDataFrame([(i, c) for i, c in enumerate((0, 0, 1, 1))], "id long, base long")
    got = {r["real"]: r["ari"] for r in labels.adjusted_rand(labelled(spark, (0, 0, 1, 2), (5, 5, 7, 7)), base).collect()}
    assert abs(got[0] - 0.571429) < 1e-6 and got[1] == 1.0


def test_recode_never_lowers_agreement(spark):
    rng = np.random.RandomState(5)
    truth = rng.randint(0, 4, 80)
    other = np.array([2, 0, 3, 1])[truth]
    other[:10] = rng.randint(0, 4, 10)
    base = spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "id long, base long")
    got = labels.recode(labelled(spark, list(map(int, other))), base).collect()
    assert np.mean([truth[r["id"]] == r["cluster"] for r in got]) >= np.mean(other == truth)
    assert abs(got[0]["score"] - np.mean([truth[r["id"]] == r["cluster"] for r in got])) < 1e-12


def test_assignment_by_all_permutations():
    rng = np.random.RandomState(2)
    for n in (3, 9, 10):
        gain = rng.rand(n, n)
        got = sum(gain[i, j] for i, j in enumerate(labels.assignment(gain)))
        if n == 3:
            assert got == max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))
        else:
            greedy = max(sum(gain[i, p[i]] for i in range(n)) for p in (rng.permutation(n) for _ in range(2000)))
            assert got >= greedy and sorted(labels.assignment(gain)) == list(range(n))


def test_different_numbers_of_clusters(spark):
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, cluster long")
    got = pairings.cluster_probability_by_count(labelled(spark, (0, 1, 2)), clusters).collect()
    assert len(got) == 6 and all(r["p"] == 0 for r in got)


def test_seeds():
    assert ensembles.seeds(3, 73021) == [443, 380, 425]
    assert ensembles.seeds(5, 69069) == [467, 173, 608, 512, 485]


def test_dual_space_makes_as_many_clusters_as_wanted(spark):
    model = ensembles.DualSpace(samples(spark), nreal=3, near=5, take=2, search=Search()).fit(3)
    rows = model.labels.collect()
    assert {r["real"]: len({x["cluster"] for x in rows if x["real"] == r["real"]}) for r in rows} == {0: 3, 1: 3, 2: 3}
    again = ensembles.DualSpace(samples(spark), nreal=3, near=5, take=2, search=Search()).fit(3).labels.collect()
    assert sorted(rows) == sorted(again)
    final = model.predict(3, method="hier").collect()
    assert {r["cluster"] for r in final} == {1, 2, 3}


def test_semi_supervised_keeps_codes(spark):
    model = ensembles.SemiSupervised(samples(spark), nreal=2, near=6, take=3, search=Search(), code="code")
    model.fit()
    assert {r["cluster"] for r in model.predict(method="hier").collect()} == {0, 1, 2}


def test_subspace_and_stats(spark):
    model = ensembles.RandomSubspace(samples(spark), nreal=3, near=6, search=Search(), metrics=(1, 2, 0), methods=("kmeans", "gmm", "hier")).fit(3)
    assert model.labels.count() == 180 and model.facts.count() == 3
    assert model.compute_stats().count() == 3
    assert model.subensemble(2).select("real").distinct().count() == 2


def test_ward_labels_split_clear_groups():
    x = np.concatenate([np.random.RandomState(0).randn(10, 2) + 20 * c for c in range(3)])
    got = kernels.ward_labels(x, 3)
    assert len(set(got)) == 3 and all(len(set(got[10 * c : 10 * c + 10])) == 1 for c in range(3))


def test_covariance_kernels(spark):
    f = spark.createDataFrame([(0.25,)], "d2 double")
    for kind, want in ((1, 0.3125), (2, 0.223130), (3, 0.472367)):
        assert abs(f.select(C.structure_covariance(kind, F.col("d2"), 1.0)).first()[0] - want) < 1e-6
    with pytest.raises(ValueError):
        C.structure_covariance(4, F.col("d2"), 1.0)


def test_matrix_kernel_equals_columns(spark):
    model = C.Variogram(0.1, (C.Structure(1, 0.5, 8.0), C.Structure(3, 0.4, 5.0, Search(45, 0, 0, 2, 1, 1))))
    s = samples(spark, n=12)
    p = np.array([[r["x"], r["y"]] for r in s.frame.orderBy("id").collect()])
    want = C.covariance_matrix(model, p, p, own_ranges=False)
    for r in kriging.pairwise(s, model).collect():
        assert abs(r["cov"] - (model.total if r["i"] == r["j"] else want[r["i"], r["j"]])) < 1e-9


def test_ordinary_kriging_of_a_constant(spark):
    model = C.Variogram(0.1, (C.Structure(1, 0.9, 8.0),))
    f = frame(spark).withColumn("a", F.lit(7.0))
    got = kriging.estimate(Samples(f, ("x", "y"), ("a",)), "a", model, 8, Search())
    assert all(abs(r["estimate"] - 7) < 1e-8 for r in got.collect())


def test_clusterers(spark):
    f = frame(spark)
    for method in ("kmeans", "gmm", "hier"):
        got = clusterers.cluster(f, ["a", "b", "c"], 3, method, 3)[0]
        base = f.select("id", F.col("code").alias("base"))
        assert labels.adjusted_rand(got.withColumn("real", F.lit(0)), base).first()["ari"] > 0.9
    with pytest.raises(ValueError):
        clusterers.cluster(f, ["a"], 3, "dbscan")


def test_consensus_finds_what_all_share(spark):
    row = [i % 3 for i in range(30)]
    got = consensus.consensus(labelled(spark, row, row, [(c + 1) % 3 for c in row]), 3, method="hier")[0].collect()
    by = {}
    for r in got:
        by.setdefault(r["id"] % 3, set()).add(r["cluster"])
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == 3


def test_samples_are_checked(spark):
    f = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0)], "id long, x double, a double")
    with pytest.raises(ValueError):
        Samples(f, ("x",), ("a",)).check()
    with pytest.raises(ValueError):
        Samples(f, ("q",), ("a",))


def test_geoeas(spark, tmp_path):
    f = frame(spark, n=7)
    path = f"file://{tmp_path}/out"
    geoeas.write_geoeas(f, path, "id", ["x", "a"])
    got = geoeas.read_geoeas(spark, path)
    assert got.columns == ["_row", "x", "a"] and got.count() == 7
    want = [float(f"{r['a']:.8g}") for r in f.orderBy("id").collect()]
    assert [r["a"] for r in got.orderBy("_row").collect()] == want
    assert geoeas.read_geoeas(spark, path, rows=3).count() == 3
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    spark.dataSource.register(geoeas.GeoeasSource)
    assert spark.read.format("geoeas").option("path", str(part)).load().count() == 7


def test_console_program(spark, tmp_path, monkeypatch):
    from stratalode import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main(["dssens"]) == 0
    text = parfiles.read_par("dssensemble.par")
    geoeas.write_geoeas(frame(spark), f"file://{tmp_path}/in", "id", ["x", "y", "a", "b", "c"])
    text = text.replace("datafile.dat", f"file://{tmp_path}/in").replace("outfile.out", f"file://{tmp_path}/out").replace("3  4  5  6 ", "3  4  5    ").replace("100  ", "3    ", 1).replace("25   ", "6    ").replace("10   ", "3    ").replace("4  6", "3  3").replace("spec  ", "hier  ")
    cli.run("dssens", text, spark)
    got = geoeas.read_geoeas(spark, f"file://{tmp_path}/out")
    assert got.columns[1:] == ["x", "y", "a", "b", "c", "dssen_clusters", "dssen_real0", "dssen_real1", "dssen_real2"]
    assert got.count() == 60


def test_registry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_linkages_split_clear_groups():
    x = np.concatenate([np.random.RandomState(0).randn(10, 2) + 20 * c for c in range(3)])
    for method in ("ward", "average", "complete", "single"):
        got = kernels.linkage_labels(x, 3, method)
        assert len(set(got)) == 3 and all(len(set(got[10 * c : 10 * c + 10])) == 1 for c in range(3))


def test_history_of_the_fold(spark):
    base = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, base long")
    row = [i % 2 for i in range(6)]
    got = pairings.cumulative(labelled(spark, row, [0, 0, 1, 1, 0, 1]), base, history=True).collect()
    assert {r["step"] for r in got} == {0, 1, 2}
    for step in (0, 1, 2):
        for i in range(6):
            assert abs(sum(r["u"] for r in got if r["step"] == step and r["id"] == i) - 1) < 1e-12


def test_label_stats(spark):
    s = samples(spark)
    row = metrics.label_stats(s, s.frame.select("id", F.col("code").alias("cluster")), 5, Search()).first()
    assert 0 < row["mv"] < 1 and row["label"] == f"MV: {row['mv']:.2f}\nSP: {row['sp']:.2f}"


def test_geoeas_rows_in_the_order_of_text_and_with_nulls(spark, tmp_path):
    f = spark.createDataFrame([("b", 2.0, None), ("a", 1.0, 0.1), ("c", 1e-9, 123456789.0)], "name string, x double, a double")
    geoeas.write_geoeas(f, f"file://{tmp_path}/out", "name")
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert part.read_text().splitlines() == ["saved data", "2", "x", "a", "1 0.1", "2 nan", "1e-09 1.2345679e+08"]


def test_random_kinds_and_version(spark):
    import stratalode
    from stratalode.functions.covariance import random_kind

    got = spark.range(3000).select(random_kind(7).alias("k")).groupBy("k").count().collect()
    assert {r["k"] for r in got} == {1, 2, 3} and all(850 < r["count"] < 1150 for r in got)
    assert stratalode.version() == stratalode.__version__


def test_holes_of_text_and_null(spark):
    rows = [(i, float(i % 7), float(i // 7), float(i % 5), float(i % 3), None if i % 4 == 0 else f"h{i % 4}") for i in range(60)]
    s = Samples(spark.createDataFrame(rows, "id long, x double, y double, a double, b double, hole string"), ("x", "y"), ("a", "b"))
    found = ensembles.RandomSubspace(s, nreal=2, near=5, holes="hole").fit(2).labels
    assert found.count() == 120
