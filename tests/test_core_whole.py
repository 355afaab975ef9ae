"""Queries over the whole table, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from stratalode.operators import ensembles
from stratalode.plans import fixtures as X
from stratalode.plans import registry


def test_local_getis_of_every_sample(spark, sf_dir):
    rows = X.frame(spark, sf_dir).orderBy("id").toPandas()
    values = rows[list(X.V)].to_numpy()
    places = np.c_[rows[["x", "y"]].to_numpy(), np.zeros(len(rows))] @ np.array(X.ANISO.matrix()).T
    got = registry.QUERIES["local_getis_all"](spark, sf_dir).orderBy("id").toPandas()
    assert got["id"].tolist() == rows["id"].tolist()
    assert (values.sum(1) <= 0.001).sum() > len(rows) / 3
    for i in range(len(rows)):
        near = np.argsort(((places - places[i]) ** 2).sum(1), kind="stable")[:10]
        want = values[near[near != i]].mean(0) / max(1e-10, values[i].sum())
        assert np.allclose(got.iloc[i][[f"a_{v}" for v in X.V]].to_numpy(float), want, rtol=1e-6, atol=1e-9)


def test_krigecluster_of_every_sample_code_and_variable(spark, tmp_path):
    rng = np.random.RandomState(5)
    ids, codes = np.arange(170, 230), np.array([0, 3, 9])[rng.randint(3, size=60)]
    vectors = rng.randn(60, 7)
    vectors[:, 2:6] += codes[:, None] % 4
    rows = [(int(i), list(map(float, e)), int(c)) for i, e, c in zip(ids, vectors, codes, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["real"], r["id"]): r["cluster"] for r in registry.QUERIES["krigecluster"](spark, str(tmp_path)).collect()}

    def cov(a, b):
        h = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) / 0.8
        return 0.9 * np.where(h > 1, 0, 1 - 1.5 * h + 0.5 * h**3)

    places, values, want = vectors[:, :2], vectors[:, 2:6], {}
    for real, seed in enumerate(ensembles.seeds(2, 69069)):
        now = codes.copy()
        for i in np.random.RandomState(seed).permutation(60):
            errors = []
            for c in (0, 3, 9):
                own = np.flatnonzero(now == c)
                own = own[np.argsort(((places[own] - places[i]) ** 2).sum(1))][:8]
                own = own[own != i]
                k = np.ones((len(own) + 1,) * 2)
                k[:-1, :-1] = cov(places[own], places[own])
                np.fill_diagonal(k, 1.0)
                k[-1, -1] = 0
                w = np.linalg.solve(k, np.append(cov(places[own], places[i : i + 1])[:, 0], 1))[:-1] if len(own) > 2 else np.zeros(len(own))
                estimate = w @ values[own]
                errors.append(np.abs((estimate - values[i]) / np.maximum(1e-5, estimate)).mean() if (now == c).any() else np.inf)
            now[i] = (0, 3, 9)[int(np.argmin(errors))]
        want |= {(real, int(i)): int(c) for i, c in zip(ids, now, strict=True)}
    assert got == want


def test_consensus_of_a_hundred_realisations(spark):
    from stratalode.operators import pairings

    rng = np.random.RandomState(2)
    n, reals = 2000, 100
    base = rng.randint(1, 5, n)
    codes = np.where(rng.rand(reals, n) < rng.uniform(0.2, 0.9, (reals, 1)), base, rng.randint(1, 5, (reals, n)))
    rows = pa.table({"real": np.repeat(np.arange(reals), n), "id": np.tile(np.arange(n), reals), "cluster": codes.reshape(-1)})
    labels, frame = spark.createDataFrame(rows.to_pandas()), spark.createDataFrame([(i, int(b)) for i, b in enumerate(base)], "id long, base long")

    def ari(c):
        t = np.zeros((5, 5))
        np.add.at(t, (base, c), 1)
        two = lambda x: (x * (x - 1) / 2).sum()
        chance = two(t.sum(1)) * two(t.sum(0)) / two(np.array([n]))
        return (two(t) - chance) / (0.5 * (two(t.sum(1)) + two(t.sum(0))) - chance)

    u = np.eye(4)[base - 1]
    for z, real in enumerate(sorted(range(reals), key=lambda r: (-ari(codes[r]), -r))):
        means = np.stack([u[codes[real] == c].mean(0) for c in range(1, 5)])
        u = ((z + 1) * u + means[codes[real] - 1]) / (z + 2)
    out = pairings.cumulative(labels, frame)
    assert len(out._jdf.queryExecution().toString()) < 50_000
    got = np.zeros((n, 4))
    for r in out.collect():
        got[r["id"], r["code"] - 1] = r["u"]
    assert np.allclose(got, u, atol=1e-9)


@pytest.mark.parametrize("few", [100_000, 2])
def test_membership_equals_cluster_probability_of_pairs(spark, monkeypatch, few):
    from stratalode.operators import pairings

    monkeypatch.setattr(pairings, "FEW", few)
    rng = np.random.RandomState(4)
    labels = spark.createDataFrame([(r, i, int(c)) for r in range(7) for i, c in enumerate(rng.randint(1, 4, 60))], "real int, id long, cluster long")
    clusters = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.randint(1, 4, 60))], "id long, cluster long")
    weights = spark.createDataFrame([(r, float(w)) for r, w in enumerate(rng.rand(7))], "real int, w double")
    for w in (None, weights):
        want = {(r["id"], r["cluster"]): r["p"] for r in pairings.cluster_probability(pairings.pairings(labels, w), clusters).collect()}
        got = {(r["id"], r["cluster"]): r["p"] for r in pairings.membership(labels, clusters, w).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def brute_knn(q, p, ids, k):
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    return [sorted(zip(row, ids, strict=True))[:k] for row in d2]


def test_grid_neighbours_of_clusters_outliers_copies_and_small_groups(spark, monkeypatch):
    from stratalode.operators import neighbors

    rng = np.random.RandomState(6)
    p = np.concatenate([rng.randn(1500, 2) * 1e-3, rng.randn(700, 2) * 1e-2 + 3, rng.uniform(-1e4, 1e4, (20, 2)), np.zeros((80, 2)), rng.randn(2, 2)])
    group = np.concatenate([rng.randint(0, 2, 2300), [7, 7]])
    points = spark.createDataFrame([(i, float(x), float(y), int(g)) for i, ((x, y), g) in enumerate(zip(p, group, strict=True))], "id long, r0 double, r1 double, grp long")
    for most in (50, 4096):
        monkeypatch.setattr(neighbors, "OPEN_QUERIES", most)
        got = {}
        for r in neighbors.grid_knn(points.drop("grp"), points.drop("grp"), 4, 2).collect():
            got.setdefault(r["i"], []).append((r["rk"], r["j"]))
        want = brute_knn(p, p, range(len(p)), 4)
        assert all([j for _, j in sorted(got[i])] == [j for _, j in want[i]] for i in range(len(p)))
        got = {}
        for r in neighbors.grid_knn(points.drop("grp"), points, 4, 2, by_group=True, reach=5.0).collect():
            got.setdefault((r["i"], r["grp"]), []).append((r["rk"], r["j"]))
        for g in (0, 1, 7):
            own = np.flatnonzero(group == g)
            for i, row in enumerate(brute_knn(p, p[own], own.tolist(), 4)):
                assert [j for _, j in sorted(got.get((i, g), []))] == [j for d, j in row if d <= 25]


def table(spark, sf_dir):
    return X.frame(spark, sf_dir).orderBy("id").toPandas()


def same_parts(a, b):
    """Whether two labellings cut the samples alike, whatever the labels."""
    pairs = set(zip(a, b, strict=True))
    return len(pairs) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("ordinary", [True, False])
def test_kriging_estimates_of_every_sample(spark, sf_dir, ordinary):
    rows = table(spark, sf_dir)
    places, values = rows[["x", "y"]].to_numpy(), rows["v1"].to_numpy()
    turn, total = np.array(X.ANISO.matrix())[:, :2], 1.0

    def cov(a, b, reach):
        d2 = [((a[:, None] - b[None]) ** 2).sum(2), (((a[:, None] - b[None]) @ turn.T) ** 2).sum(2)]
        h = np.sqrt(d2[0]) / 0.8
        parts = [np.where(h > 1, 0, 1 - 1.5 * h + 0.5 * h**3), np.exp(-3 * np.sqrt(d2[1]) / reach)]
        return sum(sill * np.where(d < 1e-9, total, p) for sill, d, p in zip((0.5, 0.4), d2, parts, strict=True))

    got = registry.QUERIES["ok_estimate" if ordinary else "sk_estimate"](spark, sf_dir).orderBy("id").toPandas()
    assert got["id"].tolist() == rows["id"].tolist()
    for i in range(len(rows)):
        near = np.argsort(((places - places[i]) ** 2).sum(1), kind="stable")[:10]
        near = near[near != i]
        k, r = cov(places[near], places[near], 0.8), cov(places[near], places[i : i + 1], 0.3)[:, 0]
        np.fill_diagonal(k, total)
        if ordinary:
            one = np.ones((len(near), 1))
            k, r = np.block([[k, one], [one.T, np.zeros((1, 1))]]), np.append(r, 1)
        assert abs(np.linalg.solve(k, r)[: len(near)] @ values[near] - got["estimate"][i]) < 1e-6


def naive_ward(x, k):
    """Agglomeration by the least growth of the summed squares, over all pairs at each step."""
    parts = [[i] for i in range(len(x))]
    size, mean = np.ones(len(x)), x.astype(float).copy()
    cost = 0.5 * ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(x) - k):
        a, b = divmod(int(cost.argmin()), len(x))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a], parts[a], parts[b] = size[a] + size[b], parts[a] + parts[b], None
        cost[b], cost[:, b] = np.inf, np.inf
        alive = np.array([p is not None for p in parts])
        alive[a] = False
        cost[a, alive] = cost[alive, a] = size[a] * size[alive] / (size[a] + size[alive]) * ((mean[alive] - mean[a]) ** 2).sum(1)
    out = np.zeros(len(x), int)
    for n, p in enumerate(p for p in parts if p):
        out[p] = n
    return out


def test_ward_of_every_sample(spark, sf_dir):
    rows = table(spark, sf_dir)
    got = registry.QUERIES["ward"](spark, sf_dir).orderBy("id").toPandas()
    assert got["id"].tolist() == rows["id"].tolist() and sorted(set(got["cluster"])) == [1, 2, 3, 4]
    assert same_parts(got["cluster"], naive_ward(rows[list(X.V)].to_numpy(), 4))


def test_consensus_of_every_sample(spark, sf_dir):
    from stratalode.operators import consensus

    labels = X.labels(spark, sf_dir).orderBy("real", "id").toPandas()
    codes = labels["cluster"].to_numpy().reshape(4, -1)
    matrix = (codes[:, :, None] == codes[:, None, :]).mean(0)
    final = consensus.consensus(X.labels(spark, sf_dir), 4, method="hier")[0].orderBy("id").toPandas()["cluster"].to_numpy()

    def cost(part):
        return sum(((matrix[part == c] - matrix[part == c].mean(0)) ** 2).sum() for c in set(part))

    # rows that tie may merge in another order, so costs are compared, not parts
    assert len(set(final)) == 4 and abs(cost(final) / cost(naive_ward(matrix, 4)) - 1) < 0.02
    for method in ("hier", "spec"):
        with pytest.raises(ValueError, match="use power"):
            consensus.consensus(X.labels(spark, sf_dir), 4, method=method, exact=100)


def test_scaling_of_every_sample(spark, sf_dir):
    rows = table(spark, sf_dir)
    x = rows[list(X.V)].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    got = registry.QUERIES["mds_embed"](spark, sf_dir).orderBy("id").toPandas()
    assert got["id"].tolist() == rows["id"].tolist()
    for n in (1, 2):
        want, e = x @ vectors[:, -n], got[f"e{n}"].to_numpy()
        assert min(np.abs(e - want).max(), np.abs(e + want).max()) < 1e-6


def test_kmeans_of_every_sample(spark, sf_dir):
    rows = table(spark, sf_dir)
    x = rows[list(X.V)].to_numpy()
    got = registry.QUERIES["kmeans"](spark, sf_dir).orderBy("id").toPandas()
    part = got["cluster"].to_numpy()
    assert got["id"].tolist() == rows["id"].tolist() and set(part) == {0, 1, 2, 3}

    def settle(part):
        for _ in range(300):
            means = np.stack([x[part == c].mean(0) if (part == c).any() else x[0] for c in range(4)])
            part = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        return part, ((x - means[part]) ** 2).sum()

    means = np.stack([x[part == c].mean(0) for c in range(4)])
    cost = ((x - means[part]) ** 2).sum()
    assert (((x[:, None] - means[None]) ** 2).sum(2).argmin(1) == part).mean() > 0.95
    rng = np.random.RandomState(1)
    starts = [settle(((x[:, None] - x[rng.choice(len(x), 4, False)][None]) ** 2).sum(2).argmin(1))[1] for _ in range(10)]
    assert cost < 1.05 * np.median(starts)


def test_metrics_of_every_realisation(spark, sf_dir):
    from stratalode.operators import metrics

    rows, labels = table(spark, sf_dir), X.labels(spark, sf_dir)
    places, values = rows[["x", "y"]].to_numpy(), rows[list(X.V)].to_numpy()
    near = ((places[:, None] - places[None]) ** 2).sum(2).argsort(1, kind="stable")[:, :10]
    both = [f.orderBy("real", "id").toPandas()["cluster"].to_numpy().reshape(4, -1) for f in (labels, metrics.permuted(labels, 69069))]
    assert (np.sort(both[0], 1) == np.sort(both[1], 1)).all() and (both[0] != both[1]).any()

    def entropy(part):
        p = np.stack([(part[near] == c).mean(1) for c in sorted(set(part))])
        return -(p * np.log(np.where(p > 0, p, 1))).sum()

    def wcss(part):
        return sum(((values[part == c] - values[part == c].mean(0)) ** 2).sum() for c in set(part))

    got = metrics.cluster_metrics(X.samples(spark, sf_dir), labels, 10, X.PLAIN, "wcss").orderBy("real").collect()
    assert len(got) == 4
    for r, part, other in zip(got, *both, strict=True):
        assert abs(r["sp"] - entropy(part) / entropy(other)) < 1e-9 and abs(r["mv"] - wcss(part) / wcss(other)) < 1e-9


def by_hash(rows, seed):
    from pyspark.sql import functions as F

    return rows.select("real", "id", "cluster", F.xxhash64("id", "real", F.lit(seed)).alias("h"))


def test_permuted_labels_by_a_plain_sort(spark):
    from stratalode.operators import metrics

    labels = spark.range(3000).selectExpr("id % 3 as real", "id * 7 % 1000 as id", "id % 11 as cluster")
    rows = by_hash(labels, 5).toPandas()
    want = {}
    for real, part in rows.groupby("real"):
        want |= {(real, i): c for i, c in zip(sorted(part["id"]), part.sort_values(["h", "id"])["cluster"], strict=True)}
    assert {(r["real"], r["id"]): r["cluster"] for r in metrics.permuted(labels, 5).collect()} == want and len(want) == 3000


def test_kernel_sums_in_blocks_equal_one_pass(spark):
    from stratalode.operators import moments

    rng = np.random.RandomState(2)
    x, of = rng.randn(90, 2), rng.randint(0, 3, 90)
    points = spark.createDataFrame([(i, int(g), *map(float, p)) for i, (g, p) in enumerate(zip(of, x, strict=True))], "id long, of long, a double, b double")
    sums = {0: np.array([1.0, 2.0]), 1: np.array([0.5, 0.1]), 2: np.array([3.0, 0.2])}
    for block in (1000, 40):
        got = moments.kernel_sums(points, points, ("a", "b"), sums, block=block).collect()
        assert len(got) == 270
        for r in got:
            gap = (x[r["id"]] - x[of == r["of"]]) ** 2
            assert abs(r["total"] - np.exp(-(gap @ sums[r["of"]])).sum()) < 1e-9


def test_kriging_path_with_a_search_for_each_category(spark):
    from stratalode.frames import Samples
    from stratalode.functions.covariance import SPHERICAL, Structure, Variogram
    from stratalode.functions.geometry import Search

    rng = np.random.RandomState(8)
    codes, xy, v = rng.randint(0, 2, 50), rng.rand(50, 2) * 4, rng.randn(50, 2)
    v[codes == 1] += 1.5
    rows = [(i, *map(float, (*p, *u)), int(c)) for i, (p, u, c) in enumerate(zip(xy, v, codes, strict=True))]
    samples = Samples(spark.createDataFrame(rows, "id long, x double, y double, v double, w double, domaincode long"), ("x", "y"), ("v", "w"))
    models = {(c, n): Variogram(0.2, (Structure(SPHERICAL, 0.8, 3.0),)) for c in (0, 1) for n in (0, 1)}
    searches = {0: Search(30, 0, 0, 2, 1, 1), 1: Search(120, 0, 0, 3, 1.5, 1)}
    model = ensembles.KrigingPath(samples, nreal=2, models=models, most_near=7, path_search=searches)
    got = {(r["real"], r["id"]): r["cluster"] for r in model.fit().labels.collect()}

    def cov(a, b):
        h = np.minimum(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) / 3.0, 1)
        return 0.8 * (1 - 1.5 * h + 0.5 * h**3)

    spaces = {c: (xy @ np.array(s.matrix())[:, :2].T)[:, :2] for c, s in searches.items()}
    want = {}
    for real, seed in enumerate(ensembles.seeds(2, 69069)):
        now = codes.copy()
        for i in np.random.RandomState(seed).permutation(50):
            errors = []
            for c, p in spaces.items():
                gap = np.sqrt(((p - p[i]) ** 2).sum(1))
                own = [j for j in sorted(np.flatnonzero(now == c), key=lambda j: gap[j])[:7] if gap[j] < searches[c].r1 and j != i]
                estimate = np.zeros(2)
                if len(own) > 2:
                    k = np.ones((len(own) + 1,) * 2)
                    k[:-1, :-1] = cov(p[own], p[own])
                    np.fill_diagonal(k, 1.0)
                    k[-1, -1] = 0
                    estimate = np.linalg.solve(k, np.append(cov(p[own], p[i : i + 1])[:, 0], 1))[:-1] @ v[own]
                errors.append(np.abs((estimate - v[i]) / np.maximum(1e-5, estimate)).mean() if (now == c).any() else np.inf)
            now[i] = int(np.argmin(errors))
        want |= {(real, i): int(c) for i, c in enumerate(now)}
    assert got == want
    with pytest.raises(ValueError, match="no search"):
        ensembles.KrigingPath(samples, nreal=1, models=models, path_search={0: searches[0]}).fit()


def plain_ward(a, b):
    middle = (a.mean(0) - b.mean(0)) / 2
    q = (len(a) + len(b)) * (middle**2).sum()
    return q / max(sum(((x - x.mean(0)) ** 2).sum() for x in (a, b)) + q, 1e-6)


def plain_ward_mahalanobis(a, b, ridge):
    q = within = 0.0
    for x in (a, b):
        sums = np.linalg.inv(np.cov(x.T, bias=True) + ridge * np.eye(x.shape[1])).sum(1)
        q += len(x) * (sums * ((a.mean(0) - b.mean(0)) / 2) ** 2).sum()
        within += (sums * ((x - x.mean(0)) ** 2).sum(0)).sum()
    return q / (within + q)


def scaled_and_near(spark, sf_dir, k=10):
    """Standardised variables, and each sample's k nearest others, the most alike first."""
    rows = table(spark, sf_dir)
    x = rows[list(X.V)].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    places, near = rows[["x", "y"]].to_numpy(), []
    for i in range(len(rows)):
        own = [j for j in np.argsort(((places - places[i]) ** 2).sum(1), kind="stable") if j != i][:k]
        near.append(sorted(own, key=lambda j: ((x[j] - x[i]) ** 2).sum()))
    return rows, x, near


def merge_once(rng, parts, x, k, distance):
    """The codes of a random part and of the one, among the k of nearest centre, that is least distant."""
    codes = list(parts)
    one = codes[rng.randint(0, len(codes))]
    centre = {c: x[parts[c]].mean(0) for c in codes}
    around = sorted((c for c in codes if c != one), key=lambda c: ((centre[c] - centre[one]) ** 2).sum())[:k]
    return one, min(around, key=lambda c: distance(x[parts[one]], x[parts[c]]))


def numbered(parts, n, names):
    out = np.empty(n, int)
    for name, part in zip(names, parts, strict=True):
        out[part] = name
    return out


def test_dual_space_search_of_every_sample(spark, sf_dir):
    rows, x, near = scaled_and_near(spark, sf_dir)
    n = len(rows)

    def distance(a, b):
        return plain_ward_mahalanobis(a, b, 1e-3) if min(len(a), len(b)) > 25 else plain_ward(a, b)

    def realisation(seed):
        rng = np.random.RandomState(seed)
        while True:
            home, count = {}, 0
            for i in rng.permutation(n):
                for j in near[i][:5]:
                    if i not in home and j not in home:
                        home[i] = home[j] = count
                        count += 1
                    else:
                        home.setdefault(i, home.get(j))
                        home.setdefault(j, home.get(i))
            parts = {c: [i for i in range(n) if home.get(i, 0) == c] for c in range(count)}
            while len(parts) > 6:
                one, two = merge_once(rng, parts, x, 10, distance)
                fresh = max(parts) + 1
                parts[fresh] = parts.pop(one) + parts.pop(two)
            if all(0.001 < len(p) / n < 0.999 for p in parts.values()):
                return numbered(parts.values(), n, range(6))

    got = registry.QUERIES["dssensemble"](spark, sf_dir).orderBy("real", "id").toPandas()["cluster"].to_numpy().reshape(8, n)
    for labels, seed in zip(got, ensembles.seeds(8, 69069), strict=True):
        assert (labels == realisation(seed)).all()


def test_semi_supervised_search_of_every_sample(spark, sf_dir):
    rows, x, near = scaled_and_near(spark, sf_dir)
    n, names = len(rows), sorted(set(rows["domaincode"]))
    codes, k = np.searchsorted(names, rows["domaincode"]), len(names)
    enough = -(-n // 4)

    def distance(a, b):
        return plain_ward(a, b) if min(len(a), len(b)) < 50 else plain_ward_mahalanobis(a, b, 1e-4)

    def realisation(seed):
        rng = np.random.RandomState(seed)
        while True:
            order = rng.permutation(n)
            home, fresh = {int(order[c]): c for c in range(k)}, k + 1
            for i in order.tolist():
                taken = 0
                for j in map(int, near[i]):
                    early = len(home) < enough
                    if not (i in home and j in home) and not (early and codes[i] != codes[j]):
                        if early:
                            code = int(codes[i])
                        elif i in home or j in home:
                            code = home.get(i, home.get(j))
                        else:
                            code, fresh = fresh, fresh + 1
                        home[i] = home[j] = code
                        taken += 1
                    taken += 1
                    if taken >= 5:
                        break
            mini = np.array([home.get(i, 0) for i in range(n)])
            parts = {c: np.flatnonzero(mini == c).tolist() for c in sorted(set(mini.tolist()))}
            while len(parts) > k:
                one, two = merge_once(rng, parts, x, 10, distance)
                if one < k and two < k:
                    continue
                name = min(one, two) if min(one, two) < k else max(parts) + 1
                both = parts.pop(one) + parts.pop(two)
                parts[name] = both
            if all(0.001 < len(p) / n < 0.999 for p in parts.values()):
                return numbered(parts.values(), n, parts), mini

    model = ensembles.SemiSupervised(X.samples(spark, sf_dir), nreal=2, near=10, search=X.PLAIN).fit()
    both = [f.orderBy("real", "id").toPandas()["cluster"].to_numpy().reshape(2, n) for f in (model.labels, model.mini)]
    for labels, mini, seed in zip(*both, ensembles.seeds(2, 69069), strict=True):
        want = realisation(seed)
        assert (labels == want[0]).all() and (mini == want[1]).all()


def test_accluster_is_a_settled_k_means_of_normal_scores(spark, sf_dir):
    from statistics import NormalDist

    rows = table(spark, sf_dir)
    n, places, values = len(rows), rows[["x", "y"]].to_numpy(), rows[list(X.V)].to_numpy()
    near = ((places[:, None] - places[None]) ** 2).sum(2).argsort(1, kind="stable")[:, :10]
    getis = np.stack([values[[j for j in near[i] if j != i]].mean(0) / max(1e-10, values[i].sum()) for i in range(n)])
    scores = np.empty_like(getis)
    for v in range(4):
        scores[np.argsort(getis[:, v], kind="stable"), v] = [NormalDist().inv_cdf((r + 0.5) / n) for r in range(n)]
    got = registry.QUERIES["accluster"](spark, sf_dir).orderBy("id").toPandas()
    part = got["cluster"].to_numpy()
    assert got["id"].tolist() == rows["id"].tolist() and set(part) == {0, 1, 2, 3}
    means = np.stack([scores[part == c].mean(0) for c in range(4)])
    assert (((scores[:, None] - means[None]) ** 2).sum(2).argmin(1) == part).mean() > 0.95


def test_elbow_falls_to_settled_costs(spark, sf_dir):
    x = table(spark, sf_dir)[list(X.V)].to_numpy()
    got = {r["k"]: r["wcss"] for r in registry.QUERIES["elbow"](spark, sf_dir).collect()}
    assert sorted(got) == [2, 3, 4, 5]
    whole, rng = ((x - x.mean(0)) ** 2).sum(), np.random.RandomState(3)
    for k, cost in got.items():
        costs = []
        for _ in range(10):
            means = x[rng.choice(len(x), k, False)]
            for _ in range(100):
                part = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
                means = np.stack([x[part == c].mean(0) if (part == c).any() else means[c] for c in range(k)])
            costs.append(((x - means[part]) ** 2).sum())
        assert 0.98 * min(costs) <= cost <= 1.05 * max(costs) < whole


def test_forest_predicts_most_of_the_held_out_samples(spark, sf_dir):
    rows = X.clustered(spark, sf_dir).where("dh >= 20").select("id", "cluster").orderBy("id").toPandas()
    got = registry.QUERIES["rf_predict"](spark, sf_dir).orderBy("id").toPandas()
    assert got["id"].tolist() == rows["id"].tolist() and (got["cluster"] == rows["cluster"]).mean() > 0.7


@pytest.mark.parametrize(("name", "reals", "codes"), [("gmm", 1, {0, 1, 2}), ("spectral_pic", 1, {0, 1, 2, 3}), ("acensemble", 8, None)])
def test_every_sample_is_in_one_cluster(spark, sf_dir, name, reals, codes):
    ids = table(spark, sf_dir)["id"].tolist()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got["id"]) == sorted(ids * reals) and not got["cluster"].isna().any()
    if codes is None:
        assert got.groupby("real")["id"].nunique().eq(len(ids)).all() and got.groupby("real")["cluster"].nunique().between(2, 4).all()
    else:
        assert set(got["cluster"] - got["cluster"].min()) <= codes
