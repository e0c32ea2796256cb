"""Golden values and invariants of the fairness operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand import FairFrame
from evenhand.functions.ranks import first_by, indexed, last_ranks, ranked
from evenhand.operators import lp, masking, metrics, neighbors, optmap, oversample, prototypes, relabel, repair, rules, weights
from evenhand.operators.linear import Logistic
from evenhand.plans.pipeline import FairPipeline, TrainOnly, cross_validate, results_pivot

AGE = {0: [25, 28, 30, 33, 35, 40, 45, 50, 55, 60], 1: [22, 27, 32, 37, 38, 42, 43, 47, 52, 57]}


@pytest.fixture(scope="module")
def simple(spark):
    """n(group, label): 7, 3, 3, 7."""
    rows = [(g * 10 + i, AGE[g][i], 1000.0 * (g * 10 + i), g, int(i >= 7) if g == 0 else int(i >= 3)) for g in (0, 1) for i in range(10)]
    return FairFrame(spark.createDataFrame(rows, "id long, age int, income double, g int, y int").cache(), "g", "y", key="id")


@pytest.fixture(scope="module")
def skewed(spark):
    """Unbalanced labels, three groups as strings, duplicates and other column types."""
    sizes = {("a", 0): 12, ("a", 1): 3, ("b", 0): 8, ("b", 1): 7, ("c", 0): 4, ("c", 1): 2}
    rows, k = [], 0
    for (g, y), n in sizes.items():
        for i in range(n):
            rows.append((k, float(i // 2 * 3 + y), i + y, ["u", "v"][i % 2], bool(i % 3), g, y))
            k += 1
    return FairFrame(spark.createDataFrame(rows, "id long, x double, n int, cat string, flag boolean, g string, y int").cache(), "g", "y", key="id", priv="a")


def vectors(spark, y, p, s):
    return spark.createDataFrame(list(zip(y, p, s, strict=True)), "y int, p int, s int")


def test_metrics(spark):
    df = vectors(spark, [1, 1, 0, 0, 1, 1, 0, 0], [1, 0, 0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 1, 1, 1, 1])
    m = lambda n: metrics.metric(n, df, "y", "p", "s")
    assert m("accuracy") == 0.75 and m("true_positive_rate") == 0.75 and m("false_positive_rate") == 0.25
    assert m("balanced_accuracy") == 0.75 and m("true_negative_rate") == 0.75 and m("false_negative_rate") == 0.25
    assert m("disparate_impact") == pytest.approx(1 / 3) and m("statistical_parity_difference") == -0.5
    assert m("equal_opportunity_difference") == -0.5 and m("average_odds_difference") == -0.5 and m("true_negative_rate_difference") == 0.5


def test_metric_edges(spark):
    none = vectors(spark, [0, 0], [0, 0], [0, 1])
    with pytest.warns(RuntimeWarning):
        assert metrics.metric("true_positive_rate", none, "y", "p") == 0
    assert metrics.metric("disparate_impact", none, "y", "p", "s") == 1
    assert metrics.metric("disparate_impact", vectors(spark, [0, 0], [1, 0], [0, 1]), "y", "p", "s") == float("inf")
    assert metrics.metric("accuracy", none.limit(0), "y", "p") == 0
    with pytest.raises(ValueError, match="privileged"):
        metrics.metric("disparate_impact", none.where("s = 0"), "y", "p", "s")
    with pytest.raises(ValueError, match="0 or 1"):
        metrics.metric("accuracy", vectors(spark, [2], [1], [1]), "y", "p")
    assert metrics.fairness_report(FairFrame(none, "s", "y", "p"), by=["s"]).count() == 2


def test_weights(simple):
    w = {(r["g"], r["y"]): r["weight"] for r in weights.reweigh(simple).collect()}
    assert w[0, 1] == pytest.approx(5 / 3) and w[0, 0] == pytest.approx(5 / 7)
    b = {(r["g"], r["y"]): r["weight"] for r in weights.fair_balance(simple).collect()}
    assert b[0, 1] == pytest.approx(10 / 3) and b[1, 1] == pytest.approx(10 / 7)
    v = weights.fair_balance(simple, variant=True)
    assert v.agg(F.sum("weight")).first()[0] == pytest.approx(20)
    with pytest.raises(ValueError, match="two values"):
        weights.reweigh(simple.with_df(simple.df.withColumn("y", F.lit(1))))
    with pytest.raises(ValueError, match="no nulls"):
        weights.reweigh(simple.with_df(simple.df.withColumn("g", F.when(F.col("id") > 1, F.col("g")))))


def test_empty_cells_weigh_nothing(spark):
    ff = FairFrame(spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "s int, y int"), "s", "y")
    assert {(r["s"], r["c"]): r["weight"] for r in weights.reweighing_table(ff).collect()}[0, 1] == 0


def test_massaging(simple):
    out = relabel.massage(simple, F.col("age")).collect()
    flips = sorted((r["id"], r["y"]) for r in out if r["flipped"])
    assert flips == [(5, 1), (6, 1), (13, 0), (14, 0)] and len(out) == 20
    back = FairFrame(simple.df, "g", "y", key="id", priv=0)
    assert not any(r["flipped"] for r in relabel.massage(back, F.col("age")).collect())


def test_ranks(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(0, 3)), float(r.integers(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    got = ranked(df, ["g"], "v", "id", ascending=False).collect()
    for g in range(3):
        order = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        assert [x["id"] for x in sorted((x for x in got if x["g"] == g), key=lambda x: x["_rank"])] == [x[0] for x in order]
    for x in last_ranks(df, ["g"], "v").collect():
        assert x["_last"] == sum(y[1] == x["g"] and y[2] <= x["v"] for y in rows) - 1
    assert sorted(x["idx"] for x in indexed(df, ["g"], "id").where("g = 1").collect()) == list(range(sum(x[1] == 1 for x in rows)))
    assert [x["id"] for x in first_by(df, 7, F.col("v"), "id").orderBy("v", "id").collect()] == [x[0] for x in sorted(rows, key=lambda x: (x[2], x[0]))[:7]]


def test_repair(simple):
    want = [23.5, 27.5, 31, 35, 36.5, 41, 44, 48.5, 53.5, 58.5]
    out = repair.QuantileRepair("g", ["age"], "id").fit_transform(simple.df).orderBy("id").collect()
    assert [r["age"] for r in out] == want + want
    model = repair.QuantileRepair("g", ["age"], "id").fit(simple.df)
    new = simple.df.limit(2).withColumn("age", F.lit(1000)).withColumn("g", F.when(F.col("id") == 0, 0).otherwise(7))
    assert sorted(r["age"] for r in model.transform(new).collect()) == [58.5, 1000.0]
    assert repair.QuantileRepair("g", ["age"], "id", 0).fit_transform(simple.df).collect() == simple.df.collect()
    with pytest.raises(ValueError, match="between"):
        repair.QuantileRepair("g", ["age"], "id", 2)


def test_rules(spark):
    t = spark.createDataFrame([(1, 1, 30.0), (0, 1, 45.0), (1, 0, None), (0, 0, float("nan")), (1, 0, 65.0)], "sex int, race int, age double")
    flag = lambda r: [x["is_privileged"] for x in rules.privilege_flag(t, r).collect()]
    assert flag({"age": {">=": 45}}) == [0, 1, 0, 0, 1]
    assert flag({"age": {"!=": 45.0}}) == [1, 0, 1, 1, 1]
    assert flag([{"sex": 1, "race": 1}, {"age": {">": 60}}]) == [1, 0, 0, 0, 1]
    assert flag({}) == [1] * 5 and flag([]) == [0] * 5 and flag({"race": [1, 7]}) == [1, 1, 0, 0, 0]
    with pytest.raises(ValueError, match="no comparison"):
        flag({"age": {"~": 1}})
    with pytest.raises(ValueError, match="one comparison"):
        flag({"age": {">": 1, "<": 2}})
    with pytest.raises(KeyError):
        flag({"no": 1})
    with pytest.raises(ValueError, match="no such column"):
        rules.drop_columns(t, "no")


def test_neighbours_meet_numpy(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    x = np.random.default_rng(2).integers(0, 6, (70, 2)).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {(r["key"], r["rank"]): r["nn_key"] for r in neighbors.knn(df, "id", ["a", "b"], 4).collect()}
    for i in range(70):
        order = sorted((j for j in range(70) if j != i), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))
        assert [got[i, r] for r in range(1, 5)] == order[:4]


@pytest.mark.parametrize(("method", "count"), [("de", 36), ("side_smote", 12), ("hetero", 36)])
def test_oversampling(skewed, method, count):
    out = oversample.oversample(skewed, method)
    rows = out.df.collect()
    assert sum(r["is_synthetic"] for r in rows) == count and len(rows) == 36 + count
    assert not any(r[c] is None for r in rows for c in ("x", "n", "cat", "flag", "g", "y"))
    same = oversample.oversample(skewed.with_df(skewed.df.repartition(5)), method).synthetic
    key = ["cell", "j", "x", "n", "cat", "flag", "g", "y"]
    assert sorted(map(tuple, same.select(*key).collect())) == sorted(map(tuple, out.synthetic.select(*key).collect()))
    if method != "side_smote":
        assert {n for _, n in ((r[0], r[1]) for r in out.df.groupBy(F.concat("y", "g")).count().collect())} == {12}


def test_typology_need(simple):
    assert oversample.typology_need(simple) == 13
    assert oversample.oversample(simple, "typology").df.count() == 33


def test_logistic_meets_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1, 50]
    y = (x[:, 0] + x[:, 1] / 50 + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    m = Logistic(["a", "b"], "y").fit(df)
    z, beta = np.c_[x, np.ones(200)], np.zeros(3)
    pen = np.diag([1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z.T * (p * (1 - p))) @ z + pen, z.T @ (y - p) - pen @ beta)
    assert np.allclose(m.coef, beta, atol=1e-6)


def test_lp_and_mapping(spark):
    x = lp.solve(np.array([1.0, 2.0, 0.0]), np.array([[1.0, 1.0, 1.0]]), np.array([1.0]), np.array([[0.0, 0.0, 1.0]]), np.array([0.25]))
    assert np.allclose(x, [0.75, 0, 0.25], atol=1e-6)
    rows = [(i, ["young", "old"][i % 2], i // 20, int(i % 20 < (7 if i < 20 else 13))) for i in range(40)]
    ff = FairFrame(spark.createDataFrame(rows, "id long, age string, g int, y int"), "g", "y", key="id")
    cost = lambda o, n: float(o["age"] != n["age"]) + (o["y"] != n["y"])
    m = optmap.RandomizedMap(["age"], cost, levels=[1.99], chances=[0.1]).fit(ff)
    q = m.mapping.collect()
    joint = {(r["g"], r["age"], r["y"]): r["p"] for r in optmap.joint_distribution(ff, ["age"]).collect()}
    rate = {g: sum(joint[g, r["age"], r["y"]] * r["p"] for r in q if r["g"] == g and r["new_y"] == 1) / 0.5 for g in (0, 1)}
    assert abs(rate[0] - rate[1]) <= 0.05 + 1e-6
    for cell in joint:
        mine = [r for r in q if (r["g"], r["age"], r["y"]) == cell]
        assert sum(r["p"] for r in mine) == pytest.approx(1)
        assert sum(r["p"] for r in mine if joint[cell] and r["new_age"] != cell[1] and r["new_y"] != cell[2]) <= 0.1 + 1e-6
    out = m.apply(ff.df, "id", seed=1)
    assert out.count() == 40 and out.select("id", "g").exceptAll(ff.df.select("id", "g")).count() == 0
    with pytest.raises(TypeError):
        optmap.RandomizedMap(["age"], None)
    with pytest.raises(ValueError, match="length"):
        optmap.RandomizedMap(["age"], cost, levels=[1])


def test_prototype_gradient_and_fit(spark):
    rng = np.random.default_rng(5)
    x, a, y = rng.normal(size=(40, 2)), rng.random(40) < 0.5, (rng.random(40) < 0.5).astype(float)
    k, coef = 3, (0.01, 1.0, 50.0)

    def f(t):
        v, w = t[:6].reshape(3, 2), t[6:]
        s = prototypes.mean_sums(x, a, v)
        gap = s[:k] / s[-2] - s[k : 2 * k] / s[-1]
        g = prototypes.loss_sums(x, a, y, v, w, coef, (s[-2], s[-1]), np.sign(gap))
        return g[0] + coef[2] * np.abs(gap).mean(), g[1:]

    t = rng.random(9)
    num = [(f(t + e)[0] - f(t - e)[0]) / 2e-6 for e in np.eye(9) * 1e-6]
    assert np.allclose(f(t)[1], num, rtol=1e-4, atol=1e-5)
    df = spark.createDataFrame([(i, float(p), float(q), int(b), int(c)) for i, ((p, q), b, c) in enumerate(zip(x, a, y, strict=True))], "id long, p double, q double, g int, y int")
    m = prototypes.PrototypeRepresentation(k=2, steps=3).fit(FairFrame(df, "g", "y", key="id"))
    assert m.losses[-1] <= m.losses[0] and ((m.weights >= 0) & (m.weights <= 1)).all()
    out = m.transform(df)
    mm, _ = prototypes.assignments(x, m.prototypes)
    assert np.allclose([[r["p"], r["q"]] for r in out.orderBy("id").collect()], mm @ m.prototypes)


def test_masking(simple):
    m = masking.MaskedClassifier("id", budget=2).fit(simple)
    assert sum(m.weights) == pytest.approx(1) and len(m.members) == 2
    out = m.transform(simple.df)
    assert out.count() == 20 and {r["prediction"] for r in out.collect()} <= {0, 1}
    vote = simple.df.select(masking.weighted_vote([F.lit(1), F.lit(0)], [0.5, 0.5], [0, 1]).alias("v")).first()[0]
    assert vote == 0


def test_pipeline_and_folds(simple):
    def make():
        ff = lambda df: simple.with_df(df)
        return FairPipeline([TrainOnly(lambda df: weights.reweigh(ff(df))), Logistic(["age", "g"], "y", weight="weight")])

    out = cross_validate(simple, make, k=2)
    assert out.count() == 7
    assert "abs_spd" in results_pivot(out).columns


def test_disagreements(simple):
    kept = relabel.drop_disagreements(simple, (F.col("age") > 30, F.col("age") > 40))
    assert kept.where("age > 30 AND age <= 40").count() == 0 and kept.count() == 20 - 6
    assert relabel.drop_disagreements(simple).count() <= 20


def test_a_fit_that_has_not_converged_says_so(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 2, int(i % 3 > 0)) for i in range(60)], "k long, x1 double, x2 double, a int, y int")
    with pytest.warns(UserWarning, match="converged"):
        prototypes.PrototypeRepresentation(k=2, steps=1).fit(FairFrame(df, "a", "y", key="k"))


def test_numbered_rows_come_in_chunks(spark, monkeypatch):
    from evenhand.functions import ranks

    monkeypatch.setattr(ranks, "CHUNK", 4)
    t = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 4), ("e", 1)], "_chunk string, n long")
    got = sorted((r["_chunk"], r["j"]) for r in ranks.numbered(t, F.col("n"), "j", first=1).collect())
    assert got == sorted([("a", i) for i in range(1, 11)] + [("d", i) for i in range(1, 5)] + [("e", 1)])


def test_ranks_with_many_bins_and_clashing_names(spark, monkeypatch):
    from evenhand.functions import ranks

    monkeypatch.setattr(ranks, "WIDTH", 3)
    rows = [(i, (i * 37 % 50) / 50, i % 2, "x", "y", "z") for i in range(50)]
    t = spark.createDataFrame(rows, "k int, v double, g int, _bin string, _n string, _before string")
    for even in (False, True):
        out = ranks.ranked(t, ["g"], "v", "k", even=even)
        assert set(out.columns) == {*t.columns, "_rank"}
        for g in (0, 1):
            want = [r[0] for r in sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))]
            assert [r["k"] for r in out.where(F.col("g") == g).orderBy("_rank").collect()] == want
        assert {r["_bin"] for r in out.collect()} == {"x"}


def test_weights_and_flips_keep_clashing_columns(spark):
    rows = [(i, i % 2, int(i % 3 == 0), float(i), "s", "c", "k", "f") for i in range(24)]
    ff = FairFrame(spark.createDataFrame(rows, "id long, g int, y int, x double, _s string, _c string, _k string, _f string"), "g", "y", key="id")
    assert {tuple(r)[4:8] for r in weights.reweigh(ff).collect()} == {("s", "c", "k", "f")}
    assert {tuple(r)[4:8] for r in relabel.massage(ff, F.col("x")).collect()} == {("s", "c", "k", "f")}


def test_domains_are_counted_before_they_are_multiplied(spark):
    ff = FairFrame(spark.createDataFrame([(i % 2, i, i % 3 % 2) for i in range(60)], "g int, x int, y int"), "g", "y")
    with pytest.raises(ValueError, match="240 cells"):
        optmap.joint_distribution(ff, ["x"], most=100)
    with pytest.raises(ValueError, match="variables"):
        optmap.RandomizedMap(["x"], lambda a, b: 0.0).fit(ff)


def test_nearest_columns_with_ties():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 6, (40, 30)).astype(float)
    assert (neighbors._first(d, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_summaries_of_nulls_and_ties(spark):
    from evenhand.plans.pipeline import numeric_summary, object_summary

    t = spark.createDataFrame([(1, None, "b", True), (None, 2.0, "a", True), (3, 4.0, None, None)], "i int, x double, s string, b boolean")
    n = {r["column"]: r for r in numeric_summary(t).collect()}
    assert (n["i"]["count"], n["i"]["mean"], n["i"]["q25"], n["x"]["max"]) == (2, 2.0, 1.5, 4.0)
    o = {r["column"]: tuple(r)[1:] for r in object_summary(t).collect()}
    assert o == {"s": (2, 2, "a", 1), "b": (2, 1, "true", 2)}
    empty = object_summary(t.limit(0)).collect()
    assert empty == [] and numeric_summary(t.limit(0)).count() == 2


def test_committee_of_given_models(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(x + rng.normal()), int(x + rng.normal() > 0), int(rng.random() < 0.5)) for i, x in enumerate(rng.normal(size=60))]
    ff = FairFrame(spark.createDataFrame(rows, "id long, x1 double, x2 double, g int, y int").cache(), "g", "y", key="id")
    one = masking.MaskedClassifier("id", budget=2).fit(ff)
    two = masking.MaskedClassifier("id", budget=2, extrapolation=lambda features, sens: Logistic(features, sens)).fit(ff)
    assert two.weights == pytest.approx(one.weights)
    clash = ff.df.withColumn("_vote", F.lit("kept"))
    assert two.masked(clash).columns == clash.columns
    assert two.masked(clash).drop("_vote").orderBy("id").collect() == one.masked(ff.df).orderBy("id").collect()
    with pytest.warns(UserWarning, match="left out: s"):
        masking.MaskedClassifier("id", budget=1).fit(ff.with_df(ff.df.withColumn("s", F.lit("a"))))


def test_neighbours_by_leaves_meet_numpy(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    # ties on a grid, one point of many rows, lone rows far off, and rows that can't be compared
    x = np.concatenate([rng.integers(0, 12, (300, 2)), np.full((40, 2), 3), [[900, -900], [-0.0, 0.0], [0.0, -0.0]]]).astype(float)
    cell = ["a" if i % 3 else "b" for i in range(len(x))]
    rows = [(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, cell, strict=True))]
    df = spark.createDataFrame([*rows, (1000, None, 1.0, "a"), (1001, float("nan"), 1.0, "a"), (1002, float("inf"), 1.0, "b"), (1003, 1.0, 1.0, "c")], "id long, a double, b double, c string")
    trees, made = [], neighbors._tree
    monkeypatch.setattr(neighbors, "_tree", lambda *a: trees.append(made(*a)) or trees[-1])
    some = df.where("id % 2 = 0")
    for within, queries in ((None, None), (["c"], some)):
        got = {}
        for r in neighbors.knn(df, "id", ["a", "b"], 4, within=within, queries=queries).orderBy("key", "rank").collect():
            got.setdefault(r["key"], []).append((r["rank"], r["nn_key"], r["d2"]))
        assert set(got) == {i for i in range(len(x)) if queries is None or i % 2 == 0} | ({1003} if within is None else set())
        for i in set(got) - {1003}:
            near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(len(x)) if j != i and (within is None or cell[i] == cell[j]))
            if within is None:
                near = sorted([*near, (float(((x[i] - 1.0) ** 2).sum()), 1003)])
            assert got[i] == [(r, j, d) for r, (d, j) in enumerate(near[:4], 1)]
    assert len(trees) == 3 and min(len(t.dim) for t in trees) > 1


def test_a_query_meets_few_leaves():
    x = np.random.default_rng(6).random((20_000, 3))
    tree = neighbors._tree(x, 500)
    leaf = tree.place(x)
    assert max(np.unique(leaf, return_counts=True)[1]) <= 500
    ask = x[leaf == leaf[0]]
    far = np.sort(((ask[:, None] - x[leaf == leaf[0]]) ** 2).sum(axis=2), axis=1)[:, 5]
    rows, leaves = tree.near(ask, far, leaf[0])
    assert leaf[0] not in leaves and len(rows) < 3 * len(ask)  # of 64 leaves
    for r in range(0, len(ask), 50):
        within = np.unique(leaf[((x - ask[r]) ** 2).sum(axis=1) <= far[r]])
        assert set(within) - {leaf[0]} <= set(leaves[rows == r])


def test_prototype_tasks_follow_the_cores(spark):
    sc = spark.sparkContext
    rows = [(i, float(i % 7), float(i % 5), i % 2, int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p double, q double, g int, y int").repartition(40)
    sc.setJobGroup("prototypes", "")
    try:
        with pytest.warns(UserWarning, match="converged"):
            prototypes.PrototypeRepresentation(k=2, steps=2).fit(FairFrame(df, "g", "y", key="id"))
        track = sc.statusTracker()
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("prototypes") for s in track.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len([s for s in stages if s]) > 6 and sum(s.numTasks >= 40 for s in stages if s) <= 3


def test_members_share_their_jobs(spark):
    sc = spark.sparkContext
    rng = np.random.default_rng(8)
    rows = [(i, float(x), int(x + rng.normal() > 0.6), int(rng.random() < 0.5)) for i, x in enumerate(rng.normal(size=80))]
    ff = FairFrame(spark.createDataFrame(rows, "id long, x double, g int, y int"), "g", "y", key="id")
    jobs = []
    for budget in (1, 4):
        sc.setJobGroup(f"members {budget}", "")
        try:
            m = masking.MaskedClassifier("id", budget=budget).fit(ff)
            jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"members {budget}")))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(m.members) == budget
    assert jobs[0] and jobs[1] < 2 * jobs[0]
