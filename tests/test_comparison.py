"""Scores, weights, tables, balance, odds ratios."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from phasewise.functions import quantiles, tail
from phasewise.functions.quantiles import exact_quantiles
from phasewise.operators import outcomes, populations, propensity, table_one
from plain_tails import chi_square_tail, f_tail

Z2 = 1.959963984540054 ** 2


@pytest.fixture(scope="module")
def sample(spark):
    """600 rows with a number, two categories, a weight, treatment and outcome."""
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(50, 12, n)
    c = rng.choice(["a", "b", "c"], n, p=[.5, .3, .2])
    t = (rng.random(n) < 1 / (1 + np.exp(-(x - 50) / 20))).astype(int)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + .6 * t + (x - 50) / 30)))).astype(int)
    table = {"id": np.arange(n), "x": np.round(x, 2), "c": c, "f": (rng.random(n) < .4).astype(int),
             "t": t, "y": y, "w": np.round(.5 + rng.random(n), 3)}
    df = spark.createDataFrame(
        [tuple(v[i].item() if hasattr(v[i], "item") else str(v[i]) for v in table.values()) for i in range(n)],
        "id long, x double, c string, f int, t int, y int, w double")
    return df, table


def test_populations(frame):
    df = frame("id int, MOLNUPIRAVIR int, PAXLOVID int, hosp180_pre_dx int, d180 int",
               (1, 1, 0, 0, 1), (2, 0, 1, 0, 0), (3, 1, 1, 0, 1), (4, 0, 0, 0, 1), (5, 1, 0, 1, 0))
    assert [r[0] for r in rows(populations.population_vs_untreated(df))] == [1, 4]
    assert [r[0] for r in rows(populations.population_active_comparator(df))] == [1, 2]
    assert [r[0] for r in rows(populations.population_followup(df))] == [1, 3, 4]


def test_score_equals_maximum_likelihood(sample):
    df, table = sample
    found = {r.id: r.pr_score for r in propensity.propensity(df, "t", ["x"], ["c"]).collect()}
    design = np.column_stack([np.ones(600), table["x"], table["c"] == "b", table["c"] == "c"]).astype(float)
    beta = np.zeros(4)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design.T * (mu * (1 - mu))) @ design, design.T @ (table["t"] - mu))
    assert np.allclose([found[i] for i in range(600)], 1 / (1 + np.exp(-design @ beta)), atol=1e-7)
    assert math.isclose(np.mean(list(found.values())), table["t"].mean(), rel_tol=1e-6)


def test_missing_covariate_is_an_error_or_skipped(frame):
    df = frame("t int, c string, x double", (1, "a", 1.0), (0, "a", 2.0), (1, "b", 2.5), (0, "b", 1.5), (1, "a", 3.0),
               (0, None, 1.0))
    with pytest.raises(Exception):
        propensity.propensity(df, "t", ["x"], ["c"]).collect()
    assert propensity.propensity(df, "t", ["x"], ["c"], on_missing="skip").count() == 5


def test_weights(frame):
    df = frame("t int, pr_score double", (1, 0.5), (0, 0.5), (0, 0.2), (0, 0.2))
    found = propensity.ip_weights(df, "t").collect()
    assert [round(r.ipw, 4) for r in found] == [0.5, 1.5, 0.9375, 0.9375]
    assert [(r.iptw, r.wt_stab) for r in found][:2] == [(2.0, 0.5), (2.0, 0.5)]


def test_saturated_weights_sum_to_arm_sizes(sample):
    df, table = sample
    scored = propensity.propensity(df, "t", [], ["c"])
    sums = {r.t: r.s for r in propensity.ip_weights(scored, "t").groupBy("t").agg(F.sum("ipw").alias("s")).collect()}
    assert math.isclose(sums[1], table["t"].sum(), rel_tol=1e-6)
    assert math.isclose(sums[0], 600 - table["t"].sum(), rel_tol=1e-6)


@pytest.mark.parametrize("last", [1, 50, 10**9])
def test_quantiles_are_exact(spark, monkeypatch, last):
    monkeypatch.setattr(quantiles, "LAST_VALUES", last)
    n = 60_000
    df = spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.pow(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003, 3)).alias("v"))
    values = np.array([r.v for r in df.collect()])
    probabilities = [0.01, 0.05, 0.5, 0.95, 0.99]
    found = exact_quantiles(df, "v", probabilities).first()
    assert np.allclose(list(found), np.quantile(values, probabilities), rtol=0, atol=1e-15)


def test_passes_do_not_grow_with_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LAST_VALUES", 50)
    df = spark.range(200_000, numPartitions=3).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))

    def jobs(probabilities):
        group = f"quantiles-{len(probabilities)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            exact_quantiles(df, "v", probabilities)
        finally:
            spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs([0.01, 0.2, 0.5, 0.77, 0.99]) == jobs([0.4]) <= 14


def test_quantiles_of_few_rows(frame):
    df = frame("v double", *[(float(i),) for i in (5, 1, 3, 2)], (None,))
    assert list(exact_quantiles(df, "v", [0.0, 0.3, 1.0]).first()) == pytest.approx([1.0, 1.9, 5.0])
    assert list(exact_quantiles(df.where("v > 9"), "v", [0.5]).first()) == [None]


def test_trim_is_strict(frame):
    df = frame("s double", *[(float(i),) for i in range(101)])
    assert [r[0] for r in rows(propensity.trim_by_quantile(df, "s", 0.5, 0.75).orderBy("s"))] == [
        float(i) for i in range(51, 75)]


def test_histogram_edges(frame):
    df = frame("t int, ipw double", (1, -0.1), (1, 0.0), (1, 0.09), (0, 4.99), (0, 5.0))
    assert rows(propensity.overlap_histogram(df, "t")) == [(0, 50, 1), (0, 51, 1), (1, 0, 1), (1, 1, 2)]


def _arms(table, weight):
    w = table["w"] if weight else np.ones(600)
    return [(w[table["t"] == a], table["x"][table["t"] == a], table["c"][table["t"] == a]) for a in (1, 0)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_description_and_smd(sample, weight):
    df, table = sample
    found = {(r.variable, r.level, r.arm): r for r in table_one.table_one(df, "t", ["x"], ["c"], weight).collect()}
    means, variances, shares = [], [], []
    for arm, (w, x, c) in zip((1, 0), _arms(table, weight)):
        m = (w * x).sum() / w.sum()
        v = (w * (x - m) ** 2).sum() / w.sum() * len(x) / (len(x) - 1)
        p = np.array([w[c == k].sum() / w.sum() for k in "abc"])
        row = found[("x", None, arm)]
        assert row.mean == pytest.approx(m) and row.sd == pytest.approx(math.sqrt(v))
        assert [found[("c", k, arm)].percent for k in "abc"] == pytest.approx(list(100 * p))
        assert found[("n", None, arm)].n == pytest.approx(w.sum())
        means.append(m), variances.append(v), shares.append(p)
    distance = dict(rows(table_one.smd(df, "t", ["x"], ["c"], weight)))
    assert distance["x"] == pytest.approx(abs(means[0] - means[1]) / math.sqrt(sum(variances) / 2))
    d = (shares[0] - shares[1])[1:]
    s = sum(np.diag(p[1:]) - np.outer(p[1:], p[1:]) for p in shares) / 2
    assert distance["c"] == pytest.approx(math.sqrt(d @ np.linalg.solve(s, d)))


def test_tail_probabilities():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(30.0, 3) == pytest.approx(1.3800570312932545e-06, rel=1e-8)
    assert f_tail(4.0, 1, 1e9) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-6)
    assert f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05)


def test_tails_as_expressions_equal_plain_ones(spark):
    """Over the degrees of freedom and statistics that tests can have, in the JVM from end to end."""
    cases = [(x, a, b) for x in (0.0, 1e-9, 0.01, 0.5, 1.0, 3.3, 12.0, 80.0, 700.0) for a in (1.0, 1.37, 2.0, 7.0, 40.0, 400.0)
             for b in (None, 1.0, 2.0, 9.5, 60.0, 1200.0, 400_000.0)]
    df = spark.createDataFrame([*cases, (None, 1.0, None), (2.0, None, 3.0), (2.0, None, None)], "x double, a double, b double")
    found = df.withColumn("p", tail.p_value(F.col("x"), F.col("a"), F.col("b")))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for x, a, b, p in found.collect():
        if x is None or a is None:
            assert p is None
        else:
            assert p == pytest.approx(chi_square_tail(x, a) if b is None else f_tail(x, a, b), rel=1e-6, abs=1e-9), (x, a, b)
    far = spark.range(1).select(tail.f_tail(F.lit(4.0), F.lit(1.0), F.lit(1e12)).alias("p")).first().p
    assert far == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-9)


def test_group_tests(sample):
    df, table = sample
    found = {r.variable: r for r in table_one.group_tests(df, "t", ["x"], ["c", "f"]).collect()}
    groups = [table["x"][table["t"] == a] for a in (1, 0)]
    total = table["x"]
    inside = sum(((g - g.mean()) ** 2).sum() for g in groups)
    between = sum(len(g) * (g.mean() - total.mean()) ** 2 for g in groups)
    assert found["x"].statistic == pytest.approx(between / (inside / 598))
    for name, correction in (("c", 0), ("f", 0.5)):
        observed = np.array([[((table[name] == k) & (table["t"] == a)).sum() for a in (1, 0)]
                             for k in sorted(set(table[name]))])
        expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
        statistic = ((abs(observed - expected) - correction) ** 2 / expected).sum()
        assert found[name].statistic == pytest.approx(statistic)
        assert found[name].p == pytest.approx(chi_square_tail(statistic, len(observed) - 1))


def test_weighted_tests(sample, spark):
    df, table = sample
    found = {r.variable: r for r in table_one.group_tests_weighted(df, "t", ["x"], ["c", "f"], "w").collect()}
    # Variance of the difference from the rows' influence values.
    influence = np.zeros(600)
    means = {}
    for a, sign in ((1, 1), (0, -1)):
        here = table["t"] == a
        w = table["w"][here]
        means[a] = (w * table["x"][here]).sum() / w.sum()
        influence[here] = sign * w * (table["x"][here] - means[a]) / w.sum()
    variance = 600 / 599 * (influence ** 2).sum()
    assert found["x"].statistic == pytest.approx((means[1] - means[0]) ** 2 / variance)
    for name in ("c", "f"):
        statistic, df1 = _design_corrected(table[name], table["t"], table["w"])
        assert found[name].statistic == pytest.approx(statistic) and found[name].df1 == pytest.approx(df1)
        assert found[name].df2 == pytest.approx(df1 * 599) and found[name].p == pytest.approx(f_tail(statistic, df1, df1 * 599))


def _design_corrected(levels, arms, weights):
    """Statistic and df1 from the log-linear form: interaction contrasts against main effects, by matrices."""
    names = sorted(set(levels))
    cell = np.array([names.index(v) * 2 + a for v, a in zip(levels, arms)])
    k, n = len(names), len(cell)
    share = np.array([weights[cell == c].sum() for c in range(2 * k)]) / weights.sum()
    scores = (np.eye(2 * k)[cell] - share) * (weights / weights.sum())[:, None]
    design = n / (n - 1) * scores.T @ scores
    row, col = share.reshape(k, 2).sum(1), share.reshape(k, 2).sum(0)
    expected = np.outer(row, col).ravel()
    main = np.column_stack([np.ones(2 * k), np.kron(np.eye(k)[:, 1:], np.ones((2, 1))), np.kron(np.ones((k, 1)), np.eye(2)[:, 1:])])
    cross = np.column_stack([np.kron(np.eye(k)[:, i], np.eye(2)[:, 1]) for i in range(1, k)])
    cross = cross - main @ np.linalg.lstsq(main, cross, rcond=None)[0]
    inverse = np.diag(1 / expected)
    delta = np.linalg.solve(cross.T @ (inverse / n) @ cross, cross.T @ inverse @ design @ inverse @ cross)
    statistic = n * ((share - expected) ** 2 / expected).sum()
    return statistic / np.trace(delta), np.trace(delta) ** 2 / np.trace(delta @ delta)


def test_weighted_test_of_one_level_is_null(sample):
    df, _ = sample
    row = table_one.group_tests_weighted(df.withColumn("one", F.lit("a")), "t", ["x"], ["one"], "w").where("variable = 'one'").first()
    assert row.test == "Rao-Scott" and row.statistic is None and row.p is None


@pytest.mark.parametrize("denominator", ["unweighted", "weighted"])
def test_balance(sample, denominator):
    df, table = sample
    found = {(r.variable, r.level): r for r in table_one.balance(
        df, "t", ["x"], ["c"], "w", denominator=denominator).collect()}
    share = {k: [w[c == "b"].sum() / w.sum() for w, _, c in _arms(table, k)] for k in (None, "w")}
    by = share["w"] if denominator == "weighted" else share[None]
    scale = math.sqrt(sum(p * (1 - p) for p in by) / 2)
    assert found[("c", "b")].smd_weighted == pytest.approx(abs(share["w"][0] - share["w"][1]) / scale)
    assert found[("x", None)].unbalanced == (found[("x", None)].smd_weighted > 0.1)
    order = [r.smd_unweighted for r in table_one.balance(df, "t", ["x"], ["c"], "w").collect()]
    assert order == sorted(order, reverse=True)


def _profile_loss(cells, b):
    """Deviance over its minimum at a fixed treatment effect, minimised by a fine search."""
    a, n10, c, n00 = cells

    def loglik(base, effect):
        s1, s0 = base + effect, base
        return (a * s1 - (a + n10) * np.logaddexp(0, s1)) + (c * s0 - (c + n00) * np.logaddexp(0, s0))

    grid = np.linspace(-12, 12, 2_000_001)
    best = loglik(math.log(c / n00), math.log(a * n00 / (n10 * c)))
    return 2 * (best - loglik(grid, b).max())


def test_odds_ratio_of_cells_and_limits(frame):
    df = frame("outcome string, weighted boolean, rows long, n11 double, n10 double, n01 double, n00 double",
               ("y", False, 150, 20.0, 14.0, 73.0, 43.0))
    found = {r.term: r for r in outcomes.cell_odds_ratios(df, "t").collect()}
    effect = found["t"]
    assert effect.odds_ratio == pytest.approx(20 * 43 / (14 * 73))
    assert found["(Intercept)"].odds_ratio == pytest.approx(73 / 43)
    for end in (effect.ci_low, effect.ci_high):
        assert _profile_loss((20, 14, 73, 43), math.log(end)) == pytest.approx(Z2, abs=1e-6)


def test_empty_cell_gives_an_open_end(frame):
    df = frame("outcome string, weighted boolean, rows long, n11 double, n10 double, n01 double, n00 double",
               ("none", False, 100, 0.0, 20.0, 30.0, 50.0), ("all", False, 100, 20.0, 0.0, 30.0, 50.0))
    found = {(r.outcome, r.term): r for r in outcomes.cell_odds_ratios(df, "t").collect()}
    none, every = found[("none", "t")], found[("all", "t")]
    assert none.odds_ratio == 0 and none.ci_low is None and 0 < none.ci_high < 1
    assert every.odds_ratio == math.inf and every.ci_high is None and every.ci_low > 1


def test_weighted_dispersion_widens_limits(sample):
    df, table = sample
    one, two = (
        {r.term: r for r in outcomes.odds_ratios(df.withColumn("w", F.col("w") * k), "t", ["y"], "w").collect()}["t"]
        for k in (1, 2))
    assert one.odds_ratio == pytest.approx(two.odds_ratio)
    # Scaling all weights scales the dispersion as well, so the limits stay.
    assert one.ci_low == pytest.approx(two.ci_low, rel=1e-6)


def test_adjusted_model_without_covariates_equals_the_cells(sample):
    df, _ = sample
    cells = {r.term: r for r in outcomes.odds_ratios(df, "t", ["y"], "w").collect()}
    model = {r.term: r for r in outcomes.odds_ratio_adjusted(df, ["y"], "t", [], "w").collect()}
    for term in cells:
        assert tuple(model[term])[3:6] == pytest.approx(tuple(cells[term])[3:6], rel=1e-5)
        assert model[term].converged and model[term].rows_left_out == 0


def test_adjusted_limits_lie_on_the_profile(sample):
    df, table = sample
    found = {r.term: r for r in outcomes.odds_ratio_adjusted(df, ["y"], "t", ["x"], "w").collect()}
    design = np.column_stack([np.ones(600), table["t"], table["x"]]).astype(float)

    def fit(x, offset):
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            mu = 1 / (1 + np.exp(-(x @ beta + offset)))
            beta += np.linalg.solve((x.T * (table["w"] * mu * (1 - mu))) @ x, x.T @ (table["w"] * (table["y"] - mu)))
        eta = x @ beta + offset
        return beta, (table["w"] * (table["y"] * eta - np.logaddexp(0, eta))).sum(), 1 / (1 + np.exp(-eta))

    beta, best, mu = fit(design, 0)
    phi = (table["w"] * (table["y"] - mu) ** 2 / (mu * (1 - mu))).sum() / 597
    assert found["t"].odds_ratio == pytest.approx(math.exp(beta[1]))
    for end in (found["t"].ci_low, found["t"].ci_high):
        held = fit(design[:, [0, 2]], math.log(end) * design[:, 1])[1]
        assert 2 * (best - held) / phi == pytest.approx(Z2, rel=1e-6)


def test_limits_that_stay_open_are_told_apart(spark):
    """Nobody treated has the outcome: the estimate of the treatment runs away; of a covariate that almost
    decides the outcome one limit is far and still reached."""
    rows_ = [(0, float(i % 7), int(i % 3 == 0), 1.0) for i in range(90)] + [(1, float(i % 7), 0, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows_, "t int, x double, y int, w double")
    marked = outcomes.odds_ratio_adjusted(df, ["y"], "t", ["x"], "w", on_failure="mark").collect()
    assert {(r.converged, r.ci_low_status, r.ci_high_status) for r in marked} == {(False, None, None)}
    one = spark.createDataFrame([*rows_, (1, 3.0, 1, 0.02)], "t int, x double, y int, w double")  # hardly anybody
    found = {r.term: r for r in outcomes.odds_ratio_adjusted(one, ["y"], "t", ["x"], "w").collect()}
    assert (found["t"].ci_low, found["t"].ci_low_status, found["t"].ci_high_status) == (None, "open", "reached")
    assert found["x"].ci_low_status == found["x"].ci_high_status == "reached"


@pytest.mark.parametrize("seed", range(3))
def test_limits_of_skewed_models_lie_on_the_profile(seed):
    """Few events and correlated covariates, where plain Newton steps leave the region: every limit
    is checked by maximising over the other coefficients."""
    own = np.random.default_rng(seed)
    t = own.integers(0, 2, 60).astype(float)
    x = np.exp(own.normal(0, 1.5, 60)) + t
    y = (own.random(60) < 0.08 + 0.3 * (x > 4)).astype(float)
    design, w = np.column_stack([np.ones(60), t, x]), own.uniform(0.2, 4, 60)

    def point(beta):
        eta = design @ beta
        mu = 1 / (1 + np.exp(-eta))
        v = w * mu * (1 - mu)
        return outcomes.Point((w * (y * eta - np.logaddexp(0, eta))).sum(), design.T @ (w * (y - mu)), (design.T * v) @ design,
                              ((w * (y - mu)) ** 2 / v).sum())

    model = outcomes._profile(["c", "t", "x"], 60, [1.0, 0.7, 3.0])
    asked, passes = next(model), 1
    while True:
        try:
            asked = model.send([point(b) for b in asked])
            passes += 1
        except StopIteration as end:
            found = end.value
            break
    assert passes < 45

    def best(i, b):
        beta, rest = np.zeros(3), [k for k in range(3) if k != i]
        beta[i] = b
        for _ in range(200):
            p = point(beta)
            step = np.linalg.solve(p.information[np.ix_(rest, rest)], p.gradient[rest])
            size = 1.0
            while size > 1e-12:
                tried = beta.copy()
                tried[rest] += size * step
                if point(tried).value >= p.value:
                    break
                size /= 2
            beta = tried
        return p.value

    full = np.array([math.log(found[k][0]) for k in ("c", "t", "x")])
    top = point(full)
    phi = top.pearson / 57
    for i, term in enumerate(("c", "t", "x")):
        for value, status in zip(found[term][1:3], found[term][3:]):
            assert status == "reached"
            assert 2 * (top.value - best(i, math.log(value))) / phi == pytest.approx(Z2, rel=1e-6)


def test_adjusted_models_take_few_jobs(spark, sample):
    df, _ = sample
    two = df.withColumn("z", 1 - F.col("y"))
    spark.sparkContext.setJobGroup("adjusted", "adjusted")
    try:
        outcomes.odds_ratio_adjusted(two, ["y", "z"], "t", ["x"], "w")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("adjusted")) < 40


@pytest.fixture
def separated(spark):
    """The outcome follows from x alone, and the treatment as well."""
    return spark.createDataFrame([(i, i % 2, int(i > 60), float(i), int(i > 40)) for i in range(120)],
                                 "id int, t int, y int, x double, s int")


def test_separated_models_give_no_estimate(separated):
    df = separated.withColumn("w", F.lit(1.0))
    with pytest.raises(propensity.NotConverged):
        outcomes.odds_ratio_adjusted(df, ["y"], "t", ["x"], "w")
    marked = outcomes.odds_ratio_adjusted(df, ["y"], "t", ["x"], "w", on_failure="mark").collect()
    assert all(not r.converged and r.odds_ratio is None and r.ci_low is None for r in marked)
    with pytest.raises(propensity.NotConverged):
        propensity.propensity(df, "s", ["x"], [])
    found = propensity.fit(df, "s", ["x"], [], on_failure="mark")
    assert not found.report.first().converged
    assert found.scored.where("pr_score is not null").count() == 0


def test_dependent_covariates_change_no_score(sample):
    """A constant, a copy and a sum of others get no coefficient; the scores are those without them, to the last digits."""
    df, _ = sample
    more = df.withColumns({"one": F.lit(3.0), "twice": 2 * F.col("x") - 1, "f2": F.col("f").cast("string")})
    plain = propensity.fit(df, "t", ["x"], ["c"])
    found = propensity.fit(more, "t", ["x", "one", "twice"], ["c"])
    assert found.report.first().aliased == "one,twice" and plain.report.first().aliased == ""
    a, b = ({r.id: r.pr_score for r in x.scored.select("id", "pr_score").collect()} for x in (plain, found))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_rows_left_out_are_counted(sample):
    df, _ = sample
    holes = df.withColumn("x", F.when(F.col("id") >= 10, F.col("x")))
    report = propensity.fit(holes, "t", ["x"], ["c"], on_missing="skip").report.first()
    assert (report.rows, report.rows_left_out, report.converged) == (590, 10, True)
    assert {r.rows_left_out for r in outcomes.odds_ratio_adjusted(holes, ["y"], "t", ["x"], "w").collect()} == {10}


def test_far_start_needs_parts_of_steps(spark):
    """A steep model, where whole Newton steps from zero overshoot."""
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(0, 2, 400))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 * x - 1)))).astype(int)
    df = spark.createDataFrame([(int(i % 2), float(a), int(b), 1.0) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y int, w double")
    rows_ = outcomes.odds_ratio_adjusted(df, ["y"], "t", ["x"], "w").collect()
    assert all(r.converged and r.ci_low < r.odds_ratio < r.ci_high for r in rows_)


def test_tables_take_one_pass_each(sample):
    df, _ = sample
    for found in (table_one.balance(df, "t", ["x"], ["c"], "w"), table_one.table_one(df, "t", ["x"], ["c"], "w")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") <= 3  # numbers, levels, and the same levels for the arms' totals


def test_large_numbers_with_a_small_spread_keep_their_digits(spark):
    values = [1e9 + k / 1000 for k in range(100)]
    df = spark.createDataFrame([(k % 2, v, 1.0 + k % 3) for k, v in enumerate(values)], "t int, x double, w double")
    rows_ = {r.arm: r for r in table_one.numeric_sums(df, "t", ["x"], "w").collect()}
    for arm in (0, 1):
        x, w = np.array(values[arm::2]) - 1e9, np.array([1.0 + k % 3 for k in range(arm, 100, 2)])
        m = (w * x).sum() / w.sum()
        assert rows_[arm].variance == pytest.approx((w * (x - m) ** 2).sum() / w.sum() * 50 / 49, rel=1e-6)


def test_fixed_lists():
    """Values that other tables must agree on, written out once more."""
    from phasewise import names

    assert names.SCORE_CATEGORICAL == ["sex", "race_ethnicity"] and names.ADJUSTED_FOR == ["age_at_covid"]
    assert names.OUTCOMES == ["mort_30", "d30_composite"] and names.LONG_TERM_OUTCOME == "pasc"
    assert names.TABLE_NUMERIC == [
        "age_at_covid", "COVID_first_poslab_or_diagnosis_date", "vaccine_number", "number_of_visits_before_covid",
        "number_of_visits_post_covid", "observation_period_before_covid", "observation_period_post_covid"]
    assert names.TABLE_CATEGORICAL == (
        "sex race_ethnicity mildliver rheum chf mi cad htn ckd cancer metcancer dmcomp dmuncomp obesity lungdisease "
        "transplant hiv immunocomp systemicsteroids biologic tobacco subuse").split()
    assert sorted(names.BALANCE_NUMERIC + names.BALANCE_CATEGORICAL) == sorted((
        "age_at_covid sex race_ethnicity mildliver cad chf mi htn cancer metcancer ckd dmuncomp dmcomp obesity hiv "
        "lungdisease immunocomp tobacco vaccine_number").split())
    assert names.TRIM_QUANTILES == (0.01, 0.99)


def test_outcome_table_is_long(sample):
    df, _ = sample
    found = outcomes.outcome_table(df, "name", "t", ["y", "f"], "w")
    assert found.count() == 8 and {r.comparison for r in found.collect()} == {"name"}
