import math

import numpy as np
import pytest

from rankloom.operators import inference


def table(rng, n=400):
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x @ [1.2, -0.7])))).astype(float)
    return x, y, rng.integers(0, 60, n)


def descent(x, y, l2, lr=0.07, epochs=3500):
    """Full-batch gradient descent from zero, intercept free of the penalty."""
    b, w = 0.0, np.zeros(x.shape[1])
    for _ in range(epochs):
        r = 1 / (1 + np.exp(-(b + x @ w))) - y
        b -= lr * r.mean()
        w -= lr * (x.T @ r / len(y) + l2 * w)
    return np.r_[b, w]


def sandwich(x, y, groups, beta, l2):
    d = np.c_[np.ones(len(y)), x]
    p = 1 / (1 + np.exp(-(d @ beta)))
    k, n = d.shape[1], len(y)
    inv = np.linalg.inv(d.T @ (d * (p * (1 - p))[:, None]) + n * l2 * np.diag([0] + [1] * (k - 1)))
    scores = np.array([(d * (y - p)[:, None])[groups == g].sum(0) for g in np.unique(groups)])
    g = len(scores)
    return np.sqrt(np.diag(inv @ (scores.T @ scores) @ inv) * g / (g - 1) * (n - 1) / (n - k))


def test_fit_and_errors_equal_numpy(spark):
    x, y, groups = table(np.random.default_rng(1))
    rows = [("m", int(g), float(t), float(a), float(b)) for g, t, (a, b) in zip(groups, y, x)]
    obs = spark.createDataFrame(rows, "model string, sample_id bigint, label double, f1 double, f2 double")
    beta = inference.fit_logistic(obs, ["f1", "f2"])
    got = np.array(beta.first().beta)
    want = descent(x, y, inference.L2)
    assert np.abs(got - want).max() < 1e-5
    t = {r.feature: r for r in inference.cluster_robust(obs, beta, ["f1", "f2"]).collect()}
    se = sandwich(x, y, groups, got, inference.L2)
    assert np.abs(np.array([t[f].se for f in ("intercept", "f1", "f2")]) - se).max() < 1e-6
    assert abs(t["f1"].p - round(math.erfc(abs(t["f1"].z) / math.sqrt(2)), 6)) < 1e-5 and t["f1"].significant
    assert t["f1"].n_observations == 400 and t["f1"].n_clusters == len(set(groups))


def test_observations_negate_when_pairs_swap(spark):
    f = inference.FEATURES
    schema = "obs_id bigint, model string, sample_id string, candidate_a string, candidate_b string, winner string, ranking array<string>, " + ", ".join(f"{c} double" for c in f)
    rows = [(1, " M", " 7", "a", "b", "A ", None, 1.0, 2.0, 3.0, 4.0), (2, "m", "7", "a", "a", "a", None, 1.0, 1.0, 1.0, 1.0), (3, "m", "7", "a", "b", None, ["b", "a"], 1.0, 1.0, 1.0, 1.0), (4, "m", "7", "a", "b", "tie", None, 1.0, 1.0, 1.0, 1.0), (5, "m", "7", "a", "b", "a", None, None, 1.0, 1.0, 1.0), (1, " M", " 7", "a", "b", "A ", None, 1.0, 2.0, 3.0, 4.0)]
    got = {r.obs_id: (r.model, r.sample_id, r.label) for r in inference.observations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("m", 7, 1.0), 3: ("m", 7, 0.0)}
    empty = inference.observations(spark.createDataFrame([], schema))
    assert inference.cluster_robust(empty, inference.fit_logistic(empty)).count() == 0


def test_constant_feature_has_no_significance(spark):
    obs = spark.createDataFrame([("m", k % 5, float(k % 2), 0.0) for k in range(40)], "model string, sample_id bigint, label double, f double")
    r = inference.cluster_robust(obs, inference.fit_logistic(obs, ["f"]), ["f"]).where("feature = 'f'").first()
    assert r.se == 0 and r.z is None and r.p is None and r.significant is False


@pytest.mark.parametrize("positive, negative, want", [(8, 0, "no_exception"), (7, 0, "mostly_supported_with_exceptions"), (4, 4, "no_stable_evidence"), (0, 6, "mostly_supported_with_exceptions")])
def test_tiers(spark, positive, negative, want):
    rows = [("f", f"m{k}", 1.0 if k < positive else -1.0, k < positive + negative) for k in range(8)]
    r = inference.tiers(spark.createDataFrame(rows, "feature string, model string, coefficient double, significant boolean")).first()
    assert r.tier == want and r.dominant_sign == ("positive" if positive >= negative else "negative")
