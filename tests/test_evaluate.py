import numpy as np

from newsloom.operators import model


def ranks(values):
    out = np.empty(len(values))
    out[np.argsort(values, kind="stable")] = np.arange(len(values))
    return out


def test_evaluate_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = 100
    x = np.c_[np.ones(n), rng.normal(size=n)]
    y, score = x @ [1.0, 2.0] + rng.normal(size=n), rng.normal(size=n).round(1)
    flag = np.arange(n) % 10 != 3
    rows = [(k, "ab"[k % 2], 1.0, float(x[k, 1]), float(y[k]), float(score[k]), bool(flag[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, audience string, intercept double, a double, y double, score double, both boolean")
    for paired, keep in ((None, np.arange(n)), ("both", np.flatnonzero(flag))):
        cut = int(len(keep) * 0.8)
        train, test = keep[:cut], keep[cut:]
        b = np.linalg.solve(x[train].T @ x[train] + np.diag([0, 0.1]), x[train].T @ y[train])
        own = np.abs(y[test] - x[test] @ b).mean()
        base = np.abs(y[test] - np.sort(y[train])[cut // 2]).mean()
        found = model.evaluate(df, ["intercept", "a"], "y", "score", "audience", ["id"], paired).collect()
        found = {r["audience"]: r for r in found}
        assert set(found) == {None, "a", "b"} and found[None]["train_rows"] == cut
        assert abs(found[None]["mae_model"] - own) < 2e-6 and abs(found[None]["mae_median"] - base) < 2e-6
        assert abs(found[None]["improvement"] - 100 * (base - own) / base) < 0.01
        for name, at in ((None, test), ("a", test[test % 2 == 0]), ("b", test[test % 2 == 1])):
            assert found[name]["test_rows"] == len(at)
            for key, p in (("spearman_model", x @ b), ("spearman_score", score)):
                assert abs(found[name][key] - np.corrcoef(ranks(p[at]), ranks(y[at]))[0, 1]) < 1e-4
    assert model.evaluate(df.limit(20), ["intercept", "a"], "y", "score", "audience", ["id"]) is None
