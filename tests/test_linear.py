"""Hinge loss with L1 and elastic-net penalty against an independent solution in numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import models as M
from txrisk.operators.linear import ProximalHinge
from txrisk.operators.metrics import ranking_scores


def made(spark, n=400, weighted=True):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 0] + [0, 5, 0, 100, 0, 3]
    y = (x[:, 0] + x[:, 1] / 10 - 0.5 + rng.normal(size=n) * 0.5 > 0).astype(int)
    w = np.where(y == 1, 2.0, 1.0) if weighted else np.ones(n)
    rows = [(i, *map(float, r), int(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, " + ", ".join(f"f{j} double" for j in range(6)) + ", TX_FRAUD int, weight double")
    df = M.assemble(df, [f"f{j}" for j in range(6)])
    return x, 2.0 * y - 1, w, df if weighted else df.drop("weight")


def objective(z, y, w, b, alpha, l1):
    return w @ np.maximum(0, 1 - y * (z @ b[:-1] + b[-1])) / w.sum() + alpha * (l1 * np.abs(b[:-1]).sum() + (1 - l1) / 2 * (b[:-1] @ b[:-1]))


def best(z, y, w, alpha, l1):
    """Subgradient steps of falling length; the best point met."""
    b, low = np.zeros(z.shape[1] + 1), np.inf
    for k in range(60000):
        out = (y * (z @ b[:-1] + b[-1]) < 1) * w * y / w.sum()
        g = np.append(-(out @ z) + alpha * (l1 * np.sign(b[:-1]) + (1 - l1) * b[:-1]), -out.sum())
        b = b - 0.5 / np.sqrt(k + 1) * g
        low = min(low, objective(z, y, w, b, alpha, l1))
    return low


@pytest.mark.parametrize("l1, alpha, weighted", [(1.0, 0.05, True), (0.15, 0.05, False), (1.0, 0.001, True)])
def test_optimum(spark, l1, alpha, weighted):
    x, y, w, df = made(spark, weighted=weighted)
    model = ProximalHinge(l1, alpha).fit(df)
    mean, sd = np.average(x, axis=0, weights=w), np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    sd[sd < 1e-9] = np.inf
    z = (x - mean) / sd
    mine = np.append(np.where(np.isfinite(sd), model.coefficients * np.where(np.isfinite(sd), sd, 0), 0), model.intercept + model.coefficients @ mean)
    assert objective(z, y, w, mine, alpha, l1) <= best(z, y, w, alpha, l1) + 0.005
    assert model.coefficients[5] == 0
    if l1 == 1.0 and alpha == 0.05:
        # only the two features that carry the signal stay
        assert set(np.flatnonzero(model.coefficients)) == {0, 1}
    out = model.transform(df)
    got = out.orderBy("TRANSACTION_ID").select("rawPrediction", "prediction").collect()
    assert np.allclose([r.rawPrediction[1] for r in got], x @ model.coefficients + model.intercept)
    assert ranking_scores(M.fraud_probability(out)).first()["auc_roc"] > 0.9


@pytest.mark.parametrize("loss", ["hinge", "log_loss"])
@pytest.mark.parametrize("penalty", ["l1", "l2", "elasticnet"])
def test_all_losses_and_penalties_run(spark, loss, penalty):
    df = made(spark, 100)[3]
    out = M.fraud_probability(M.sgd_linear(loss=loss, penalty=penalty, alpha=0.01).fit(df).transform(df))
    assert ranking_scores(out).first()["auc_roc"] > 0.85


def test_empty_table_gives_the_zero_model(spark):
    df = made(spark, 10)[3]
    out = ProximalHinge().fit(df.limit(0)).transform(df)
    assert [r.prediction for r in out.collect()] == [0.0] * 10
    assert ProximalHinge().fit(df.withColumn("weight", F.lit(0.0))).intercept == 0.0


def test_rounds_read_blocks_of_rows(spark):
    from txrisk.operators import linear as L
    n = 2 * L.BLOCK_ROWS + 5
    rows = spark.range(0, n, 1, 2).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"), F.lit(2.0).alias("w"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("x"))
    blocks = L._blocks(rows)
    assert 3 <= blocks.count() <= 6 and blocks.first()["p"] == 2
    got = L._sums(blocks, lambda y, w, x: np.concatenate([[len(y), w.sum(), y.sum()], w @ x]), 5)
    assert got.tolist() == [n, 2 * n, sum(1 if i % 3 == 0 else -1 for i in range(n)), n * (n - 1), n]
