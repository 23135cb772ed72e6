"""Learners on data with a planted signal, and ranks to a stated accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from shopweave.operators import graph as G
from shopweave.operators import models as M
from shopweave.operators import rank as R
from tests.test_graph_fixtures import edges
from tests.test_vertex_programs import random_edges


def features(spark, n=1500):
    """Purchases after the split follow num_pay and shop_level, with noise; the other columns say nothing."""
    rng = random.Random(8)
    rows = []
    for u in range(n // 10):
        for s in range(10):
            pay, view, level = rng.randint(0, 20), rng.randint(0, 9), rng.randint(0, 3)
            count = max(0, round(0.5 * pay + 3 * level + rng.gauss(0, 1)))
            rows.append((u, s, pay, view, rng.randint(0, 24), rng.randint(0, 99), rng.randint(0, 4), rng.randint(0, 49), level, int(count > 9), count))
    names = "user_id long, shop_id long, num_pay long, num_view long, location_id int, per_pay int, score int, comment_cnt int, shop_level int, bought_after int, after_buy_count long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def regressed(spark):
    return M.regression_predictions(features(spark), fit_fraction=1.0)


def deviation(pred):
    return pred.agg(F.stddev_pop("label")).first()[0]


def test_classifier_finds_the_signal_on_every_layout(spark):
    data = features(spark).drop("after_buy_count")
    a = M.classifier_predictions(data)
    assert M.auc(a, "p_buy", "label").first()["auc"] > 0.95
    wrong = a.filter("prediction != label").count() / a.count()
    assert wrong < 0.15
    b = M.classifier_predictions(data.repartition(5, "per_pay"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_regressors_find_the_signal(spark, regressed):
    std = deviation(regressed)
    for name in ("rf_prediction", "gbt_prediction"):
        assert M.rmse(regressed, name, "label").first()["rmse"] < 0.5 * std


def test_regressors_are_alike_on_every_layout(spark, regressed):
    again = M.regression_predictions(features(spark).repartition(7, "num_view"), fit_fraction=1.0)
    columns = ["user_id", "shop_id", "rf_prediction", "gbt_prediction"]
    assert sorted(map(tuple, regressed.select(*columns).collect())) == sorted(map(tuple, again.select(*columns).collect()))


def test_stacks(spark, regressed):
    std = deviation(regressed)
    stacked = M.stack_gbt(regressed)
    inputs = [M.rmse(stacked, c, "label").first()["rmse"] for c in ("rf_prediction", "gbt_prediction")]
    assert M.rmse(stacked, "gbt2_prediction", "label").first()["rmse"] < min(1.3 * max(inputs), 0.6 * std)
    # Counts as classes under a strong penalty: the stack says the most frequent count or close to it.
    logistic = M.stack_logistic(regressed)
    labels = {r.label for r in regressed.select("label").distinct().collect()}
    assert {r.lr_prediction for r in logistic.select("lr_prediction").distinct().collect()} <= labels
    assert M.rmse(logistic, "lr_prediction", "label").first()["rmse"] < 1.5 * std


@pytest.mark.parametrize("weighted", [True, False])
def test_pushed_ranks_are_within_the_bound(spark, weighted):
    e = G.normalize_out_weights(edges(spark, random_edges(30, 3, 2))).select(F.col("src").cast("long").alias("src"), "dst", "weight")
    seeds = spark.range(0, 6).select(F.col("id").alias("seed"))
    exact = {}
    for r in R.personal_rank_many(e, seeds, 0.85, 12, weighted).collect():
        exact[r.seed, r.id] = r["rank"]
    ranks, report = R.push_rank_many(e, seeds, 1e-2, 0.85, weighted)
    got = {(r.seed, r.id): r["rank"] for r in ranks.collect()}
    for s in range(6):
        far = sum(abs(x - got.get((s, v), 0.0)) for (seed, v), x in exact.items() if seed == s)
        assert far <= report["bound"] + 0.85**13
    assert report["rows"] == len(got) and report["rounds"] > 0
    assert all(r.residual <= 1e-2 * 3 * (1 + 1e-9) for r in ranks.collect())
    unknown = spark.createDataFrame([(777,)], "seed long")
    assert R.push_rank_many(e, unknown, 1e-2)[0].count() == 0
