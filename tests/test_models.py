import pytest
from pyspark.sql import functions as F

from cartlight.operators import churn, forecast, models_io, segments
from cartlight.sources.starschema import shop_tables
from tests.seed import order, seed_rows, shop

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return shop_tables(spark, FOLDER)


@pytest.fixture(scope="module")
def trained(tables):
    return churn.train_and_test(tables)


def test_quality(trained):
    row = trained[1].first()
    assert row["accuracy"] >= 0.9
    assert (row["test_rows"], row["train_rows"]) == (30, 120)


def test_scores(tables, trained):
    scored = churn.score_churn(trained[0], churn.churn_features(tables)).collect()
    assert len(scored) == 150
    assert all(0.0 <= r["churn_probability"] <= 1.0 for r in scored)
    low = [r["churn_probability"] for r in sorted(scored, key=lambda r: r["total_spending"])]
    assert sum(low[:40]) > sum(low[-40:])
    top = churn.top_risk(churn.score_churn(trained[0], churn.churn_features(tables))).collect()
    assert len(top) == 5 and [r["risk_score"] for r in top] == sorted((r["risk_score"] for r in top), reverse=True)


def test_saved_model_scores_the_same(spark, tables, trained, tmp_path):
    path = str(tmp_path / "churn")
    models_io.save_churn(trained[0], path)
    loaded = models_io.load_churn(spark, path)
    assert loaded.labels == [0, 1] and not loaded.one_class
    features = churn.churn_features(tables)
    a = {r["customer_id"]: r["churn_probability"] for r in churn.score_churn(trained[0], features).collect()}
    b = {r["customer_id"]: r["churn_probability"] for r in churn.score_churn(loaded, features).collect()}
    assert a == b


def test_load_or_fit(spark, seed, tmp_path):
    path = str(tmp_path / "line")
    first = models_io.load_or_fit_forecast(spark, seed, path).first()
    orders = [order(1, 1, "2025-05-01", total=5.0), order(2, 1, "2025-06-01", total=7.0)]
    later = shop(spark, **{**seed_rows(), "orders": orders})
    stale = models_io.load_or_fit_forecast(spark, later, path)
    assert stale.first() == first
    # the old line applied to the longer history
    assert tuple(forecast.forecast_with(stale, later).first()) == (3, 218900.0)
    fresh = models_io.load_or_fit_forecast(spark, later, path, refit=True)
    assert tuple(forecast.forecast_with(fresh, later).first()) == (3, 9.0)


def test_load_or_fit_churn(spark, seed, tmp_path):
    path = str(tmp_path / "churn")
    model = models_io.load_or_fit_churn(spark, seed, path)
    again = models_io.load_or_fit_churn(spark, seed, path)
    assert model.labels == again.labels == [0, 1]
    churn_model, line = models_io.retrain(spark, seed, str(tmp_path))
    assert churn_model.labels == [0, 1] and line.first()["months"] == 1


def test_a_crashed_save_counts_as_none(spark, seed, tmp_path):
    path = str(tmp_path / "line")
    crashed = f"{path}/00000000000000000001/line/_temporary"
    spark.createDataFrame([(1,)], "x int").write.parquet(crashed)
    assert models_io.load_or_fit_forecast(spark, seed, path).first()["months"] == 1
    assert models_io.load_churn(spark, str(tmp_path / "nothing")) is None


def test_churn_after_the_cutoff(spark):
    from tests.seed import customer

    rows = [order(k, k % 40 + 1, f"2025-0{1 + k % 6}-10", total=float(k)) for k in range(1, 200)]
    tables = shop(spark, **{**seed_rows(), "customers": [customer(k) for k in range(1, 31)], "orders": rows})
    features = churn.churn_90d_features(tables, cutoff="2025-03-01").collect()
    assert {r["customer_id"] for r in features} <= set(range(1, 31))  # orphans have no label
    for r in features:
        own = [o for o in rows if o[1] == r["customer_id"]]
        assert r["total_orders"] == sum(str(o[2]) < "2025-03-01" for o in own)
        assert r["churn"] == int(not any("2025-03-01" <= str(o[2]) <= "2025-05-30" for o in own))
    with pytest.raises(ValueError):
        churn.fit_churn(churn.churn_features(tables).withColumn("churn", F.lit(2)))


def test_recommendations_for_any_id(spark):
    from tests.seed import customer, item

    big = 3_000_000_000
    rows = seed_rows()
    rows["customers"] += [customer(big)]
    rows["orders"] += [order(500, big, "2025-06-01", total=1.0)]
    rows["order_items"] += [item(500, 500, 1, 2, 1.0)]
    got = [r for r in segments.reco_als(shop(spark, **rows), n=2).collect() if r["customer_id"] == big]
    assert [r["rank"] for r in got] == [1, 2] and got[0]["score"] >= got[1]["score"]


def test_segments(tables):
    clusters = segments.customer_clusters(tables, k=3)
    assert clusters.count() == 150
    assert {r[0] for r in clusters.select("segment").distinct().collect()} <= {0, 1, 2}
    ranked = segments.reco_als(tables, n=4)
    assert ranked.filter(F.col("rank") > 4).count() == 0 and ranked.count() > 0


def test_rfm_range(tables):
    rows = segments.rfm_scores(tables).collect()
    assert {r["r_score"] for r in rows} == {1, 2, 3, 4, 5}
    best = max(rows, key=lambda r: r["monetary"])
    assert best["m_score"] == 5
