"""Scores, rankings and the occurrence model."""

from datetime import timedelta

import numpy as np
import pytest
from helpers import at
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from surveyspark.operators import model as md
from surveyspark.operators import report as rp


def average_precision(labels, scores):
    total, ap = sum(labels), 0.0
    for s in sorted(set(scores), reverse=True):
        seen = [l for l, x in zip(labels, scores) if x >= s]
        new = sum(l for l, x in zip(labels, scores) if x == s)
        ap += new / total * (sum(seen) / len(seen))
    return ap


@pytest.mark.parametrize("limit", [None, 4])
def test_average_precision_groups_equal_scores(spark, limit):
    rng = np.random.default_rng(0)
    scores = [float(x) for x in rng.integers(0, 12, 60) / 12]
    labels = [int(x) for x in rng.integers(0, 2, 60)]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, probability double")
    assert rp.average_precision(df, group_rows=limit).first()[0] == pytest.approx(average_precision(labels, scores))
    assert rp.brier(df).first()[0] == pytest.approx(np.mean((np.array(scores) - labels) ** 2))


def learning(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        night, speed, rain = i % 4, float(rng.normal()), float(rng.normal())
        y = int(rng.uniform() < 1 / (1 + np.exp(1.5 - 1.2 * speed)))
        rows.append((at("2026-08-01 20:00") + timedelta(days=night, minutes=i), y, speed, None if i % 7 == 0 else rain, float("inf") if i == 3 else 1.0 * i, float(i % 3)))
    return spark.createDataFrame(rows, "entered_at timestamp_ntz, target_capture int, mean_speed_mps double, rain_1h_mm double, elevation_m double, bio_x_5m_count double")


def prepared(df, features):
    raw = np.array([[np.nan if v is None or not np.isfinite(v) else v for v in r] for r in df.select(*features).collect()], float)
    medians = np.nanmedian(raw, axis=0)
    gaps = np.isnan(raw)
    full = np.where(gaps, medians, raw)
    x = np.column_stack([full, gaps[:, gaps.any(axis=0)].astype(float)])
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)


def test_fit_reaches_the_penalised_optimum(spark):
    df = learning(spark)
    features = md.feature_names(df)
    assert features == ["mean_speed_mps", "elevation_m", "rain_1h_mm", "bio_x_5m_count"]
    fitted = md.fit_model(df)
    x = prepared(df, features)
    y = np.array([r[0] for r in df.select("target_capture").collect()], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(x.shape[1] + 1)
    design = np.column_stack([x, np.ones(len(y))])
    penalty = np.array([1.0] * x.shape[1] + [0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = 0.2 * design.T @ (weight * (p - y)) + penalty * beta
        hessian = 0.2 * design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag(penalty)
        beta -= np.linalg.solve(hessian, gradient)
    assert list(fitted.model.coefficients) == pytest.approx(beta[:-1], abs=1e-4)
    assert fitted.model.intercept == pytest.approx(beta[-1], abs=1e-4)


def test_saved_pipeline_scores_like_the_expression(spark, tmp_path):
    df = learning(spark)
    fitted = md.fit_model(df)
    table = md.training_table(df, fitted.features)
    fitted.pipeline().write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).transform(table).orderBy("mean_speed_mps")
    saved = [r.probability[1] for r in loaded.collect()]
    direct = [r.probability for r in fitted.score(table).orderBy("mean_speed_mps").collect()]
    assert saved == pytest.approx(direct)


def test_leave_one_night_out(spark):
    df = learning(spark).withColumn(
        "target_capture", F.when(F.col("entered_at") < F.lit("2026-08-02 07:00:00").cast("timestamp_ntz"), 0).otherwise(F.col("target_capture"))
    )
    out = {r.night: r for r in md.loono_cv(df).collect()}
    assert len(out) == 5 and out["all"].rows == 240 and out["all"].status == "ok"
    assert out["2026-08-01"].average_precision is None and out["2026-08-01"].brier is not None
    nights = [n for n in out if n != "all"]
    pooled = sum(out[n].brier * out[n].rows for n in nights) / 240
    assert out["all"].brier == pytest.approx(pooled)


def test_model_report(spark):
    df = learning(spark)
    fitted = md.fit_model(df)
    report, folds = md.model_report(df, fitted)
    row, parts = report.first(), folds.collect()
    x = md.training_table(df, fitted.features)
    error = [(r.probability - r.label) ** 2 for r in fitted.score(x).collect()]
    assert (row.status, row.rows, row.oof_rows) == ("ok", 240, 240) and row.features == fitted.features
    assert row.positives == row.oof_positives == sum(r.positives for r in parts)
    assert row.brier_train == pytest.approx(np.mean(error))
    assert row.brier_loono == pytest.approx(sum(r.brier * r.rows for r in parts) / 240)
    assert 0 < row.pr_auc_loono < 1 and len(parts) == 4


def test_single_class_folds_are_skipped(spark):
    first = F.lit("2026-08-02 07:00:00").cast("timestamp_ntz")
    df = learning(spark).withColumn("target_capture", F.when(F.col("entered_at") < first, F.col("target_capture")).otherwise(0))
    out = {r.night: r.status for r in md.loono_cv(df).collect()}
    assert out["2026-08-01"] == "skipped" and out["2026-08-02"] == "ok"
    assert md.fit_model(df.withColumn("target_capture", F.lit(0))) is None


def test_holdout_scores_are_marked(spark):
    df = learning(spark)
    fitted = md.fit_model(df)
    r = md.score_holdout(fitted, df.drop("elevation_m")).first()
    assert (r.status, r.rows, r.evaluation_mode, r.strict_no_leakage_eligible) == ("ok", 240, "DIAGNOSTIC_HINDSIGHT_WEATHER", False)
    assert 0 < r.mean_pred_prob < r.max_pred_prob < 1 and r.brier > 0
    assert md.score_holdout(fitted, df.where("1 = 0")).first().status == "no-holdout"


def test_rank_risk_and_peak(spark):
    df = spark.createDataFrame(
        [("a", at("2026-08-01 23:10"), 1, 2), ("a", at("2026-08-01 22:10"), 0, 0), ("b", at("2026-08-01 22:20"), 0, 0)],
        "segment_id string, entered_at timestamp_ntz, target_capture int, target_individuals int",
    )
    g = (1 + 1) / (3 + 100)
    top = rp.rank_segments(df, 1).first()
    assert top.segment_id == "a" and top.smoothed_rate == pytest.approx((1 + g * 20) / 22)
    peak = rp.peak_hour(df).first()
    assert (peak.provisional_peak_start, peak.provisional_peak_end) == ("23:00", "00:00")
    segs = spark.createDataFrame([("a",), ("c",)], "segment_id string")
    risk = {r.segment_id: r for r in rp.segment_risk(segs, df).collect()}
    g2 = (1 + 1) / (2 + 100)
    assert risk["c"].unvisited == 1 and risk["c"].risk == pytest.approx(g2)
    rates = {r.feature: (r.present, r.missing_rate) for r in rp.missing_rates(df, {"x": ["segment_id", "nope"]}).collect()}
    assert rates == {"segment_id": (True, 0.0), "nope": (False, None)}


def test_a_table_of_one_class_has_no_fit_but_a_report(spark):
    one = learning(spark).withColumn("target_capture", F.lit(1))
    fitted = md.fit_model(one)
    assert fitted is None
    assert md.coefficient_table(fitted, spark).collect() == []
    row = md.score_holdout(fitted, one).first()
    assert (row["rows"], row["positive_rows"], row["status"], row["brier"]) == (240, 240, "insufficient-data", None)
    assert md.score_holdout(fitted, one).columns == md.score_holdout(md.fit_model(learning(spark)), one).columns


def test_folds_of_one_class_are_told_by_their_counts(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a fold of one class was prepared")

    monkeypatch.setattr(md, "_terms", never)
    found = md.loono_cv(learning(spark).withColumn("target_capture", F.lit(1)))
    assert {r["status"] for r in found.collect()} == {"skipped"}
