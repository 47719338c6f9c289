"""Occurrence model: balanced L2 logistic regression, validated by leaving out whole nights."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import finite
from ..functions.timeops import night_key
from ..session import checkpointed
from .ordered import quantiles
from .report import average_precision, brier

# Fixed feature names; the wildlife columns found in the table are added to them.
BASE_FEATURES = (
    "sin_hour",
    "cos_hour",
    "mean_speed_mps",
    "elevation_m",
    "rain_1h_mm",
    "rain_3h_mm",
    "rain_6h_mm",
    "rain_12h_mm",
    "rain_24h_mm",
    "rain_48h_mm",
    "temperature_c",
    "humidity_pct",
    "dew_point_c",
    "hours_since_rain",
    "curvature_deg",
    "segment_prior_visits",
    "slope_observed_deg",
    "local_relief_proxy_m",
    "road_class_code",
    "junction_distance_m",
    "stream_distance_m",
    "coast_distance_m",
    "forest_distance_m",
    "farmland_distance_m",
    "residential_distance_m",
)
WEIGHT = "_weight"


def feature_names(table: DataFrame) -> list[str]:
    bio = [
        c
        for c in table.columns
        if c.startswith("bio_") and (c.endswith("_count") or c.endswith("_nearest_m"))
    ]
    return [c for c in BASE_FEATURES if c in table.columns] + bio


def training_table(learning: DataFrame, features: list[str]) -> DataFrame:
    """Night, 0/1 label and finite features only: the narrow table every fit reads."""
    return learning.select(
        night_key(F.col("entered_at")).alias("night"),
        F.col("target_capture").cast("int").alias("label"),
        *[finite(F.col(c)).alias(c) for c in features],
    )


@dataclass(frozen=True)
class Fitted:
    """Preparation values and coefficients of one fit; a term is (name, expression)."""

    features: list[str]
    terms: dict[str, str]
    model: LogisticRegressionModel
    rows: int
    positives: int

    def pipeline(self) -> PipelineModel:
        """The fit as a pipeline that can be saved and loaded."""
        return PipelineModel([*_preparation(self.terms), self.model])

    def score(self, table: DataFrame) -> DataFrame:
        """Rows with `probability`, computed from the coefficients without leaving the JVM rows."""
        margin: Column = F.lit(float(self.model.intercept))
        for weight, expression in zip(self.model.coefficients, self.terms.values()):
            margin = margin + F.lit(float(weight)) * F.expr(expression)
        return table.withColumn("probability", 1.0 / (1.0 + F.exp(-margin)))


def _preparation(terms: dict[str, str]) -> list:
    columns = ", ".join(f"{expression} AS `{name}`" for name, expression in terms.items())
    return [
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        VectorAssembler(inputCols=list(terms), outputCol="features"),
    ]


def _terms(train: DataFrame, features: list[str], group_rows: int | None) -> tuple[dict[str, str], int, int]:
    """Median filling, a flag per feature that has gaps, then zero mean and unit variance."""
    first = train.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("label").alias("_positives"),
        *[F.count_if(F.col(c).isNull()).alias(f"_gaps_{i}") for i, c in enumerate(features)],
    ).first()
    # all features are ranked in one keyed pass over counted values, however many values they have
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])
    long = train.select(F.explode(pairs).alias("_p")).select("_p.*")
    ranked = quantiles(long, ["feature"], F.col("value"), {"median": 0.5}, group_rows=group_rows)
    medians = {r["feature"]: r["median"] for r in ranked.collect()}
    raw: dict[str, str] = {}
    for i, c in enumerate(features):
        if medians.get(i) is not None:
            raw[f"z_{i}"] = f"coalesce(`{c}`, {medians[i]!r}D)"
    for i, c in enumerate(features):
        if first[f"_gaps_{i}"] and f"z_{i}" in raw:
            raw[f"gap_{i}"] = f"cast(`{c}` IS NULL AS double)"
    moments = train.agg(
        *[F.avg(F.expr(e)).alias(f"m_{n}") for n, e in raw.items()],
        *[F.stddev_pop(F.expr(e)).alias(f"s_{n}") for n, e in raw.items()],
    ).first()
    scaled = {
        n: f"(({e}) - {moments[f'm_{n}']!r}D) / {(moments[f's_{n}'] or 1.0)!r}D" for n, e in raw.items()
    }
    return scaled, int(first["_rows"] or 0), int(first["_positives"] or 0)


def fit(
    train: DataFrame, features: list[str], c: float = 0.2, *, group_rows: int | None = None
) -> Fitted | None:
    """Fit on a `training_table`; None when only one class is present."""
    terms, rows, positives = _terms(train, features, group_rows)
    if positives == 0 or positives == rows:
        return None
    weight = F.when(F.col("label") == 1, rows / (2.0 * positives)).otherwise(
        rows / (2.0 * (rows - positives))
    )
    prepared = PipelineModel(_preparation(terms)).transform(train).select(
        "features", "label", weight.alias(WEIGHT)
    )
    # The penalty of a fit with strength 1/C on summed losses, for averaged losses.
    estimator = LogisticRegression(
        weightCol=WEIGHT,
        regParam=1.0 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=200,
        tol=1e-7,
    )
    return Fitted(features, terms, estimator.fit(prepared), rows, positives)


def fit_model(learning: DataFrame, c: float = 0.2) -> Fitted | None:
    features = feature_names(learning)
    return fit(checkpointed(training_table(learning, features)), features, c)


def coefficient_table(fitted: Fitted | None, spark) -> DataFrame:
    """Coefficients by feature; no rows where the fit had one class only."""
    rows = [] if fitted is None else [("intercept", float(fitted.model.intercept))]
    for name, weight in zip(fitted.terms, fitted.model.coefficients) if fitted is not None else ():
        kind, index = name.split("_")
        label = fitted.features[int(index)]
        rows.append((label if kind == "z" else f"{label}_missing", float(weight)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def loono_cv(learning: DataFrame, c: float = 0.2, parallelism: int = 4) -> DataFrame:
    """Leave-one-night-out validation: a row per night and one, `all`, over the pooled rows.

    Nights are refit side by side like the folds of a cross validator. The table is materialised
    once; a held-out night is scored by its own fit only, so all predictions come from one union.
    """
    features = feature_names(learning)
    table = checkpointed(training_table(learning, features))
    counts = {
        r["night"]: (r["n"], r["p"])
        for r in table.groupBy("night")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        .collect()
    }

    rows, positives = (sum(int(c[i] or 0) for c in counts.values()) for i in (0, 1))

    def one(night: str) -> DataFrame | None:
        others = positives - int(counts[night][1] or 0)
        # the counts tell a fold of one class before any pass over its rows
        if others in (0, rows - counts[night][0]):
            return None
        fitted = fit(table.where(F.col("night") != night), features, c)
        if fitted is None:
            return None
        return fitted.score(table.where(F.col("night") == night)).select(
            "night", "label", "probability"
        )

    with ThreadPool(parallelism) as pool:
        scored = pool.map(inheritable_thread_target(table.sparkSession)(one), sorted(counts))
    held_out = [s for s in scored if s is not None]
    spark = table.sparkSession
    nights = spark.createDataFrame(
        [(n, int(counts[n][0]), int(counts[n][1])) for n in sorted(counts)],
        "night string, rows bigint, positives bigint",
    )
    if not held_out:
        return nights.select("*", F.lit("skipped").alias("status"), *_no_scores())
    pooled = held_out[0]
    for part in held_out[1:]:
        pooled = pooled.unionByName(part)
    pooled = checkpointed(pooled)
    per_night = brier(pooled, ["night"]).join(average_precision(pooled, ["night"]), "night")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    folds = nights.join(per_night, "night", "left").select(
        "*", F.when(F.col("brier").isNull(), "skipped").otherwise("ok").alias("status")
    ).withColumn("average_precision", F.when(both, F.col("average_precision")))
    total = pooled.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives")).select(
        F.lit("all").alias("night"),
        "rows",
        "positives",
        brier(pooled).scalar().alias("brier"),
        average_precision(pooled).scalar().alias("average_precision"),
        F.lit("ok").alias("status"),
    )
    return folds.unionByName(total)


def model_report(learning: DataFrame, fitted: Fitted | None, c: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """One row about the fit on `learning` (training Brier, out-of-fold scores), and the folds behind it.

    Where the fit had one class only, the row has the status `insufficient-data` and there are no folds.
    """
    spark = learning.sparkSession
    schema = "status string, rows bigint, positives bigint, features array<string>, cv_method string"
    folds = loono_cv(learning, c) if fitted is not None else None
    if folds is None:
        none = spark.createDataFrame([("insufficient-data", None, None, None, None)], schema)
        names = ("brier_train", "brier_loono", "pr_auc_loono")
        counts = [F.lit(None).cast("bigint").alias(n) for n in ("oof_rows", "oof_positives")]
        empty = spark.createDataFrame(
            [], "night string, rows bigint, positives bigint, brier double, average_precision double, status string"
        )
        return none.select("*", *[F.lit(None).cast("double").alias(n) for n in names], *counts), empty
    folds = checkpointed(folds)
    pooled = folds.where(F.col("night") == "all")
    # scores of a pool with one class say nothing
    both = pooled.where((F.col("positives") > 0) & (F.col("positives") < F.col("rows")))
    trained = brier(fitted.score(training_table(learning, fitted.features)))
    head = spark.createDataFrame(
        [("ok", fitted.rows, fitted.positives, fitted.features, "leave-one-survey-night-out")], schema
    )
    report = head.select(
        "*",
        trained.select("brier").scalar().alias("brier_train"),
        both.select("brier").scalar().alias("brier_loono"),
        both.select("average_precision").scalar().alias("pr_auc_loono"),
        both.select("rows").scalar().alias("oof_rows"),
        both.select("positives").scalar().alias("oof_positives"),
    )
    return report, folds.where(F.col("night") != "all")


def _no_scores() -> list[Column]:
    return [F.lit(None).cast("double").alias(c) for c in ("brier", "average_precision")]


def score_holdout(fitted: Fitted | None, holdout: DataFrame) -> DataFrame:
    """Summary of the hold-out scores, marked as diagnostic.

    The weather features are measurements made after the fact, so these scores say nothing
    about a forecast issued before the night. Without a fit (one class only) the rows are counted
    and there are no scores.
    """
    if fitted is None:
        label = F.col("target_capture").cast("bigint")
        counted = holdout.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).alias("positive_rows")
        )
        none = [F.lit(None).cast("double").alias(c) for c in ("mean_pred_prob", "max_pred_prob", "brier")]
        return mark_diagnostic(counted.select("*", *none, F.lit("insufficient-data").alias("status")))
    missing = [c for c in fitted.features if c not in holdout.columns]
    table = training_table(
        holdout.withColumns({c: F.lit(None).cast("double") for c in missing}), fitted.features
    )
    scored = fitted.score(table)
    error = F.col("probability") - F.col("label")
    summary = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("positive_rows"),
        F.avg("probability").alias("mean_pred_prob"),
        F.max("probability").alias("max_pred_prob"),
        F.avg(error * error).alias("brier"),
    )
    both = (F.col("positive_rows") > 0) & (F.col("positive_rows") < F.col("rows"))
    marked = summary.withColumns(
        {
            "brier": F.when(both, F.col("brier")),
            "status": F.when(F.col("rows") > 0, "ok").otherwise("no-holdout"),
        }
    )
    return mark_diagnostic(marked)


def mark_diagnostic(scores: DataFrame) -> DataFrame:
    return scores.withColumns(
        {
            "evaluation_mode": F.lit("DIAGNOSTIC_HINDSIGHT_WEATHER"),
            "strict_no_leakage_eligible": F.lit(False),
            "weather_feature_source": F.lit("archive_actual_or_reanalysis"),
            "strict_blocker": F.lit("needs a forecast frozen before the night"),
        }
    )
