"""Offline comparison of models on the backtest windows, for whole panels.

Training and test rows come from one scan of the panel. Predictions are
expressions over the fitted parameters, evaluated on the actual rows, so no
forecast table is built or joined step by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricewatch.config import DEFAULT, Settings
from pricewatch.functions import literals
from pricewatch.functions.numeric import clip_negative
from pricewatch.operators import calendar, closed_form, metrics
from pricewatch.operators.regularise import MODEL, segments
from pricewatch.plans import forecasting

KEYS = ("series_id", "horizon")


def window_days(placed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows inside each test window, with the window's columns; a row without a price keeps a null.

    The windows that hold a row are chosen before the explode, so other rows are never multiplied. No
    condition here can move below the exchange of ``placed``, so other readers of it share that exchange.
    """
    day = F.col("date")
    mine = F.filter(
        literals.window_rows(settings.eval_windows, settings),
        lambda w: (day >= w["start"]) & (day < F.date_add(w["start"], w["steps"])),
    )
    return placed.select("series_id", "date", "price", F.explode(mine).alias("_w")).select(
        "series_id", "date", "price", "_w.*"
    )


def actual_rows(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows inside each test window; ``step`` is the position of the row in its window.

    Rows without a price take no position and stay, for metrics pass over them.
    """
    position = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return window_days(obs, settings).select(
        *KEYS, "date", "price", F.count("price").over(position).cast("int").alias("step")
    )


def dated_pairs(placed: DataFrame, fits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Test rows with the blended forecast of their date, null beyond a fit's last step.

    ``fits`` come from the same placed panel; both are read from one exchange and joined in place.
    """
    ahead = F.datediff("date", "last_date")
    known = (ahead >= 1) & (ahead <= F.col("steps"))
    actual = window_days(placed, settings).select(*KEYS, "date", "price")
    joined = actual.join(fits, list(KEYS))
    yhat = forecasting.blended_at(F.when(known, ahead))[0]
    return joined.select(*KEYS, "date", "price", yhat.alias("yhat"))


def backtest_metrics(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``rmse``, ``mape`` and ``n`` of the blended backtest per series and horizon, aligned by date."""
    placed = forecasting.place(obs)
    pairs = dated_pairs(placed, forecasting.backtest_fits(placed, settings), settings)
    return metrics.evaluate(pairs, KEYS).filter(F.col("n") > 0)


def backtest_searched_metrics(obs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`backtest_metrics` of the searched and the changepoint model."""
    placed = forecasting.place(obs)
    ahead = F.datediff("date", "last_date")
    known = (ahead >= 1) & (ahead <= F.col("steps"))
    paths = forecasting.backtest_paths(placed, settings)
    joined = window_days(placed, settings).select(*KEYS, "date", "price").join(paths, list(KEYS))
    at = F.when(known, ahead) - 1
    yhat = forecasting.blend(F.get("arima_path", at), F.get("yhat", at))
    return metrics.evaluate(joined.select(*KEYS, "price", yhat.alias("yhat")), KEYS).filter(F.col("n") > 0)


def _step(align: str) -> Column:
    """Pairing of actual rows with forecast steps.

    ``position``: the k-th actual row meets the k-th step, whatever its date.
    ``date``: the step is the distance from the last training row.
    """
    if align == "position":
        return F.col("step")
    if align == "date":
        return F.datediff("date", "last_date")
    raise ValueError(f"align must be 'position' or 'date', not {align!r}")


def _predict(actual: DataFrame, fits: DataFrame, yhat: Column, align: str, name: str) -> DataFrame:
    """Adds the clipped prediction ``name``; series without a fit get null."""
    return (
        actual.join(fits, list(KEYS), "left")
        .withColumn("_step", _step(align).cast("double"))
        .withColumn(name, clip_negative(yhat))
        .select(*actual.columns, name)
    )


def predictions(
    obs: DataFrame, settings: Settings = DEFAULT, align: str = "position"
) -> DataFrame:
    """Actual rows with the predictions of the autoregressive and the seasonal model.

    Both models train on the raw rows up to the cut-off, not on the prepared
    series: the autoregressive model makes its own calendar, the seasonal model
    skips missing rows.
    """
    obs = forecasting.place(obs)
    train = calendar.training_rows(obs, settings.eval_windows, settings).drop("train_end")
    ari = closed_form.fit_ari(segments(train, KEYS, MODEL), KEYS, MODEL)
    seasonal = closed_form.fit_seasonal(train, KEYS)
    step = F.col("_step")
    actual = actual_rows(obs, settings)
    first = _predict(actual, ari, closed_form.ari_at(step), align, "yhat_arima")
    return _predict(first, seasonal, closed_form.seasonal_at(step)[0], align, "yhat_seasonal")


def compare_models(
    obs: DataFrame, settings: Settings = DEFAULT, align: str = "position"
) -> DataFrame:
    """eval_result: ``rmse``, ``mape`` and ``n`` per series, horizon and model."""
    actual = F.col("price")
    both = predictions(obs, settings, align).groupBy(*KEYS).agg(
        F.count("price").alias("_n"),
        *[
            F.struct(
                F.lit(model).alias("model"),
                metrics.rmse(actual, F.col(f"yhat_{model}")).alias("rmse"),
                metrics.mape(actual, F.col(f"yhat_{model}")).alias("mape"),
                F.count("price").alias("n"),
            ).alias(model)
            for model in ("arima", "seasonal")
        ]
    )
    return both.filter(F.col("_n") > 0).select(*KEYS, F.explode(F.array("arima", "seasonal")).alias("_r")).select(
        *KEYS, "_r.*"
    )


def compare_log_variants(
    obs: DataFrame, settings: Settings = DEFAULT, align: str = "position"
) -> DataFrame:
    """eval_result of the seasonal model with and without the log transform."""
    obs = forecasting.place(obs)
    train = calendar.training_rows(obs, settings.eval_windows, settings).drop("train_end")
    fits = closed_form.fit_seasonal_variants(train, KEYS)
    rows = actual_rows(obs, settings).join(fits, list(KEYS)).withColumn(
        "_step", _step(align).cast("double")
    )
    yhat = closed_form.seasonal_at(F.col("_step"), F.col("model") == "log")[0]
    return metrics.evaluate(rows.withColumn("yhat", clip_negative(yhat)), (*KEYS, "model")).filter(F.col("n") > 0)


def winner(results: DataFrame, first: str, second: str) -> DataFrame:
    """Model with the lower error per series and horizon; a tie goes to ``second``.

    So does a window of zeros, whose percentage error is undefined for both. A model that failed (no
    error of either kind) leaves the horizon without a winner.
    """

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return (
        results.groupBy(*KEYS)
        .agg(
            of(first, "mape").alias(f"mape_{first}"),
            of(second, "mape").alias(f"mape_{second}"),
            of(first, "rmse").alias(f"rmse_{first}"),
            of(second, "rmse").alias(f"rmse_{second}"),
        )
        .withColumn(
            "winner",
            F.when(F.col(f"mape_{first}") < F.col(f"mape_{second}"), first).when(
                F.col(f"rmse_{first}").isNotNull() & F.col(f"rmse_{second}").isNotNull(), second
            ),
        )
    )


def recommendation(results: DataFrame, first: str, second: str) -> DataFrame:
    """(series_id, horizon, model, rmse, mape) of the winner."""
    won = winner(results, first, second)

    def of_winner(metric: str) -> Column:
        return F.when(F.col("winner") == first, F.col(f"{metric}_{first}")).when(
            F.col("winner") == second, F.col(f"{metric}_{second}")
        )

    return won.select(
        *KEYS,
        F.col("winner").alias("model"),
        of_winner("rmse").alias("rmse"),
        of_winner("mape").alias("mape"),
    )
