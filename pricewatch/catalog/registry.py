"""All registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewatch.catalog import job_oracles, oracles as base_oracles
from pricewatch.catalog import job_queries as jobs
from pricewatch.catalog import queries as base

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "price_scan": base.price_scan,
        "calendar_daily": base.calendar_daily,
        "interp_limit30": base.interp_limit30,
        "interp_limit30_null": base.interp_limit30_null,
        "interp_unbounded": base.interp_unbounded,
        "fill_ff_bf": base.fill_ff_bf,
        "flat_tail": base.flat_tail_days,
        "flat_tail_trim": base.flat_tail_trim,
        "rolling_mean_30": base.rolling_mean_30,
        "rolling_std_30": base.rolling_std_30,
        "volatility_chart": base.volatility_chart,
        "std_fallback": base.std_fallback,
        "vol_ratio": base.vol_ratio,
        "vol_ratio_short_window": base.vol_ratio_short_window,
        "trend_slope": base.trend_slope,
        "latest_rows": base.latest_rows,
        "seasonal_baseline": base.seasonal_baseline,
        "series_stats": base.series_stats,
        "ari_params": base.ari_params,
        "ari_forecast": base.ari_forecast,
        "seasonal_params": base.seasonal_params,
        "seasonal_forecast": base.seasonal_forecast,
        "seasonal_forecast_log": base.seasonal_forecast_log,
        "hybrid_forecast": base.hybrid_forecast,
        "forecast_operational": base.forecast_operational,
        "backtest_forecast": base.backtest_forecast,
        "clean_upload": jobs.clean_upload,
        "import_files_valid": jobs.import_files_valid,
        "upload_file": jobs.upload_file,
        "import_folder": jobs.import_folder,
        "yearly_files": jobs.yearly_files,
        "concat_years": jobs.concat_years,
        "dedupe_first": jobs.dedupe_first,
        "upsert_prices": jobs.upsert_prices,
        "upsert_table": jobs.upsert_table,
        "append_unique": jobs.append_unique,
        "safe_values": jobs.safe_values,
        "train_slice": jobs.train_slice,
        "chart_window": jobs.chart_window,
        "future_calendar": jobs.future_calendar,
        "backtest_metrics": jobs.backtest_metrics,
        "backtest_metrics_positional": jobs.backtest_metrics_positional,
        "model_winner": jobs.model_winner,
        "model_winner_by_date": jobs.model_winner_by_date,
        "log_variant_winner": jobs.log_variant_winner,
        "recommendation": jobs.recommendation,
        "fdi": jobs.fdi,
        "seasonal_deviation": jobs.seasonal_deviation,
        "risk_score": jobs.risk_score,
        "risk_level": jobs.risk_level,
        "risk_message": jobs.risk_message,
        "risk_fallback": jobs.risk_fallback,
        "risk_assessment": jobs.risk_assessment,
        "risk_append": jobs.risk_append,
        "risk_history": jobs.risk_history,
        "risk_latest": jobs.risk_latest,
        "forecast_replace": jobs.forecast_replace,
        "timeline": jobs.timeline,
        "forecast_summary": jobs.forecast_summary,
        "risk_cards": jobs.risk_cards,
        "dashboard_payload": jobs.dashboard_payload,
        "refit_needed": jobs.refit_needed,
        "fit_invalidate": jobs.fit_invalidate,
        "forecast_from_stored_fits": jobs.forecast_from_stored_fits,
        "forecast_from_blocks": jobs.forecast_from_blocks,
        "fit_table_invalidate": jobs.fit_table_invalidate,
        "export_csv": jobs.export_csv,
        "stream_upsert": jobs.stream_upsert,
        "sarima_forecast": jobs.sarima_forecast,
        "seasonal_map_forecast": jobs.seasonal_map_forecast,
        "forecast_operational_searched": jobs.forecast_operational_searched,
        "backtest_searched_metrics": jobs.backtest_searched_metrics,
    }


def oracles() -> dict[str, str]:
    found = {**base_oracles.oracles(), **job_oracles.oracles()}
    found |= {
        "upload_file": found["clean_upload"],
        "import_folder": f"select file_no, date, price from ({found['import_files_valid']})",
        "yearly_files": found["dedupe_first"],
    }
    return {**found, "dashboard_payload": job_oracles.dashboard_payload(found)}
