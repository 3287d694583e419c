"""Check queries, second part: ingest, evaluation, risk, reports, tables."""

from __future__ import annotations

from pricewatch.catalog import sql
from pricewatch.catalog.fixture import SETTINGS
from pricewatch.catalog.oracles import (
    BACKTEST,
    BLEND,
    BLEND_LOWER,
    BLEND_UPPER,
    FEATURES,
    OPERATIONAL,
    SEASONS,
    risk_daily,
)
from pricewatch.catalog.sql import query

_START, _END = SETTINGS.chart_range

# One series of hand-kept prices; the sheet of 1998 uses another spelling.
_YEARLY = """yearly as (
  select 'all' as series_id, file_no, row_no,
         cast(coalesce(try_strptime(tanggal, '%d/%m/%Y'), try_strptime(tanggal, '%Y-%m-%d')) as date) as date,
         harga as price
  from raw_upload)"""

_BACKTEST_ROWS = f"""backtest as (
  select s.series_id, s.horizon, s.forecast_date, {BLEND} as yhat
  from s {SEASONS})"""
_OPERATIONAL_ROWS = f"""operational as (
  select s.series_id, s.horizon, s.h, s.steps, s.forecast_date, {BLEND} as yhat,
         {BLEND_LOWER} as yhat_lower, {BLEND_UPPER} as yhat_upper
  from (select x.*, c.steps from s x join horizon_cfg c using (horizon)) s {SEASONS})"""


def _pairs(model_keys: str = "series_id, horizon") -> str:
    """Test rows numbered inside their window."""
    return f"""actual as (
  select series_id, horizon, date, price,
         row_number() over (partition by {model_keys} order by date) as step
  from panel join window_cfg on date between start_date and end_date
  where price is not null)"""


_TRAIN_ROWS = """train_rows as (
  select series_id, horizon, date, price from panel join window_cfg on date <= train_end)"""
_KEYS = "series_id, horizon"


def _compare(panel_ctes: tuple[str, ...], panel: str, align: str = "position") -> tuple[str, ...]:
    """eval_result of both models; ``res`` holds the rows."""
    h_a = "a.step" if align == "position" else "(a.date - f.last_date)"
    return (
        *panel_ctes,
        f"panel as (select * from {panel})",
        sql.WINDOW_CFG,
        _TRAIN_ROWS,
        _pairs(),
        sql.daily("cal", "train_rows", _KEYS, limit=None, zero_as_missing=True, fill_edges=False),
        "cal_known as (select * from cal where price is not null)",
        sql.ari_fit("ari", "cal_known", _KEYS),
        sql.seasonal_fit("sea", "train_rows", _KEYS),
        f"""pred_a as (
  select a.*, greatest({sql.ari_at(h_a, 'f')}, 0) as yhat
  from actual a join ari f using (series_id, horizon))""",
        f"""rows_s as (
  select a.*, f.level, f.slope, cast({h_a} as int) as h,
         cast(f.last_date + cast({h_a} as int) as date) as model_date
  from actual a join sea f using (series_id, horizon))""",
        f"""pred_s as (
  select s.series_id, s.horizon, s.date, s.price, greatest({sql.seasonal_at('s.h', 's')}, 0) as yhat
  from rows_s s {sql.seasonal_joins('sea', _KEYS)})""",
        """res as (
  select series_id, horizon, model, sqrt(avg(pow(price - yhat, 2))) as rmse,
         avg(abs((price - yhat) / price)) filter (price <> 0) * 100 as mape, count(*) as n
  from (select series_id, horizon, 'arima' as model, price, yhat from pred_a
        union all select series_id, horizon, 'seasonal', price, yhat from pred_s)
  group by series_id, horizon, model)""",
        """won as (
  select x.series_id, x.horizon, x.mape as mape_arima, y.mape as mape_seasonal,
         case when x.mape < y.mape then 'arima' else 'seasonal' end as winner
  from res x join res y on x.series_id = y.series_id and x.horizon = y.horizon
       and x.model = 'arima' and y.model = 'seasonal')""",
    )


_HORIZON_TEXT = (
    "case horizon when 'short' then '30 hari ke depan' when 'mid' then '6 bulan ke depan'"
    " when 'long' then '12 bulan ke depan' else horizon end"
)


def _risk(*panel_ctes: str, panel: str) -> tuple[str, ...]:
    """Risk rows of ``panel`` in ``risk``, from the operational forecast endpoints."""
    return (
        *panel_ctes,
        sql.daily("daily", panel),
        *OPERATIONAL,
        _OPERATIONAL_ROWS,
        risk_daily(panel),
        FEATURES,
        """raw_risk as (
  select f.*, c.horizon, o.yhat as forecast,
         case when abs(rolling_std) < 1e-10 then 0 else (o.yhat - moving_avg) / rolling_std end as fdi,
         case when seasonal_baseline > 0 then (o.yhat - seasonal_baseline) / seasonal_baseline * 100 end as dev
  from features f cross join horizon_cfg c
       left join operational o on o.series_id = f.series_id and o.horizon = c.horizon and o.h = o.steps)""",
        """parts as (
  select *, least(abs(fdi), 5) / 5 * 40 as fdi_score,
         least(greatest(vol_ratio - 1, 0) / 2 * 30, 30) as vol_score,
         case when direction = 'stable' then 0.0
              when (direction = 'down' and fdi > 0) or (direction = 'up' and fdi < 0) then 10.0
              else 20.0 end as trend_score,
         coalesce(least(abs(dev) / 30 * 10, 10), 0) as seasonal_score
  from raw_risk)""",
        """totals as (
  select *, case when fdi is not null then cast(least(round_even(
              fdi_score + vol_score + trend_score + seasonal_score, 0), 100) as int) end as total
  from parts)""",
        f"""risk as (
  select series_id, last_date as date, horizon, coalesce(total, 0) as risk_score,
         case when total is null or total < 30 then 'Normal' when total < 60 then 'Waspada' else 'Bahaya' end
           as risk_level,
         case when total is null then 'stable' else direction end as direction,
         case when total is null then 0 else fdi end as fdi_value,
         cast(case when total is null then 1 else vol_ratio end as double) as vol_ratio,
         case when total is null then 0 else trend_slope end as trend_slope,
         case when total is null then 'Data tidak cukup untuk kalkulasi risiko.' else
           'Forecast ' || {_HORIZON_TEXT} ||
           case when abs(fdi) < 0.5 then ' berada dalam rentang normal'
                else ' berpotensi ' || cast(cast(round_even(abs(fdi) * 15, 0) as bigint) as varchar) ||
                     case when fdi > 0 then '% di atas rata-rata 30 hari'
                          else '% di bawah rata-rata 30 hari' end end ||
           coalesce(' — ' || nullif(concat_ws(', ',
             case when vol_ratio >= 2.0 then 'volatilitas saat ini ' ||
                       cast(cast(round_even(vol_ratio, 1) as double) as varchar) || 'x lebih tinggi dari normal'
                  when vol_ratio >= 1.3 then 'volatilitas mulai meningkat (' ||
                       cast(cast(round_even(vol_ratio, 1) as double) as varchar) || 'x dari normal)' end,
             case direction when 'up' then 'tren harga cenderung naik dalam 7 hari terakhir'
                            when 'down' then 'tren harga cenderung turun dalam 7 hari terakhir' end), ''), '')
           || '.' end as risk_message,
         dev, fdi_score, vol_score, trend_score, seasonal_score, total
  from totals)""",
    )


_RISK_EDGE = _risk(sql.PRICE_OBS_EDGE, panel="price_obs_edge")
_RISK_ROUNDED = """
select series_id, date, horizon, risk_score, risk_level, direction,
       round(fdi_value, 6) + 0.0 as fdi_value, round(vol_ratio, 6) as vol_ratio,
       round(trend_slope, 6) + 0.0 as trend_slope, risk_message
from risk"""

_SEED = """seed as (
  select event_type as series_id, cast(ts as date) as date,
         case user_id % 3 when 0 then 'short' when 1 then 'mid' else 'long' end as horizon,
         cast(least(floor(value), 100) as int) as risk_score, value,
         case when least(floor(value), 100) < 30 then 'Normal'
              when least(floor(value), 100) < 60 then 'Waspada' else 'Bahaya' end as risk_level,
         date_trunc('hour', ts) as created_at, event_id as row_no, event_type
  from events)"""

_STORED_AND_BATCH = """fixes as (
  select series_id, date, price * 2 as price from price_obs where day(date) = 1),
last_rows as (
  select series_id, max(date) as last_date, arg_max(price, date) as price from price_obs group by series_id),
new_days as (
  select series_id, cast(last_date + cast(i as int) as date) as date, price
  from last_rows, unnest(generate_series(1, 30)) u(i)),
writes as (
  select series_id, date, price, 0 as batch_no from price_obs
  union all
  select series_id, date, price + b - 1, b from (select * from fixes union all select * from new_days),
         (values (1), (2)) v(b))"""
_LAST_WRITE = """
select series_id, date, cast(price as double) as price, cast(batch_no as int) as batch_no from (
  select *, row_number() over (partition by series_id, date order by batch_no desc) as rn from writes)
where rn = 1"""

_REQUIRED = """required as (
  select series_id, 'op' as scope, model, horizon, max(date) as anchor_date,
         count(*) filter (date = date '1999-12-31') as corrected
  from price_obs_supplier join horizon_cfg on date <= train_end,
       (values ('arima'), ('seasonal')) m(model)
  group by series_id, model, horizon)"""


def dashboard_payload(found: dict[str, str]) -> str:
    """Figures of every series from the checks of the single frames."""
    def total(column: str) -> str:
        return f"round(sum(coalesce({column}, 0)), 1) as {column}"

    lines = ", ".join(total(c) for c in ("actual", "mid_eval", "long_prod", "long_lower"))
    return f"""with lines as ({found["timeline"]}),
spread as ({found["volatility_chart"]}),
summary as ({found["forecast_summary"]}),
cards as ({found["risk_cards"]}),
per_line as (select series_id, cast(count(*) as int) as n_days, {lines} from lines group by series_id),
per_spread as (
  select series_id, cast(count(*) as int) as n_volatility, {total("volatility")} from spread group by series_id),
per_forecast as (select series_id, cast(sum(case horizon when 'short' then 30 when 'mid' then 180 else 365 end) as int)
  as n_forecast from cards group by series_id)
select l.series_id, n_days, actual, mid_eval, long_prod, long_lower, n_volatility, volatility, n_forecast,
       m.mape as mape_mid, g.avg_forecast as avg_long, c.risk_score as risk_short, d.risk_message as message_long
from per_line l join per_spread using (series_id) join per_forecast using (series_id)
left join summary m on m.series_id = l.series_id and m.horizon = 'mid'
left join summary g on g.series_id = l.series_id and g.horizon = 'long'
left join cards c on c.series_id = l.series_id and c.horizon = 'short'
left join cards d on d.series_id = l.series_id and d.horizon = 'long'"""


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    out["clean_upload"] = query(
        sql.RAW_UPLOAD,
        sql.parsed("raw_upload"),
        select="select file_no, row_no, date, price from parsed where price > 0",
    )
    out["import_files_valid"] = query(
        sql.RAW_UPLOAD,
        sql.parsed("raw_upload"),
        select="""
select file_no, row_no, date, price from parsed where file_no not in (1997, 1999) and price > 0
union all
select file_no, row_no, date, price from parsed
where file_no = 1997 and price > 0 and not exists (
  select 1 from parsed p where p.file_no = 1997 and p.harga is not null and p.price is null)""",
    )
    out["concat_years"] = query(
        sql.RAW_UPLOAD, _YEARLY, select="select series_id, file_no, row_no, date, price from yearly"
    )
    out["dedupe_first"] = query(
        sql.RAW_UPLOAD,
        _YEARLY,
        """ranked as (
  select *, row_number() over (partition by series_id, date order by file_no, row_no) as rn from yearly)""",
        select="""
select series_id, date, file_no, row_no, try_cast(price as double) as price
from ranked where rn = 1 and try_cast(price as double) > 0""",
    )
    out["upsert_prices"] = query(sql.PRICE_OBS, _STORED_AND_BATCH, select=_LAST_WRITE)
    out["upsert_table"] = out["upsert_prices"]
    out["append_unique"] = query(
        sql.PRICE_OBS,
        """refused as (
  select 1995 as y where exists (select 1 from price_obs where year(date) = 1995 and month(date) = 6)
  union all
  select 1997 where exists (select 1 from price_obs where date = date '1997-03-03'))""",
        select="""
select cast(year(date) as int) as file_no, series_id, date, price from price_obs
where year(date) not in (select y from refused)
union all
select cast(year(date) + 10000 as int), series_id, date, price from price_obs
where year(date) in (select y from refused) and month(date) = 12""",
    )
    out["safe_values"] = query(
        sql.PRICE_OBS_NULL,
        select="""
select series_id, strftime(date, '%Y-%m-%d') as day_text, strftime(date, '%Y%m%d') as day_key,
       cast(case when price is null or price = 0 then -1 else round_even(price / 700, 2) end as double) as share,
       cast(round_even(coalesce(price, 0) / 2000, 0) as double) as half,
       case when price is not null then greatest(round(price - 200000, 2), 0) end as clipped,
       round(ln(nullif(price, 0)), 8) as ln_price, round(ln(price + 1), 8) as ln1_price
from price_obs_null""",
    )
    out["train_slice"] = query(
        sql.PRICE_OBS,
        sql.WINDOW_CFG,
        select="""
select series_id, horizon, train_end, count(*) as n_rows, min(date) as first_date, max(date) as anchor_date
from price_obs join window_cfg on date <= train_end group by all""",
    )
    out["chart_window"] = query(
        sql.PRICE_OBS,
        select=f"select * from price_obs where date >= date '{_START}' and date <= date '{_END}'",
    )
    out["future_calendar"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.HORIZON_CFG,
        "lasts as (select series_id, max(date) as last_date from price_obs_supplier group by series_id)",
        select="""
select series_id, horizon, cast(h as int) as step, cast(train_end + cast(h as int) as date) as forecast_date,
       cast(train_end + cast(h as int) - last_date as int) as days_after_last
from lasts cross join horizon_cfg, unnest(generate_series(1, steps)) u(h)""",
    )
    out["backtest_metrics"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.daily("daily", "price_obs_supplier"),
        *BACKTEST,
        _BACKTEST_ROWS,
        select="""
select b.series_id, horizon,
       case when count(yhat) = count(*) then round(sqrt(avg(pow(price - yhat, 2))), 3) end as rmse,
       case when count(yhat) = count(*)
            then round(avg(abs((price - yhat) / price)) filter (price <> 0) * 100, 6) end as mape,
       count(*) as n
from backtest b join price_obs_supplier p on p.series_id = b.series_id and p.date = b.forecast_date
group by b.series_id, horizon""",
    )
    out["backtest_metrics_positional"] = query(
        *_compare((sql.PRICE_OBS_MARKET,), "price_obs_market"),
        select="select series_id, horizon, model, round(rmse, 3) as rmse, round(mape, 6) as mape, n from res",
    )
    out["model_winner"] = query(
        *_compare((sql.PRICE_OBS_NULL,), "price_obs_null"),
        select="""
select series_id, horizon, round(mape_arima, 6) as mape_arima, round(mape_seasonal, 6) as mape_seasonal, winner
from won""",
    )
    out["model_winner_by_date"] = query(
        *_compare((sql.PRICE_OBS_BRAND,), "price_obs_brand", align="date"),
        select="select series_id, horizon, winner from won",
    )
    variants = []
    for name, target, back in (("no", "price", "{}"), ("lg", "ln(price + 1)", "exp({}) - 1")):
        value = back.format(sql.seasonal_at("s.h", "s"))
        variants += [
            sql.seasonal_fit(name, "train_rows", _KEYS, target),
            f"""rows_{name} as (
  select a.*, f.level, f.slope, cast(a.step as int) as h,
         cast(f.last_date + cast(a.step as int) as date) as model_date
  from actual a join {name} f using (series_id, horizon))""",
            f"""mape_{name} as (
  select s.series_id, s.horizon,
         avg(abs((price - greatest({value}, 0)) / price)) filter (price <> 0) * 100 as mape
  from rows_{name} s {sql.seasonal_joins(name, _KEYS)} group by s.series_id, s.horizon)""",
        ]
    out["log_variant_winner"] = query(
        sql.PRICE_OBS_BRAND,
        "panel as (select * from price_obs_brand)",
        sql.WINDOW_CFG,
        _TRAIN_ROWS,
        _pairs(),
        *variants,
        select="""
select x.series_id, x.horizon, round(x.mape, 6) as mape_no_log, round(y.mape, 6) as mape_log,
       case when x.mape < y.mape then 'no_log' else 'log' end as winner
from mape_no x join mape_lg y using (series_id, horizon)""",
    )
    out["recommendation"] = query(
        *_compare((sql.PRICE_OBS,), "price_obs"),
        select="""
select series_id, horizon, winner as model, round(rmse, 3) as rmse, round(mape, 6) as mape
from won join res using (series_id, horizon) where model = winner""",
    )
    out["fdi"] = query(
        *_RISK_EDGE, select="select series_id, horizon, round(fdi_value, 6) + 0.0 as fdi_value from risk"
    )
    out["seasonal_deviation"] = query(
        *_risk(sql.PRICE_OBS, panel="price_obs"),
        select="select series_id, horizon, round(dev, 6) + 0.0 as seasonal_deviation from risk",
    )
    out["risk_score"] = query(
        *_RISK_EDGE,
        select="""
select series_id, horizon, risk_score,
       cast(round_even(fdi_score, 1) as double) as fdi_score, cast(round_even(vol_score, 1) as double) as vol_score,
       cast(trend_score as double) as trend_score,
       cast(round_even(seasonal_score, 1) as double) as seasonal_score
from risk""",
    )
    out["risk_level"] = query(
        *_RISK_EDGE, select="select series_id, horizon, risk_score, risk_level from risk"
    )
    out["risk_message"] = query(
        *_RISK_EDGE, select="select series_id, horizon, direction, risk_message from risk"
    )
    out["risk_fallback"] = query(
        sql.PRICE_OBS_BRAND,
        "lasts as (select series_id, max(date) as date from price_obs_brand group by series_id)",
        sql.HORIZON_CFG,
        select="""
select series_id, date, horizon, 0 as risk_score, 'Normal' as risk_level, 'stable' as direction,
       cast(0 as double) as fdi_value, cast(1 as double) as vol_ratio, cast(0 as double) as trend_slope,
       'Data tidak cukup untuk kalkulasi risiko.' as risk_message
from lasts cross join horizon_cfg""",
    )
    out["risk_assessment"] = query(
        *_risk(sql.PRICE_OBS_SUPPLIER, panel="price_obs_supplier"), select=_RISK_ROUNDED
    )
    out["risk_append"] = query(
        _SEED,
        select="""
select series_id, date, horizon, count(*) as n, cast(sum(risk_score) as bigint) as score_sum,
       max(round_even(value / 7, 4)) as fdi_max,
       min(case when value > 1 then round_even(value / 3, 4) else 1 end) as vol_min,
       max(case when event_type = 'error' then 0 else round_even(value - 5, 4) end) as slope_max
from seed group by series_id, date, horizon""",
    )
    out["risk_history"] = query(
        _SEED,
        select="""
select series_id, date, risk_score, risk_level, row_no from seed where horizon = 'short'
order by created_at desc, row_no desc limit 30""",
    )
    out["risk_latest"] = query(
        _SEED,
        select="""
select series_id, horizon, date, risk_score, risk_level, row_no from (
  select *, row_number() over (partition by series_id, horizon order by created_at desc, row_no desc) as rn
  from seed) where rn = 1""",
    )
    operational = (
        sql.PRICE_OBS,
        sql.daily("daily", "price_obs"),
        *OPERATIONAL,
        _OPERATIONAL_ROWS,
    )
    out["forecast_replace"] = query(
        *operational,
        select="""
select series_id, horizon, forecast_date,
       round(case when horizon = 'mid' then 2 * yhat else yhat end, 2) as yhat
from operational""",
    )
    out["timeline"] = query(
        *operational,
        # The backtest fits use the same names; they live in their own scope.
        "ops as (select * from operational)",
        "bt as (select * from (" + query(
            sql.PRICE_OBS, sql.daily("daily", "price_obs"), *BACKTEST, _BACKTEST_ROWS,
            select="select * from backtest",
        ) + "))",
        f"""stacked as (
  select series_id, date, 'actual' as line, price as v from price_obs
  where date between date '{_START}' and date '{_END}'
  union all select series_id, forecast_date, horizon || '_eval', yhat from bt
  union all select series_id, forecast_date, 'long_prod', yhat from ops where horizon = 'long'
  union all select series_id, forecast_date, 'long_lower', yhat_lower from ops where horizon = 'long'
  union all select series_id, forecast_date, 'long_upper', yhat_upper from ops where horizon = 'long')""",
        select="""
select series_id, date,
       round(max(v) filter (line = 'actual'), 2) as actual,
       round(max(v) filter (line = 'short_eval'), 2) as short_eval,
       round(max(v) filter (line = 'mid_eval'), 2) as mid_eval,
       round(max(v) filter (line = 'long_eval'), 2) as long_eval,
       round(max(v) filter (line = 'long_prod'), 2) as long_prod,
       round(max(v) filter (line = 'long_lower'), 2) as long_lower,
       round(max(v) filter (line = 'long_upper'), 2) as long_upper
from stacked group by series_id, date""",
    )
    out["forecast_summary"] = query(
        sql.PRICE_OBS,
        sql.daily("daily", "price_obs"),
        *BACKTEST,
        _BACKTEST_ROWS,
        select="""
select b.series_id, horizon, coalesce(round_even(avg(yhat), 2), 0) as avg_forecast,
       coalesce(case when count(*) filter (price is not null and yhat is null) = 0
                     then round_even(avg(abs((price - yhat) / price)) * 100, 2) end, 0) as mape,
       min(forecast_date) as forecast_start
from backtest b left join price_obs p on p.series_id = b.series_id and p.date = b.forecast_date
group by b.series_id, horizon""",
    )
    out["risk_cards"] = query(
        *_risk(sql.PRICE_OBS, panel="price_obs"),
        select="""
select series_id, horizon, risk_level, risk_score, round_even(fdi_value, 3) + 0.0 as fdi_value,
       round_even(vol_ratio, 2) as vol_ratio, direction, risk_message
from risk""",
    )
    out["refit_needed"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.HORIZON_CFG,
        _REQUIRED,
        select="""
select series_id, scope, model, horizon, anchor_date from required
where corrected > 0 or day(anchor_date) >= 24""",
    )
    out["fit_invalidate"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.HORIZON_CFG,
        _REQUIRED,
        select="""
select series_id, scope, model, horizon, anchor_date from required
where not (horizon = 'short' and model = 'arima')""",
    )
    out["fit_table_invalidate"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.HORIZON_CFG,
        sql.WINDOW_CFG,
        """held as (
  select series_id, 'operational' as scope, horizon, max(date) as anchor_date
  from price_obs_supplier join horizon_cfg on date <= train_end group by series_id, horizon
  union all
  select series_id, 'backtest', horizon, max(date)
  from price_obs_supplier join window_cfg on date <= train_end group by series_id, horizon)""",
        select="""
select series_id, scope, 'hybrid' as model, horizon, anchor_date, cast(28 as int) as n_params from held
where not (scope = 'backtest' and horizon = 'short')
  and not (horizon = 'long' and anchor_date = date '2001-07-31')""",
    )
    out["export_csv"] = query(
        *operational,
        select="""
select series_id, strftime(forecast_date, '%Y-%m-%d') as date, round(yhat, 2) as long_term_forecast
from operational where horizon = 'long'""",
    )
    out["stream_upsert"] = query(
        sql.RAW_UPLOAD,
        sql.parsed("raw_upload"),
        select="""
select 'all' as series_id, date, price, cast(file_no as int) as batch_no, row_no from (
  select *, row_number() over (partition by date order by file_no desc, row_no desc) as rn
  from parsed where price > 0 and date is not null)
where rn = 1""",
    )
    return out
