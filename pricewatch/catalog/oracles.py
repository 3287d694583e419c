"""Check queries, first part: panels, calendars, windows, features, models."""

from __future__ import annotations

from pricewatch.catalog import sql
from pricewatch.catalog.fixture import SETTINGS
from pricewatch.catalog.sql import query

_LAST30 = "(partition by series_id order by date rows between 29 preceding and current row)"

_DAILY_BRAND = (sql.PRICE_OBS_BRAND, sql.daily("daily", "price_obs_brand"))


def _rolling(function: str, out: str, source: str) -> str:
    return query(
        *_DAILY_BRAND,
        select=f"""
select series_id, date,
       round(case when count(price) over {_LAST30} = 30 then {function}(price) over {_LAST30} end, 4) as {out}
from {source}""",
    )


def risk_daily(source: str) -> str:
    return sql.daily("rdaily", source, limit=None, zero_as_missing=False, fill_edges=False)


FEATURES = """last30 as (
  select series_id, count(price) as n30, avg(price) as a30, stddev_samp(price) as s30
  from rdaily where rn <= 30 group by series_id),
whole as (
  select series_id, avg(price) as a, stddev_samp(price) as s, max(date) as last_date,
         count(price) as n_priced from rdaily group by series_id),
tails as (
  select series_id, w, count(price) as n, stddev_samp(price) as sd, avg(price) as mean,
         regr_slope(price, cast(-rn as double)) as slope
  from rdaily cross join (values (7), (14), (30), (60), (90), (365)) v(w)
  where rn <= w and price is not null group by series_id, w),
ratio_in as (
  select series_id, n_priced,
         max(sd) filter (w = 90) as recent, max(sd) filter (w = 14) as fallback,
         max(sd) filter (w = 365) as baseline
  from tails join whole using (series_id) group by series_id, n_priced),
ratio as (
  select series_id,
         case when n_priced < 365 or baseline is null or baseline < 1e-10 then 1.0
              when coalesce(recent, 0) >= 1e-10 then least(recent / baseline, 20)
              when coalesce(fallback, 0) >= 1e-10 then least(fallback / baseline, 20)
              else 0.5 end as vol_ratio
  from ratio_in),
moving as (
  select *, row_number() over (partition by series_id order by w) as pick
  from tails where w in (7, 14, 30, 60) and n >= 3 and sd >= 1.0),
trend as (
  select w0.series_id,
         case when m.slope is null or m.mean = 0 then 0 else m.slope end as trend_slope,
         case when m.slope is null or m.mean = 0 then 'stable'
              when m.slope / m.mean * 100 > 0.5 then 'up'
              when m.slope / m.mean * 100 < -0.5 then 'down' else 'stable' end as direction
  from whole w0 left join (select * from moving where pick = 1) m using (series_id)),
season as (
  select series_id, case when count(*) >= 10 then avg(price) end as seasonal_baseline
  from rdaily join whole using (series_id) where month(date) = month(last_date) group by series_id),
features as (
  select series_id, last_date,
         case when n30 = 30 then a30 else a end as moving_avg,
         case when n30 = 30 and s30 > 1e-10 then s30 else s end as rolling_std,
         vol_ratio, trend_slope, direction, seasonal_baseline
  from whole left join last30 using (series_id) left join ratio using (series_id)
       left join trend using (series_id) left join season using (series_id))"""


def _three_months(name: str) -> str:
    return f"""steps as (
  select f.*, h, cast(last_date + cast(h as int) as date) as model_date
  from {name} f cross join (select unnest(generate_series(1, 90)) as h))"""


def _seasonal_forecast(log: bool) -> str:
    target = "ln(price + 1)" if log else "price"
    back = "exp({}) - 1" if log else "{}"
    value = sql.seasonal_at("h", "s")
    shown = {
        "yhat": value,
        "yhat_lower": f"{value} - 1.959964 * s.sigma",
        "yhat_upper": f"{value} + 1.959964 * s.sigma",
    }
    columns = ", ".join(f"round({back.format(v)}, 2) as {k}" for k, v in shown.items())
    return query(
        *_DAILY_BRAND,
        sql.seasonal_fit("fit", "daily", "series_id", target),
        _three_months("fit"),
        select=f"select s.series_id, model_date as forecast_date, {columns} from steps s"
        + sql.seasonal_joins("fit", "series_id"),
    )


CUTS = "cuts as (select distinct train_end from horizon_cfg)"
WINDOW_CUTS = "cuts as (select distinct train_end from window_cfg)"
TRAIN = "train as (select d.*, train_end from daily d join cuts on d.date <= train_end)"
CUT_KEYS = "series_id, train_end"

# Smallest tail whose deviation exceeds 1, per series and cut, then the trim rule.
TRIM = """backwards as (
  select *, row_number() over (partition by series_id, train_end order by date desc) as back,
         count(*) over (partition by series_id, train_end) as n_rows,
         stddev_samp(price) over (partition by series_id, train_end order by date desc
                                  rows between unbounded preceding and current row) as sd
  from train),
tail as (
  select series_id, train_end, any_value(n_rows) as n_rows,
         coalesce(min(back - 1) filter (sd > 1 and back between 2 and least(60, n_rows) - 1), 0) as flat_days
  from backwards group by series_id, train_end),
trimmed as (
  select b.* from backwards b join tail t using (series_id, train_end)
  where not (t.flat_days > 0 and t.flat_days < 0.10 * t.n_rows) or back > t.flat_days)"""


def hybrid(train: str) -> tuple[str, str]:
    return (
        sql.ari_fit("ari", train, CUT_KEYS),
        sql.seasonal_fit("sea", train, CUT_KEYS),
    )


OPERATIONAL_STEPS = """s as (
  select a.series_id, horizon, c.train_end, wa, ws, h, cast(s0.last_date + cast(h as int) as date) as model_date,
         cast(c.train_end + cast(h as int) as date) as forecast_date, s0.last_date, s0.level, s0.slope, s0.sigma,
         a.y_last, a.d_last, a.phi, a.mu
  from ari a join sea s0 using (series_id, train_end) join horizon_cfg c on c.train_end = a.train_end,
       unnest(generate_series(1, c.steps)) u(h))"""

BACKTEST_STEPS = """s0 as (
  select a.series_id, horizon, c.train_end, wa, ws, steps, k as step,
         cast(start_date + cast(k as int) - 1 as date) as forecast_date, f.last_date, f.level, f.slope, f.sigma,
         a.y_last, a.d_last, a.phi, a.mu
  from ari a join sea f using (series_id, train_end) join window_cfg c on c.train_end = a.train_end,
       unnest(generate_series(1, c.steps)) u(k)),
s as (
  select *, case when forecast_date - last_date between 1 and steps then forecast_date end as model_date,
         case when forecast_date - last_date between 1 and steps
              then cast(forecast_date - last_date as bigint) end as h
  from s0)"""

BLEND = f"({sql.ari_at('h', 's')} * wa + {sql.seasonal_at('h', 's')} * ws)"
BLEND_LOWER = f"({sql.ari_at('h', 's')} * wa + ({sql.seasonal_at('h', 's')} - 1.959964 * s.sigma) * ws)"
BLEND_UPPER = f"({sql.ari_at('h', 's')} * wa + ({sql.seasonal_at('h', 's')} + 1.959964 * s.sigma) * ws)"
SEASONS = sql.seasonal_joins("sea", CUT_KEYS)

OPERATIONAL = (sql.HORIZON_CFG, CUTS, TRAIN, TRIM, *hybrid("trimmed"), OPERATIONAL_STEPS)
BACKTEST = (sql.WINDOW_CFG, WINDOW_CUTS, TRAIN, *hybrid("train"), BACKTEST_STEPS)

_CHART_START, _CHART_END = SETTINGS.chart_range


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    out["price_scan"] = query(sql.PRICE_OBS, select="select * from price_obs order by series_id, date")
    out["calendar_daily"] = query(
        sql.PRICE_OBS_MARKET,
        sql.daily("daily", "price_obs_market", zero_as_missing=False),
        select="select series_id, date, p as price from daily_row",
    )
    out["interp_limit30"] = query(
        sql.PRICE_OBS_MARKET,
        sql.daily("daily", "price_obs_market"),
        select="select series_id, date, price, is_observed from daily",
    )
    out["interp_limit30_null"] = query(
        sql.PRICE_OBS_NULL,
        sql.daily("daily", "price_obs_null"),
        select="select series_id, date, price, is_observed from daily",
    )
    out["interp_unbounded"] = query(
        sql.PRICE_OBS_NULL,
        risk_daily("price_obs_null"),
        select="select series_id, date, price, is_observed, rn from rdaily",
    )
    out["fill_ff_bf"] = query(
        sql.PRICE_OBS_NULL,
        select="""
select series_id, date,
       coalesce(last_value(price ignore nulls) over (partition by series_id order by date
                  rows between unbounded preceding and current row),
                first_value(price ignore nulls) over (partition by series_id order by date
                  rows between current row and unbounded following)) as price
from price_obs_null""",
    )
    edge_tail = """backwards as (
  select *, row_number() over (partition by series_id order by date desc) as back,
         count(*) over (partition by series_id) as n_rows,
         stddev_samp(price) over (partition by series_id order by date desc
                                  rows between unbounded preceding and current row) as sd
  from price_obs_edge),
tail as (
  select series_id, any_value(n_rows) as n_rows,
         cast(coalesce(min(back - 1) filter (sd > 1 and back between 2 and least(60, n_rows) - 1), 0) as int)
           as flat_days
  from backwards group by series_id)"""
    out["flat_tail"] = query(sql.PRICE_OBS_EDGE, edge_tail, select="select * from tail")
    out["flat_tail_trim"] = query(
        sql.PRICE_OBS_EDGE,
        edge_tail,
        select="""
select series_id, date, price from backwards b join tail t using (series_id)
where not (t.flat_days > 0 and t.flat_days < 0.10 * t.n_rows) or back > t.flat_days""",
    )
    out["rolling_mean_30"] = _rolling("avg", "rolling_mean", "price_obs_brand")
    out["rolling_std_30"] = _rolling("stddev_samp", "rolling_std", "daily")
    out["volatility_chart"] = query(
        sql.PRICE_OBS,
        select=f"""
select * from (
  select series_id, date,
         round(coalesce(case when count(price) over {_LAST30} = 30
                             then stddev_samp(price) over {_LAST30} end, 0), 4) as volatility
  from price_obs)
where date between date '{_CHART_START}' and date '{_CHART_END}'""",
    )
    both = "both_obs as (select * from {} union all select * from price_obs_event)"
    out["std_fallback"] = query(
        sql.PRICE_OBS_EDGE,
        risk_daily("price_obs_edge"),
        FEATURES,
        select="select series_id, round(moving_avg, 4) as moving_avg, round(rolling_std, 4) as rolling_std from features",
    )
    out["vol_ratio"] = query(
        sql.PRICE_OBS_EDGE,
        sql.PRICE_OBS_EVENT,
        both.format("price_obs_edge"),
        risk_daily("both_obs"),
        FEATURES,
        select="select series_id, cast(round(vol_ratio, 6) as double) as vol_ratio from features",
    )
    out["vol_ratio_short_window"] = query(
        sql.PRICE_OBS_EDGE,
        risk_daily("price_obs_edge"),
        """sds as (
  select series_id, count(*) as n,
         stddev_samp(price) filter (rn <= 7) as recent, stddev_samp(price) filter (rn <= 14) as fallback,
         stddev_samp(price) filter (rn <= 30) as baseline
  from rdaily where price is not null group by series_id)""",
        select="""
select series_id,
       cast(round(case when n < 30 or coalesce(baseline, 0) < 1e-10 then 1.0
                       when recent >= 1e-10 then least(recent / baseline, 20)
                       when fallback >= 1e-10 then least(fallback / baseline, 20) else 0.5 end, 6) as double)
         as vol_ratio
from sds""",
    )
    out["trend_slope"] = query(
        sql.PRICE_OBS_EDGE,
        risk_daily("price_obs_edge"),
        FEATURES,
        select="select series_id, round(trend_slope, 4) + 0.0 as trend_slope, direction from features",
    )
    out["latest_rows"] = query(
        sql.PRICE_OBS_BRAND,
        select="""
select * from (
  select *, cast(row_number() over (partition by series_id order by date desc) as int) as rn
  from price_obs_brand)
where rn <= 7""",
    )
    out["seasonal_baseline"] = query(
        sql.PRICE_OBS,
        sql.PRICE_OBS_EVENT,
        both.format("price_obs"),
        risk_daily("both_obs"),
        FEATURES,
        select="select series_id, round(seasonal_baseline, 4) as seasonal_baseline from features",
    )
    out["series_stats"] = query(
        sql.PRICE_OBS_BRAND,
        select="""
select series_id, min(date) as first_date, max(date) as last_date, count(*) as n_rows,
       round(avg(price), 4) as mean_price, round(stddev_samp(price), 4) as std_price,
       arg_max(price, date) as last_price
from price_obs_brand group by series_id""",
    )
    ari = (*_DAILY_BRAND, sql.ari_fit("fit", "daily", "series_id"))
    out["ari_params"] = query(
        *ari,
        select="""
select series_id, last_date, round(y_last, 8) as y_last, round(d_last, 8) as d_last,
       round(phi, 8) as phi, round(mu, 8) as mu from fit""",
    )
    out["ari_forecast"] = query(
        *ari,
        _three_months("fit"),
        select=f"select series_id, model_date as forecast_date, round({sql.ari_at('h', 's')}, 2) as yhat from steps s",
    )
    out["seasonal_params"] = query(
        *_DAILY_BRAND,
        sql.seasonal_fit("fit", "daily", "series_id"),
        select="""
select series_id, n_train, round(level, 3) as level, round(slope, 6) as slope, round(sigma, 3) as sigma
from fit""",
    )
    out["seasonal_forecast"] = _seasonal_forecast(log=False)
    out["seasonal_forecast_log"] = _seasonal_forecast(log=True)
    out["hybrid_forecast"] = query(
        sql.PRICE_OBS_SUPPLIER,
        sql.daily("daily", "price_obs_supplier"),
        sql.HORIZON_CFG,
        CUTS,
        TRAIN,
        *hybrid("train"),
        OPERATIONAL_STEPS,
        select=f"select s.series_id, s.horizon, cast(h as int) as step, round({BLEND}, 2) as yhat from s" + SEASONS,
    )
    out["forecast_operational"] = query(
        sql.PRICE_OBS_EDGE,
        sql.daily("daily", "price_obs_edge"),
        *OPERATIONAL,
        select=f"""
select s.series_id, s.horizon, 'hybrid' as model, cast(h as int) as step, forecast_date,
       round({BLEND}, 2) as yhat, round({BLEND_LOWER}, 2) as yhat_lower,
       round({BLEND_UPPER}, 2) as yhat_upper,
       cast(s.train_end - s.last_date as int) as origin_gap_days
from s""" + SEASONS,
    )
    out["forecast_from_stored_fits"] = out["forecast_operational"]
    out["backtest_forecast"] = query(
        sql.PRICE_OBS_MARKET,
        sql.daily("daily", "price_obs_market"),
        *BACKTEST,
        select=f"""
select s.series_id, s.horizon, 'hybrid' as model, cast(s.step as int) as step, forecast_date,
       round({BLEND}, 2) as yhat, round({BLEND_LOWER}, 2) as yhat_lower,
       round({BLEND_UPPER}, 2) as yhat_upper
from s""" + SEASONS,
    )
    out["forecast_from_blocks"] = out["backtest_forecast"]
    return out
