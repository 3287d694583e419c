"""Building blocks of the check queries, in DuckDB SQL.

They state each operator the textbook way (calendar tables, row-level windows),
not the way the Spark operators are built, so that the two check each other.
"""

from __future__ import annotations

from pricewatch.catalog.fixture import SETTINGS

HORIZONS = ", ".join(
    f"('{h.name}', {h.days}, date '{h.train_end}', {SETTINGS.weights(h.name).arima},"
    f" {SETTINGS.weights(h.name).seasonal})"
    for h in SETTINGS.horizons
)
WINDOWS = ", ".join(
    f"('{w.name}', {w.days}, date '{w.train_end}', date '{w.start}', date '{w.end}',"
    f" {SETTINGS.weights(w.name).arima}, {SETTINGS.weights(w.name).seasonal})"
    for w in SETTINGS.eval_windows
)
HORIZON_CFG = (
    f"horizon_cfg as (select * from (values {HORIZONS}) t(horizon, steps, train_end, wa, ws))"
)
WINDOW_CFG = (
    f"window_cfg as (select * from (values {WINDOWS})"
    " t(horizon, steps, train_end, start_date, end_date, wa, ws))"
)


def _panel(name: str, series: str, day: str, amount: str, source: str) -> str:
    cents = f"cast(sum(cast({amount} as decimal(18,2))) * 100 as bigint)"
    return (
        f"{name} as (select {series} as series_id, cast({day} as date) as date,"
        f" (({cents} * 2 + count(*)) // (2 * count(*))) / cast(100 as double) as price"
        f" from {source} group by 1, 2)"
    )


PRICE_OBS = _panel("price_obs", "o_orderpriority", "o_orderdate", "o_totalprice", "orders")
PRICE_OBS_BRAND = _panel(
    "price_obs_brand",
    "p_brand",
    "l_shipdate",
    "l_extendedprice",
    "lineitem join part on l_partkey = p_partkey",
)
PRICE_OBS_SUPPLIER = _panel(
    "price_obs_supplier",
    "cast(l_suppkey as varchar)",
    "l_shipdate",
    "l_extendedprice",
    "lineitem",
)
PRICE_OBS_EVENT = _panel("price_obs_event", "event_type", "ts", "value", "events")
PRICE_OBS_MARKET = _panel(
    "price_obs_market",
    "cast(c_nationkey as varchar) || '|' || o_orderpriority",
    "o_orderdate",
    "o_totalprice",
    "orders join customer on o_custkey = c_custkey",
)
PRICE_OBS_EDGE = (
    PRICE_OBS
    + """, price_obs_edge as (
  select series_id, date,
         case when max(date) over (partition by series_id) - date <
              case series_id when '1-URGENT' then 10 when '3-MEDIUM' then 20 when '2-HIGH' then 70
                             when '5-LOW' then 100 else 0 end
              then cast(250000 as double) else price end as price
  from price_obs)"""
)
PRICE_OBS_NULL = (
    PRICE_OBS
    + """, price_obs_null as (
  select series_id, date,
         case when day(date) = 1 then null when day(date) in (2, 15) then cast(0 as double)
              else price end as price
  from price_obs)"""
)
RAW_UPLOAD = """raw_upload as (
  select cast(year(o_orderdate) as int) as file_no, o_orderkey as row_no,
         case when o_orderstatus = 'O' then strftime(o_orderdate, '%Y-%m-%d')
              else strftime(o_orderdate, '%d/%m/%Y') end as tanggal,
         case day(o_orderdate)
              when 31 then 'n/a' when 30 then '0' when 29 then null
              else cast(cast(floor(o_totalprice / 1000) as bigint) as varchar) || '.' ||
                   lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as varchar), 3, '0') end as harga
  from orders)"""


def parsed(source: str) -> str:
    """Typed rows of a raw sheet; date and price are null where they do not parse."""
    return f"""parsed as (
  select file_no, row_no, try_cast(replace(replace(trim(harga), '.', ''), ',', '') as double) as price,
         harga,
         cast(coalesce(try_strptime(trim(tanggal), '%d/%m/%Y'),
                       try_strptime(trim(tanggal), '%Y-%m-%d')) as date) as date
  from {source})"""


def daily(
    name: str,
    source: str,
    keys: str = "series_id",
    limit: int | None = 30,
    zero_as_missing: bool = True,
    fill_edges: bool = True,
) -> str:
    """Calendar join plus nearest known neighbours on both sides."""
    price = "case when o.price <> 0 then o.price end" if zero_as_missing else "o.price"
    step = "(date - pd)" if limit is None else f"least(date - pd, {limit})"
    lead_in = "nv" if fill_edges else "null"
    back = f"(partition by {keys} order by date rows between unbounded preceding and current row)"
    ahead = f"(partition by {keys} order by date rows between current row and unbounded following)"
    return f"""{name}_cal as (
  select {keys}, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
  from {source} group by {keys}),
{name}_row as (
  select {', '.join('c.' + k.strip() for k in keys.split(','))}, c.date, {price} as p
  from {name}_cal c left join {source} o using ({keys}, date)),
{name}_near as (
  select *, last_value(p ignore nulls) over {back} as pv,
         last_value(case when p is not null then date end ignore nulls) over {back} as pd,
         first_value(p ignore nulls) over {ahead} as nv,
         first_value(case when p is not null then date end ignore nulls) over {ahead} as nd
  from {name}_row),
{name} as (
  select {keys}, date, p is not null as is_observed,
         case when p is not null then p when pd is null then {lead_in} when nd is null then pv
              else pv + (nv - pv) * {step} / (nd - pd) end as price,
         cast(row_number() over (partition by {keys} order by date desc) as int) as rn
  from {name}_near)"""


def ari_fit(name: str, source: str, keys: str) -> str:
    """AR(1) on differences of the log price, by regression aggregates."""
    o = f"(partition by {keys} order by date)"
    return f"""{name}_y as (
  select {keys}, date, ln(price) as y from {source} where price > 0),
{name}_dy as (select *, y - lag(y) over {o} as dy from {name}_y),
{name}_dx as (select *, lag(dy) over {o} as dx from {name}_dy),
{name}_reg as (
  select {keys}, max(date) as last_date, arg_max(y, date) as y_last, arg_max(dy, date) as d0,
         case when var_pop(dx) filter (dy is not null) > 0 then regr_slope(dy, dx) end as b,
         regr_avgy(dy, dx) as my, regr_avgx(dy, dx) as mx
  from {name}_dx group by {keys}),
{name} as (
  select {keys}, last_date, y_last,
         case when b is null then 0 else d0 end as d_last,
         case when b is null then 0 else greatest(-0.999, least(b, 0.999)) end as phi,
         case when b is null then 0
              else (my - greatest(-0.999, least(b, 0.999)) * mx) / (1 - greatest(-0.999, least(b, 0.999))) end as mu
  from {name}_reg)"""


def ari_at(h: str, f: str) -> str:
    return (
        f"exp({f}.y_last + {h} * {f}.mu + ({f}.d_last - {f}.mu) * {f}.phi"
        f" * (1 - pow({f}.phi, {h})) / (1 - {f}.phi))"
    )


def seasonal_fit(name: str, source: str, keys: str, target: str = "price") -> str:
    """Row-level trend, then month means, then weekday means of what is left."""
    return f"""{name}_t as (
  select {keys}, date, {target} as y,
         cast(date - max(date) over (partition by {keys}) as double) as t,
         max(date) over (partition by {keys}) as last_date
  from {source} where price is not null),
{name}_trend as (
  select {keys}, max(last_date) as last_date, count(*) as n_train,
         case when count(*) > 1 then regr_slope(y, t) else 0 end as slope,
         case when count(*) > 1 then regr_intercept(y, t) else avg(y) end as level
  from {name}_t group by {keys}),
{name}_r as (
  select {keys}, date, y - level - slope * t as r, month(date) as mon, dayofweek(date) + 1 as dow
  from {name}_t join {name}_trend using ({keys})),
{name}_mon as (select {keys}, mon, avg(r) as m from {name}_r group by {keys}, mon),
{name}_r2 as (select *, r - m as r2 from {name}_r join {name}_mon using ({keys}, mon)),
{name}_dow as (select {keys}, dow, avg(r2) as w from {name}_r2 group by {keys}, dow),
{name}_sd as (
  select {keys}, case when count(*) > 1 then sqrt(sum(pow(r2 - w, 2)) / (count(*) - 1)) else 0 end as sigma
  from {name}_r2 join {name}_dow using ({keys}, dow) group by {keys}),
{name} as (select * from {name}_trend join {name}_sd using ({keys}))"""


def seasonal_joins(name: str, keys: str, rows: str = "s", day: str = "s.model_date") -> str:
    """Joins of the month and weekday effects of fit ``name`` to forecast rows."""
    on_m = " and ".join(f"sm.{k.strip()} = {rows}.{k.strip()}" for k in keys.split(","))
    on_w = " and ".join(f"sw.{k.strip()} = {rows}.{k.strip()}" for k in keys.split(","))
    return (
        f" left join {name}_mon sm on {on_m} and sm.mon = month({day})"
        f" left join {name}_dow sw on {on_w} and sw.dow = dayofweek({day}) + 1"
    )


def seasonal_at(h: str, f: str) -> str:
    return f"({f}.level + {f}.slope * {h} + coalesce(sm.m, 0) + coalesce(sw.w, 0))"


def query(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select
