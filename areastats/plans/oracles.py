"""The registered queries as SQL over the same tables."""

from __future__ import annotations

_DAILY = """
select event_type as gisjoin, cast(ts as date) as formatted_date,
       count(*) as cases, round(sum(value), 2) as total_value
from events group by 1, 2
"""

_DAILY_USER = """
select concat('U', user_id) as gisjoin, cast(ts as date) as formatted_date, count(*) as cases
from events group by 1, 2
"""

_READINGS = """
select concat('S', l_suppkey) as gis_join, l_shipdate as timestamp, l_orderkey, l_linenumber,
       l_quantity, l_discount, l_tax, l_extendedprice, l_extendedprice / 10000 as gross_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) / 10000 as net_price
from lineitem
"""

_STATE = """
select concat('R', n_regionkey) as gisjoin, count(*) as total_population,
       round(median(c_acctbal), 4) as median_household_income
from customer join nation on c_nationkey = n_nationkey group by 1
"""

_COUNTY = """
select concat('N', c_nationkey) as gisjoin, count(*) as total_population,
       round(median(c_acctbal), 4) as median_household_income
from customer group by 1
"""

_TRACT = """
select concat('C', c_custkey) as gisjoin, coalesce(n, 0) as total_population,
       c_acctbal as median_household_income
from customer left join (select o_custkey, count(*) as n from orders group by 1)
  on o_custkey = c_custkey
"""

_BLOCK = """
select concat('O', o_orderkey) as gisjoin, coalesce(n, 0) as total_population,
       o_totalprice as median_household_income
from orders left join (select l_orderkey, count(*) as n from lineitem group by 1)
  on l_orderkey = o_orderkey
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_SIDES = """
with l as (
  select concat('O', l_orderkey) as gisjoin, round(sum(l_extendedprice), 2) as price,
         sum(l_quantity) as quantity
  from lineitem group by 1
), r as (
  select case when o_orderstatus <> 'P' then concat('O', o_orderkey) end as gisjoin,
         o_totalprice as price, o_orderpriority
  from orders
)
"""

_NATIONS = """
with c as (
  select concat('N', c_nationkey) as gisjoin, count(*) as customers,
         round(sum(c_acctbal), 2) as balance
  from customer group by 1
), s as (
  select concat('N', s_nationkey) as gisjoin, count(*) as suppliers from supplier group by 1
), n as (
  select concat('N', n_nationkey) as gisjoin, n_name as name from nation
)
"""

_USER_EVENTS = """
select case when user_id <> 13 then concat('U', user_id) end as gisjoin,
       ts, event_id, event_type, value
from events
"""

_LATEST = f"""
select gisjoin, event_id, event_type, value from (
  select *, row_number() over (partition by gisjoin order by ts desc, event_id desc) as rn
  from ({_USER_EVENTS}) where gisjoin is not null
) where rn = 1
"""

_REQUEST = """
select * from (values (0, 'click'), (1, 'view'), (2, 'nosuch'), (3, 'click')) as q(req_ord, gisjoin)
"""

_IN_RANGE = "formatted_date between date '2024-01-05' and date '2024-01-20'"


_UNROUNDED_TRACT = f"""
select gisjoin,
       (total_population - min(total_population) over ())
         / cast(max(total_population) over () - min(total_population) over () as double) as x0,
       (median_household_income - min(median_household_income) over ())
         / (max(median_household_income) over () - min(median_household_income) over ()) as x1
from ({_TRACT})
"""

_SCALED_TRACT = f"select gisjoin, round(x0, 6) as x0, round(x1, 6) as x1 from ({_UNROUNDED_TRACT})"

_REQUESTED_FITS = "(values (0, 'S3'), (2, 'S1'), (3, 'S3'), (4, 'S2')) as q(req_ord, k)"


def _moving_average(frame: str) -> str:
    return f"""
select gisjoin, formatted_date, round(a, 6) as avg, 7 as num_days, start_date from (
  select gisjoin, formatted_date,
         avg(cases) over (partition by gisjoin order by formatted_date
                          rows between 6 preceding and current row) as a,
         min(formatted_date) over (partition by gisjoin) as start_date,
         row_number() over (partition by gisjoin order by formatted_date) as rn
  from ({frame})
) where rn >= 7
"""


def _one_feature(
    reg: float, elastic: float = 0.0, intercept: bool = True, standardization: bool = True
) -> str:
    """Closed form of penalised least squares with one feature, from population moments."""
    l1, l2 = f"({elastic * reg} / sy)", f"({(1 - elastic) * reg} / sy)"
    if not standardization:
        l1, l2 = f"({l1} / sx)", f"({l2} / vx)"
    if intercept:
        xx, xy, sst = "1.0", "cxy / (sx * sy)", "vy"
    else:
        xx, xy, sst = "((vx + mx * mx) / vx)", "(cxy + mx * my) / (sx * sy)", "(vy + my * my)"
    exact = elastic * reg == 0
    return f"""
with m as (
  select gis_join, avg(gross_price) as mx, avg(net_price) as my, var_pop(gross_price) as vx,
         var_pop(net_price) as vy, covar_pop(gross_price, net_price) as cxy,
         stddev_pop(gross_price) as sx, stddev_pop(net_price) as sy
  from ({_READINGS}) group by 1
), b as (
  select *, sign({xy}) * greatest(abs({xy}) - {l1}, 0) / ({xx} + {l2}) * sy / sx as slope from m
), f as (
  select *, {"my - slope * mx" if intercept else "cast(0 as double)"} as icept from b
), e as (
  select *, vy - 2 * slope * cxy + slope * slope * vx
            + (my - slope * mx - icept) * (my - slope * mx - icept) as mse
  from f
)
select gis_join, {"0" if exact else "cast(null as integer)"} as total_iterations,
       round(sqrt(mse), 6) as rmse, round(1 - mse / {sst}, 6) as r2,
       round(icept, 6) as intercept, round(slope, 6) as slope0,
       {"cast(0 as double)" if exact else "cast(null as double)"} as first_objective
from e
"""


_TWO_FEATURES = f"""
with m as (
  select gis_join, avg(gross_price) as m1, avg(l_discount) as m2, avg(net_price) as my,
         var_pop(gross_price) as v1, var_pop(l_discount) as v2, var_pop(net_price) as vy,
         covar_pop(gross_price, l_discount) as c12, covar_pop(gross_price, net_price) as c1,
         covar_pop(l_discount, net_price) as c2
  from ({_READINGS}) group by 1
), b as (
  select *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) as b1,
         (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) as b2
  from m
), e as (select *, vy - b1 * c1 - b2 * c2 as mse from b)
select gis_join, 0 as total_iterations, round(sqrt(mse), 6) as rmse, round(1 - mse / vy, 6) as r2,
       round(my - b1 * m1 - b2 * m2, 6) as intercept, round(b1, 6) as slope0,
       round(b2, 6) as slope1, cast(0 as double) as first_objective
from e
"""

def _trees(rounds: int, step: float, depth: int, fewest: int) -> str:
    """Boosted regression trees on l_discount and l_tax, every distinct value a cut."""
    parts = [
        f"""r as (
  select gis_join, l_discount as x0, l_tax as x1, net_price as y,
         cast(concat('0x', substr(md5(concat_ws('|', l_orderkey, l_linenumber, 42)), 1, 8))
              as bigint) % 10000 < 8000 as train
  from ({_READINGS})
), f0 as (
  select r.gis_join, x0, x1, y - m as y, train, cast(0 as double) as f
  from r join (select gis_join, avg(y) as m from r where train group by 1) t
    on r.gis_join = t.gis_join
)"""
    ]
    for turn in range(rounds):
        target = "y" if turn == 0 else "2 * (y - f)"
        parts.append(f"n{turn}_0 as (select *, {target} as t, 0 as node from f{turn})")
        for level in range(depth):
            rows, name = f"n{turn}_{level}", f"{turn}_{level}"
            parts.append(
                f"""h{name} as (
  select gis_join, node, fx, v, count(*) as n, sum(t) as s, sum(t * t) as ss
  from (select gis_join, node, t, 0 as fx, x0 as v from {rows} where train
        union all select gis_join, node, t, 1, x1 from {rows} where train)
  group by 1, 2, 3, 4
), c{name} as (
  select *, sum(n) over (part order by v) as ln, sum(s) over (part order by v) as ls,
         sum(ss) over (part order by v) as lss,
         sum(n) over part as tn, sum(s) over part as ts, sum(ss) over part as tss
  from h{name} window part as (partition by gis_join, node, fx)
), b{name} as (
  select gis_join, node, fx, v from (
    select *, row_number() over (partition by gis_join, node order by
              ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) desc, fx, v) as place
    from c{name} where ln >= {fewest} and tn - ln >= {fewest}
  ) where place = 1
), n{turn}_{level + 1} as (
  select n.gis_join, x0, x1, y, train, f, t,
         case when n.node < 0 then n.node
              when b.fx is null then -n.node - 1
              when (case when b.fx = 0 then x0 else x1 end) > b.v then 2 * n.node + 2
              else 2 * n.node + 1 end as node
  from {rows} n left join b{name} b on n.gis_join = b.gis_join and n.node = b.node
)"""
            )
        weight = 1.0 if turn == 0 else step
        last = f"n{turn}_{depth}"
        parts.append(
            f"""f{turn + 1} as (
  select n.gis_join, x0, x1, y, train, f + {weight} * value as f
  from {last} n join (select gis_join, node, avg(t) as value from {last} where train group by 1, 2) l
    on n.gis_join = l.gis_join and n.node = l.node
)"""
        )
    return f"""
with {", ".join(parts)}
select gis_join, round(sqrt(avg((y - f) * (y - f))), 6) as rmse,
       round(1 - sum((y - f) * (y - f)) / nullif(count(*) * var_pop(y), 0), 6) as r2
from f{rounds} where not train group by 1
"""


ORACLES = {
    "loaded_collection": "select * from nation",
    "collection_counts": " union all ".join(
        f"select {i} as ord, '{t}' as collection, count(*) as count from {t}"
        for i, t in enumerate(_TABLES)
    ),
    "resolution_stats": _COUNTY,
    "resolution_stats_state": _STATE,
    "resolution_stats_tract": _TRACT,
    "resolution_stats_block": _BLOCK,
    "key_medians": """
        select event_type, count(*) as rows, round(median(value), 6) as median
        from events group by 1""",
    "result_documents": f"""
        select concat('{{"gisjoin":"', gisjoin, '"',
                      case when total_population > 0
                           then concat(',"total_population":', total_population) else '' end,
                      ',"median_household_income":', median_household_income, '}}') as data
        from ({_TRACT})""",
    "project_label": f"""
        select gis_join, round(gross_price, 6) as gross_price, l_discount,
               round(net_price, 6) as label
        from ({_READINGS})""",
    "key_rows": f"""
        select gis_join, l_orderkey, l_linenumber, l_extendedprice
        from ({_READINGS}) where gis_join = 'S7'""",
    "requested_keys": f"""
        select q.req_ord, q.gisjoin, d.formatted_date, d.cases, d.total_value
        from ({_REQUEST}) q left join ({_DAILY}) d on q.gisjoin = d.gisjoin""",
    "date_range_rows": f"select * from ({_DAILY}) where {_IN_RANGE}",
    "timestamp_range_rows": """
        select event_id, value from events
        where cast(ts as date) between date '2024-01-05' and date '2024-01-20'""",
    "parsed_days": "select event_id, cast(ts as date) as day from events",
    "drop_null_rows": f"""
        select gis_join, l_discount as discount, l_quantity
        from ({_READINGS}) where l_discount <> 0""",
    "find_rows": """
        select o_orderkey, o_custkey, o_totalprice from orders
        where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'""",
    "find_rows_compare": """
        select o_orderkey, o_custkey, o_totalprice from orders
        where o_totalprice >= 1000 and o_totalprice < 200000 and o_custkey > 9""",
    "json_fields": """
        select event_id, json_exists(props, '$.k') as has_k,
               json_exists(props, '$.GISJOIN') as has_gisjoin,
               json_extract_string(props, '$.k') as k_text,
               cast(json_extract_string(props, '$.k') as bigint) as k
        from events""",
    "compound_inner": f"""{_SIDES}
        select l.gisjoin, l.price, l.quantity, r.o_orderpriority
        from l join r on l.gisjoin = r.gisjoin""",
    "compound_left": f"""{_SIDES}
        select l.gisjoin, l.price, l.quantity, r.o_orderpriority
        from l left join r on l.gisjoin = r.gisjoin""",
    "compound_right": f"""{_SIDES}
        select r.gisjoin, case when l.gisjoin is not null then l.price else r.price end as price,
               l.quantity, r.o_orderpriority
        from l right join r on l.gisjoin = r.gisjoin""",
    "compound_outer": f"""{_SIDES}
        select coalesce(l.gisjoin, r.gisjoin) as gisjoin,
               case when l.gisjoin is not null then l.price else r.price end as price,
               l.quantity, r.o_orderpriority
        from l full join r on l.gisjoin = r.gisjoin""",
    "compound_nested": f"""{_NATIONS}
        select n.gisjoin, c.customers, c.balance, s.suppliers, n.name
        from n left join (c join s on c.gisjoin = s.gisjoin) on c.gisjoin = n.gisjoin""",
    "compound_single": f"""
        {_LATEST}
        union all
        select '~', event_id, event_type, value from ({_USER_EVENTS}) where gisjoin is null""",
    "latest_per_key": _LATEST,
    "surrogate_keys": f"""
        select count(*) as rows,
               count(distinct gisjoin) + sum(case when gisjoin is null then 1 else 0 end) as keys,
               sum(case when gisjoin is null then 1 else 0 end) as surrogates,
               max(case when gisjoin is null then 1 end) as rows_per_surrogate
        from ({_USER_EVENTS})""",
    "ordered_series": f"""
        select gisjoin, min(formatted_date) over (partition by gisjoin) as start_date,
               row_number() over (partition by gisjoin order by formatted_date) - 1 as pos,
               formatted_date as date, cases as value
        from ({_DAILY})""",
    "ordered_series_split": """
        select event_type,
               row_number() over (partition by event_type order by ts, event_id) - 1 as pos, value
        from events""",
    "date_range_mean": f"""
        select round(avg(cases), 6) as mean from ({_DAILY})
        where gisjoin = 'click' and {_IN_RANGE}""",
    "regression_metrics": f"""
        select gis_join, count(*) as n,
               round(sqrt(avg((net_price - gross_price * 0.98) * (net_price - gross_price * 0.98))), 6)
                 as rmse,
               round(1 - sum((net_price - gross_price * 0.98) * (net_price - gross_price * 0.98))
                         / nullif(count(*) * var_pop(net_price), 0), 6) as r2
        from ({_READINGS}) group by 1""",
    "moving_average": _moving_average(_DAILY),
    "moving_average_users": _moving_average(_DAILY_USER),
    "moving_average_requested": f"""
        select q.req_ord, q.gisjoin, w.formatted_date, w.avg, w.num_days, w.start_date
        from ({_REQUEST}) q left join ({_moving_average(_DAILY)}) w on q.gisjoin = w.gisjoin""",
    "moving_average_split": """
        select event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as second, round(a, 6) as avg from (
          select event_type, ts,
                 avg(value) over (partition by event_type order by ts, event_id
                                  rows between 6 preceding and current row) as a,
                 row_number() over (partition by event_type order by ts, event_id) as rn
          from events
        ) where rn >= 7""",
    "moving_average_array_split": """
        select event_type, cast(n - 6 as integer) as num_windows,
               strftime(ts, '%Y-%m-%d %H:%M:%S') as second, round(a, 6) as avg from (
          select event_type, ts,
                 avg(value) over (partition by event_type order by ts, event_id
                                  rows between 6 preceding and current row) as a,
                 row_number() over (partition by event_type order by ts, event_id) as rn,
                 count(*) over (partition by event_type) as n
          from events
        ) where rn >= 7""",
    "moving_average_array": f"""
        select gisjoin, start_date, num_days, num_windows, formatted_date as date, avg from (
          select *, cast(count(*) over (partition by gisjoin) as integer) as num_windows
          from ({_moving_average(_DAILY)}))""",
    "array_functions": f"""
        with s as (
          select gisjoin, list(cases order by formatted_date) as v from ({_DAILY}) group by 1
        )
        select gisjoin, v[3] as third, v[100001] as beyond, len(v) as length,
               greatest(len(v) - 6, 0) as windows, 0 as empty_range,
               array_to_string(v[4:7], ',') as slice,
               array_to_string(list_transform(v, lambda x: x + 1), ',') as mapped,
               round(list_avg(v), 6) as mean,
               round(list_avg(list_filter(v, lambda x: x % 2 = 0)), 6) as mean_of_even
        from s""",
    "direct_pipeline": """
        select user_id, min(day) as start_date, cast(count(*) as integer) as num_days,
               max(day) as last
        from (select distinct user_id, cast(ts as date) as day from events where value >= 10)
        group by 1""",
    "assembled_features": f"""
        select gisjoin, 0 as pos, cast(total_population as double) as value from ({_COUNTY})
        union all select gisjoin, 1, median_household_income from ({_COUNTY})""",
    "min_max_scaled": f"""
        select gisjoin,
               round((total_population - min(total_population) over ())
                     / cast(max(total_population) over () - min(total_population) over () as double), 6)
                 as total_population,
               round((median_household_income - min(median_household_income) over ())
                     / (max(median_household_income) over () - min(median_household_income) over ()), 6)
                 as median_household_income,
               cast(0.5 as double) as constant
        from ({_TRACT})""",
    "clustering_features": f"""
        with t as (select * from ({_TRACT}) where total_population > 0)
        select gisjoin, 0 as pos,
               round((total_population - min(total_population) over ())
                     / cast(max(total_population) over () - min(total_population) over () as double), 6)
                 as value from t
        union all
        select gisjoin, 1,
               round((median_household_income - min(median_household_income) over ())
                     / (max(median_household_income) over () - min(median_household_income) over ()), 6) from t""",
    "train_test_split": """
        select event_id,
               case when cast(concat('0x', substr(md5(concat_ws('|', event_id, 42)), 1, 8)) as bigint)
                         % 10000 < 8000 then 'train' else 'test' end as side
        from events""",
    "linear_regression_ols": _one_feature(0.0),
    "linear_regression_ridge": _one_feature(0.5),
    "linear_regression_elastic": _one_feature(1.0, elastic=0.5),
    "linear_regression_lasso": _one_feature(2.0, elastic=1.0, standardization=False),
    "linear_regression_origin": _one_feature(0.5, intercept=False),
    "linear_regression_many": _TWO_FEATURES,
    "random_forest_plain": _trees(rounds=1, step=1.0, depth=2, fewest=5),
    "gradient_boost_plain": _trees(rounds=3, step=0.3, depth=1, fewest=5),
    "per_key_models": """
        with m as (
          select o_orderpriority, covar_pop(o_custkey, o_totalprice / 1000) as c,
                 var_pop(o_custkey) as vx, var_pop(o_totalprice / 1000) as vy
          from orders group by 1
        ), b as (
          select *, (c / sqrt(vx * vy)) / (1 + 0.5 / sqrt(vy)) * sqrt(vy) / sqrt(vx) as slope from m
        )
        select q.req_ord, b.o_orderpriority, round(slope, 6) as slope,
               round(sqrt(vy - 2 * slope * c + slope * slope * vx), 6) as rmse
        from b join (values (0, '5-LOW'), (1, '1-URGENT'), (3, '2-HIGH'), (4, '3-MEDIUM'),
                            (5, '4-NOT SPECIFIED'), (6, '5-LOW')) as q(req_ord, p)
          on p = o_orderpriority""",
    # what holds of any clustering: the scaled areas, each of them checked
    "kmeans_nearest": f"select *, true as nearest from ({_SCALED_TRACT})",
    "bisecting_kmeans_walk": f"select *, true as agrees from ({_SCALED_TRACT})",
    "gaussian_mixture_likeliest": f"select *, true as likeliest from ({_SCALED_TRACT})",
    "lda_inferred": f"select *, true as agrees from ({_SCALED_TRACT})",
    "kmeans_centres": f"""
        with s as (select * from ({_UNROUNDED_TRACT}))
        select cast(c as int) as component, cast(i as int) as i, true as is_mean, true as has_members,
               (select count(*) from s) as members,
               round(if(i = 0, (select avg(x0) from s), (select avg(x1) from s)), 6) as overall_mean
        from range(10) a(c), range(2) b(i)""",
    "bisecting_kmeans_tree": f"""
        select cast(10 as int) as leaves, cast(9 as int) as splits, true as splits_are_whole,
               count(*) as members from ({_TRACT})""",
    "gaussian_mixture_step": """
        select cast(c as int) as component, true as stays, 1.0::double as weights,
               1.0::double as next_weights from range(3) a(c)""",
    "lda_bounds": """
        select cast(c as int) as component, cast(i as int) as i, true as positive,
               true as bounds_agree, 1.0::double as shares from range(3) a(c), range(2) b(i)""",
    "huber_settled": f"select gis_join, count(*) as n, true as settled from ({_READINGS}) group by 1",
    "compound_latest": """
        with e as (select *, value >= 50 as large from events),
        last as (
          select *, row_number() over (partition by user_id, large order by event_id desc) as n from e
        ), l as (select * from last where n = 1 and large), r as (select * from last where n = 1 and not large)
        select concat('U', coalesce(l.user_id, r.user_id)) as gisjoin,
               if(l.event_id is not null, l.event_id, r.event_id) as event_id, l.value, r.event_type
        from l full join r on l.user_id = r.user_id""",
    "requested_fits": f"""
        with m as (
          select gis_join, regr_slope(net_price, gross_price) as slope,
                 regr_intercept(net_price, gross_price) as intercept from ({_READINGS}) group by 1
        )
        select q.req_ord, gis_join, round(intercept, 6) as intercept, round(slope, 6) as slope
        from m join {_REQUESTED_FITS} on k = gis_join""",
    "requested_trees": f"""
        select q.req_ord, t.* from ({_trees(rounds=1, step=1.0, depth=2, fewest=5)}) t
        join {_REQUESTED_FITS} on k = gis_join""",
}
