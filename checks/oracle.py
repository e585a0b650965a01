"""DuckDB statements with the same results, written from the definitions.

Thresholds come from an as-of join, scores from plain row frames, water levels from breakpoints,
and the adaptive recurrence from a recursive query.
"""

from __future__ import annotations

PLUG = "house_id, household_id, plug_id"
MODES = (
    "full_tx", "uniform", "flat_variance", "legacy_two_stage", "true_hierarchical",
    "true_hierarchical_cap",
)
EPSILONS = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0)


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0::double as {name or expression}"


def rs(names: str) -> str:
    return ", ".join(r(n.strip()) for n in names.split(","))


def config_rows(configs) -> str:
    """(config, mode, eps, alpha, beta, q, mult, frac, mins) rows."""
    rows = ", ".join(
        f"('{c}', '{m}', {e}::double, {a}::double, {b}::double, {q}::double, {u}::double, "
        f"{f}::double, {n})"
        for c, m, e, a, b, q, u, f, n in configs
    )
    return (
        f"select * from (values {rows}) "
        "t(config, mode, eps, alpha, beta, q, mult, frac, mins)"
    )


def grid(modes, epsilons):
    return [(f"{m}@{e:g}", m, e, 0.2, 0.1, 0.95, 1.0, 0.05, 25) for e in epsilons for m in modes]


SIX = grid(MODES, (5.0,))
SWEEP = grid(("uniform", "flat_variance", "true_hierarchical", "true_hierarchical_cap"), EPSILONS)


def ofat():
    base = dict(alpha=0.2, beta=0.1, q=0.95, mult=1.0, frac=0.05)
    names = {"alpha": "alpha", "beta": "beta", "q": "cap.quantile", "mult": "cap.multiplier",
             "frac": "cap.max_house_budget_fraction"}
    values = {"alpha": (0.1, 0.2, 0.4), "beta": (0.0, 0.1, 0.2), "q": (0.9, 0.95, 0.99),
              "mult": (0.5, 1.0, 1.5), "frac": (0.1, 0.25, 0.5)}
    variants = [("base", base)]
    for field, options in values.items():
        for option in options:
            if option != base[field]:
                variants.append((f"{names[field]}={option}", {**base, field: option}))
    return [
        (n, "true_hierarchical_cap", 5.0, v["alpha"], v["beta"], v["q"], v["mult"], v["frac"], 25)
        for n, v in variants
    ]


def base(
    *,
    first="2024-01-15",
    last="2024-01-30 23:59:59.999999",
    range_end="2024-01-30 23:59:59.999999",
    period=21_600,
    active=86_400,
    configs=SIX,
) -> str:
    """Common table expressions from the raw events to decisions and batches."""
    return f"""
with recursive ev as (
  select cast(event_id as varchar) as event_id, event_id as row_id,
         date_trunc('hour', ts)::timestamp as timestamp, value,
         case when event_type = 'error' then 2 else 1 end as property,
         user_id % 3 as house_id, (user_id // 3) % 4 as household_id, user_id // 12 as plug_id
  from events),
acc as (
  select * from ev where property = 1 and value is not null and isfinite(value) and value >= 0
    and timestamp between timestamp '2024-01-01' and timestamp '{range_end}'),
slotted as (
  select *, isodow(timestamp) - 1 as weekday,
         (hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp)) // 21600 as slot
  from acc),
warm as (
  select * from slotted
  where timestamp between timestamp '2024-01-01' and timestamp '2024-01-14 23:59:59.999999'),
evl as (
  select * from slotted where timestamp between timestamp '{first}' and timestamp '{last}'),
slot_m as (
  select {PLUG}, weekday, slot, median(value) as slot_median from warm group by all),
plug_m as (select {PLUG}, median(value) as plug_median from warm group by all),
warm_r as (
  select w.*, coalesce(slot_median, plug_median) as prediction,
         value - coalesce(slot_median, plug_median) as residual
  from warm w left join slot_m using ({PLUG}, weekday, slot) left join plug_m using ({PLUG})),
eval_r as (
  select w.*, coalesce(slot_median, plug_median) as prediction,
         value - coalesce(slot_median, plug_median) as residual
  from evl w left join slot_m using ({PLUG}, weekday, slot) left join plug_m using ({PLUG})),
sig as (select {PLUG}, sqrt(avg(residual * residual)) as sigma from warm_r group by all),
floors as (
  select house_id,
         coalesce(quantile_cont(sigma, 0.05) filter (where sigma > 0), 1.0) as sigma_floor
  from sig group by all),
loads as (
  select house_id, avg(house_load) as mean_load
  from (select house_id, timestamp, sum(value) as house_load from warm group by all) group by all),
houses as (select * from loads join floors using (house_id)),
quants as (
  select {PLUG}, count(*) as samples, quantile_cont(abs(residual), 0.9) as q90,
         quantile_cont(abs(residual), 0.95) as q95, quantile_cont(abs(residual), 0.99) as q99
  from warm_r group by all),
meds as (select {PLUG}, median(residual) as med from warm_r group by all),
mads as (
  select {PLUG}, median(abs(residual - med)) as mad
  from warm_r join meds using ({PLUG}) group by all),
scales as (
  select {PLUG}, mad, greatest(1.4826 * mad, sigma_floor, 1.0) as scale
  from mads join floors using (house_id)),
firsts as (
  select house_id, (epoch_us(timestamp) - epoch_us(timestamp '{first}')) // {period * 1_000_000}
           as cell, min(timestamp) as first_ts from evl group by all),
ticks as (
  select house_id, tick_ts, row_number() over (partition by house_id order by tick_ts) - 1 as cycle
  from (select distinct house_id, timestamp '{first}' - interval 1 microsecond as tick_ts from evl
        union all select house_id, first_ts from firsts where cell >= 1)),
hist as (
  select {PLUG}, timestamp, row_id, residual * residual as sq from warm_r
  union all select {PLUG}, timestamp, row_id, residual * residual from eval_r),
rolled as (
  select *, avg(sq) over (partition by {PLUG} order by timestamp, row_id
                          rows between 19 preceding and current row) as moment from hist),
lastrow as (
  select {PLUG}, timestamp, arg_max(moment, row_id) as moment from rolled group by all),
gov as (
  select e.*, t.cycle, t.tick_ts
  from eval_r e asof join ticks t on e.house_id = t.house_id and e.timestamp > t.tick_ts),
seen as (
  select g.*, l.timestamp as last_seen, l.moment as moment_before,
         l.timestamp is null or epoch_us(g.timestamp) - epoch_us(l.timestamp) > {active * 1_000_000}
           as reactivated
  from gov g asof left join lastrow l
    on g.house_id = l.house_id and g.household_id = l.household_id and g.plug_id = l.plug_id
   and g.timestamp > l.timestamp),
snap as (
  select t.house_id, t.cycle, t.tick_ts, l.household_id, l.plug_id, l.timestamp as last_seen,
         greatest(sqrt(l.moment), f.sigma_floor) as score
  from (select t.*, p.household_id, p.plug_id
        from ticks t join (select distinct {PLUG} from acc) p using (house_id)) t
  asof join lastrow l
    on t.house_id = l.house_id and t.household_id = l.household_id and t.plug_id = l.plug_id
   and t.tick_ts >= l.timestamp
  join floors f on f.house_id = t.house_id
  where l.timestamp > t.tick_ts - interval {active} second),
by_household as (
  select house_id, cycle, household_id, count(*) as n_h, sum(score) as s_h, avg(score) as m_h,
         max(score) as x_h from snap group by all),
by_house as (
  select house_id, cycle, count(*) as n, sum(score) as s, median(score) as med
  from snap group by all),
risk as (
  select h.*, n, s, 0.5 * m_h + 0.4 * x_h + 0.1 * ln(1 + n_h) * med as household_risk
  from by_household h join by_house using (house_id, cycle)),
shares as (
  select *, household_risk / sum(household_risk) over (partition by house_id, cycle) as risk_share,
         count(*) over (partition by house_id, cycle) as n_households from risk),
cfg as ({config_rows(configs)}),
rows0 as (
  select c.*, s.*, x.n_h, x.s_h, x.n, x.s, x.risk_share, b.sigma_floor, c.eps * b.mean_load as budget,
         c.alpha / n_households + (1 - c.alpha) * x.risk_share as hshare,
         c.beta / n_h + (1 - c.beta) * s.score / s_h as pshare,
         case when coalesce(samples, 0) >= c.mins
              then least(c.frac * c.eps * b.mean_load, greatest(c.mult *
                   case c.q when 0.9 then q90 when 0.95 then q95 else q99 end, b.sigma_floor))
              else c.frac * c.eps * b.mean_load end as cap0
  from snap s join shares x using (house_id, cycle, household_id) join houses b using (house_id)
  left join quants using ({PLUG}) cross join cfg c),
ch as (
  select config, house_id, cycle, household_id, max(budget) as budget,
         max(risk_share) as risk_share, least(max(hshare * budget), sum(cap0)) as kept,
         sum(cap0) - least(max(hshare * budget), sum(cap0)) as room
  from rows0 where mode = 'true_hierarchical_cap' group by all),
chl as (
  select *, greatest(budget - sum(kept) over (partition by config, house_id, cycle), 0) as amount
  from ch),
hbreaks as (
  select config, house_id, cycle, amount, room / risk_share as b from chl where room > 1e-9
  union select distinct config, house_id, cycle, amount, 0.0 from chl),
hlevels as (
  select k.config, k.house_id, k.cycle, k.amount, k.b,
         coalesce(sum(least(o.room, k.b * o.risk_share)) filter (o.room > 1e-9), 0) as f,
         coalesce(sum(o.risk_share) filter (o.room > 1e-9 and o.room / o.risk_share > k.b), 0) as w
  from hbreaks k join chl o using (config, house_id, cycle) group by all),
hlevel as (
  select config, house_id, cycle,
         arg_max(b + case when w > 0 then greatest(amount - f, 0) / w else 0 end, b) as level
  from hlevels where f <= amount + 1e-9 group by all),
granted as (
  select chl.*, kept + case when room > 1e-9 then least(room, level * risk_share) else 0 end as g
  from chl join hlevel using (config, house_id, cycle)),
prow as (
  select r.config, r.house_id, r.cycle, r.household_id, r.plug_id, r.cap0, r.pshare, g.g
  from rows0 r join granted g using (config, house_id, cycle, household_id)),
pbreaks as (
  select distinct config, house_id, cycle, household_id, g, cap0 / pshare as b from prow
  union select distinct config, house_id, cycle, household_id, g, 0.0 from prow),
plevels as (
  select k.config, k.house_id, k.cycle, k.household_id, k.g, k.b,
         sum(least(o.cap0, k.b * o.pshare)) as f,
         coalesce(sum(o.pshare) filter (o.cap0 / o.pshare > k.b), 0) as w
  from pbreaks k join prow o using (config, house_id, cycle, household_id) group by all),
plevel as (
  select config, house_id, cycle, household_id,
         arg_max(b + case when w > 0 then greatest(g - f, 0) / w else 0 end, b) as level
  from plevels where f <= g + 1e-9 group by all),
thr as (
  select r.*, case r.mode
      when 'full_tx' then 0.0::double
      when 'uniform' then budget / n
      when 'flat_variance' then budget * score / s
      when 'legacy_two_stage' then (budget * s_h / s) * score / s_h
      when 'true_hierarchical' then budget * hshare * pshare
      else least(cap0, p.level * pshare) end as threshold,
    case when r.mode = 'true_hierarchical_cap' then cap0 end as cap
  from rows0 r left join plevel p using (config, house_id, cycle, household_id)),
kept_in as (
  select config, house_id, cycle, sum(kept) as kept from ch group by all),
trace as (
  select t.*, sum(threshold) over tick as used_budget,
         greatest(budget - sum(threshold) over tick, 0) as unused_budget,
         case when t.mode = 'true_hierarchical' then budget * hshare
              else sum(threshold) over (partition by t.config, t.house_id, t.cycle, t.household_id)
         end as household_budget,
         case when t.mode = 'true_hierarchical_cap'
              then count(*) filter (cap0 - threshold <= 1e-9) over tick else 0 end as cap_hit_count,
         case when t.mode = 'true_hierarchical_cap' then greatest(
              k.kept - sum(least(budget * hshare * pshare, cap0)) over tick, 0) else 0 end as within,
         case when t.mode = 'true_hierarchical_cap'
              then greatest(sum(threshold) over tick - k.kept, 0) else 0 end as spill
  from thr t left join kept_in k using (config, house_id, cycle)
  window tick as (partition by t.config, t.house_id, t.cycle)),
cyc as (
  select config, mode, house_id, cycle, max(tick_ts) as tick_ts, max(budget) as budget,
         max(used_budget) as used, max(unused_budget) as unused, max(cap_hit_count) as hits,
         max(within) as within, max(spill) as spill, count(*) as n_rows from trace group by all),
dec0 as (
  select c.config, c.mode, s.*, c.eps * b.mean_load as budget, b.sigma_floor,
         coalesce(t.threshold, 0) as threshold_used, t.cap as cap,
         case when c.mode = 'full_tx' then 'full_tx'
              when prediction is null then 'missing_prediction'
              when reactivated then 'inactive_reactivation' end as forced_reason
  from seen s join houses b using (house_id) cross join cfg c
  left join trace t on t.config = c.config and t.house_id = s.house_id and t.cycle = s.cycle
    and t.household_id = s.household_id and t.plug_id = s.plug_id),
dec as (
  select *, forced_reason is not null or abs(coalesce(residual, 0)) > threshold_used as transmitted,
         case when forced_reason is not null or abs(coalesce(residual, 0)) > threshold_used
                or prediction is null then value else prediction end as reconstructed
  from dec0),
bat as (
  select d.config, d.mode, d.house_id, d.cycle, d.timestamp, max(d.budget) as budget,
         sum(value) as actual_house, sum(reconstructed) as reconstructed_house,
         count(*) as event_count, count(*) filter (transmitted) as transmitted_count,
         count(*) filter (forced_reason = 'full_tx') as f_full,
         count(*) filter (forced_reason = 'missing_prediction') as f_missing,
         count(*) filter (forced_reason = 'inactive_reactivation') as f_back
  from dec d group by all),
batch as (
  select b.*, actual_house - reconstructed_house as house_error,
         abs(actual_house - reconstructed_house) as abs_house_error,
         coalesce(c.used, 0) as allocated_budget, coalesce(c.used, 0) / b.budget as bu,
         abs(actual_house - reconstructed_house) / b.budget as ub,
         abs(actual_house - reconstructed_house) > b.budget + 1e-9 as bad
  from bat b left join cyc c using (config, house_id, cycle)),
streak as (
  select *, case when transmitted then 0 else
           row_number() over (partition by config, {PLUG}, island order by timestamp, row_id)
           - case when island > 0 then 1 else 0 end end as consecutive_suppression
  from (select *, sum(transmitted::int) over (
          partition by config, {PLUG} order by timestamp, row_id) as island from dec)),
tails as (
  select config, house_id, quantile_cont(abs_house_error, 0.95) as p95,
         quantile_cont(abs_house_error, 0.99) as p99 from batch group by all),
cvars as (
  select config, house_id, max(p95) as p95, max(p99) as p99,
         avg(abs_house_error) filter (abs_house_error >= p95) as cvar95,
         avg(abs_house_error) filter (abs_house_error >= p99) as cvar99
  from batch join tails using (config, house_id) group by all),
central as (
  select config, mode, house_id, sum(event_count)::bigint as valid_events,
         count(*) as timestamp_batches, sum(transmitted_count)::bigint as transmitted,
         sum(event_count - transmitted_count)::bigint as suppressed,
         sum(transmitted_count) / sum(event_count) as transmission_ratio,
         1 - sum(transmitted_count) / sum(event_count) as reduction,
         avg(abs_house_error) as mae, sqrt(avg(house_error * house_error)) as rmse,
         max(abs_house_error) as max, count(*) filter (bad) as bound_violation_count,
         max(ub) as max_bound_utilization, avg(bu) as mean_budget_utilization,
         max(budget) as house_budget, sum(f_full)::bigint as forced_full_tx,
         sum(f_missing)::bigint as forced_missing_prediction,
         sum(f_back)::bigint as forced_inactive_reactivation
  from batch group by all),
budgeted as (
  select config, house_id, count(*) filter (used > budget + 1e-9) as budget_violation_count,
         max(unused) as unused_budget, max(unused / budget) as unused_budget_ratio,
         count(*) filter (unused > 1e-9) as number_of_cycles_with_unused_budget,
         sum(hits)::bigint as cap_hit_count, sum(hits) / sum(n_rows) as cap_hit_rate,
         sum(within) as within_household_redistributed_budget,
         sum(spill) as cross_household_spill_budget
  from cyc group by all),
viol as (
  select config, house_id,
         count(*) filter (not transmitted and abs(residual) > threshold_used + 1e-9)
           as suppression_violation_count,
         max(consecutive_suppression) as maximum_consecutive_suppression
  from streak group by all),
summ as (
  select * from central join cvars using (config, house_id) join budgeted using (config, house_id)
  join viol using (config, house_id))
"""


def query(final: str, **changes) -> str:
    return base(**changes) + final


# The adaptive recurrence of the fixture's template, one row per predictor mode, plug and batch.
# Alpha .2, CUSUM .5 / 5, cooldown 2, at most 4 suppressions and 259200 s of silence.
ADAPTIVE = f""",
pmode as (
  select * from (values
    ('slot_median_frozen', 0, 0, 0), ('slot_median_ewma', 1, 0, 0),
    ('slot_median_ewma_periodic_sync', 1, 0, 1), ('slot_median_ewma_drift', 1, 1, 0),
    ('slot_median_ewma_drift_periodic_sync', 1, 1, 1)) t(pm, adapts, drifts, syncs)),
wbias as (
  select {PLUG}, list_reduce(list(residual order by timestamp, row_id),
         lambda b, x: b + 0.2::double * (x - b), 0.0::double) as bias
  from warm_r group by all),
pb as (
  select config, mode, budget, {PLUG}, timestamp, any_value(cycle) as cycle,
         any_value(prediction) as base, any_value(threshold_used) as thr,
         any_value(reactivated) as back, any_value(scale) as scale,
         list({{'event_id': event_id, 'row_id': row_id, 'value': value}} order by row_id) as items,
         row_number() over (partition by config, {PLUG} order by timestamp) as k
  from dec join scales using ({PLUG}) where mode = 'uniform'
  group by config, mode, budget, {PLUG}, timestamp),
run as (
  select p.pm, adapts, drifts, syncs, b.config, b.house_id, b.household_id, b.plug_id, 0::bigint as k,
         (adapts * coalesce(w.bias, 0))::double as edge, 0::bigint as streak,
         null::timestamp as last_tx, 0.0::double as up, 0.0::double as down, 0::bigint as wait,
         0::bigint as version,
         []::struct(event_id varchar, row_id bigint, value double, r double, z double, up double,
                    down double, fires boolean, held boolean, would boolean, reason varchar)[]
           as done,
         0::bigint as streak0, null::timestamp as last0, 0.0::double as edge0,
         null::timestamp as now_ts
  from (select distinct config, {PLUG} from pb) b cross join pmode p
  left join wbias w using ({PLUG})
  union all
  select pm, adapts, drifts, syncs, config, house_id, household_id, plug_id, k,
         edge + adapts * 0.2::double * coalesce(list_sum([x.r for x in done if x.reason is not null]), 0),
         list_reduce([case when x.reason is not null then 1 else 0 end::bigint for x in done],
                     lambda s, x: case when x = 1 then 0::bigint else s + 1 end, streak),
         case when list_count([x.r for x in done if x.reason is not null]) > 0 then now_ts else last_tx end,
         case when done[-1].fires or done[-1].held then 0 else done[-1].up end,
         case when done[-1].fires or done[-1].held then 0 else done[-1].down end,
         case when done[-1].fires then 2 else greatest(wait - 1, 0) end::bigint,
         version + adapts * len([x.r for x in done if x.reason is not null]),
         done, streak, last_tx, edge, now_ts
  from (
    select *, list_transform(d1, lambda x: {{
        'event_id': x.event_id, 'row_id': x.row_id, 'value': x.value, 'r': x.r, 'z': x.z,
        'up': x.up, 'down': x.down,
        'fires': drifts = 1 and wait = 0 and greatest(x.up, x.down) >= 5,
        'held': wait > 0 and greatest(x.up, x.down) >= 5,
        'would': abs(x.r) > thr,
        'reason': case when back then 'inactive_reactivation'
             when drifts = 1 and wait = 0 and greatest(x.up, x.down) >= 5 then 'drift_detected'
             when syncs = 1 and streak >= 4 then 'periodic_sync_count'
             when syncs = 1 and epoch_us(now_ts) - epoch_us(coalesce(last_tx, timestamp '2024-01-15'))
                  >= 259200000000 then 'periodic_sync_time'
             when abs(x.r) > thr then 'normal_deadband' end }}) as done
    from (
      select *, list_transform(d0, lambda x: {{
          'event_id': x.event_id, 'row_id': x.row_id, 'value': x.value, 'r': x.r, 'z': x.r / scale,
          'up': greatest(0, up + x.r / scale - 0.5), 'down': greatest(0, down - x.r / scale - 0.5)
        }}) as d1
      from (
        select run.* exclude (k, done, now_ts, streak0, last0, edge0), b.k, b.timestamp as now_ts, b.thr,
               b.back, b.scale,
               list_transform(b.items, lambda x: {{
                 'event_id': x.event_id, 'row_id': x.row_id, 'value': x.value,
                 'r': x.value - (b.base + run.adapts * run.edge) }}) as d0
        from run join pb b on b.config = run.config and b.house_id = run.house_id
          and b.household_id = run.household_id and b.plug_id = run.plug_id and b.k = run.k + 1)))
),
flat as (
  select pm, adapts, drifts, syncs, run.config, run.house_id, run.household_id, run.plug_id,
         run.now_ts as timestamp, wait, streak0, last0, edge0, run.edge as edge, version,
         unnest(done) as x, generate_subscripts(done, 1) as pos, len(done) as size
  from run where k > 0),
ad as (
  select f.*, x.event_id as event_id, x.row_id as row_id, x.value as value, x.r as innovation,
         abs(x.z) as z, x.fires as fires, (x.held and drifts = 1) as held, x.would as would,
         x.reason as reason, d.cycle as cycle, d.threshold_used as threshold_used,
         d.budget as budget, s.scale as scale, d.mode as mode,
         x.value - x.r as prediction, x.reason is not null as sent
  from flat f join dec d on d.mode = 'uniform' and d.event_id = x.event_id
  join scales s on s.house_id = f.house_id and s.household_id = f.household_id
    and s.plug_id = f.plug_id),
abat as (
  select pm, a.config, a.mode, a.house_id, a.cycle, a.timestamp, max(a.budget) as budget,
         sum(value) as actual_house, sum(case when sent then value else prediction end) as rec,
         count(*) as event_count, count(*) filter (sent) as transmitted_count
  from ad a group by all),
abatch as (
  select b.*, actual_house - rec as house_error, abs(actual_house - rec) as e,
         abs(actual_house - rec) > b.budget + 1e-9 as bad
  from abat b),
atails as (
  select pm, house_id, quantile_cont(e, 0.95) as p95, quantile_cont(e, 0.99) as p99
  from abatch group by all),
asum as (
  select pm, house_id, sum(event_count)::bigint as valid_events,
         sum(transmitted_count) / sum(event_count) as transmission_ratio,
         avg(e) as mae, sqrt(avg(house_error * house_error)) as rmse, max(e) as max,
         max(p95) as p95, max(p99) as p99,
         avg(e) filter (e >= p95) as cvar95, avg(e) filter (e >= p99) as cvar99,
         count(*) filter (bad) as bound_violation_count
  from abatch join atails using (pm, house_id) group by all),
ordered as (
  select *, row_number() over w as seq,
         coalesce(sum((reason = 'drift_detected')::int) over (
           partition by pm, {PLUG} order by timestamp, row_id
           rows between unbounded preceding and 1 preceding), 0)::bigint as ep
  from ad window w as (partition by pm, {PLUG} order by timestamp, row_id)),
trig as (
  select pm, {PLUG}, ep + 1 as ep, timestamp as trigger_ts, abs(innovation) as pre
  from ordered where reason = 'drift_detected'),
obs as (
  select o.*, t.trigger_ts, row_number() over (
           partition by o.pm, o.house_id, o.household_id, o.plug_id, o.ep order by o.seq) as num
  from ordered o join trig t using (pm, house_id, household_id, plug_id, ep)
  where o.timestamp > t.trigger_ts),
eps as (
  select t.pm, t.house_id, t.household_id, t.plug_id, t.ep, t.trigger_ts, t.pre,
         min(o.num) filter (abs(o.innovation) <= o.scale) as rec_events,
         arg_min(o.timestamp, o.num) filter (abs(o.innovation) <= o.scale) as rec_ts,
         max(abs(o.innovation)) filter (o.num = 1) as e1,
         max(abs(o.innovation)) filter (o.num = 5) as e5,
         max(abs(o.innovation)) filter (o.num = 10) as e10
  from trig t left join obs o using (pm, house_id, household_id, plug_id, ep) group by all),
pmet as (
  select pm, house_id, count(*) as events, avg(abs(innovation)) as prediction_mae,
         sqrt(avg(innovation * innovation)) as prediction_rmse, avg(innovation) as prediction_bias,
         quantile_cont(abs(innovation), 0.95) as prediction_p95,
         quantile_cont(abs(innovation), 0.99) as prediction_p99
  from ad group by all),
ranked as (
  select pm, house_id, innovation, abs(innovation) as a,
         row_number() over (partition by pm, house_id order by abs(innovation) desc) as rk
  from ad),
pmet2 as (
  select m.*, prediction_cvar95, prediction_cvar99, top_1_percent_squared_error_share,
         top_5_percent_squared_error_share
  from pmet m join (
    select pm, house_id, avg(a) filter (a >= prediction_p95) as prediction_cvar95,
           avg(a) filter (a >= prediction_p99) as prediction_cvar99,
           sum(a * a) filter (rk <= greatest(ceil(events * 0.01), 1)) / sum(a * a)
             as top_1_percent_squared_error_share,
           sum(a * a) filter (rk <= greatest(ceil(events * 0.05), 1)) / sum(a * a)
             as top_5_percent_squared_error_share
    from ranked join pmet using (pm, house_id) group by all) using (pm, house_id)),
sil as (
  select pm, house_id, event_id,
         greatest(epoch_us(timestamp) - epoch_us(coalesce(last0, timestamp '2024-01-15')), 0) / 1e6
           as silence_seconds
  from ad where sent),
topout as (
  select pm, house_id, event_id, innovation, timestamp, household_id, plug_id, reason,
         threshold_used, streak0, z,
         row_number() over (partition by pm, house_id
           order by abs(innovation) desc, timestamp, row_id) as outlier_rank
  from ad)
"""


def adaptive(final: str) -> str:
    return base() + ADAPTIVE + final


def trace_of(mode: str) -> str:
    return query(
        f"""select house_id, cycle, household_id, plug_id,
        {rs('score, threshold, household_budget, used_budget, unused_budget')}
        from trace where mode = '{mode}'"""
    )


def decisions_of(mode: str) -> str:
    return query(
        f"""select event_id, {r('threshold_used')}, transmitted, forced_reason,
        {r('reconstructed')}, {r('value - reconstructed', 'reconstruction_error')}
        from dec where mode = '{mode}'"""
    )


def adaptive_of(mode: str) -> str:
    # the bias moves inside a batch, one transmitted value after another
    return adaptive(
        f"""select event_id, {rs('prediction, innovation, threshold_used')},
        sent as transmitted, reason, would as normal_would_transmit,
        streak0 as prior_suppressions,
        round(edge0 + adapts * 0.2 * coalesce(sum(case when sent then innovation else 0 end) over w,
              0), 6) + 0.0::double as edge_bias,
        (version - adapts * (sum(sent::int) over (partition by pm, {PLUG}, timestamp)
          - sum(sent::int) over w))::bigint as version
        from ad where pm = '{mode}'
        window w as (partition by pm, {PLUG}, timestamp order by row_id
                     rows between unbounded preceding and current row)"""
    )


def detector(kind: str) -> str:
    """Stand-alone detector on the evaluation residuals, row by row."""
    if kind == "cusum":
        run, up, down = "0::bigint", "greatest(0, up + z - 0.5)", "greatest(0, down - z - 0.5)"
        alarm = f"greatest({up}, {down}) >= 4"
    else:
        run = "(case when abs(z) >= 1.5 then run + 1 else 0 end)"
        up = down = "0.0::double"
        alarm = f"{run} >= 2"
    return query(
        f""",
series as (
  select s.*, c.scale, residual / c.scale as zz,
         row_number() over (partition by {PLUG} order by timestamp, row_id) as k
  from seen s join scales c using ({PLUG})),
walk as (
  select house_id, household_id, plug_id, 0::bigint as k, null::varchar as event_id, 0.0::double as z,
         0::bigint as run, 0.0::double as up, 0.0::double as down, 0::bigint as wait,
         false as fires, false as held
  from (select distinct {PLUG} from series)
  union all
  select house_id, household_id, plug_id, k, event_id, z,
         case when alarm then 0 else run1 end::bigint,
         case when alarm then 0 else up1 end::double,
         case when alarm then 0 else down1 end::double,
         case when alarm and wait = 0 then 2 else greatest(wait - 1, 0) end::bigint,
         alarm and wait = 0, alarm and wait > 0
  from (select *, {run} as run1, {up} as up1, {down} as down1, {alarm} as alarm
        from (select w.house_id, w.household_id, w.plug_id, s.k, s.event_id, s.zz as z, w.run,
                     w.up, w.down, w.wait
              from walk w join series s on s.house_id = w.house_id
                and s.household_id = w.household_id and s.plug_id = w.plug_id and s.k = w.k + 1)))
select event_id, {r('abs(z)', 'standardized')}, fires as drift_detected, held as held_by_cooldown,
       run as z_run, {r('up', 'cusum_up')}, {r('down', 'cusum_down')}, wait as cooldown_left
from walk where k > 0"""
    )


_SUMMARY = f"""select mode, house_id, valid_events, timestamp_batches, transmitted, suppressed,
  {rs('transmission_ratio, reduction, mae, rmse, max, p95, p99, cvar95, cvar99')},
  bound_violation_count, suppression_violation_count,
  {rs('max_bound_utilization, mean_budget_utilization, house_budget')}, budget_violation_count,
  {rs('unused_budget, unused_budget_ratio')}, number_of_cycles_with_unused_budget, cap_hit_count,
  {rs('cap_hit_rate, within_household_redistributed_budget, cross_household_spill_budget')},
  maximum_consecutive_suppression,
  bound_violation_count = 0 and suppression_violation_count = 0 and budget_violation_count = 0
    as safety_pass,
  forced_full_tx, forced_missing_prediction, forced_inactive_reactivation from summ"""

# Columns of the consolidated table, by where their figures come from.
_OF_RUNS = (
    "valid_events, timestamp_batches, transmitted, suppressed, transmission_ratio, reduction, rmse, "
    "p95, p99, cvar95, cvar99, max, house_budget, bound_violation_count, suppression_violation_count, "
    "budget_violation_count, maximum_consecutive_suppression"
).split(", ")
_OF_PREDICTORS = (
    "prediction_mae, prediction_rmse, prediction_p95, prediction_p99, prediction_cvar95, "
    "prediction_cvar99, prediction_bias, predictor_update_count, predictor_update_rate, "
    "drift_trigger_count, additional_drift_transmission_count, periodic_sync_count_trigger_count, "
    "periodic_sync_time_trigger_count, additional_periodic_transmission_count, "
    "maximum_consecutive_suppressions_observed, predictor_state_divergence_count"
).split(", ")


def _consolidated(found: dict[str, str]) -> str:
    """Two folders of frozen runs, one of which lacks the mean error, and one of adaptive ones."""
    none = ", ".join(f"null::varchar as {c}" for c in (
        "experiment_name", "input_sha256", "evaluation_start", "evaluation_end"))
    group = "case when mode = 'uniform' then 'uniform' else 'modes' end"
    return f"""
      with f as ({found['summary_modes']}), a as ({found['adaptive_summary']}),
      p as ({found['predictor_summary']})
      select {group} as source_group, 'allocator_baseline' as result_type,
        'frozen/' || {group} || '/summary' as source_path, {none}, house_id, mode as allocator_mode,
        'slot_median_frozen' as predictor_mode, {', '.join(_OF_RUNS)},
        case when mode <> 'uniform' then mae end as mae, null as prediction_events,
        {', '.join(f'null as {c}' for c in _OF_PREDICTORS)}, safety_pass
      from f
      union all by name
      select 'predictors' as source_group, 'adaptive_predictor' as result_type,
        'adaptive/predictors/summary' as source_path, {none}, a.house_id, a.mode as allocator_mode,
        a.predictor_mode, {', '.join('a.' + c for c in _OF_RUNS)}, a.mae, p.events as prediction_events,
        {', '.join('p.' + c for c in _OF_PREDICTORS)},
        a.safety_pass and p.predictor_state_divergence_count = 0 as safety_pass
      from a join p on a.house_id = p.house_id and a.predictor_mode = p.predictor_mode"""


_HIERARCHY = f""",
pair as (
  select coalesce(f.house_id, t.house_id) as house_id, coalesce(f.cycle, t.cycle) as cycle,
         coalesce(f.household_id, t.household_id) as household_id,
         coalesce(f.tick_ts, t.tick_ts) as tick_ts, coalesce(f.budget, t.budget) as budget,
         coalesce(f.threshold, 0) as a, coalesce(t.threshold, 0) as b
  from (select * from trace where mode = 'flat_variance') f
  full join (select * from trace where mode = 'true_hierarchical') t
    on f.house_id = t.house_id and f.cycle = t.cycle and f.household_id = t.household_id
   and f.plug_id = t.plug_id),
hh as (
  select house_id, cycle, household_id, max(tick_ts) as tick_ts, max(budget) as budget,
         count(*) as n, sum(abs(b - a)) as l1, abs(sum(b) - sum(a)) as hl1 from pair group by all),
hc as (
  select house_id, cycle, max(tick_ts) as allocation_timestamp, count(*) as active_households,
         sum(n)::bigint as active_plugs, sum(l1) / max(budget) as threshold_l1_normalized,
         sum(hl1) / max(budget) as household_budget_l1_normalized,
         sum(l1) / max(budget) > 1e-9 as hierarchy_changed
  from hh group by all having count(*) >= 2)
"""

_POINTS = """,
points as (
  select house_id, mode, cast(split_part(config, '@', 2) as double) as epsilon, transmission_ratio,
         rmse, cvar99, mae, p99, max,
         bound_violation_count = 0 and suppression_violation_count = 0
           and budget_violation_count = 0 as safety_pass from summ)
"""


def _sweep(final: str) -> str:
    return query(_POINTS + final, configs=SWEEP)


def _lookup() -> str:
    return query(
        f""",
known as (
  select s.* from scales s join quants q using ({PLUG}) where samples >= 28),
hs as (select house_id, household_id, median(scale) as v from known group by all),
os as (
  select f.house_id, f.sigma_floor,
         coalesce(median(scale), greatest(max(f.sigma_floor), 1.0)) as v
  from floors f left join known using (house_id) group by all)
select p.house_id, p.household_id, p.plug_id,
       round(greatest(coalesce(k.scale, hs.v, os.v, os.sigma_floor, 1.0), 1.0), 6) as robust_scale
from (select distinct {PLUG} from acc) p left join known k using ({PLUG})
left join hs using (house_id, household_id) left join os using (house_id)"""
    )


_PREDICTOR_SUMMARY = f""",
tot as (
  select pm, house_id, any_value(adapts) as adapts, count(*) as n,
         sum((sent and adapts = 1)::int)::bigint as updates,
         count(*) filter (reason = 'drift_detected') as drifts,
         count(*) filter (reason = 'drift_detected' and would) as redundant,
         median(z) filter (reason = 'drift_detected') as zmed,
         max(z) filter (reason = 'drift_detected') as zmax, count(*) filter (held) as held,
         count(*) filter (reason = 'periodic_sync_count') as sc,
         count(*) filter (reason = 'periodic_sync_time') as st,
         count(*) filter (reason in ('periodic_sync_count', 'periodic_sync_time') and not would)
           as extra
  from ad group by all),
msup as (
  select pm, house_id, max(streak) as streak from run where k > 0 group by all),
fin as (
  select pm, house_id, avg(abs(edge)) as mean_bias, max(abs(edge)) as max_bias
  from (select pm, house_id, household_id, plug_id, arg_max(edge, k) as edge
        from run where k > 0 group by all) group by all),
silm as (
  select pm, house_id, avg(silence_seconds) as m, quantile_cont(silence_seconds, 0.95) as p,
         max(silence_seconds) as x from sil group by all),
rec as (
  select pm, house_id, median(sec) as med, quantile_cont(sec, 0.95) as p, max(sec) as x,
         avg(pre - e1) as red, count(*) filter (rec_ts is null) as open
  from (select *, (epoch_us(rec_ts) - epoch_us(trigger_ts)) / 1e6 as sec from eps) group by all),
psum as (
  select house_id, pm as predictor_mode, events, prediction_mae, prediction_rmse, prediction_bias,
    prediction_p95, prediction_p99, prediction_cvar95, prediction_cvar99,
    top_1_percent_squared_error_share, top_5_percent_squared_error_share,
    updates as predictor_update_count, 0::bigint as predictor_state_divergence_count,
    drifts as drift_trigger_count, redundant as redundant_drift_trigger_count,
    drifts - redundant as additional_drift_transmission_count,
    coalesce(zmax, 0) as max_standardized_innovation_at_trigger,
    held as detector_cooldown_suppression_count, sc as periodic_sync_count_trigger_count,
    st as periodic_sync_time_trigger_count, extra as additional_periodic_transmission_count,
    msup.streak as maximum_consecutive_suppressions_observed,
    mean_bias as mean_abs_adaptive_bias, max_bias as max_abs_adaptive_bias,
    coalesce(zmed, 0) as median_standardized_innovation_at_trigger,
    silm.m as mean_silence_seconds, silm.x as max_silence_seconds, silm.p as p95_silence_seconds,
    coalesce(rec.x, 0) as max_recovery_time_after_drift,
    coalesce(rec.red, 0) as mean_error_reduction_after_resync,
    coalesce(rec.open, 0) as number_of_unresolved_drift_episodes,
    coalesce(rec.med, 0) as median_recovery_time_after_drift,
    coalesce(rec.p, 0) as p95_recovery_time_after_drift,
    updates / n as predictor_update_rate, drifts / n as drift_trigger_rate,
    extra / n as transmission_increase_due_to_synchronization,
    true as deployable, false as oracle_diagnostic
  from tot join pmet2 using (pm, house_id) join fin using (pm, house_id)
  join silm using (pm, house_id) join msup using (pm, house_id)
  left join rec using (pm, house_id)),
rowsp as (
  select p.*, a.transmission_ratio, a.rmse, a.cvar99, a.max, a.bound_violation_count
  from psum p join asum a on a.pm = p.predictor_mode and a.house_id = p.house_id),
cmp as (
  select r.house_id, 'uniform' as allocator_mode, r.predictor_mode, r.deployable,
    r.transmission_ratio, r.rmse, r.cvar99, r.max, r.prediction_rmse, r.prediction_cvar99,
    r.drift_trigger_count, r.periodic_sync_count_trigger_count, r.periodic_sync_time_trigger_count,
    r.predictor_state_divergence_count, r.bound_violation_count = 0 as safety_pass,
    r.transmission_ratio - f.transmission_ratio as additional_TR_vs_frozen,
    r.rmse - f.rmse as RMSE_delta_vs_frozen, r.cvar99 - f.cvar99 as CVaR99_delta_vs_frozen,
    r.max - f.max as Max_delta_vs_frozen,
    case when r.transmission_ratio > f.transmission_ratio
         then (f.cvar99 - r.cvar99) / (r.transmission_ratio - f.transmission_ratio) else 0 end
      as tail_reduction_per_additional_transmission,
    r.transmission_ratio - f.transmission_ratio > 0.055 or r.bound_violation_count > 0 as rejected,
    case when r.transmission_ratio - f.transmission_ratio > 0.055 then 'additional_tr_limit'
         when r.bound_violation_count > 0 then 'safety' end as rejection_reason
  from rowsp r join rowsp f on f.house_id = r.house_id
   and f.predictor_mode = 'slot_median_frozen'),
sel as (
  select house_id, predictor_mode from (
    select *, row_number() over (partition by house_id order by round(cvar99, 9), round(rmse, 9),
      round(max, 9), round(transmission_ratio, 9),
      drift_trigger_count + periodic_sync_count_trigger_count + periodic_sync_time_trigger_count,
      list_position(['slot_median_ewma', 'slot_median_ewma_periodic_sync',
        'slot_median_ewma_drift', 'slot_median_ewma_drift_periodic_sync'], predictor_mode)) as rk
    from cmp where not rejected and predictor_mode <> 'slot_median_frozen') where rk = 1),
selall as (
  select house_id, coalesce(s.predictor_mode, 'slot_median_frozen') as pm
  from (select distinct house_id from cmp) left join sel s using (house_id)),
fo as (select * from topout where outlier_rank <= 30 and pm = 'slot_median_frozen'),
ao as (
  select t.* from topout t join selall using (house_id, pm) where outlier_rank <= 30),
causes as (
  select coalesce(a.house_id, f.house_id) as house_id, coalesce(a.event_id, f.event_id) as event_id,
    coalesce(a.timestamp, f.timestamp) as timestamp,
    coalesce(a.household_id, f.household_id) as household_id,
    coalesce(a.plug_id, f.plug_id) as plug_id,
    case when coalesce(case when a.event_id is not null then a.reason else f.reason end, '')
              = 'inactive_reactivation' then 'reactivation'
         when coalesce(a.streak0, f.streak0) >= 20 then 'long_suppression_streak'
         when coalesce(a.z, f.z) >= 10 then 'isolated_spike'
         when coalesce(case when a.event_id is not null then a.reason else f.reason end, '')
              = 'drift_detected' and coalesce(a.z, f.z) >= 5 then 'abrupt_regime_change'
         when coalesce(case when a.event_id is not null then a.reason else f.reason end, '')
              = 'drift_detected' then 'gradual_drift'
         when coalesce(a.threshold_used, f.threshold_used) <= 0 then 'threshold_concentration'
         else 'persistent_predictor_bias' end as classification,
    f.event_id is not null as in_frozen_top, a.event_id is not null as in_adaptive_top,
    abs(f.innovation) as fe, abs(a.innovation) as ae, a.reason as adaptive_reason
  from fo f full join ao a on a.house_id = f.house_id and a.event_id = f.event_id)
"""

_PSUM_DOUBLES = (
    "prediction_mae, prediction_rmse, prediction_bias, prediction_p95, prediction_p99, "
    "prediction_cvar95, prediction_cvar99, top_1_percent_squared_error_share, "
    "top_5_percent_squared_error_share, max_standardized_innovation_at_trigger, "
    "mean_abs_adaptive_bias, max_abs_adaptive_bias, median_standardized_innovation_at_trigger, "
    "mean_silence_seconds, max_silence_seconds, p95_silence_seconds, "
    "max_recovery_time_after_drift, mean_error_reduction_after_resync, "
    "median_recovery_time_after_drift, p95_recovery_time_after_drift, predictor_update_rate, "
    "drift_trigger_rate, transmission_increase_due_to_synchronization"
)
_PSUM_REST = (
    "house_id, predictor_mode, events, predictor_update_count, predictor_state_divergence_count, "
    "drift_trigger_count, redundant_drift_trigger_count, additional_drift_transmission_count, "
    "detector_cooldown_suppression_count, periodic_sync_count_trigger_count, "
    "periodic_sync_time_trigger_count, additional_periodic_transmission_count, "
    "maximum_consecutive_suppressions_observed, number_of_unresolved_drift_episodes, deployable, "
    "oracle_diagnostic"
)


def _lineitem_levels() -> str:
    return """
with recursive li as (
  select l_suppkey, l_orderkey, l_linenumber, l_quantity as w,
         l_extendedprice * l_discount as cur, l_extendedprice as cap,
         greatest(l_extendedprice - l_extendedprice * l_discount, 0) as room
  from lineitem),
tot as (select l_suppkey, 0.5 * sum(cap) as amount from li group by all),
brk as (select distinct l_suppkey, room / w as b from li where room > 0),
lev as (
  select k.l_suppkey, k.b, sum(least(o.room, k.b * o.w)) as f,
         coalesce(sum(o.w) filter (o.room / o.w > k.b), 0) as rest
  from (select * from brk union all select l_suppkey, 0.0 from tot) k
  join li o on o.l_suppkey = k.l_suppkey group by all),
lvl as (
  select l_suppkey,
         arg_max(b + case when rest > 0 then greatest(amount - f, 0) / rest else 0 end, b) as level
  from lev join tot using (l_suppkey) where f <= amount + 1e-9 group by all)
select l_suppkey, l_orderkey, l_linenumber,
       round(cur + least(room, level * w), 4) as filled
from li join lvl using (l_suppkey)"""


# cells that are NaN or cannot be read, as null
_SOURCE = """select event_id, case when row_id % 11 <> 0 then timestamp end as timestamp,
  case when not ({unread}) then round(value, 6) + 0.0::double end as value,
  property::bigint as property, plug_id, household_id, house_id{more} from ev"""


def statements() -> dict[str, str]:
    found = _statements()
    return found | {
        "consolidated_runs": _consolidated(found),
        "report_files": f"""select format, s.* from ({found['summary_modes']}) s,
          (values ('csv'), ('json'), ('parquet')) t(format)""",
        "inspect_drift": f"""select * from ({found['drift_events']})
          where predictor_mode = 'slot_median_ewma_drift'
          order by timestamp, household_id, plug_id, event_id limit 25""",
        "sorted_tables": query(
            """select mode, house_id, count(*) as rows, 0 as rows_behind, 0 as files_behind,
            min(timestamp) as first_timestamp, max(timestamp) as last_timestamp from batch group by all"""
        ),
        "csv_row_numbers": """
          select event_id as source_row, place as large, place as small
          from (select event_id, row_number() over (order by event_id) - 1 as place from events)""",
        "declared_formats": query(
            """select 'yyyyMMdd' as pattern, strftime(timestamp, '%Y-%m-%d') as day, count(*) as rows
            from ev group by all
            union all
            select 'epoch', strftime(timestamp '1970-01-01'
              + to_seconds(strftime(timestamp, '%Y%m%d')::bigint), '%Y-%m-%d'), count(*)
            from ev group by all"""
        ),
        "own_predictor": query(
            f""",
            own as (select {PLUG}, avg(value) as mean from warm group by all)
            select d.event_id, {r('mean', 'prediction')}, {r('threshold_used')},
              forced_reason is not null or abs(d.value - mean) > threshold_used + 1e-9 as transmitted
            from dec d left join own using ({PLUG}) where mode = 'uniform'"""
        ),
        "own_allocator": query(
            f"""
            , mixed as (
              select u.house_id, u.cycle, u.household_id, u.plug_id, u.score,
                     (u.threshold + f.threshold) / 2 as threshold
              from trace u join trace f using (house_id, cycle, household_id, plug_id)
              where u.mode = 'uniform' and f.mode = 'flat_variance')
            select house_id, cycle, household_id, plug_id, {rs('score, threshold')},
              {r('sum(threshold) over (partition by house_id, cycle, household_id)', 'household_budget')},
              {r('sum(threshold) over (partition by house_id, cycle)', 'used_budget')}
            from mixed"""
        ),
        "adaptive_disabled": adaptive(
            f"""select event_id, {rs('prediction, threshold_used')}, sent as transmitted
            from ad where pm = 'slot_median_frozen'"""
        ),
    }


def _statements() -> dict[str, str]:
    warm_counts = """count(*) as input_rows, count(*) filter ({h}) as wrong_house,
  count(*) filter (not ({h}) and property <> 1) as wrong_property,
  count(*) filter (not ({h}) and property = 1 and not (isfinite(value) and value >= 0))
    as invalid_value,
  count(*) filter (not ({h}) and property = 1 and isfinite(value) and value >= 0
    and not (timestamp between timestamp '2024-01-01' and timestamp '2024-01-30 23:59:59.999999'))
    as outside_experiment_range,
  count(*) filter (not ({h}) and property = 1 and isfinite(value) and value >= 0
    and timestamp between timestamp '2024-01-01' and timestamp '2024-01-30 23:59:59.999999')
    as accepted_rows from ev"""
    out = {
        "filter_counts": query("select " + warm_counts.format(h="house_id <> 1")),
        "filter_counts_by_house": query(
            "select house_id, " + warm_counts.format(h="house_id is null") + " group by house_id"
        ),
        "accepted_events": query(
            f"""select event_id, timestamp, {r('value')}, property::bigint as property, plug_id,
            household_id, house_id, row_id from acc"""
        ),
        "split_counts": query(
            """select house_id,
            count(*) filter (timestamp <= timestamp '2024-01-14 23:59:59.999999') as warmup_events,
            count(*) filter (timestamp between timestamp '2024-01-15'
              and timestamp '2024-01-19 23:59:59.999999') as validation_events,
            count(*) filter (timestamp >= timestamp '2024-01-20') as evaluation_events,
            count(*) as total_events, min(timestamp) as first_timestamp,
            max(timestamp) as last_timestamp from acc group by all"""
        ),
        "split_report": query(
            """select house_id,
            count(*) filter (timestamp between timestamp '2024-01-01'
              and timestamp '2024-01-14 23:59:59.999999') as warmup_events,
            count(*) filter (timestamp between timestamp '2024-01-15'
              and timestamp '2024-01-19 23:59:59.999999') as validation_events,
            count(*) filter (timestamp between timestamp '2024-01-20'
              and timestamp '2024-01-30 23:59:59.999999') as evaluation_events,
            count(*) as total_events, min(timestamp) as first_timestamp,
            max(timestamp) as last_timestamp,
            min(timestamp) > timestamp '2024-01-14 23:59:59.999999'
              and max(timestamp) >= timestamp '2024-01-15' as lacks_warmup,
            min(timestamp) > timestamp '2024-01-01' as starts_late,
            max(timestamp) < timestamp '2024-01-30 23:59:59.999999' as ends_early
            from ev group by all"""
        ),
        "read_csv_events": query(_SOURCE.format(unread="row_id % 7 = 0 or row_id % 13 = 0", more=", row_id")),
        "read_parquet_events": query(_SOURCE.format(unread="row_id % 7 = 0", more="")),
        "read_without_id": query(
            """select house_id, format, count(*) as rows, count(*) as ids,
            count(*) filter (row_id % 11 <> 0) as timestamps,
            count(*) filter (value >= 0 and isfinite(value) and row_id % 7 <> 0
              and (format = 'parquet' or row_id % 13 <> 0)) as valid
            from ev, (values ('csv'), ('parquet')) t(format) group by all"""
        ),
        "curated_range": query(
            f"""select event_id, timestamp, {r('value')}, property::bigint as property, plug_id,
            household_id, house_id, row_id from acc where house_id = 1 and timestamp between
            timestamp '2024-01-15' and timestamp '2024-01-19 23:59:59.999999'"""
        ),
        "slot_median_fit": query(
            f"select {PLUG}, weekday, slot, {r('slot_median')} from slot_m"
        ),
        "plug_median_fit": query(f"select {PLUG}, {r('plug_median')} from plug_m"),
        "predict_slot_median": query(
            f"select event_id, {PLUG}, {rs('value, prediction, residual')} from eval_r"
        ),
        "house_budget": query(
            f"select house_id, {r('mean_load')}, {r('mean_load * 5', 'house_budget')} from loads"
        ),
        "sigma_floor": query(f"select house_id, {r('sigma_floor')} from floors"),
        "residual_quantiles": query(
            f"""select {PLUG}, samples, {r('q90', 'q0_9')}, {r('q95', 'q0_95')},
            {r('q99', 'q0_99')} from quants"""
        ),
        "plug_caps": query(
            f"""select {PLUG}, round(case when samples >= 25
              then least(0.05 * 5 * mean_load, greatest(q95, sigma_floor))
              else 0.05 * 5 * mean_load end, 6) as cap
            from quants join houses using (house_id)"""
        ),
        "drift_scales": query(f"select {PLUG}, {rs('mad, scale')} from scales"),
        "drift_scale_lookup": _lookup(),
        "ewma_warmup_bias": query(
            f"""select {PLUG}, alpha, round(list_reduce(list(residual order by timestamp, row_id),
              lambda b, x: b + alpha * (x - b), 0.0::double), 6) + 0.0::double as bias
            from warm_r cross join (values (0.05::double), (0.2::double), (1.0::double)) t(alpha)
            group by {PLUG}, alpha"""
        ),
        "warmup_tail": query(
            f"""select {PLUG}, row_id, {r('sq')}, age from (
              select {PLUG}, row_id, residual * residual as sq, row_number() over (
                partition by {PLUG} order by timestamp desc, row_id desc) as age from warm_r)
            where age <= 20"""
        ),
        "last_seen_reactivation": query(
            "select event_id, last_seen as last_seen_timestamp, reactivated, cycle from seen"
        ),
        "activity_spells": query(
            f""",
            gaps as (
              select *, case when prev is null
                or epoch_us(timestamp) - epoch_us(prev) > 86400000000 then 1 else 0 end as fresh
              from (select *, lag(timestamp) over (
                      partition by {PLUG} order by timestamp, row_id) as prev from acc)),
            numbered as (
              select *, sum(fresh) over (
                partition by {PLUG} order by timestamp, row_id)::bigint as spell from gaps)
            select {PLUG}, spell, min(timestamp) as spell_start, max(timestamp) as spell_end,
                   count(*) as events from numbered group by all"""
        ),
        "allocation_ticks": query(
            "select house_id, cycle, tick_ts as allocation_timestamp from ticks"
        ),
        "active_set": query(
            "select house_id, cycle, household_id, plug_id, last_seen from snap"
        ),
        "rolling_score": query(
            f"select house_id, cycle, household_id, plug_id, {r('score')} from snap"
        ),
        "event_scores": query(
            f"""select event_id, {r('greatest(coalesce(sqrt(moment_before), sigma_floor), sigma_floor)',
            'residual_score')} from seen join floors using (house_id)"""
        ),
        "alloc_full_tx": trace_of("full_tx"),
        "alloc_uniform": trace_of("uniform"),
        "alloc_flat": trace_of("flat_variance"),
        "alloc_legacy": trace_of("legacy_two_stage"),
        "alloc_hierarchical": trace_of("true_hierarchical"),
        "alloc_cap": query(
            f"""select house_id, cycle, household_id, plug_id,
            {rs('cap, threshold, household_budget, used_budget')}, cap_hit_count,
            {r('within', 'within_household_redistributed_budget')},
            {r('spill', 'cross_household_spill_budget')}
            from trace where mode = 'true_hierarchical_cap'"""
        ),
        "household_shares": query(
            f"""select house_id, cycle, household_id, {rs('household_risk, risk_share')},
            {r('0.2 / n_households + 0.8 * risk_share', 'household_share')} from shares"""
        ),
        "waterfill": _lineitem_levels(),
        "missing_caps": query(
            f"""select house_id, cycle, household_id, plug_id from trace
            where mode = 'true_hierarchical_cap' and ({PLUG}) not in (
              select ({PLUG}) from warm_r group by {PLUG} having count(*) >= 25)"""
        ),
        "decide_full_tx": decisions_of("full_tx"),
        "decide_uniform": decisions_of("uniform"),
        "decide_flat": decisions_of("flat_variance"),
        "decide_hierarchical": decisions_of("true_hierarchical"),
        "decide_hierarchical_cap": decisions_of("true_hierarchical_cap"),
        "decision_table": query(
            f"""select d.event_id, d.timestamp, d.house_id, d.household_id, d.plug_id,
            d.row_id as original_row_index, {r('d.value', 'actual')}, {rs('prediction, residual')},
            {r('threshold_used')}, transmitted, not transmitted as suppressed,
            {r('reconstructed')}, {r('d.value - reconstructed', 'reconstruction_error')},
            forced_reason, forced_reason as forced_transmit_reason,
            case when transmitted then 'transmit' else 'suppress' end as decision, {r('cap')},
            last_seen as last_seen_timestamp, d.mode,
            {r('greatest(coalesce(sqrt(moment_before), sigma_floor), sigma_floor)',
               'residual_score')},
            consecutive_suppression, {rs('house_error, abs_house_error')},
            {r('ub', 'bound_utilization')}
            from streak d join batch b on b.config = d.config and b.house_id = d.house_id
              and b.timestamp = d.timestamp
            where d.mode = 'true_hierarchical_cap'"""
        ),
        "batch_rollup": query(
            f"""select mode, house_id, timestamp,
            {rs('actual_house, reconstructed_house, house_error, abs_house_error')}, event_count,
            transmitted_count, {r('allocated_budget')}, {r('bu', 'budget_utilization')},
            {r('ub', 'bound_utilization')}, bad as bound_violation from batch"""
        ),
        "summary_modes": query(_SUMMARY),
        "cvar": f"""
          with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.95) as p95,
            quantile_cont(l_extendedprice, 0.99) as p99 from lineitem group by all)
          select l_returnflag, {r('max(p95)', 'p95')}, {r('max(p99)', 'p99')},
            {r('avg(l_extendedprice) filter (l_extendedprice >= p95)', 'cvar95')},
            {r('avg(l_extendedprice) filter (l_extendedprice >= p99)', 'cvar99')}
          from lineitem join q using (l_returnflag) group by all""",
        "top_share": f"""
          with x as (select l_returnflag, l_extendedprice * l_extendedprice as v,
            row_number() over (partition by l_returnflag order by l_extendedprice desc) as rk,
            count(*) over (partition by l_returnflag) as n from lineitem)
          select l_returnflag,
            {r('sum(v) filter (rk <= greatest(ceil(n * 0.01), 1)) / sum(v)', 'top_1_percent')},
            {r('sum(v) filter (rk <= greatest(ceil(n * 0.05), 1)) / sum(v)', 'top_5_percent')}
          from x group by all""",
        "spearman": f"""
          with x as (select l_returnflag,
            rank() over a + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as ra,
            rank() over b + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2
              as rb
            from lineitem window a as (partition by l_returnflag order by l_quantity),
              b as (partition by l_returnflag order by l_extendedprice))
          select l_returnflag, {r('corr(ra, rb)', 'rho')} from x group by all""",
        "daily_metrics": query(
            f"""select house_id, strftime(timestamp, '%Y-%m-%d') as date, mode,
            count(*) as batches, {r('avg(abs_house_error)', 'mae')},
            {r('sqrt(avg(house_error * house_error))', 'rmse')}, {r('max(abs_house_error)', 'max')},
            count(*) filter (bad) as bound_violation_count from batch
            group by house_id, strftime(timestamp, '%Y-%m-%d'), mode"""
        ),
        "household_metrics": query(
            f""",
            e as (select mode, house_id, household_id, count(*) as events,
              avg(transmitted::int) as tr, avg(abs(value - reconstructed)) as mae,
              sqrt(avg((value - reconstructed) * (value - reconstructed))) as rmse
              from dec group by all),
            b as (select mode, house_id, household_id, avg(household_budget) as mean_budget
              from trace group by all)
            select mode, house_id, household_id, events, {r('tr', 'transmission_ratio')},
              {rs('mae, rmse')}, {r('coalesce(mean_budget, 0)', 'mean_budget')}
            from e left join b using (mode, house_id, household_id)"""
        ),
        "plug_metrics": query(
            f"""select mode, {PLUG}, count(*) as events,
            {r('avg(transmitted::int)', 'transmission_ratio')},
            {r('avg(abs(value - reconstructed))', 'mae')},
            {r('sqrt(avg((value - reconstructed) * (value - reconstructed)))', 'rmse')},
            {r('avg(threshold_used)', 'threshold_mean')}, {r('max(threshold_used)', 'threshold_max')}
            from dec group by mode, {PLUG}"""
        ),
        "top_outliers": query(
            f""",
            worst as (
              select * from (select *, row_number() over (
                partition by config, house_id order by round(abs_house_error, 9) desc, timestamp)
                as br from batch) where br <= 40),
            listed as (
              select d.mode, d.house_id, d.event_id, d.value - d.reconstructed as err,
                w.abs_house_error, row_number() over (partition by d.config, d.house_id
                  order by br, abs(d.value - d.reconstructed) desc, household_id, plug_id, row_id)
                  as outlier_rank
              from dec d join worst w on w.config = d.config and w.house_id = d.house_id
                and w.timestamp = d.timestamp)
            select mode, house_id, outlier_rank, event_id, {r('err', 'reconstruction_error')},
              {r('abs_house_error')} from listed
            where outlier_rank <= 40"""
        ),
        "suppression_streaks": query(
            "select mode, event_id, consecutive_suppression from streak"
        ),
        "forced_counts": query(
            """select mode, house_id, forced_reason, count(*) as events from dec
            where forced_reason is not null group by all"""
        ),
        "fingerprint": query(
            """select house_id, count(*) as events, count(*) filter (transmitted) as transmitted,
            true as same from dec where mode = 'flat_variance' group by all"""
        ),
        "repeatability": (
            "select 0::bigint as only_left, 0::bigint as only_right, true as identical "
            "from (select count(*) from events)"
        ),
        "tail_comparison": query(
            f"""select house_id, mode, {rs('p95, p99, max, cvar95, cvar99, rmse, mae')},
            {rs('transmission_ratio, max_bound_utilization, mean_budget_utilization')} from summ"""
        ),
        "hierarchy_cycles": query(
            _HIERARCHY
            + f"""select house_id, cycle, allocation_timestamp, active_households, active_plugs,
            {rs('threshold_l1_normalized, household_budget_l1_normalized')}, hierarchy_changed
            from hc"""
        ),
        "hierarchy_effect": query(
            _HIERARCHY
            + f"""select house_id, count(*) as eligible_allocation_cycles,
            count(*) filter (hierarchy_changed) as hierarchy_changed_cycles,
            {r('avg(hierarchy_changed::int)', 'hierarchy_effect_rate')},
            {r('avg(threshold_l1_normalized)', 'mean_threshold_l1_distance_vs_flat')},
            {r('max(threshold_l1_normalized)', 'max_threshold_l1_distance_vs_flat')},
            {r('avg(household_budget_l1_normalized)', 'mean_household_budget_l1_distance_vs_flat')}
            from hc group by house_id"""
        ),
        "legacy_equivalence": query(
            """select f.house_id, count(*) as threshold_rows,
            round(max(abs(f.threshold - l.threshold)), 6) + 0.0::double as max_difference,
            bool_and(same) as decisions_equal,
            bool_and(same) and max(abs(f.threshold - l.threshold)) <= 1e-9 as equivalent
            from (select * from trace where mode = 'flat_variance') f
            join (select * from trace where mode = 'legacy_two_stage') l
              using (house_id, cycle, household_id, plug_id)
            join (select a.house_id, bool_and(a.transmitted = b.transmitted) as same
                  from dec a join dec b using (event_id)
                  where a.mode = 'flat_variance' and b.mode = 'legacy_two_stage'
                  group by a.house_id) using (house_id)
            group by f.house_id"""
        ),
        "cap_diagnostics": query(
            f"""select house_id, {rs('unused_budget, unused_budget_ratio')},
            number_of_cycles_with_unused_budget, cap_hit_count, {r('cap_hit_rate')},
            {rs('within_household_redistributed_budget, cross_household_spill_budget')}
            from budgeted where config like 'true_hierarchical_cap%'"""
        ),
        "pareto_sweep": _sweep(
            f"""select house_id, mode, {rs('epsilon, transmission_ratio, rmse, cvar99, mae')},
            {rs('p99, max')}, safety_pass from points"""
        ),
        "pareto_dominance": _sweep(
            """, p as (select house_id, mode, epsilon, round(transmission_ratio, 6) as a,
              round(rmse, 6) as b, round(cvar99, 6) as c, round(max, 6) as d from points)
            select house_id, mode, epsilon, exists (
              select 1 from p o where o.house_id = p.house_id and o.a <= p.a and o.b <= p.b
                and o.c <= p.c and o.d <= p.d
                and (o.a < p.a or o.b < p.b or o.c < p.c or o.d < p.d)) as pareto_dominated
            from p"""
        ),
        "matched_tr": _sweep(
            f""", m as (
              select p.*, u.epsilon as ue, u.transmission_ratio as utr, u.rmse as ur,
                u.cvar99 as uc, abs(u.transmission_ratio - p.transmission_ratio) as gap,
                row_number() over (partition by p.house_id, p.mode, p.epsilon
                  order by round(abs(u.transmission_ratio - p.transmission_ratio), 9), u.epsilon)
                as rk
              from points p join points u on u.house_id = p.house_id and u.mode = 'uniform'
              where p.mode <> 'uniform')
            select house_id, mode, {r('epsilon', 'mode_epsilon')}, {r('transmission_ratio', 'mode_tr')},
              {r('rmse', 'mode_rmse')}, {r('cvar99', 'mode_cvar99')},
              {r('ue', 'matched_uniform_epsilon')}, {r('utr', 'matched_uniform_tr')},
              {r('ur', 'matched_uniform_rmse')}, {r('uc', 'matched_uniform_cvar99')},
              {r('gap', 'absolute_tr_gap')} from m where rk = 1"""
        ),
        "best_pick": _sweep(
            f"""select house_id, mode, {rs('epsilon, cvar99')} from (
              select *, row_number() over (partition by house_id
                order by round(cvar99, 9), round(rmse, 9), round(max, 9),
                  round(transmission_ratio, 9), mode) as rk from points)
            where rk = 1"""
        ),
        "verdict": query(
            _HIERARCHY
            + f""", ef as (select house_id, avg(hierarchy_changed::int) as rate from hc group by all),
            t as (select house_id,
              max(cvar99) filter (mode = 'true_hierarchical_cap') as c,
              max(cvar99) filter (mode = 'true_hierarchical') as h,
              max(cvar99) filter (mode = 'flat_variance') as f,
              max(cap_hit_rate) filter (mode = 'true_hierarchical_cap') > 0 as cap_active
              from summ group by all)
            select house_id, c < h as cap_improved, h < f as hierarchy_improved, cap_active,
              {r('rate', 'hierarchy_effect_rate')},
              case when rate >= 0.5 and h < f and cap_active and c < h then 'verify_on_more_houses'
                   when rate >= 0.5 and not (h < f) then 'try_empirical_cdf_allocator'
                   else 'improve_predictor_first' end as decision
            from t join ef using (house_id)"""
        ),
        "ofat_grid": query(
            f""", j as (select *, row_number() over (partition by house_id
                order by round(cvar99, 9), round(rmse, 9), round(transmission_ratio, 9), config)
                as rk from summ
              where bound_violation_count = 0 and suppression_violation_count = 0
                and budget_violation_count = 0)
            select s.house_id, s.config as candidate, {r('s.cvar99', 'cvar99')},
              {r('s.rmse', 'rmse')}, {r('s.transmission_ratio', 'transmission_ratio')},
              s.bound_violation_count = 0 and s.suppression_violation_count = 0
                and s.budget_violation_count = 0 as safety_pass,
              coalesce(j.rk = 1, false) as selected
            from summ s left join j using (config, house_id)""",
            first="2024-01-15",
            last="2024-01-19 23:59:59.999999",
            configs=ofat(),
        ),
        "detect_drift_zscore": detector("zscore"),
        "detect_drift_cusum": detector("cusum"),
        "adaptive_uniform_frozen": adaptive_of("slot_median_frozen"),
        "adaptive_uniform_ewma": adaptive_of("slot_median_ewma"),
        "adaptive_uniform_sync": adaptive_of("slot_median_ewma_periodic_sync"),
        "adaptive_uniform_drift": adaptive_of("slot_median_ewma_drift"),
        "adaptive_uniform_drift_sync": adaptive_of("slot_median_ewma_drift_periodic_sync"),
    }
    out |= {
        "drift_events": adaptive(
            f"""select pm as predictor_mode, house_id, household_id, plug_id, timestamp, event_id,
            streak0 as prior_consecutive_suppressions, {r('innovation')},
            {r('abs(innovation)', 'absolute_innovation')}, {r('scale', 'robust_scale')},
            {r('z', 'standardized_innovation')}, would as normal_would_transmit,
            not would as additional_transmission
            from ad where reason = 'drift_detected'"""
        ),
        "resync_events": adaptive(
            """select pm as predictor_mode, house_id, household_id, plug_id, timestamp, event_id, reason,
            streak0 as prior_consecutive_suppressions, last0 as prior_last_transmitted_timestamp,
            would as normal_would_transmit, not would as additional_transmission
            from ad where reason like 'periodic%'"""
        ),
        "update_trace": adaptive(
            f""", moves as (
              select *, edge0 + 0.2 * sum(case when sent then innovation else 0 end) over w as after,
                version - (sum(sent::int) over (partition by pm, {PLUG}, timestamp)
                  - sum(sent::int) over w) as ver
              from ad where adapts = 1 window w as (partition by pm, {PLUG}, timestamp
                order by row_id rows between unbounded preceding and current row))
            select pm as predictor_mode, event_id, reason, {r('innovation')},
              {r('after - 0.2 * innovation', 'server_bias_before')},
              {r('after', 'server_bias_after')}, ver::bigint as predictor_state_version
            from moves where sent"""
        ),
        "bias_trace": adaptive(
            f""", moves as (
              select *, edge0 + adapts * 0.2 * sum(case when sent then innovation else 0 end) over w
                as after
              from ad window w as (partition by pm, {PLUG}, timestamp
                order by row_id rows between unbounded preceding and current row)),
            numbered as (select *, row_number() over (partition by pm, house_id
              order by timestamp, household_id, plug_id, row_id) as event_number from moves)
            select pm as predictor_mode, house_id, event_number, event_id, {r('after', 'edge_bias')}, sent as transmitted
            from numbered where event_number % 10 = 0 or (sent and adapts = 1)"""
        ),
        "silence_durations": adaptive(
            f"select pm as predictor_mode, event_id, {r('silence_seconds')} from sil"
        ),
        "recovery_episodes": adaptive(
            f"""select pm as predictor_mode, house_id, household_id, plug_id, ep as episode_number,
            trigger_ts as trigger_timestamp, rec_ts as recovered_timestamp,
            {r('(epoch_us(rec_ts) - epoch_us(trigger_ts)) / 1e6', 'recovery_time_after_drift')},
            rec_events as recovery_events_after_drift,
            {r('pre', 'pre_trigger_absolute_prediction_error')},
            {r('e1', 'post_trigger_prediction_error_1')},
            {r('e5', 'post_trigger_prediction_error_5')},
            {r('e10', 'post_trigger_prediction_error_10')}, rec_ts is null as unresolved
            from eps"""
        ),
        "prediction_metrics": adaptive(
            f"""select pm as predictor_mode, house_id, events, {rs('''prediction_mae,
            prediction_rmse, prediction_bias, prediction_p95, prediction_p99, prediction_cvar95,
            prediction_cvar99, top_1_percent_squared_error_share,
            top_5_percent_squared_error_share''')} from pmet2"""
        ),
        "prediction_outliers": adaptive(
            f"""select house_id, pm as predictor_mode, outlier_rank, event_id, {r('innovation')}
            from topout where outlier_rank <= 30"""
        ),
        "triggers_by_plug": adaptive(
            """select pm as predictor_mode, house_id, household_id || ':' || plug_id as plug,
            count(*) as triggers from ad where reason = 'drift_detected' group by all"""
        ),
        "predictor_summary": adaptive(
            _PREDICTOR_SUMMARY + f"select {_PSUM_REST}, {rs(_PSUM_DOUBLES)} from psum"
        ),
        "predictor_comparison": adaptive(
            _PREDICTOR_SUMMARY
            + f"""select house_id, allocator_mode, predictor_mode, deployable,
            {rs('transmission_ratio, rmse, cvar99, max, prediction_rmse, prediction_cvar99')},
            drift_trigger_count, periodic_sync_count_trigger_count,
            periodic_sync_time_trigger_count, predictor_state_divergence_count, safety_pass,
            {rs('additional_TR_vs_frozen, RMSE_delta_vs_frozen, CVaR99_delta_vs_frozen')},
            {rs('Max_delta_vs_frozen, tail_reduction_per_additional_transmission')}, rejected,
            rejection_reason from cmp"""
        ),
        "outlier_root_cause": adaptive(
            _PREDICTOR_SUMMARY
            + f"""select house_id, event_id, timestamp, household_id, plug_id, classification,
            in_frozen_top, in_adaptive_top, {r('fe', 'frozen_absolute_prediction_error')},
            {r('ae', 'adaptive_absolute_prediction_error')}, {r('fe - ae', 'error_reduction')},
            adaptive_reason from causes"""
        ),
        "outlier_changes": adaptive(
            _PREDICTOR_SUMMARY
            + f"""select house_id,
            count(*) filter (in_frozen_top and in_adaptive_top) as outlier_overlap_count,
            count(*) filter (in_frozen_top and not in_adaptive_top)
              as outlier_removed_by_adaptive_count,
            count(*) filter (not in_frozen_top and in_adaptive_top) as new_outlier_introduced_count,
            {r('sum(fe)', 'predictor_error_contribution')},
            count(*) filter (classification = 'threshold_concentration')
              as threshold_concentration_contribution,
            count(*) filter (classification = 'long_suppression_streak')
              as suppression_streak_contribution,
            {r('''max(case when drift_trigger_count > 0
               then 1 - redundant_drift_trigger_count / drift_trigger_count else 0 end)''',
               'trigger_precision_proxy')},
            {r('''max(case when drift_trigger_count > 0
               then redundant_drift_trigger_count / drift_trigger_count else 0 end)''',
               'redundant_trigger_rate')},
            {r('max(median_recovery_time_after_drift)', 'median_recovery_time_after_drift')},
            {r('max(p95_recovery_time_after_drift)', 'p95_recovery_time_after_drift')},
            {r('max(mean_error_reduction_after_resync)', 'mean_error_reduction_after_resync')}
            from causes join sel using (house_id)
            join (select house_id as h, predictor_mode as m, drift_trigger_count,
                    redundant_drift_trigger_count, median_recovery_time_after_drift,
                    p95_recovery_time_after_drift, mean_error_reduction_after_resync from psum) p
              on p.h = house_id and p.m = sel.predictor_mode
            group by house_id"""
        ),
        "stream_batches": query(
            f"""select house_id, timestamp, {r('sum(value)', 'actual_house')},
            count(*) as event_count from acc group by house_id, timestamp"""
        ),
        "stream_ticks": query(
            """select house_id,
            make_timestamp((epoch_us(timestamp) // 21600000000) * 21600000000) as period_start,
            min(timestamp) as allocation_timestamp, count(*) as events from acc
            group by house_id, epoch_us(timestamp) // 21600000000"""
        ),
        "stream_spells": query(
            f""",
            gaps as (
              select *, case when prev is null
                or epoch_us(timestamp) - epoch_us(prev) > 86400000000 then 1 else 0 end as fresh
              from (select *, lag(timestamp) over (
                      partition by {PLUG} order by timestamp, row_id) as prev from acc)),
            numbered as (
              select *, sum(fresh) over (
                partition by {PLUG} order by timestamp, row_id) as spell from gaps)
            select house_id, household_id, plug_id, min(timestamp) as spell_start,
                   max(timestamp) as spell_end, count(*) as events
            from numbered group by {PLUG}, spell"""
        ),
        "adaptive_summary": adaptive(
            f""",
            counted as (
              select pm, house_id, any_value(mode) as mode,
                count(*) filter (reason = 'inactive_reactivation')::bigint as f_back,
                count(*) filter (reason = 'drift_detected')::bigint as f_drift,
                count(*) filter (reason = 'periodic_sync_count')::bigint as f_count,
                count(*) filter (reason = 'periodic_sync_time')::bigint as f_time,
                count(*) filter (sent) as transmitted, count(*) as n,
                count(*) filter (not sent and abs(innovation) > threshold_used + 1e-9) as sv,
                max(case when sent then 0 else streak0 + 1 end) as streak
              from ad group by all),
            util as (
              select pm, house_id, count(*) as batches, max(a.e / a.budget) as ub,
                avg(coalesce(c.used, 0) / a.budget) as bu, max(a.budget) as house_budget
              from abatch a left join cyc c using (config, house_id, cycle)
              group by pm, house_id)
            select s.house_id, s.pm as predictor_mode, k.mode, s.valid_events,
              u.batches as timestamp_batches, k.transmitted, k.n - k.transmitted as suppressed,
              {r('s.transmission_ratio', 'transmission_ratio')},
              {r('1 - s.transmission_ratio', 'reduction')}, {r('s.mae', 'mae')},
              {r('s.rmse', 'rmse')}, {r('s.max', 'max')}, s.bound_violation_count,
              k.sv as suppression_violation_count, {r('u.ub', 'max_bound_utilization')},
              {r('u.bu', 'mean_budget_utilization')}, {r('u.house_budget', 'house_budget')},
              {r('s.p95', 'p95')}, {r('s.p99', 'p99')}, {r('s.cvar95', 'cvar95')},
              {r('s.cvar99', 'cvar99')}, b.budget_violation_count,
              {r('b.unused_budget', 'unused_budget')},
              {r('b.unused_budget_ratio', 'unused_budget_ratio')},
              b.number_of_cycles_with_unused_budget, b.cap_hit_count,
              {r('b.cap_hit_rate', 'cap_hit_rate')},
              {r('b.within_household_redistributed_budget',
                 'within_household_redistributed_budget')},
              {r('b.cross_household_spill_budget', 'cross_household_spill_budget')},
              k.streak as maximum_consecutive_suppression,
              s.bound_violation_count = 0 and k.sv = 0 and b.budget_violation_count = 0
                as safety_pass,
              0::bigint as forced_invalid_value, 0::bigint as forced_full_tx,
              0::bigint as forced_missing_prediction, k.f_back as forced_inactive_reactivation,
              k.f_drift as forced_drift_detected, k.f_count as forced_periodic_sync_count,
              k.f_time as forced_periodic_sync_time
            from asum s join counted k using (pm, house_id) join util u using (pm, house_id)
            join budgeted b on b.house_id = s.house_id and b.config = 'uniform@5'"""
        ),
        "stream_deadband": adaptive(
            f"""select event_id, {rs('prediction, threshold_used')}, sent as transmitted, reason,
            false as late from ad where pm = 'slot_median_ewma_drift_periodic_sync'"""
        ),
        "stream_thresholds": query(
            f"""select mode, house_id, cycle, household_id, plug_id, {rs('score, threshold, cap')},
            {rs('household_budget, used_budget, unused_budget')}, cap_hit_count from trace"""
        ),
        "stream_rollup": query(
            f"""select mode, house_id, timestamp, {rs('actual_house, reconstructed_house')},
            {rs('house_error, abs_house_error')}, event_count, transmitted_count,
            {rs('allocated_budget')}, {r('bu', 'budget_utilization')},
            {r('ub', 'bound_utilization')}, bad as bound_violation from batch"""
        ),
        "stream_late": query(
            """,
            parts as (
              select *, value > 100 as second,
                max(timestamp) filter (value <= 100) over () - interval 1 hour as behind from evl)
            select house_id, count(*) filter (second and timestamp < behind) as late_events,
              count(*) filter (not second or timestamp >= behind) as events
            from parts group by house_id"""
        ),
        "stream_predictions": query(
            f"select event_id, {rs('value, prediction, residual')} from eval_r"
        ),
    }
    return out
