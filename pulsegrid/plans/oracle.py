"""DuckDB SQL for the rows of the queries, over the driver's views."""

from __future__ import annotations

from ..functions.arrays import masks
from ..operators.dsp import blackman_harris
from ..params import INSTRUMENTS
from ..sources.tables import EVENT_INSTRUMENT
from . import queries as Q
from . import state_sql

_NAMES = "case event_type " + " ".join(f"when '{e}' then '{i}'" for e, i in EVENT_INSTRUMENT.items()) + " end"
_INDEX = "case instrument " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(INSTRUMENTS)) + " end"
F = f"""f as (select user_id as stream_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_idx,
    value as x, event_type, {_NAMES} as instrument, ts, event_id, props from events)"""
B = """b as (select cast(label as bigint) as stream_id, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame_idx,
    vec_id, list_transform(embedding, lambda v: cast(v as double)) as bands from embeddings)"""
H = F + ", h as (select stream_id, instrument, frame_idx, round(frame_idx * 4096.0::double / 40960.0::double, 6) as t, x, ts from f)"
I = (
    H
    + """, recent as (select *, t - lag(t) over w as gap, list(t) over (partition by stream_id, instrument order by frame_idx rows 19 preceding) as r
        from h window w as (partition by stream_id, instrument order by frame_idx)),
    gaps as (select *, list_filter(list_transform(range(1, len(r)), lambda i: round(r[i + 1] - r[i], 9)), lambda g: g >= 0.3 and g <= 4.0) as g from recent),
    i as (select stream_id, instrument, frame_idx, t, round(gap, 9) as gap, cast(len(r) as integer) as n_recent, cast(len(g) as integer) as n_valid,
        case when len(g) >= 2 then list_median(g) end as period_median,
        case when len(g) >= 2 then 1.4826 * list_median(list_transform(g, lambda v: abs(v - list_median(g)))) end as period_mad from gaps)"""
)
P = (
    I
    + """, p as (select stream_id, instrument, frame_idx, t as now, cast(k as integer) as hit_index, t + k * period_median as t_pred_sec,
        t + k * period_median - 1.96 * greatest(0.001, period_mad) as ci_low_sec, t + k * period_median + 1.96 * greatest(0.001, period_mad) as ci_high_sec,
        greatest(0.0, least(1.0, 1 - period_mad / period_median)) as confidence from i, unnest([1, 2]) as u(k) where period_median is not null)"""
)
P4 = P.replace("unnest([1, 2])", "unnest([1, 2, 3, 4])")
_EVENT_ID = "instrument || '_' || printf('%.2f', round(t_pred_sec, 2))"
_FIRST = f"row_number() over (partition by stream_id, {_EVENT_ID} order by frame_idx, {_INDEX}, hit_index) = 1"
C = (
    P
    + f""", c as (select stream_id, frame_idx, instrument, t_pred_sec, confidence, cast(instrument = 'kick' as integer) as r, cast(instrument = 'snare' as integer) as g,
        cast(instrument not in ('kick', 'snare') as integer) as b, {_EVENT_ID} as event_id from
        (select * from p where confidence >= 0.3 and round(t_pred_sec - now, 9) between 0.07 and 2.0 qualify {_FIRST}) where instrument = 'kick')"""
)
_BY = "partition by stream_id order by frame_idx"


def accepted(candidates: str, frames: str, apart: int, keys: str = "stream_id") -> str:
    """CTEs that leave ``hit`` of every frame: candidates at least ``apart`` frames after the last accepted one."""
    on = " and ".join(f"n.{k} = a.{k}" for k in keys.split(", "))
    same = " and ".join(f"q.{k} = s.{k}" for k in keys.split(", "))
    return f"""cand as (select {keys}, frame_idx, row_number() over (partition by {keys} order by frame_idx) as c from {candidates} where candidate),
    acc as (select {keys}, frame_idx, c, frame_idx as last, true as ok from cand where c = 1
        union all select {", ".join("n." + k for k in keys.split(", "))}, n.frame_idx, n.c, case when n.frame_idx - a.last >= {apart} then n.frame_idx else a.last end, n.frame_idx - a.last >= {apart} from acc a join cand n on {on} and n.c = a.c + 1),
    gated as (select s.*, cast(coalesce(q.ok, false) as bigint) as hit from {frames} s left join acc q on {same} and q.frame_idx = s.frame_idx)"""


def onset(p) -> str:
    """CTEs up to ``gated`` for the adaptive gate."""
    least = 2 if p.method in ("hfc", "flux") else 1
    factor = p.threshold if p.threshold > 0 else 0.3
    skip = max(0, p.warmup - 1)
    if p.method == "rms":
        odf = f"odf as (select stream_id, frame_idx, x as o from f where frame_idx >= {skip})"
    else:
        odf = f"""start as (select stream_id, frame_idx, x, frame_idx - {skip} as k from f where frame_idx >= {skip}),
        odf as (select stream_id, frame_idx, k, 0.0::double as o from start where k = 0
            union all select n.stream_id, n.frame_idx, n.k, case when least(n.k, {p.smooth_window}) >= {least} then greatest(0.0, n.x - a.o) else 0.0 end from odf a join start n on n.stream_id = a.stream_id and n.k = a.k + 1)"""
    return f"""{F}, {odf},
    smooth as (select stream_id, frame_idx, o, avg(o) over ({_BY} rows {p.smooth_window - 1} preceding) as s from odf),
    limits as (select *, case when count(*) over w >= 8 then median(s) over w + {factor} * greatest(1e-6, mad(s) over w) else {p.threshold} end as thr from smooth
        window w as ({_BY} rows {p.odf_window - 1} preceding)),
    edges as (select *, s > thr and not coalesce(lag(s > thr) over ({_BY}), false) and s >= coalesce(lag(s) over ({_BY}), 0.0) as candidate from limits),
    {accepted("edges", "(select f.stream_id, f.frame_idx, e.o, e.thr from f left join edges e using (stream_id, frame_idx))", p.refractory)}"""


def onset_vector(p) -> str:
    k = "stream_id, band"
    w = f"partition by {k} order by frame_idx"
    return f"""{B}, v as (select stream_id, frame_idx, cast(u.i - 1 as integer) as band, bands[u.i] as x from b, unnest(range(1, 65)) as u(i)),
    odf as (select stream_id, band, frame_idx, 0.0::double as o from v where frame_idx = 0
        union all select n.stream_id, n.band, n.frame_idx, greatest(0.0, n.x - a.o) from odf a join v n on n.stream_id = a.stream_id and n.band = a.band and n.frame_idx = a.frame_idx + 1),
    smooth as (select *, case when frame_idx < {p.warmup - 1} then o else avg(o) over ({w} rows {p.smooth_window - 1} preceding) end as s from odf),
    limits as (select *, case when count(*) over y >= 8 then median(s) over y + {p.threshold} * greatest(1e-6, mad(s) over y) else {p.threshold} end as thr from smooth window y as ({w} rows {p.odf_window - 1} preceding)),
    edges as (select *, frame_idx >= {p.warmup - 1} and s > thr and not coalesce(frame_idx - 1 >= {p.warmup - 1} and lag(s > thr) over ({w}), false) and s >= coalesce(lag(s) over ({w}), 0.0) as candidate from limits),
    {accepted("edges", "v", p.refractory, k)}"""


def multi(mode: str) -> str:
    p = Q.multi_params(mode)
    n, mid = p.window_size, p.window_size // 2
    first, second = f"{_BY} rows between {n - 1} preceding and {n - mid} preceding", f"{_BY} rows between {n - mid - 1} preceding and current row"
    past = f"{_BY} rows between {n - 1} preceding and 1 preceding"
    fired = {"combined": "(pk::int + tr::int + va::int) >= 2", "peak": "pk", "trend": "tr", "variance": "va"}[mode]
    return f"""with recursive {F}, votes as (select *,
        coalesce(case when stddev_samp(x) over ({past}) >= 1e-6 then (x - avg(x) over ({past})) / stddev_samp(x) over ({past}) > {p.peak_threshold} end, false) as pk,
        coalesce(case when avg(x) over ({first}) < 1e-6 then 1.0 else avg(x) over ({second}) / avg(x) over ({first}) end > {p.trend_threshold}, false) as tr,
        coalesce(case when var_samp(x) over ({first}) >= 1e-6 then var_samp(x) over ({second}) / var_samp(x) over ({first}) > {p.variance_threshold} end, false) as va from f),
    marked as (select *, frame_idx + 1 >= {max(p.warmup, n)} and {fired} as candidate from votes),
    {accepted("marked", "f", p.refractory)} select stream_id, frame_idx, hit from gated"""


def _onset_query(name: str) -> str:
    return f"with recursive {onset(Q.ONSETS[name])} select stream_id, frame_idx, round(o, 6) as odf, round(thr, 6) as threshold, hit from gated"


_first_params = Q.OnsetParams("rms", threshold=1.4, refractory=4, warmup=8, smooth_window=2, odf_window=64)
_sums = ", ".join(f"round(list_dot_product(bands, [{', '.join(repr(float(w)) for w in ws)}]), 6) as {n}" for n, ws in masks().items())
_q = Q.QUANTILE
_window = ", ".join(repr(float(w)) for w in blackman_harris(1024))
_device = """d as (select stream_id, frame_idx * 100000 as arrival_us, frame_idx as seq, frame_idx * 100000 + (event_id * 7919) % 90 * 100000 as execute_time_us,
    instrument = 'kick' as red, instrument = 'snare' as green, instrument not in ('kick', 'snare') as blue, cast(event_id as integer) as event_id from f)"""

ORACLE_SQL = {
    "onset_counts": f"with recursive {onset(_first_params)} select stream_id, cast(sum(hit) as bigint) as n_hits, count(*) as n_frames from gated group by 1",
    "vector_index": f"with {B} select vec_id, round(bands[1], 6) as below, round(bands[4], 6) as inside, 0.0::double as beyond from b",
    "sum_range": f"with {B} select vec_id, round(list_sum(bands[2:11]), 6) as inside, round(list_sum(bands[61:64]), 6) as clamped, 0.0::double as empty from b",
    "instrument_sum": f"with {B} select vec_id, {_sums} from b",
    "vector_pack5": f"with {F} select stream_id, frame_idx, {', '.join(f'cast(instrument = {n!r} as double) as {n}' for n in INSTRUMENTS)}, true as any_hit from f",
    "instrument_map": f"with {F} select event_id, instrument, cast({_INDEX} as integer) as idx, instrument as back, cast(instrument = 'kick' as integer) as r, cast(instrument = 'snare' as integer) as g, cast(instrument not in ('kick', 'snare') as integer) as b, cast({_INDEX} as integer) as feature_idx, cast(null as integer) as unknown from f",
    "silence_gate": f"with {B}, c as (select stream_id, frame_idx as chunk_idx, sqrt(list_sum(list_transform(bands, lambda v: v * v)) / 64) as rms from b) select stream_id, chunk_idx, round(rms, 6) as rms from c where rms > 0.125 or chunk_idx < 9",
    "threshold_filter": f"with {F} select stream_id, count(*) as always, count(*) filter (x >= 50) as above, count(*) filter (x <= 50) as below from f group by 1",
    "hit_filter": f"with {F} select stream_id, frame_idx, instrument, 1.0::double as value from f",
    "pool_stats": f"with {F} select stream_id, 'gate.' || instrument as feature, count(x) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var, round(case when count(x) > 1 then var_samp(x) end, 6) as var_samp, round(min(x), 6) as min, round(max(x), 6) as max from f group by 1, 2",
    "frame_arrays": f"with {F} select stream_id, 'gate.' || instrument as feature, string_agg(cast(cast(round(x * 100) as bigint) as varchar), ',' order by frame_idx) as frames from f group by 1, 2",
    "band_covariance": f"with {B}, v as (select stream_id, frame_idx, cast(u.i - 1 as integer) as i, bands[u.i] as x from b, unnest(range(1, 65)) as u(i)) select a.stream_id, a.i, c.i as j, round(covar_pop(a.x, c.x), 6) + 0.0 as cov from v a join v c on a.stream_id = c.stream_id and a.frame_idx = c.frame_idx and a.i <= c.i group by all",
    "running_median_mad": f"with {F} select stream_id, frame_idx, round(median(x) over w, 6) as median, round(mad(x) over w, 6) as mad from f window w as ({_BY} rows 15 preceding)",
    "running_quantiles": f"with {F} select stream_id, frame_idx, round(quantile_cont(x, 0.98) over w, 6) as hi, round(quantile_cont(x, 0.8) over w, 6) as lo from f window w as ({_BY} rows unbounded preceding)",
    **{name: _onset_query(name) for name in Q.ONSETS},
    "onset_gate_vector": f"with recursive {onset_vector(Q.VECTOR)} select stream_id, frame_idx, band, hit from gated",
    **{f"multiframe_{m}": multi(m) for m in ("peak", "trend", "variance", "combined")},
    "quantile_gate": f"""with recursive {F}, early as (select stream_id, list_sort([first(x) filter (frame_idx = 0), first(x) filter (frame_idx = 0), first(x) filter (frame_idx = 1), first(x) filter (frame_idx = 1), first(x) filter (frame_idx = 2)])[3] as hi,
        median(x) filter (frame_idx between 2 and 6) as lo, count(*) as n from f group by 1),
    g as (select f.stream_id, f.frame_idx, f.x, e.hi, e.lo, f.frame_idx + 1 > {_q.warmup} and f.frame_idx >= 6 as live from f join early e using (stream_id)),
    s as (select stream_id, frame_idx, false as armed, 0 as ref, 0 as hit from g where frame_idx = 0
        union all select n.stream_id, n.frame_idx,
            case when not n.live then a.armed else (a.armed or (greatest(0, a.ref - 1) = 0 and n.x > n.hi)) and not n.x < n.lo end,
            case when n.live and (a.armed or (greatest(0, a.ref - 1) = 0 and n.x > n.hi)) and n.x < n.lo then {_q.refractory} else greatest(0, a.ref - 1) end,
            case when n.live and (a.armed or (greatest(0, a.ref - 1) = 0 and n.x > n.hi)) and n.x < n.lo then 1 else 0 end
        from s a join g n on n.stream_id = a.stream_id and n.frame_idx = a.frame_idx + 1)
    select stream_id, frame_idx, cast(hit as bigint) as hit from s""",
    "refractory": f"with recursive {F}, m as (select *, x > 30 as candidate from f), {accepted('m', 'f', 4)} select stream_id, frame_idx, hit from gated",
    "ioi_stats": f"with {I} select stream_id, instrument, frame_idx, gap, n_recent, n_valid, round(period_median, 6) as period_median, round(period_mad, 6) as period_mad from i",
    "beat_kalman": f"""with recursive {H}, k as (select stream_id, frame_idx, t, row_number() over ({_BY}) as n from h where instrument = 'kick'),
    s as (select stream_id, frame_idx, n, t as phase, 0.5::double as period, 0.01::double as a, 0.0::double as b, 0.0::double as c, 0.01::double as d from k where n = 1
        union all select stream_id, frame_idx, n, ph + a1 / (a1 + 0.0025) * (t - ph), least(1.5, greatest(0.2, period + c1 / (a1 + 0.0025) * (t - ph))),
            (1 - a1 / (a1 + 0.0025)) * a1, (1 - a1 / (a1 + 0.0025)) * b1, c1 - c1 / (a1 + 0.0025) * a1, d1 - c1 / (a1 + 0.0025) * b1
        from (select k.stream_id, k.frame_idx, k.n, k.t, s.phase + s.period as ph, s.period, s.a + s.b + s.c + s.d + 1e-4 as a1, s.b + s.d as b1, s.c + s.d as c1, s.d + 5e-5 as d1 from s join k on k.stream_id = s.stream_id and k.n = s.n + 1))
    select stream_id, frame_idx, round(phase, 6) as phase, round(period, 6) as period, round(sqrt(greatest(a + d + 0.0025, 1e-6)), 6) as std from s""",
    "beat_forecast": f"with {H}, l as (select stream_id, min(t) as phase, max(t) as now from h where instrument = 'kick' group by 1) select stream_id, cast(k as integer) as k, round(phase + (greatest(1, ceil((now + 0.01 - phase) / 0.5)) + k) * 0.5, 6) as t from l, unnest([0, 1, 2, 3]) as u(k)",
    "clock_offset": f"""with recursive {H}, c as (select stream_id, frame_idx, t + x / 1000 - t as d from h),
    s as (select stream_id, frame_idx, d as o from c where frame_idx = 0 union all select n.stream_id, n.frame_idx, 0.9 * a.o + 0.1 * n.d from s a join c n on n.stream_id = a.stream_id and n.frame_idx = a.frame_idx + 1)
    select stream_id, frame_idx, round(o, 6) as clock_offset from s""",
    "buffered_messages": f"""with {F}, k as (select stream_id, frame_idx, x, frame_idx + 1 as seen, cast((row_number() over ({_BY}) - 1) // 5 as bigint) as message_no from f where x >= 20)
    select stream_id, message_no, 'gate.kick' as feature_name, max(seen) as frame_count, string_agg(cast(cast(round(x * 100) as bigint) as varchar), ',' order by frame_idx) as "values" from k group by 1, 2 having count(*) = 5""",
    "hit_ratio": f"""with {B}, v as (select vec_id, bands, list_transform(bands, lambda z: abs(z) * 4) as w from b) select vec_id, cast(len(list_filter(w, lambda z: z > 0.5)) as integer) as hits, cast(len(w) as integer) as n, round(len(list_filter(w, lambda z: z > 0.5)) * 100.0 / len(w), 6)::double as percentage,
        cast(len(list_filter(w, lambda z: z >= 0.5)) as integer) as loose_hits, array_to_string(list_transform(bands[1:5], lambda z: cast(cast(floor(z * 1000) as bigint) as varchar)), ',') as first_five from v""",
    "trailing_rate": f"""with {F}, z as (select stream_id, instrument, frame_idx * 100000 as t_us from f) select stream_id, instrument, t_us, count(*) over (partition by stream_id, instrument order by t_us range unbounded preceding) as total,
        count(*) over (partition by stream_id, instrument order by t_us range 1999999 preceding) as recent, round(count(*) over (partition by stream_id, instrument order by t_us range 1999999 preceding) / 2, 6)::double as rate from z""",
    "prediction_counts": f"with {P} select stream_id, instrument, count(*) as n_hits, count(distinct frame_idx) as n_messages from p group by 1, 2",
    "predictions_flat": f"with {P} select stream_id, instrument, frame_idx, hit_index, round(now, 6) as now, round(t_pred_sec, 6) as t_pred_sec, round(ci_low_sec, 6) as ci_low_sec, round(ci_high_sec, 6) as ci_high_sec, round(confidence, 6) as confidence from p",
    "confidence_filter": f"with {P} select stream_id, instrument, count(*) as n from p where confidence >= 0.5 group by 1, 2",
    "latency_filter": f"with {P} select stream_id, instrument, count(*) as n from p where round(t_pred_sec - now, 9) between 0.5 and 1.5 group by 1, 2",
    "event_dedup": f"with {P} select stream_id, {_EVENT_ID} as event_id, frame_idx, hit_index from p qualify {_FIRST}",
    "lighting_commands": f"with {C} select stream_id, frame_idx, instrument, round(t_pred_sec, 6) as t_pred_sec, round(confidence, 6) as confidence, r, g, b, event_id from c",
    "unix_events": f"with {C}, u as (select *, 900000 + cast(round(t_pred_sec * 1000000) as bigint) as us from c) select stream_id, event_id, 100 + us // 1000000 as unix_time, us % 1000000 as microseconds, r, g, b from u",
    "nearest_discard": f"""with recursive {P}, q as (select stream_id, instrument, hit_index, frame_idx, round(t_pred_sec, 6) as t, row_number() over (partition by stream_id, instrument, hit_index order by frame_idx) as n from p),
    s as (select stream_id, instrument, hit_index, frame_idx, t, n, [t] as kept, true as keep from q where n = 1
        union all select q.stream_id, q.instrument, q.hit_index, q.frame_idx, q.t, q.n, case when len(list_filter(s.kept, lambda k: abs(k - q.t) <= 0.003)) = 0 then list_append(s.kept, q.t) else s.kept end, len(list_filter(s.kept, lambda k: abs(k - q.t) <= 0.003)) = 0
        from s join q on q.stream_id = s.stream_id and q.instrument = s.instrument and q.hit_index = s.hit_index and q.n = s.n + 1)
    select stream_id, instrument, hit_index, frame_idx, t as t_pred_sec from s where keep""",
    "hit_log": f"with {H} select stream_id, frame_idx as frame, t as audio_time, 'hit' as type, instrument, 1.0::double as value from h",
    "prediction_log": f"with {P} select stream_id, frame_idx as frame, round(now, 6) as audio_time, 'prediction' as type, instrument, round(t_pred_sec, 6) as predicted_time, round(confidence, 6) as confidence, round(ci_low_sec, 6) as ci_low, round(ci_high_sec, 6) as ci_high, hit_index from p",
    "log_union": f"with {P} select stream_id, 'hit' as type, instrument, count(*) as n, count(*) as n_value, 0::bigint as n_predicted from h group by all union all select stream_id, 'prediction', instrument, count(*), 0, count(*) from p group by all",
    "prediction_accuracy": f"""with {P}, w as (select p.*, (select min(t) from h where h.stream_id = p.stream_id and h.instrument = p.instrument and h.t >= p.t_pred_sec) as next_hit,
        (select max(t) from h where h.stream_id = p.stream_id and h.instrument = p.instrument and h.t < p.t_pred_sec) as last_hit,
        exists (select 1 from h where h.stream_id = p.stream_id and h.instrument = p.instrument and h.t between p.ci_low_sec and p.ci_high_sec) as in_interval from p)
    select stream_id, instrument, frame_idx, hit_index, round(next_hit, 6) as next_hit, round(last_hit, 6) as last_hit, in_interval, round(least(abs(next_hit - t_pred_sec), abs(t_pred_sec - last_hit)), 6) as abs_error from w""",
    "due_order": f"with {F}, {_device} select stream_id, event_id, execute_time_us, cast(row_number() over (partition by stream_id order by execute_time_us, seq) as integer) as position from d",
    "led_timeline": f"""with {F}, {_device}, u as (select stream_id, execute_time_us as due, seq, 0 as off, red, green, blue from d union all select stream_id, execute_time_us + 150000, seq, 1, false, false, false from d)
    select stream_id, due as from_us, lead(due) over (partition by stream_id order by due, off, seq) as to_us, red, green, blue from u""",
    "device_queue": f"with recursive {F}, {_device}, {state_sql.device_queue(Q.QueueParams())} select stream_id, at_us, cast(event_id as integer) as event_id, kind, red, green, blue from done",
    "instrument_predictor": f"with recursive {F}, {state_sql.predictor(Q.PREDICTOR)} select stream_id, frame_idx, inst as instrument, cast(k as integer) as hit_index, round(now, 6) as now, round(t_pred, 6) as t_pred_sec, round(t_pred - 1.96 * sigma, 6) as ci_low_sec, round(t_pred + 1.96 * sigma, 6) as ci_high_sec, round(belief, 6) as confidence from forecast",
    "predictor_states": f"with recursive {F}, {state_sql.predictor(Q.PREDICTOR)} select stream_id, frame_idx, inst as instrument, round(case when period > 1e-6 then 60.0::double / period else 0.0::double end, 6) as tempo_bpm, round(period, 6) as period_sec, round(phase, 6) as phase, warm as warmup_complete, cast((select count(*) from forecast c where c.stream_id = t.stream_id and c.frame_idx = t.frame_idx and c.inst = t.inst) as integer) as n_hits from told t",
    "scheduled_release": f"""with {P}, q as (select stream_id, instrument, frame_idx, hit_index, round(t_pred_sec, 6) as t_pred_sec, now from p) select stream_id, instrument, frame_idx, hit_index, t_pred_sec, round(t_pred_sec - now, 6) as wait,
        cast(row_number() over (partition by stream_id order by t_pred_sec, instrument, frame_idx, hit_index) as integer) as release_no from q where t_pred_sec > now""",
    "visual_intervals": f"with {H} select stream_id, frame_idx, instrument, t as shown_at, round(t + 0.12, 6) as gone_at from h",
    "trajectory": f"""with {F}, m as (select stream_id as move_id, min(x) as x0, max(x) as x1, count(*) * 0.1::double as t1 from f group by 1), s as (select *, u.s as step, u.s / 59 as z from m, unnest(range(1, 60)) as u(s))
    select move_id, cast(step as integer) as step, round(x0 + (x1 - x0) * (10 * z**3 - 15 * z**4 + 6 * z**5), 6) as position, round(t1 * z, 6) as time from s""",
    "json_defaults": f"with {F} select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as integer), -1) as k, 7 as missing from f",
    "batch_envelope": f"with {F} select stream_id, case when stream_id % 2 = 1 then frame_idx else frame_idx - frame_idx % 10 end as message, frame_idx as unix_time, 0::bigint as microseconds, cast(event_id % 3 as integer) as r, 0 as g, 0 as b, cast(event_id % 256 as integer) as event_id from f",
    "message_routing": f"""with {F} select stream_id, count(*) as n, cast(sum(frame_idx) as bigint) as frames, count(*) as named, 'gates' as channel from f where event_type not in ('error', 'view') group by 1
    union all select stream_id, count(*), cast(sum(frame_idx) as bigint), 0, 'predictions' from f where event_type = 'view' group by 1""",
    "run_summary": f"with {F}, s as (select stream_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as sec, count(*) as frames from f group by 1) select stream_id, round(sec, 6) as seconds, frames, round(case when sec > 0 then frames / sec else 0 end, 9)::double as fps from s",
    "beat_dedup": f"with {P} select stream_id, round_even(round(t_pred_sec, 6), 2) as beat_time, hit_index as event_type, min(frame_idx) as frame_idx from p group by 1, 2, 3",
    "beat_log": f"""with {P}, q as (select stream_id, instrument, frame_idx, round(now, 6) as t, round(t_pred_sec, 6) as p from p where hit_index = 1)
    select stream_id, instrument, frame_idx, printf('%.3f', t) || ' +' || printf('%.3f', round(p - t, 3)) || 's ±12ms' as line, printf('%.6f', t) || ',' || printf('%.6f', p) || ',0.012500' as csv from q""",
    "scalar_functions": f"""with {F}, z as (select *, x / 1000 as s from f) select event_id, round(2595 * log10(1 + x / 700), 6) as mel, round(700 * (pow(10, x / 2595) - 1), 6) as hz, greatest(10.0::double, least(x, 90.0::double)) as clamped,
        round(x / 7 - floor(x / 7), 6) as unit, round(x / 7 + 0.5 - floor(x / 7 + 0.5) - 0.5, 6) as half,
        round(case when x < 20 or x > 80 then 0 when x < 29 then 0.7 * 0.5 * (1 - cos(pi() * (x - 20) / 9)) when x > 71 then 0.7 * 0.5 * (1 - cos(pi() * (80 - x) / 9)) else 0.7 end, 6)::double as lobe,
        round(frame_idx * 256.0::double / 44100.0::double, 6) as audio_time, round(2 * (30 * s**2 - 60 * s**3 + 30 * s**4), 6) as velocity, round(2 * (60 * s - 180 * s**2 + 120 * s**3), 6) as acceleration, round(2 * (60 - 360 * s + 360 * s**2), 6) as jerk,
        1000000 + (frame_idx - 5) * 1000000 + (frame_idx * 10 - 250) as tick, cast({_INDEX} * 200 as integer) as lane, 'beats_' || strftime(ts, '%Y%m%d_%H%M%S') || '.log' as log_file,
        frame_idx * 7 as ntp_offset, cast(frame_idx % 2 as integer) as flag, frame_idx * 1001 as ms from z""",
    "time_windows": f"""with {F}, w as (select cast(epoch(date_trunc('hour', ts)) as bigint) - 3600 * k as start, instrument, x from f, unnest([0, 1]) as u(k))
    select start, instrument, count(*) as hits, cast(sum(cast(round(x * 100) as bigint)) as bigint) as energy_cents from w group by 1, 2""",
    "sine_frames": f"""with s as (select list(sin(i * (2 * 3.141592653589793 * 440.0::double / 44100.0::double)) order by i) as v from range(4096) as r(i)), w as (select [{_window}] as w),
    fr as (select cast(k as bigint) as frame_idx, v[k * 256 + 1 : k * 256 + 1024] as a from s, range(13) as r(k))
    select frame_idx, round(list_sum(list_transform(a, lambda z: z * z)), 6) as energy, round(list_sum(list_transform(range(1, 1025), lambda i: pow(a[i] * w.w[i], 2))) * 1e6, 4) as windowed_energy from fr, w""",
    "beat_log_formats": f"""with {P4}, q as (select stream_id, instrument, frame_idx, round(any_value(now), 6) as t, list(round(t_pred_sec, 6) order by t_pred_sec) as p from p group by 1, 2, 3),
        d as (select *, list_transform(p, lambda x: round(x - t, 6)) as a from q)
    select stream_id, instrument, frame_idx, 'BEAT EVENT | Time: ' || printf('%.3f', t) || 's | Next4: ' || array_to_string(list_transform(a, lambda x: printf('%+.3fs', x)), ', ') || ' (±12ms)' as detailed,
        'BEAT at ' || printf('%.3f', t) || 's' as simple, printf('%.3f', t) || ',12.5,' || array_to_string(list_transform(a, lambda x: printf('%.3f', x)), ',') as csv from d""",
    "beat_intervals": f"""with {H}, k as (select stream_id, frame_idx, row_number() over ({_BY}) as beat_no, round(t - lag(t) over ({_BY}), 9) as ibi from h where instrument = 'kick'),
        v as (select *, coalesce(ibi between 0.2 and 1.5, false) as ibi_valid from k)
    select stream_id, frame_idx, beat_no, ibi, ibi_valid, coalesce(array_to_string(list_transform((list(ibi) filter (ibi_valid) over ({_BY}))[-8:], lambda x: cast(cast(round(x * 10) as bigint) as varchar)), ','), '') as recent_ibis from v""",
    "delayed_shows": f"""with {P}, q as (select stream_id || '/' || instrument || '/' || frame_idx as beat, cast(row_number() over (partition by stream_id, instrument, frame_idx order by t_pred_sec) - 1 as integer) as index, now + 0.5 as moment, round(t_pred_sec, 6) as show_at from p)
    select beat, index, show_at, round(show_at - moment, 6) as delay from q where show_at - moment > 0""",
    "bounded_queues": f"""with {F}, e as (select stream_id, frame_idx // 10 as trigger, frame_idx, event_id, row_number() over (partition by stream_id, frame_idx // 10 order by frame_idx) as a, row_number() over (partition by stream_id, frame_idx // 10 order by frame_idx desc) as z from f)
    select stream_id, trigger, frame_idx, event_id, policy from e, (values ('drop_newest'), ('drop_oldest'), ('keep_latest')) as p(policy) where case policy when 'drop_newest' then a <= 3 when 'drop_oldest' then z <= 3 else z = 1 end""",
    "event_patterns": """with b as (select 3000 + i as event_id, 1700000012250000 + i * 500000 as us, (i % 2 = 0)::integer as r, (i % 2 = 1)::integer as g, 0 as b from range(8) as x(i)
        union all select 4000 + i, 1700000020000000 + i * 500000, (i in (0, 3, 4, 6))::integer, (i in (1, 3, 5, 6))::integer, (i in (2, 4, 5, 6))::integer from range(7) as x(i)),
        n as (select n_nationkey::bigint as run, b.*, us + n_nationkey::bigint * 300000 as t from nation, b)
    select run, cast(event_id as integer) as event_id, t // 1000000 as unix_time, t % 1000000 as microseconds, r, g, b from n""",
    "prediction_payloads": f"with recursive {F}, {state_sql.predictor(Q.PREDICTOR)} select frame_idx, round(now, 6) as now, inst as instrument, round(period, 6) as period_sec, round(phase, 6) as phase, warm as warmup_complete, cast((select count(*) from forecast c where c.stream_id = t.stream_id and c.frame_idx = t.frame_idx and c.inst = t.inst) as integer) as n_hits from told t",
    "canvas_places": f"""with {P} select stream_id, instrument, frame_idx, hit_index, cast(420 + (hit_index - 1) * 120 as integer) as horizontal_x, cast(({_INDEX} + 1) * 116 as integer) as horizontal_y,
        cast(({_INDEX} + 1) * 200 as integer) as vertical_x, cast(244 + (hit_index - 1) * 70 as integer) as vertical_y, true as feature_kept from p""",
    "spectral_peak": f"""with s as (select list(sin(i * (2 * 3.141592653589793 * 440.0::double / 44100.0::double)) order by i) as v from range(4096) as r(i)), w as (select [{_window}] as w),
    fr as (select cast(k as bigint) as frame_idx, list_transform(range(1, 1025), lambda i: v[k * 256 + i] * w[i]) as a from s, w, range(13) as r(k)),
    turns as (select list(cos(2 * pi() * i / 1024) order by i) as c, list(sin(2 * pi() * i / 1024) order by i) as z from range(1024) as r(i)),
    sp as (select frame_idx, k, pow(list_sum(list_transform(range(1, 1025), lambda i: a[i] * c[k * (i - 1) % 1024 + 1])), 2) + pow(list_sum(list_transform(range(1, 1025), lambda i: a[i] * z[k * (i - 1) % 1024 + 1])), 2) as power from fr, turns, range(513) as r(k)),
    e as (select i, 700 * (pow(10, i * (2595 * log10(1 + 22050.0::double / 700)) / 65 / 2595) - 1) as hz from range(66) as r(i)),
    m as (select frame_idx, l.i as band, sum(greatest(0.0, least((k * 22050.0::double / 512 - l.hz) / (c.hz - l.hz), (h.hz - k * 22050.0::double / 512) / (h.hz - c.hz))) * 2 / (h.hz - l.hz) * power) as energy
        from sp, e l join e c on c.i = l.i + 1 join e h on h.i = l.i + 2 group by 1, 2),
    peak as (select frame_idx, arg_max(k, power) as peak_bin from sp group by 1),
    cep as (select frame_idx, arg_max(band, energy) as peak_band, max(energy) as top_band, sum(10 * log10(greatest(1e-10, energy))) / 8 as c0, sum(10 * log10(greatest(1e-10, energy)) * cos(pi() * (2 * band + 1) / 128)) * sqrt(2 / 64) as c1 from m group by 1)
    select frame_idx, peak_bin, peak_band, 13 as n_mfcc, round(top_band, 9) as top_band, round(c0, 4) as c0, round(c1, 4) as c1 from peak join cep using (frame_idx)""",
    "test_patterns": "select r_regionkey::bigint as event_id, cast(1700000000 + r_regionkey // 2 as bigint) as unix_time, cast(r_regionkey % 2 * 500000 as bigint) as microseconds, (r_regionkey % 3 = 0)::integer as r, (r_regionkey % 3 = 1)::integer as g, (r_regionkey % 3 = 2)::integer as b from region",
}

from . import front_sql  # noqa: E402  (its SQL uses what stands above)

ORACLE_SQL |= front_sql.ORACLE_SQL
